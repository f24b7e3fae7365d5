"""Toxicity: a learned weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, replaces homoglyphs by Latin letters and, inside words that also have
a letter, digits and signs by the letters they stand for. What may be an i or an l (both letters, 1, ! and |) is
one class, in the lexicon as in the text, so either reading meets its word. The lexicon's entries are folded
words and word beginnings (``^``: matched at a word's start only) whose document frequency
among toxic training documents is far above that among the others; the weight is the log
odds. A word's weight is that of its heaviest entry. Exception phrases, pairs of words
that hold an entry but are at home in documents that are not toxic, cancel the match.

The score is a logistic function of the summed weight, that weight normalised by length,
and whether anything matched, fitted on the training documents and corrected to the share
of toxic ones among all of them.

Defined cases: null, empty or wordless text scores as text without a match. No training
labels of one kind: an empty lexicon, every score is the toxic share (0 without labels).
Repeated rows: scored each; labels of one id that differ count as they come. Texts are read
whole. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.arrays import slices
from nocturne.llm.tables import stored

#: Documents of each label from which lexicon, exceptions and curve are learned: a bound on the
#: fitting sample, drawn by hash of the id.
SAMPLE = 4000
#: An entry needs as many toxic sample documents, log odds as high, and a likelihood ratio as high.
LEAST_DOCS = 5
LEAST_LOG_ODDS = 2.0
LEAST_RATIO = 18.0
BEGINNINGS = (4, 5, 6, 7)

#: Letters of other scripts that look like Latin ones, and signs read as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ν": "v", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ѡ": "w", "ⅼ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_LETTERS = str.maketrans(HOMOGLYPHS)
_SIGNS = str.maketrans(SIGNS)
_ONE_CLASS = str.maketrans({"l": "i"})
_SIGNED = re.compile(r"[^\W_]*[^\W\d_][013456789@$!|]+(?=[^\W\d_])[\w@$!|]*|[013456789@$]+[^\W\d_][\w@$!|]*[^\W_]")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def fold(text: str) -> str:
    """Lower case, full-width and look-alike letters as Latin, digits within words as letters, l as i."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_LETTERS)
    else:
        text = text.lower()
    return _SIGNED.sub(lambda m: m.group().translate(_SIGNS), text).translate(_ONE_CLASS)


@dataclass(frozen=True)
class Lexicon:
    """Entries and exception phrases with the curve: all plain values, found in the bounded sample."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float, float, float]


def _matcher(weights: dict[str, float]) -> ahocorasick.Automaton | None:
    """All entries in one automaton; a beginning ``^abc`` is the pattern `` abc`` after a blank."""
    if not weights:
        return None
    automaton = ahocorasick.Automaton()
    for entry, weight in weights.items():
        pattern = f" {entry[1:]}" if entry.startswith("^") else f" {entry} "
        automaton.add_word(pattern, (len(pattern), weight, entry))
    automaton.make_automaton()
    return automaton


def _matches(automaton, folded: str) -> tuple[int, list[tuple[str, str, str, float]]]:
    """Number of words, and ``previous, word, next, weight`` of each matched one."""
    words = _WORD.findall(folded)
    if automaton is None or not words:
        return len(words), []
    line = f" {' '.join(words)} "
    heaviest: dict[int, float] = {}
    for end, (length, weight, _) in automaton.iter(line):
        start = end - length + 1
        heaviest[start] = max(heaviest.get(start, 0.0), weight)
    found = []
    for start, weight in sorted(heaviest.items()):
        stop = line.index(" ", start + 1)
        before = line.rfind(" ", 0, start)
        after = line.find(" ", stop + 1)
        found.append((line[before + 1 : start] if before >= 0 else "", line[start + 1 : stop], line[stop + 1 : after] if after > 0 else "", weight))
    return len(words), found


def _weigh(automaton, exceptions: frozenset[str], text: str | None) -> tuple[float, int, int]:
    """Summed weight, matched words, words."""
    n, found = _matches(automaton, fold(text or ""))
    held = [w for before, word, after, w in found if f"{before} {word}" not in exceptions and f"{word} {after}" not in exceptions]
    return sum(held), len(held), n


def _inputs(weight: float, hits: int, n: int) -> tuple[float, float, float]:
    return math.log1p(weight), math.log1p(100 * weight / max(n, 1)), float(hits > 0)


def _counted(sample: DataFrame, terms) -> DataFrame:
    """``term, toxic, plain``: documents of either label that hold a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in terms(text):
                    held.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            if len(held) > 200_000:
                yield flat(held)
                held = {}
        yield flat(held)

    def flat(held: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())],
            names=["term", "toxic", "plain"],
        )

    counts = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, plain long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _words_and_beginnings(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {w for w in words if len(w) > 2} | {f"^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``: at most ``sample`` ids of each label.

    The ids are drawn from the labels alone, by hash, so only the drawn texts are read.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("boolean").alias("toxic")).dropna()
    shares = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_all = sum(shares.values())
    share = shares.get(True, 0) / n_all if n_all else 0.0
    plain = math.log((share + 1e-9) / (1 - share + 1e-9))
    drawn = [
        rows.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for toxic in (True, False)
    ]
    # at most twice ``sample`` ids
    chosen = F.broadcast(stored(drawn[0].unionByName(drawn[1]), "toxic-ids"))
    taken = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").select("text", "toxic").distinct()
    taken = stored(taken, "toxic-sample")
    size = {bool(r["toxic"]): r["count"] for r in taken.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Lexicon({}, frozenset(), (plain, 0.0, 0.0, 0.0))
    n_toxic, n_plain = size[True], size[False]

    a, b = F.col("toxic") + 0.5, F.col("plain") + 0.5
    odds = F.log(a / (n_toxic + 1 - a)) - F.log(b / (n_plain + 1 - b))
    held, share = F.col("toxic") + F.col("plain"), n_toxic / (n_toxic + n_plain)

    def part(seen: str, of: float):
        return F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (held * of))).otherwise(0.0)

    strong = (
        _counted(taken, _words_and_beginnings)
        .filter(F.col("toxic") >= LEAST_DOCS)
        .withColumn("odds", odds)
        .withColumn("ratio", 2 * (part("toxic", share) + part("plain", 1 - share)))
        .filter((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("ratio") >= LEAST_RATIO))
    )
    weights = {r["term"]: r["odds"] for r in strong.collect()}

    built: list = []

    def phrases(text: str) -> set[str]:
        if not built:  # once in each Python worker
            built.append(_matcher(weights))
        _, found = _matches(built[0], fold(text))
        return {f"{x} {w}" for x, w, _, _ in found if x} | {f"{w} {y}" for _, w, y, _ in found if y}

    at_home = _counted(taken, phrases).filter((F.col("plain") >= 5) & (F.col("plain") * n_toxic >= 4 * F.col("toxic") * n_plain))
    exceptions = frozenset(r["term"] for r in at_home.collect())

    measured = _weighed(taken.select("toxic", "text"), weights, exceptions, "toxic boolean").groupBy(
        "toxic", F.round("log_weight", 1).alias("x"), F.round("log_rate", 1).alias("y"), "any"
    ).count()
    grid = [(r["toxic"], r["x"], r["y"], r["any"], r["count"]) for r in measured.collect()]
    curve = _fit(grid, {True: shares[True] / n_toxic, False: shares[False] / n_plain})
    return Lexicon(weights, exceptions, curve)


def _weighed(rows: DataFrame, weights: dict[str, float], exceptions: frozenset[str], first: str) -> DataFrame:
    """The first column of ``rows`` and ``log_weight, log_rate, any`` of its last, ``text``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _matcher(weights)
        for whole in batches:
            for batch in slices(whole, 1):
                held = [_inputs(*_weigh(automaton, exceptions, x)) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([h[k] for h in held], pa.float64()) for k in range(3))],
                    names=[first.split()[0], "log_weight", "log_rate", "any"],
                )

    return rows.mapInArrow(weigh, f"{first}, log_weight double, log_rate double, any double")


def _fit(grid: list[tuple], share: dict[bool, float], ridge: float = 0.05) -> tuple[float, float, float, float]:
    """Weighted logistic regression on counted cells, by Newton steps."""
    x = np.array([[1.0, a, b, c] for _, a, b, c, _ in grid])
    y = np.array([float(t) for t, *_ in grid])
    w = np.array([n * share[t] for t, *_, n in grid])
    beta, penalty = np.zeros(4), np.diag([0.0, ridge, ridge, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - penalty @ beta
        curved = (x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(4)
        step = np.linalg.solve(curved, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = _weighed(docs.select("doc_id", "text"), lexicon.weights, lexicon.exceptions, f"doc_id {kind}")
    a, b, c, d = lexicon.curve
    logit = F.lit(a) + b * F.col("log_weight") + c * F.col("log_rate") + d * F.col("any")
    held = measured.withColumn("score", 1 / (1 + F.exp(-logit)))
    return held.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
