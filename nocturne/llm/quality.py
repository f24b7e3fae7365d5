"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at one measure of a text and votes good (1) or bad (-1) or abstains (0).
Votes are counted by pattern over all documents (at most 3 ** rules patterns, so the
counts fit any driver); expectation-maximisation on the counts estimates the share of
good documents and, per rule and class, how likely each vote is. The posterior
probability of a pattern decides, instead of demanding that every rule passes.

Defined cases: null or empty text: no words, all measures 0. Repeated rows: judged each.
No documents: no patterns, no rows. Texts are read whole, in blocks. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.arrays import SPACE, _table, mix, slices, text_buffer, word_hashes

#: Characters counted as symbols, and what else the rules look at.
SYMBOLS = _table(b"#*$%&|<>")
MARKS = _table(b"!")
UPPER = _table(bytes(range(65, 91)))
LOWER_LETTERS = _table(bytes(range(97, 123)))
DIGITS = _table(b"0123456789")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_lower", "n_digits")

_BLANK = " \t\n\x0b\x0c\r"


def _duplicate_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen, lines, again = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.strip(_BLANK):
            lines += 1
            again += line in seen
            seen.add(line)
    return lines, again


def _repeats(words: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, words inside three-word windows that it holds twice or more."""
    if len(words) < 3:
        return np.zeros(n_docs, np.int64)
    window = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
    place = np.flatnonzero(owner[:-2] == owner[2:])
    window, holder = window[place], owner[place]
    order = np.lexsort((window, holder))
    window, holder = window[order], holder[order]
    same = (window[1:] == window[:-1]) & (holder[1:] == holder[:-1])
    twice = np.zeros(len(window), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(words), bool)
    at = place[order[twice]]
    for k in range(3):
        hit[at + k] = True
    return np.bincount(owner[hit], minlength=n_docs)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole-text counts ``MEASURES`` of ``docs(doc_id, text)``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                n = batch.num_rows
                data, offsets = text_buffer(batch.column(1))
                words, owner = word_hashes(data, offsets, lower=False)
                low, high = int(offsets[0]), int(offsets[-1])
                part = data[low:high]

                def per_doc(flags: np.ndarray, offsets: np.ndarray = offsets, low: int = low) -> np.ndarray:
                    summed = np.r_[0, np.cumsum(flags, dtype=np.int64)]
                    return summed[offsets[1:] - low] - summed[offsets[:-1] - low]

                lines = [_duplicate_lines(x) for x in batch.column(1).to_pylist()]
                counted = [
                    np.bincount(owner, minlength=n),
                    per_doc(~SPACE[part] & ((part & 0xC0) != 0x80)),
                    per_doc(SYMBOLS[part]),
                    np.array([x[1] for x in lines], np.int64),
                    _repeats(words, owner, n),
                    np.array([x[0] for x in lines], np.int64),
                    per_doc(MARKS[part]),
                    per_doc(UPPER[part]),
                    per_doc(LOWER_LETTERS[part]),
                    per_doc(DIGITS[part]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x.astype(np.int64)) for x in counted)], names=["doc_id", *MEASURES]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def rules() -> dict[str, Column]:
    """Name to vote. A rule speaks for one side only and abstains otherwise or without a basis.

    Two rules can say good: natural characters, natural layout. The others say bad.
    """
    length, mean = F.col("n_words"), _share("word_chars", "n_words")
    symbols, marks = _share("n_symbols", "n_words"), _share("n_marks", "n_words")
    lines, repeats = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    upper = F.col("n_upper") / F.nullif(F.col("n_upper") + F.col("n_lower"), F.lit(0))
    per_line = _share("n_words", "n_lines")
    good = {
        "characters": (symbols <= 0.02) & (marks <= 0.05) & F.coalesce(upper <= 0.2, F.lit(True)) & mean.between(2.5, 12),
        "layout": (lines <= 0.1) & (repeats <= 0.1) & (per_line >= 4),
    }
    bad = {
        "length": length < 30,
        "word_size": (mean < 2) | (mean > 15),
        "symbols": symbols > 0.1,
        "marks": marks > 0.3,
        "lines": lines > 0.3,
        "repeats": repeats > 0.35,
        "capitals": upper > 0.5,
        "line_size": per_line < 3,
    }
    speaks = {name: F.when(held, 1).otherwise(0) for name, held in good.items()}
    return speaks | {name: F.when(held, -1).otherwise(0) for name, held in bad.items()}


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, prior: float = 1.0) -> np.ndarray:
    """Posterior probability of good for each vote pattern, by expectation-maximisation.

    ``patterns`` is (patterns x rules) of -1, 0, 1. The start
    takes a pattern as good if no rule says bad; two classes, independent rules given the class.
    """
    if not len(patterns):
        return np.zeros(0)
    q = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    votes = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        logits = []
        for share in (1 - q, q):
            mass = weights * share
            table = np.einsum("p,prv->rv", mass, votes) + prior
            table /= table.sum(axis=1, keepdims=True)
            logits.append(np.log((mass.sum() + prior) / (weights.sum() + 2 * prior)) + np.einsum("prv,rv->p", votes, np.log(table)))
        fresh = 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -500, 500)))
        if np.abs(fresh - q).max() < 1e-9:
            break
        q = fresh
    return q


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``measured`` with ``posterior``, ``base_failed`` and ``kept``.

    ``measured`` is read twice (count patterns, apply); store it first.
    """
    voted = measured.withColumn("pattern", F.concat_ws(",", *(v.cast("string") for v in rules().values())))
    held = voted.groupBy("pattern").count().toPandas().sort_values("pattern")
    patterns = np.array([[int(x) for x in p.split(",")] for p in held["pattern"]]).reshape(len(held), len(rules()))
    posterior = estimate(patterns, held["count"].to_numpy(float))
    spark = measured.sparkSession
    known = spark.createDataFrame(
        [(p, float(x)) for p, x in zip(held["pattern"], posterior, strict=True)], "pattern string, posterior double"
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(known), "pattern", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .drop("pattern")
    )
