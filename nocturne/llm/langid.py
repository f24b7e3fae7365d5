"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character pairs and triples of the lower-cased text, padded with two blanks at its end,
are hashed into a fixed number of buckets. Training counts buckets per language in each
task and adds the counts by Spark; the log-probability matrix (languages x buckets) is broadcast. Its size is
bound by ``MATRIX_BYTES``: with more languages there are fewer buckets, never fewer languages. A batch is scored at
once, as a sparse matrix of documents and buckets: the n-grams of all its texts are one array, the matrix
rows they ask for are gathered and summed by document.

Defined cases: null text or text without a letter: ``und``, score 0. Nothing to learn from:
``und`` for all. Null languages are not learned. Repeated rows: scored each. Texts of any
length are read whole, in blocks. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.llm.arrays import slices

BUCKETS = 1 << 15
#: Bound of the broadcast matrix: 512 languages at ``BUCKETS`` buckets, more at fewer.
MATRIX_BYTES = 64 << 20
LEAST_BUCKETS = 1 << 8
#: Languages whose counts a task holds before it sends them on.
HELD_LANGS = 64
#: Matrix entries gathered at a time.
GATHERED = 4_000_000
#: n-grams' worth of evidence in a score, so that long texts do not all score 1.
EVIDENCE = 30
UNDETERMINED = "und"

_BLOCK_CHARS = 1 << 19


def _grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all pairs and triples that start in ``text``, block by block."""
    for low in range(0, len(text), _BLOCK_CHARS):
        part = text[low : low + _BLOCK_CHARS + 2]
        n = min(_BLOCK_CHARS, len(text) - low)
        part += "  "[: n + 2 - len(part)]
        yield _hashed(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), n)


def batch_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the pairs and triples of all ``texts``, text after text, and where each text's begin."""
    lengths = np.array([len(t) for t in texts])
    chars = np.frombuffer(("  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.ones(len(chars), bool)
    blank = np.cumsum(lengths + 2) - 2
    inside[blank] = inside[blank + 1] = False
    n = len(chars) - 2
    both = _hashed(chars, n).reshape(2, n).T[inside[:n]]
    return both.reshape(-1), 2 * np.r_[0, np.cumsum(lengths)[:-1]]


def summed(log_prob: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts x languages: the log-probabilities of each text's n-grams added up. No text may be empty."""
    table = np.ascontiguousarray(log_prob.T)
    out = np.zeros((len(starts), log_prob.shape[0]))
    ends = np.r_[starts[1:], len(grams)]
    first = 0
    while first < len(starts):
        last = first + 1
        while last < len(starts) and (ends[last] - starts[first]) * table.shape[1] <= GATHERED:
            last += 1
        for low in range(starts[first], ends[last - 1], max(1, GATHERED // table.shape[1])):
            # one text longer than that is taken in parts
            high = min(low + max(1, GATHERED // table.shape[1]), ends[last - 1]) if last - first == 1 else ends[last - 1]
            part = table[grams[low:high]].astype(np.float64)
            out[first:last] += np.add.reduceat(part, starts[first:last] - starts[first] if last - first > 1 else [0], axis=0)
            if last - first > 1:
                break
        first = last
    return out


def _hashed(chars: np.ndarray, n: int) -> np.ndarray:
    pair = chars[:n] * np.uint32(0x9E3779B1) + chars[1 : n + 1] * np.uint32(0x85EBCA77)
    triple = (pair ^ np.uint32(0x27D4EB2F)) + chars[2 : n + 2] * np.uint32(0xC2B2AE3D)
    both = np.concatenate([pair, triple])
    both ^= both >> np.uint32(15)
    both *= np.uint32(0x2C1B3C6D)
    return both >> np.uint32(32 - BUCKETS.bit_length() + 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets, a power of two


def train(docs: DataFrame, smoothing: float = 0.5, matrix_bytes: int = MATRIX_BYTES) -> LanguageModel:
    """Fit on all rows of ``docs(text, lang)`` that have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py().lower(), lang.as_py()
                if lang not in held:
                    if len(held) == HELD_LANGS:
                        yield from sent(held)
                        held = {}
                    held[lang] = np.zeros(BUCKETS + 1, np.int64)
                held[lang][BUCKETS] += 1
                for grams in _grams(text):
                    held[lang][:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
        yield from sent(held)

    def sent(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full)), pa.array(full.astype(np.int32)), pa.array(counts[full])],
                names=["lang", "bucket", "held"],
            )

    labelled = docs.select("text", "lang").dropna()
    found = labelled.select("lang").distinct().count()
    buckets = BUCKETS
    while found * buckets * 4 > matrix_bytes and buckets > LEAST_BUCKETS:
        buckets //= 2
    # a bucket of fewer is several of all; the last place counts documents
    folded = F.when(F.col("bucket") == BUCKETS, buckets).otherwise(F.floor(F.col("bucket") * buckets / BUCKETS))
    parts = labelled.mapInArrow(count, "lang string, bucket int, held long")
    table = parts.groupBy("lang", folded.cast("int").alias("bucket")).agg(F.sum("held").alias("held")).toPandas()
    languages = sorted(table["lang"].unique())
    row = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    full = np.zeros((len(languages), buckets + 1))
    full[row, table["bucket"].to_numpy(np.int64)] = table["held"]
    seen = full[:, :buckets] + smoothing
    return LanguageModel(
        languages,
        np.log(full[:, buckets] / max(full[:, buckets].sum(), 1)),
        np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32),
    )


def identify(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """``docs`` with the language and its score, from its column ``text``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))
    kept = docs.drop(pred, score_column)
    columns = kept.columns
    at = columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_prior, log_prob = shared.value
        for whole in batches:
            for batch in slices(whole, at):
                texts = batch.column(at).to_pylist()
                told = [k for k, t in enumerate(texts) if languages and t and any(map(str.isalpha, t))]
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                lowered = [texts[k].lower() for k in told]
                shift = BUCKETS.bit_length() - log_prob.shape[1].bit_length()
                if len(lowered) == 1 and len(lowered[0]) > _BLOCK_CHARS:  # a long text, alone in its batch
                    counts = sum(np.bincount(grams >> shift, minlength=log_prob.shape[1]) for grams in _grams(lowered[0]))
                    totals = (log_prob @ counts)[None]
                elif lowered:
                    grams, starts = batch_grams(lowered)
                    totals = summed(log_prob, grams >> shift, starts)
                for k, text, total in zip(told, lowered, totals if lowered else [], strict=True):
                    n = 2 * len(text)
                    logit = (total + log_prior) * (min(n, EVIDENCE) / n)
                    best = int(np.argmax(logit))
                    names[k] = languages[best]
                    scores[k] = float(1 / np.exp(logit - logit[best]).sum())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*columns, pred, score_column],
                )

    schema = T.StructType([*kept.schema.fields]).add(pred, "string").add(score_column, "double")
    return kept.mapInArrow(score, schema)
