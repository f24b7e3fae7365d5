"""From raw documents to a mixed training corpus, each stage written and read again.

Stages: language ID (undetermined or doubtful documents go), near-duplicates (one document
of each group stays), benchmark decontamination (documents that hold a benchmark passage
go), secrets (found spans are replaced by their kind), mixing (every document gets its place).

Verdicts hold for a row's id and text: rows that share an id (or have none) but differ in
text are judged each by itself, and of rows equal in both one stays. Null ids are never near-duplicates of anything. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nocturne.llm import langid, mixing, secrets
from nocturne.llm.decontaminate import decontaminate
from nocturne.llm.neardup import near_duplicates
from nocturne.llm.tables import counted_broadcast, read, stored, unused

#: Least language score of a document that stays.
LANGUAGE_SCORE = 0.5

#: The first stage cannot be said in SQL.
ORACLE_SQL = None


def _without(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` less the rows that ``judge(docs, key)`` returns by doc_id (null included) and ``key``, a hash of the text."""
    key, gone_id, gone_key = unused(docs, "text_key"), unused(docs, "gone_id"), unused(docs, "gone_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    dropped = judge(keyed, key).select(F.col("doc_id").alias(gone_id), F.col(key).alias(gone_key))
    gone = stored(dropped.distinct(), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    return keyed.join(counted_broadcast(gone), same, "left_anti").drop(key)


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for rows of equal id and text: the first by hash of all it holds. Null ids are not equal."""
    key, turn = unused(docs, "text_key"), unused(docs, "row_turn")
    known = docs.filter("doc_id is not null and text is not null")
    ids = known.select("doc_id", F.xxhash64("text").alias(key)).groupBy("doc_id", key).count().filter("count > 1")
    twice = stored(ids.select(F.col("doc_id").alias("again_id"), F.col(key).alias("again_key")), "twice")
    if twice.isEmpty():
        return docs
    # whole rows are compared only where an id and a text come again
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("again_id")) & (F.col(key) == F.col("again_key")) & F.col("text").isNotNull()
    again = counted_broadcast(twice)
    order = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*docs.columns))
    firsts = keyed.join(again, same, "left_semi").withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1)
    return keyed.join(again, same, "left_anti").drop(key).unionByName(firsts.drop(key, turn))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from all that carry a language."""
    model = langid.train(docs)
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    judged = langid.identify(docs, model, pred, score)
    told = (F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LANGUAGE_SCORE)
    return judged.filter(told).drop(pred, score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; of its equal rows one."""
    return _once(_without(docs, lambda keyed, key: near_duplicates(keyed, carried=[key]).filter(~F.col("kept"))))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    return _without(docs, lambda keyed, key: decontaminate(keyed, items, carried=[key]).filter("contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", deduplicate),
    ("benchmark", benchmark),
    ("secrets", redact),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` in order over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
