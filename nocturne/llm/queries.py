"""The operators on the given tables, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm import langid, mixing, negatives, quality, repeats, secrets, toxicity, urls, warc, whitening
from nocturne.llm.decontaminate import decontaminate, proximity
from nocturne.llm.jaccard import jaccard_classes
from nocturne.llm.neardup import near_duplicates
from nocturne.llm.tables import held_out, read, stored


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "source"))


def op1_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with given weights: by the length of a source's name."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source")
    names = [r[0] for r in docs.select(F.coalesce("source", F.lit(mixing.NO_SOURCE))).distinct().collect()]
    return mixing.mix(docs, {s: 2 + len(s) % 5 for s in names}, block_rows=10)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [secrets.count("known_spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    known = F.sha2(secrets.span_list("known_spans"), 256).alias("base_sha256")
    return scanned.select("doc_id", *counts, known, secrets.span_list("spans").alias("spans"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages", "page_id", "url")).drop("score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").filter(~held_out())
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.with_revisits(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    chunks = warc.read_archives(warc.write_archives(records), with_data=False)
    return warc.payloads(chunks).drop("intact")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(quality.measures(read(spark, sf_dir, "documents", "doc_id", "text")), "measures")
    return quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op9_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures that the rules vote on, and the base verdict."""
    measured = quality.measures(read(spark, sf_dir, "documents", "doc_id", "text"))
    judged = quality.judge(stored(measured, "measures"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_mix": op1_mix,
    "op1_target_weights": op1_target_weights,
    "op2_secrets": op2_secrets,
    "op3_urls": op3_urls,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op5_proximity": op5_proximity,
    "op6_repeats": op6_repeats,
    "op7_warc": op7_warc,
    "op8_langid": op8_langid,
    "op9_quality": op9_quality,
    "op9_base": op9_base,
    "op10_minhash": op10_minhash,
    "op11_whitening": op11_whitening,
    "op12_negatives": op12_negatives,
    "op13_jaccard": op13_jaccard,
}
