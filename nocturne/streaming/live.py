"""Message parsing, derivation, imputation, gating and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nocturne.functions.live import derived_channels, message_bpm
from nocturne.runtime import cut_lineage
from nocturne.schemas import CHANNELS

MESSAGE = "topic string, value string, timestamp timestamp"
IMPUTED = ("EDA", "TEMP", "BVP")
#: Highest heart rate with a bin of its own: bounds the number of bins, which are broadcast.
TOP_RATE = 1000.0


def read_live(spark: SparkSession, folder: str, schema: str = MESSAGE, **options: str) -> DataFrame:
    """Messages arriving as JSON-lines files."""
    return spark.readStream.schema(schema).options(**options).json(folder)


def read_live_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages from a Kafka-compatible broker; the connector comes with the cluster."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return stream.select("topic", F.col("value").cast("string").alias("value"), "timestamp")


def parse_live(messages: DataFrame) -> DataFrame:
    """Adds ``bpm`` and drops messages that cannot be read.

    The explode parses each message once; a filter would be pushed down and
    parse it again.
    """
    readable = F.array_compact(F.array(message_bpm(F.col("value"))))
    return messages.select("*", F.explode(readable).alias("bpm"))


def rejected_live(messages: DataFrame) -> DataFrame:
    """The messages ``parse_live`` drops, for a log."""
    return messages.filter(message_bpm(F.col("value")).isNull())


def derive_live(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns(derived_channels(F.col("bpm")))


def with_device(messages: DataFrame, name: str = "device") -> DataFrame:
    """The device key: the second part of ``sensor/<device>/<channel>``."""
    return messages.withColumn(name, F.regexp_extract("topic", r"^[^/]+/([^/]+)/", 1))


def fit_bins(readings: DataFrame, width: float) -> DataFrame:
    """Mean EDA, TEMP and BVP per heart-rate bin, from rows that have all four.

    Rates above ``TOP_RATE`` share its bin.
    """
    complete = readings.select("HR", *IMPUTED).dropna().filter(F.col("HR") >= 0)
    bins = complete.groupBy(F.floor(F.least("HR", F.lit(TOP_RATE)) / width).alias("hr_bin")).agg(
        *[F.avg(c).alias(f"bin_{c}") for c in IMPUTED]
    )
    # A stream joins the bins in every trigger; they must not be fitted each time.
    return cut_lineage(bins)


def impute_live(rows: DataFrame, bins: DataFrame, width: float) -> DataFrame:
    """Replaces EDA, TEMP and BVP by the bin means; no bin or no pulse keeps them."""
    keyed = rows.withColumn("hr_bin", F.when(F.col("bpm") > 0, F.floor(F.least("bpm", F.lit(TOP_RATE)) / width)))
    # At most TOP_RATE / width bins; rates crowd into few, so a shuffle would be skewed.
    joined = keyed.join(F.broadcast(bins), "hr_bin", "left")
    return joined.withColumns(
        {
            "imputed": F.col(f"bin_{IMPUTED[0]}").isNotNull(),
            **{c: F.coalesce(F.col(f"bin_{c}"), F.col(c)) for c in IMPUTED},
        }
    ).drop("hr_bin", *[f"bin_{c}" for c in IMPUTED])


def gate_active(rows: DataFrame, sessions: DataFrame, at: str = "timestamp") -> DataFrame:
    """Rows that fall into a recording of their device, keyed by its SID."""
    spans = sessions.select("device", "SID", "started_at", "ended_at")
    inside = (F.col(at) >= F.col("started_at")) & (
        F.col("ended_at").isNull() | (F.col(at) < F.col("ended_at"))
    )
    return rows.join(spans, "device").filter(inside).drop("started_at", "ended_at")


def payload(at: str = "timestamp") -> Column:
    """The JSON text shown live."""
    return F.to_json(
        F.struct(
            "HR", "EDA", "TEMP", "BVP",
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        )
    )


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_recording(
    stream: DataFrame, out: str, checkpoint: str, buckets: int = 64, available_now: bool = False
) -> StreamingQuery:
    """Appends the eight channels, each row exactly once.

    Folders go by a hash bucket of the SID: one per SID would leave a small file
    per recording and trigger.
    """
    rows = stream.select(
        "SID", F.col("timestamp").alias("ts"), *CHANNELS,
        F.pmod(F.xxhash64("SID"), F.lit(buckets)).cast("int").alias("sid_bucket"),
    )
    return _start(rows.writeStream.format("parquet").partitionBy("sid_bucket").option("path", out), checkpoint, available_now)


def write_live(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Live payloads per SID as JSON lines."""
    rows = stream.select("SID", payload().alias("payload"))
    return _start(rows.writeStream.format("json").option("path", out), checkpoint, available_now)


def write_gated(
    rows: DataFrame,
    sessions: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    buckets: int = 64,
    available_now: bool = False,
    after: Callable[[], object] | None = None,
) -> StreamingQuery:
    """Gates every trigger by the sessions as they are then, records and shows what is inside.

    ``sessions`` is asked anew in each trigger, so a recording that begins while the stream
    runs is recorded. A trigger has its own folders; a repeated trigger replaces them.
    ``after`` runs when a trigger is stored, e.g. to score sessions that have finished.
    """

    def put(batch: DataFrame, number: int) -> None:
        inside = gate_active(batch, sessions()).persist()
        kept = inside.select(
            "SID", F.col("timestamp").alias("ts"), *CHANNELS, F.pmod(F.xxhash64("SID"), F.lit(buckets)).cast("int").alias("sid_bucket")
        )
        kept.write.mode("overwrite").partitionBy("sid_bucket").parquet(f"{out}/recording/batch={number}")
        inside.select("SID", payload().alias("payload")).write.mode("overwrite").json(f"{out}/payload/batch={number}")
        inside.unpersist()
        if after is not None:
            after()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
