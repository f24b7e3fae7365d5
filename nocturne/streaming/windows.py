"""Windowed aggregates over a stream of readings; batch input works too."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nocturne.operators.features import (
    channel_aggregates,
    coerce_channels,
    event_aggregates,
    event_rate,
    stage_aggregates,
)
from nocturne.schemas import CHANNELS


#: Microseconds of a SID in which overlapping windows are added up in one place.
SLOT = 86_400_000_000
#: Overlapping windows that a task adds up, some 500 bytes each.
HELD = 500_000


def _span(df: DataFrame, name: str = "window") -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(F.col(f"{name}.start").alias("start"), F.col(f"{name}.end").alias("end"), *rest)


def stream_features(readings: DataFrame, span: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The per-recording features for each SID and window."""
    columns = readings.columns
    rows = coerce_channels(readings.withWatermark("ts", delay))
    out = rows.groupBy("SID", F.window("ts", span)).agg(
        F.count(F.lit(1)).alias("records"),
        *channel_aggregates(),
        *event_aggregates(columns),
        *stage_aggregates(columns),
    )
    return _span(out.withColumn("event_rate", event_rate()))


def live_vitals(
    readings: DataFrame, span: str = "1 minute", slide: str | None = None, delay: str = "5 minutes"
) -> DataFrame:
    """Channel means per SID and window; ``slide`` makes the windows overlap.

    Each overlapping window is held by itself; ``vital_panes`` and ``sliding_vitals`` hold a row a slide.
    """
    window = F.window("ts", span, slide) if slide else F.window("ts", span)
    out = readings.withWatermark("ts", delay).groupBy("SID", window).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in CHANNELS if c in readings.columns]
    )
    return _span(out)


def _micros(length: timedelta) -> int:
    return length // timedelta(microseconds=1)


def vital_panes(readings: DataFrame, span: timedelta, slide: timedelta, delay: str = "5 minutes") -> DataFrame:
    """Channel sums and counts per SID and ``slide``, of which ``sliding_vitals`` makes windows of ``span``.

    A pane is one row of state and sink, however many windows it belongs to. It is held until the last of them
    is over, and a reading that comes by then counts in all of them. ``span`` must be a multiple of ``slide``.
    """
    if span % slide:
        raise ValueError("the span must be a multiple of the slide")
    named = [c for c in CHANNELS if c in readings.columns]
    held = readings.withWatermark("ts", f"{delay} {_micros(span - slide)} microseconds")
    out = held.groupBy("SID", F.window("ts", f"{_micros(slide)} microseconds")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in named],
        *[F.count(c).alias(f"{c}_count") for c in named],
    )
    return _span(out)


def sliding_vitals(panes: DataFrame, span: timedelta, slide: timedelta, most: int | None = None) -> DataFrame:
    """Channel means per SID and overlapping window, from the newest rows of ``vital_panes``.

    Panes are shuffled once, to each slot in which a window of theirs opens; they become windows only there.
    The number of tasks follows that of panes, or ``most`` where an upper bound is known, as a task holds its windows.
    """
    opening = (panes.count() if most is None else most) * (span // slide)
    tasks = max(panes.sparkSession.sparkContext.defaultParallelism, -(-opening // HELD))
    named = [c for c in CHANNELS if f"{c}_sum" in panes.columns]
    at = F.unix_micros("start")
    first = at - _micros(span - slide)
    slots = F.sequence(F.floor(first / SLOT), F.floor(at / SLOT))
    placed = panes.withColumn("slot", F.explode(slots)).repartition(tasks, "SID", "slot")
    opened = placed.withColumn("opens", F.explode(F.sequence(first, at, F.lit(_micros(slide)))))
    inside = opened.filter(F.floor(F.col("opens") / SLOT) == F.col("slot"))
    out = inside.groupBy("SID", "slot", "opens").agg(
        F.sum("n").alias("n"), *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_count")).alias(c) for c in named]
    )
    end = F.timestamp_micros(F.col("opens") + _micros(span))
    return out.select(F.timestamp_micros("opens").alias("start"), end.alias("end"), "SID", "n", *named)


def recordings(readings: DataFrame, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Stretches of a SID without a silence longer than ``gap``."""
    out = readings.withWatermark("ts", delay).groupBy("SID", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("records")
    )
    return _span(out, "session_window")


def dedup(messages: DataFrame, keys: list[str], at: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """One message per key; a repeat within the delay is dropped."""
    if not messages.isStreaming:
        return messages.dropDuplicates(keys)
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def pivot_channels(
    messages: DataFrame, channels: list[str], step: str = "1 second", delay: str = "1 minute"
) -> DataFrame:
    """(topic, value, timestamp) to one row per device and step, a column per channel.

    The topic is ``sensor/<device>/<channel>``; of several values the largest counts.
    """
    named = messages.withColumns(
        {
            "SID": F.regexp_extract("topic", r"^[^/]+/([^/]+)/", 1),
            "channel": F.regexp_extract("topic", r"/([^/]+)$", 1),
        }
    )
    out = named.withWatermark("timestamp", delay).groupBy("SID", F.window("timestamp", step)).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels]
    )
    return _span(out)


def last_seen(readings: DataFrame) -> DataFrame:
    """Time of the newest row per SID; run the stream in update mode."""
    return readings.groupBy("SID").agg(F.max("ts").alias("last_seen"))


def stale(seen: DataFrame, now: str, limit_seconds: int) -> DataFrame:
    """Marks SIDs silent for longer than the limit at time ``now``."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_seen")
    return seen.withColumn("stale", age > limit_seconds)


def write_updates(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes every window that a trigger changed, open ones included.

    Update mode; a trigger has its own folder, so a repeated trigger replaces what it
    wrote. ``newest_windows`` reads the current state.
    """

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_windows(
    spark: SparkSession, out: str, stream: DataFrame, keys: tuple[str, ...] = ("SID", "start"), base: str | None = None
) -> DataFrame:
    """The last written row of each window; with ``base``, from its newest state and the triggers since."""
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(T.StructType([*stream.schema.fields]).add("batch", "long")).parquet(out)
    upto = _compacted(spark, base)
    if upto is not None:
        state = spark.read.schema(stream.schema).parquet(f"{base}/upto={upto}").withColumn("batch", F.lit(upto).cast("long"))
        written = written.filter(F.col("batch") > upto).unionByName(state)
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in stream.columns])


def _compacted(spark: SparkSession, base: str | None) -> int | None:
    """The trigger up to which a state is stored below ``base``."""
    if base is None:
        return None
    try:
        return spark.read.parquet(base).agg(F.max("upto")).first()[0]
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def compact(spark: SparkSession, out: str, base: str, stream: DataFrame, keys: tuple[str, ...] = ("SID", "start")) -> int:
    """Stores the state up to the last trigger below ``base``, so that later reads skip the triggers before.

    The folders of those triggers (``batch`` up to the returned number) may then be removed by their owner.
    """
    last = spark.read.schema(T.StructType([*stream.schema.fields]).add("batch", "long")).parquet(out).agg(F.max("batch")).first()[0]
    before = _compacted(spark, base)
    if last is None or (before is not None and before >= last):
        return -1 if before is None else before
    newest_windows(spark, out, stream, keys, base).write.mode("overwrite").parquet(f"{base}/upto={last}")
    return last


def still_open(readings: DataFrame, closed: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Recordings of a source that has ended which append mode has not closed yet.

    Readings at or after the end of a SID's last closed recording belong to them.
    """
    last = closed.groupBy("SID").agg(F.max("end").alias("closed_until"))
    rest = readings.join(last, "SID", "left").filter(F.col("closed_until").isNull() | (F.col("ts") >= F.col("closed_until")))
    return recordings(rest.drop("closed_until"), gap)
