"""Streaming queries over the given tables.

Each drains its source once (``availableNow``) into files under the shared
folder, with a checkpoint, and returns what the sink holds. Windows are written in
update mode, so those still open at the end are there too, as are stretches with timers.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.learning.training import save_bundle, train_and_select
from nocturne.plans import adapters as a
from nocturne.plans import jobs
from nocturne.plans.catalogue import STDS, device_sessions, device_sessions_from, feature_rows, participants, rounded, stamp
from nocturne.runtime import scratch_path
from nocturne.schemas import CHANNELS, IMPACTS
from nocturne.streaming import lifecycle, timers, windows
from nocturne.streaming import live as feed


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The given table read as a file stream."""
    schema = a.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream to its end and read its sink."""
    spark = stream.sparkSession
    home = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{home}/rows")
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


#: How late a reading may come.
DELAY = "2 days"


def drain_windows(stream: DataFrame, label: str) -> DataFrame:
    """Run a windowed stream to its end and read every window's last state."""
    spark = stream.sparkSession
    home = scratch_path(spark, label)
    windows.write_updates(stream, f"{home}/rows", f"{home}/checkpoint", True).awaitTermination()
    return windows.newest_windows(spark, f"{home}/rows", stream)


def stream_features(spark, sf):
    rows = windows.stream_features(a.readings_from(table_stream(spark, sf, "events")), "1 day", DELAY)
    return rounded(drain_windows(rows, "features").withColumns({"start": stamp("start"), "end": stamp("end")}), STDS)


def live_vitals(spark, sf):
    rows = windows.live_vitals(a.readings_from(table_stream(spark, sf, "events")), "1 minute", None, DELAY)
    return drain_windows(rows, "vitals").withColumns({"start": stamp("start"), "end": stamp("end")})


def live_vitals_sliding(spark, sf):
    timers.with_state_store(spark)  # a row for each reading: too many for the heap
    span, slide = timedelta(minutes=5), timedelta(minutes=1)
    panes = windows.vital_panes(a.readings_from(table_stream(spark, sf, "events")), span, slide, DELAY)
    home = scratch_path(spark, "sliding")
    windows.write_updates(panes, f"{home}/rows", f"{home}/checkpoint", True).awaitTermination()
    written = spark.read.schema(panes.schema).parquet(f"{home}/rows").count()
    newest = windows.newest_windows(spark, f"{home}/rows", panes)
    return windows.sliding_vitals(newest, span, slide, written).select("SID", stamp("start"), "n", *CHANNELS)


def _written(stream: DataFrame, label: str) -> DataFrame:
    """All rows that a stream with state sent out."""
    spark = timers.with_state_store(stream.sparkSession)
    home = scratch_path(spark, label)
    windows.write_updates(stream, f"{home}/rows", f"{home}/checkpoint", True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows/*")


def stream_sessions(spark, sf):
    rows = timers.stretches(a.readings_from(table_stream(spark, sf, "events")), timedelta(hours=12), DELAY)
    out = timers.current(_written(rows, "sessions"), "SID", "start").filter("records > 0")
    return out.select("SID", stamp("start"), stamp("end"), "records")


def stream_stale(spark, sf):
    """The last word on each SID: silent for five days as far as the stream's time tells, or not."""
    rows = timers.watch(a.readings_from(table_stream(spark, sf, "events")), timedelta(days=5), "0 seconds")
    return timers.current(_written(rows, "stale"), "SID").select("SID", stamp("last_seen"), "stale")


#: Sent at the end of a source, so that its time passes all that came before.
HEARTBEAT = "2100-01-01 00:00:00"


def _heartbeat(spark: SparkSession, rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """A stream of one row like ``rows``: NULL but for ``values``."""
    folder = scratch_path(spark, "heartbeat")
    cells = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    spark.range(1).select(*cells).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def stream_gated(spark, sf):
    """Readings inside recordings, judged by a stream of status messages."""
    sent = a.messages_from(table_stream(spark, sf, "events"))
    sent = sent.unionByName(_heartbeat(spark, sent, {"topic": "sensor/none/hr", "value": '{"bpm":0}', "timestamp": HEARTBEAT}))
    spans = device_sessions_from(table_stream(spark, sf, "customer"))
    ends = F.array(F.struct(F.lit("recording").alias("status"), F.col("started_at").alias("at")),
                   F.struct(F.lit("complete").alias("status"), F.col("ended_at").alias("at")))
    changes = spans.select("device", "SID", F.explode(ends).alias("e")).select("device", "SID", "e.status", "e.at").filter("at IS NOT NULL")
    changes = changes.unionByName(_heartbeat(spark, changes, {"device": "none", "status": "heartbeat", "at": HEARTBEAT}))
    rows = feed.with_device(feed.derive_live(feed.parse_live(sent)))
    timers.with_state_store(spark)
    gated = timers.held_gate(rows, changes, lifecycle.TERMINAL, "2 days")
    return drain(gated.select("SID", "event_id", "HR"), "gated").select("SID", "event_id", F.round("HR", 6).alias("HR"))


def stream_completion(spark, sf):
    """The live pipeline, scoring finished sessions once while it runs; every second session is scored already."""
    home = scratch_path(spark, "completion")
    trained = train_and_select(feature_rows(spark, sf), only=["logistic_regression"])
    save_bundle(spark, trained, f"{home}/bundle")
    known = a.predictions(spark, sf).filter("session_id % 2 = 0").select("session_id", "prediction")
    service = {"sessions": a.sessions(spark, sf), "predictions": known}

    def completed() -> DataFrame:
        return jobs.score_finished(spark, a.readings(spark, sf), participants(spark, sf), service, f"{home}/bundle", f"{home}/scored")

    query = jobs.live_sessions(
        spark, a.messages_from(table_stream(spark, sf, "events")), lambda: device_sessions(spark, sf), f"{home}/live",
        available_now=True, completed=completed,
    )
    query.awaitTermination()
    again = completed().count()
    rows = spark.read.parquet(f"{home}/scored/new_predictions")
    return rows.groupBy("session_id").agg(
        (F.count(F.lit(1)) + again).alias("scored"),
        F.bool_and((F.col("prediction") == (F.col("probability") >= 0.5).cast("int")) & F.col("label").isNotNull()).alias("decided"),
        F.max(F.size(F.from_json("shap_features", IMPACTS))).alias("impacts"),
    )


def stream_dedup(spark, sf):
    sent = a.messages_from(table_stream(spark, sf, "events"))
    again = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    repeated = sent.withColumn("copy", F.explode(again)).drop("copy")
    return drain(windows.dedup(repeated, ["event_id"]), "dedup").select("event_id", "topic")


def pivot_channels(spark, sf):
    events, kinds = table_stream(spark, sf, "events"), ["view", "click", "purchase", "signup", "error"]
    sent = events.select(
        F.concat(F.lit("sensor/S"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("topic"),
        "value",
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    rows = windows.pivot_channels(sent, kinds, "1 hour", DELAY)
    return drain_windows(rows, "pivot").select("SID", stamp("start"), *kinds)


def stream_recording(spark, sf):
    """Messages to gated, imputed rows in the bucketed recording files."""
    parsed = feed.parse_live(a.messages_from(table_stream(spark, sf, "events")))
    bins = feed.fit_bins(a.readings(spark, sf), 5.0)
    rows = feed.impute_live(feed.with_device(feed.derive_live(parsed)), bins, 5.0)
    gated = feed.gate_active(rows, device_sessions(spark, sf))
    home = scratch_path(spark, "recording")
    feed.write_recording(gated, f"{home}/rows", f"{home}/checkpoint", 8, True).awaitTermination()
    written = spark.read.parquet(f"{home}/rows")
    return written.groupBy("SID").agg(
        F.count(F.lit(1)).alias("records"), *[F.round(F.avg(c), 6).alias(c) for c in CHANNELS]
    )


def stream_payload(spark, sf):
    parsed = feed.parse_live(a.messages_from(table_stream(spark, sf, "events")))
    gated = feed.gate_active(feed.with_device(feed.derive_live(parsed)), device_sessions(spark, sf))
    home = scratch_path(spark, "payload")
    feed.write_live(gated, f"{home}/rows", f"{home}/checkpoint", True).awaitTermination()
    shown = spark.read.schema("SID string, payload string").json(f"{home}/rows")
    parts = F.from_json("payload", "HR double, EDA double, TEMP double, BVP double, ts string")
    return shown.select("SID", parts.alias("p")).select(
        "SID", *[F.round(f"p.{c}", 6).alias(c) for c in ("HR", "EDA", "TEMP", "BVP")], F.col("p.ts").alias("ts")
    )


def status_changes(spark, sf) -> DataFrame:
    """Three status messages per session, from the lines of its order."""
    step = F.col("l_linenumber")
    status = (
        F.when(step <= 2, "recording").when(step <= 4, "processing").when(step == 5, "failed").otherwise("complete")
    )
    return a.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_orderkey")).alias("sid"),
        status.alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        (step.cast("bigint") * 100000000 + F.col("l_partkey")).alias("seq"),
    )


def session_state(spark, sf):
    state = lifecycle.session_state(status_changes(spark, sf))
    return state.withColumns({"started_at": stamp("started_at"), "ended_at": stamp("ended_at")})


def last_seen(spark, sf):
    seen = windows.stale(windows.last_seen(a.readings(spark, sf)), "2024-01-31 00:00:00", 86400)
    return seen.withColumn("last_seen", stamp("last_seen"))


STREAMS = {
    f.__name__: f
    for f in (
        stream_features, live_vitals, live_vitals_sliding, stream_sessions, stream_dedup, pivot_channels,
        stream_recording, stream_payload, session_state, last_seen, stream_stale, stream_gated, stream_completion,
    )
}
