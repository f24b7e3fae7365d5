"""Streams give what the batch gives; the live job writes each accepted row once."""

import json
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from nocturne.plans import adapters as a
from nocturne.plans import catalogue_streams, jobs
from nocturne.plans.catalogue import stamp
from nocturne.plans.catalogue_streams import table_stream
from nocturne.schemas import CHANNELS
from nocturne.streaming import lifecycle, timers, windows
from nocturne.streaming import live as feed


def complete(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_features_equal_batch(spark, sf):
    batch = rows(windows.stream_features(a.readings(spark, sf)), "SID", "start")
    stream = rows(complete(windows.stream_features(a.readings_from(table_stream(spark, sf, "events"))), "t_features"), "SID", "start")
    assert stream == batch and len(batch) == 397


def test_sessions_and_last_seen_equal_batch(spark, sf):
    batch = rows(windows.recordings(a.readings(spark, sf)), "SID", "start")
    stream = rows(complete(windows.recordings(a.readings_from(table_stream(spark, sf, "events"))), "t_sessions"), "SID", "start")
    assert stream == batch and len(batch) == 329
    seen = rows(complete(windows.last_seen(a.readings_from(table_stream(spark, sf, "events"))), "t_seen"), "SID")
    assert seen == rows(windows.last_seen(a.readings(spark, sf)), "SID")


def test_session_state(spark, tmp_path):
    changes = [
        ("s1", "created", "2024-01-01 20:00:00", 1), ("s1", "recording", "2024-01-01 21:00:00", 2),
        ("s1", "complete", "2024-01-02 05:00:00", 3), ("s2", "recording", "2024-01-01 22:00:00", 4),
        ("s2", "failed", "2024-01-01 22:00:00", 5), ("s3", "created", "2024-01-01 23:00:00", 6),
    ]
    df = spark.createDataFrame(changes, "sid string, status string, at string, seq long").withColumn("at", F.col("at").cast("timestamp"))
    df.orderBy(F.desc("seq")).coalesce(1).write.parquet(str(tmp_path / "c"))
    batch = rows(lifecycle.session_state(df), "sid")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "c"))
    assert rows(complete(lifecycle.session_state(stream), "t_state"), "sid") == batch
    assert [(r["status"], r["started_at"] is None, r["ended_at"] is None) for r in batch] == [
        ("complete", False, False), ("failed", False, False), ("created", True, True),
    ]
    assert [r["sid"] for r in lifecycle.finished_sessions(lifecycle.session_state(df)).collect()] == ["s1"]


def test_dedup_and_pivot(spark):
    sent = spark.createDataFrame(
        [("sensor/S1/hr", "60", "2024-01-01 00:00:00.1"), ("sensor/S1/eda", "2", "2024-01-01 00:00:00.9"),
         ("sensor/S1/hr", "61", "2024-01-01 00:00:01.2"), ("sensor/S1/hr", "60", "2024-01-01 00:00:00.1")],
        "topic string, value string, timestamp string",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert windows.dedup(sent, ["topic", "value", "timestamp"]).count() == 3
    wide = rows(windows.pivot_channels(sent, ["hr", "eda"]), "start")
    assert [(r["SID"], r["hr"], r["eda"]) for r in wide] == [("S1", "60", "2"), ("S1", "61", None)]


def test_live_job(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    at = lambda s: f"2024-01-01T22:00:{s:02d}.000Z"
    messages = [
        ("sensor/d1/hr", '{"bpm":72.5}', at(10)), ("sensor/d1/hr", '{"bpm":"60"}', at(5)), ("sensor/d1/hr", "{}", at(11)),
        ("sensor/d1/hr", '{"bpm":null}', at(12)), ("sensor/d1/hr", "notjson", at(13)),
        ("sensor/d1/hr", '{"bpm":80}', at(1)), ("sensor/d2/hr", '{"bpm":70}', at(20)), ("sensor/d1/hr", '{"bpm":90}', at(40)),
    ]
    lines = [json.dumps({"topic": t, "value": v, "timestamp": s}) for t, v, s in messages]
    (inbox / "m.json").write_text("\n".join(lines))
    spans = spark.createDataFrame(
        [("d1", "R1", "2024-01-01 22:00:02", "2024-01-01 22:00:30"), ("d2", "R2", "2024-01-01 22:00:00", None)],
        "device string, SID string, started_at string, ended_at string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "ended_at")})
    bins = feed.fit_bins(spark.createDataFrame([(72.0, 9.0, 30.0, 1.0)], "HR double, EDA double, TEMP double, BVP double"), 5.0)
    for _ in range(2):
        stream = feed.read_live(spark, str(inbox))
        for query in jobs.live(stream, spans, str(tmp_path / "out"), bins, 5.0, True):
            query.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out" / "recording")), "SID", "ts")
    assert [(r["SID"], r["HR"], r["EDA"], r["BVP"]) for r in got] == [
        ("R1", 60.0, 2.0, 20.0), ("R1", 72.5, 9.0, 1.0), ("R1", 0.0, 2.0, 20.0), ("R2", 70.0, 9.0, 1.0),
    ]
    shown = spark.read.schema("SID string, payload string").json(str(tmp_path / "out" / "payload"))
    payloads = [json.loads(r["payload"]) for r in shown.filter("SID = 'R2'").collect()]
    assert payloads == [{"HR": 70.0, "EDA": 9.0, "TEMP": 30.0, "BVP": 1.0, "ts": "2024-01-01T22:00:20"}]
    rejected = feed.rejected_live(spark.createDataFrame(messages, "topic string, value string, timestamp string"))
    assert sorted(r["value"] for r in rejected.collect()) == ["notjson", '{"bpm":null}']


def test_sessions_that_begin_while_the_stream_runs(spark, tmp_path):
    from nocturne.plans import jobs
    from nocturne.streaming import live as feed

    sent = tmp_path / "sent"
    sent.mkdir()
    spans = {"now": [("d1", "A", "2024-01-01 00:00:00", None)]}
    schema = "device string, SID string, started_at string, ended_at string"
    current = lambda: spark.createDataFrame(spans["now"], schema).selectExpr(
        "device", "SID", "cast(started_at as timestamp) started_at", "cast(ended_at as timestamp) ended_at"
    )
    calls = []

    def run(name, lines):
        (sent / name).write_text("\n".join(lines) + "\n")
        stream = feed.read_live(spark, str(sent))
        jobs.live_sessions(spark, stream, current, str(tmp_path / "out"), available_now=True, completed=lambda: calls.append(1)).awaitTermination()

    line = lambda d, t: f'{{"topic": "sensor/{d}/hr", "value": "{{\\"bpm\\": 70}}", "timestamp": "2024-01-01T0{t}:00:00.000Z"}}'
    run("1.json", [line("d1", 1), line("d2", 1)])
    spans["now"].append(("d2", "B", "2024-01-01 02:00:00", None))
    run("2.json", [line("d1", 3), line("d2", 3), line("d2", 1)])
    out = spark.read.parquet(str(tmp_path / "out" / "recording"))
    assert sorted((r["SID"], r["ts"].hour) for r in out.collect()) == [("A", 1), ("A", 3), ("B", 3)]
    assert len(calls) == 2


def test_late_files_reach_their_windows(spark, tmp_path):
    from nocturne.streaming import windows

    folder = tmp_path / "r"
    folder.mkdir()
    stream = spark.readStream.schema("SID string, ts timestamp, HR double").json(str(folder))
    rows = windows.live_vitals(stream, "1 hour", None, "1 day")

    def run(name, hours):
        text = "".join(f'{{"SID": "A", "ts": "2024-01-02T{h:02d}:10:00.000Z", "HR": {h}}}\n' for h in hours)
        (folder / name).write_text(text)
        windows.write_updates(rows, str(tmp_path / "o"), str(tmp_path / "c"), True).awaitTermination()

    run("a.json", [5, 9])
    run("b.json", [5, 1])
    read = lambda base=None: {r["start"].hour: r["n"] for r in windows.newest_windows(spark, str(tmp_path / "o"), rows, base=base).collect()}
    assert read() == {1: 1, 5: 2, 9: 1}
    base = str(tmp_path / "base")
    assert read(base) == read()
    assert windows.compact(spark, str(tmp_path / "o"), base, rows) == windows.compact(spark, str(tmp_path / "o"), base, rows)
    assert read(base) == read()
    run("c.json", [9, 12])
    assert read(base) == read() == {1: 1, 5: 2, 9: 2, 12: 1}


def write_readings(folder, name, rows):
    text = "".join(f'{{"SID": "{sid}", "ts": "2024-01-02T{at}:00.000Z"}}\n' for sid, at in rows)
    (folder / name).write_text(text)


def test_stretches_are_sent_as_they_change(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    timers.with_state_store(spark)
    stream = spark.readStream.schema("SID string, ts timestamp").json(str(folder))
    rows_ = timers.stretches(stream, timedelta(hours=1), "2 hours")

    def run(name, readings):
        write_readings(folder, name, readings)
        windows.write_updates(rows_, str(tmp_path / "o"), str(tmp_path / "c"), True).awaitTermination()
        out = timers.current(spark.read.schema(rows_.schema).parquet(str(tmp_path / "o" / "*")), "SID", "start")
        return [(r["SID"], r["start"].strftime("%H:%M"), r["end"].strftime("%H:%M"), r["records"], r["closed"])
                for r in rows(out, "SID", "start") if r["records"]]

    assert run("1.json", [("A", "01:00"), ("A", "01:30"), ("A", "03:00"), ("B", "02:00")]) == [
        ("A", "01:00", "02:30", 2, False), ("A", "03:00", "04:00", 1, False), ("B", "02:00", "03:00", 1, False),
    ]
    # a late reading joins two stretches; the second goes
    assert run("2.json", [("A", "02:15")]) == [("A", "01:00", "04:00", 4, False), ("B", "02:00", "03:00", 1, False)]
    # time goes on: timers close them, what lies behind it does not count
    assert run("3.json", [("B", "09:00")])[0] == ("A", "01:00", "04:00", 4, True)
    assert run("4.json", [("A", "05:00"), ("B", "09:30")]) == [
        ("A", "01:00", "04:00", 4, True), ("B", "02:00", "03:00", 1, True), ("B", "09:00", "10:30", 2, False),
    ]


def test_silence_is_told_by_a_timer(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    timers.with_state_store(spark)
    stream = spark.readStream.schema("SID string, ts timestamp").json(str(folder))
    rows_ = timers.watch(stream, timedelta(hours=2), "0 seconds")

    def run(name, readings):
        write_readings(folder, name, readings)
        windows.write_updates(rows_, str(tmp_path / "o"), str(tmp_path / "c"), True).awaitTermination()
        return {r["SID"]: r["stale"] for r in timers.current(spark.read.schema(rows_.schema).parquet(str(tmp_path / "o" / "*")), "SID").collect()}

    assert run("1.json", [("A", "01:00"), ("B", "02:00")]) == {"A": False, "B": False}
    assert run("2.json", [("B", "03:30")]) == {"A": True, "B": False}
    assert run("3.json", [("A", "03:45")]) == {"A": False, "B": False}
    written = spark.read.schema(rows_.schema).parquet(str(tmp_path / "o" / "*"))
    assert written.filter("SID = 'A'").count() == 3  # heard, silent, heard again


def test_a_reading_waits_for_its_status_message(spark, tmp_path):
    """The message that begins a recording comes after its first readings, in a later trigger."""
    sent, told = tmp_path / "sent", tmp_path / "told"
    sent.mkdir()
    told.mkdir()
    readings = spark.readStream.schema("device string, timestamp timestamp, n int").json(str(sent))
    changes = spark.readStream.schema("device string, SID string, status string, at timestamp").json(str(told))
    gated = timers.held_gate(readings, changes, lifecycle.TERMINAL, "1 hour")
    timers.with_state_store(spark)
    at = lambda t: f"2024-01-02T{t}:00.000Z"

    def run(name, sends, tells):
        (sent / name).write_text("".join(json.dumps({"device": d, "timestamp": at(t), "n": n}) + "\n" for d, t, n in sends))
        (told / name).write_text("".join(json.dumps({"device": d, "SID": s, "status": x, "at": at(t)}) + "\n" for d, s, x, t in tells))
        query = gated.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()

    run("1.json", [("d", "01:00", 1), ("d", "02:10", 2), ("d", "02:20", 3), ("e", "02:00", 4)], [("x", "none", "heartbeat", "02:00")])
    run("2.json", [("d", "02:50", 5), ("d", "03:10", 6)], [("d", "R1", "recording", "02:05"), ("d", "R1", "complete", "03:00"), ("x", "none", "heartbeat", "03:00")])
    run("3.json", [("x", "09:00", 7)], [("x", "none", "heartbeat", "09:00")])
    out = sorted((r["SID"], r["n"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert out == [("R1", 2), ("R1", 3), ("R1", 5)]


def test_rates_beyond_the_last_bin(spark):
    readings = spark.createDataFrame([(1500.0, 1.0, 2.0, 3.0), (2500.0, 3.0, 2.0, 3.0), (60.0, 9.0, 9.0, 9.0)], "HR double, EDA double, TEMP double, BVP double")
    bins = feed.fit_bins(readings, 5.0)
    live = spark.createDataFrame([(1800.0, 0.0, 0.0, 0.0), (61.0, 0.0, 0.0, 0.0)], "bpm double, EDA double, TEMP double, BVP double")
    assert [r["EDA"] for r in feed.impute_live(live, bins, 5.0).orderBy("bpm").collect()] == [9.0, 2.0]


def test_sids_of_a_bucket_share_state_and_timer(spark, tmp_path, monkeypatch):
    """All SIDs in one state: each is still told apart, and one timer closes what is over."""
    monkeypatch.setattr(timers, "BUCKETS", 1)
    folder = tmp_path / "r"
    folder.mkdir()
    timers.with_state_store(spark)
    stream = spark.readStream.schema("SID string, ts timestamp").json(str(folder))
    rows_ = timers.stretches(stream, timedelta(hours=1), "0 seconds")
    for name, readings in (
        ("1.json", [("A", "01:00"), ("A", "01:30"), ("B", "01:00"), ("B", "02:00"), ("C", "01:59")]),
        ("2.json", [("D", "02:45")]),
    ):
        write_readings(folder, name, readings)
        query = windows.write_updates(rows_, str(tmp_path / "o"), str(tmp_path / "c"), True)
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3  # of the bucket, not of the SIDs
    out = timers.current(spark.read.schema(rows_.schema).parquet(str(tmp_path / "o" / "*")), "SID", "start").filter("records > 0")
    got = sorted((r["SID"], r["start"].strftime("%H:%M"), r["records"], r["closed"]) for r in out.collect())
    assert got == [("A", "01:00", 2, True), ("B", "01:00", 1, True), ("B", "02:00", 1, False), ("C", "01:59", 1, False), ("D", "02:45", 1, False)]


def test_a_reading_is_held_once_for_all_its_windows(spark, tmp_path, monkeypatch):
    """State and sink of the sliding windows grow by a row a reading, not by one for each window it falls in."""
    sent = [(n, f"2024-01-0{1 + n % 3} 0{n % 10}:{3 * n:02d}:30", n % 2, "view", 20.5 + n, f'{{"k": {n}}}') for n in range(20)]
    df = spark.createDataFrame(sent, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1)
    df.write.parquet(str(tmp_path / "e"))
    shutil.copy(next((tmp_path / "e").glob("part-*.parquet")), tmp_path / "events.parquet")
    started, write = [], windows.write_updates
    monkeypatch.setattr(windows, "write_updates", lambda *args: started.append((write(*args), args[1])) or started[-1][0])
    got = rows(catalogue_streams.live_vitals_sliding(spark, str(tmp_path)), "SID", "start")
    query, out = started[0]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == len(sent)
    assert spark.read.parquet(out).count() == len(sent)
    want = windows.live_vitals(a.readings(spark, str(tmp_path)), "5 minutes", "1 minute")
    assert got == rows(want.select("SID", stamp("start"), "n", *CHANNELS), "SID", "start") and len(got) == 5 * len(sent)


SENSED = "SID string, ts string, BVP double, HR double, IBI double"
SENSED_ROWS = [
    ("A", "2024-01-01 23:57:59.999999", 1.0, 60.0, None), ("A", "2024-01-01 23:58:00", 2.0, None, None), ("A", "2024-01-02 00:01:10", 4.0, 62.0, 8.0),
    ("A", "2024-01-02 00:01:10", 4.0, 62.0, 8.0), ("A", "2024-01-02 00:06:10", None, 64.0, None), ("A", None, 9.0, 64.0, None),
    ("B", "1969-12-31 23:59:30", 1.0, None, 2.0), ("B", "1970-01-01 00:00:30", 2.0, None, 4.0), ("B", "2024-01-05 12:00:00", None, None, None),
    (None, "2024-01-02 00:00:00", 1.0, 1.0, 1.0), (None, "2024-01-02 00:00:01", 2.0, 2.0, 2.0),
]


@pytest.mark.parametrize("span, slide", [("5 minutes", "1 minute"), ("3 days", "12 hours"), ("1 hour", "1 hour")])
def test_panes_add_up_to_the_overlapping_windows(spark, span, slide):
    """Nulls, repeated rows, midnight and times before 1970 included."""
    readings = spark.createDataFrame(SENSED_ROWS, SENSED).withColumn("ts", F.col("ts").cast("timestamp"))
    lengths = [timedelta(**{t.split()[1].rstrip("s") + "s": int(t.split()[0])}) for t in (span, slide)]
    got = windows.sliding_vitals(windows.vital_panes(readings, *lengths), *lengths)
    want = windows.live_vitals(readings, span, slide)
    assert got.dtypes == want.dtypes and rows(got, "SID", "start") == rows(want, "SID", "start")


def test_tasks_follow_the_windows_they_hold(spark, monkeypatch):
    monkeypatch.setattr(windows, "HELD", 1)
    readings = spark.createDataFrame(SENSED_ROWS, SENSED).withColumn("ts", F.col("ts").cast("timestamp"))
    lengths = timedelta(minutes=5), timedelta(minutes=1)
    panes = windows.vital_panes(readings, *lengths)
    assert windows.sliding_vitals(panes, *lengths).rdd.getNumPartitions() == 5 * panes.count() > 8
    got = rows(windows.sliding_vitals(panes, *lengths, most=1000), "SID", "start")
    assert got == rows(windows.live_vitals(readings, "5 minutes", "1 minute"), "SID", "start")


def test_panes_need_a_span_of_whole_slides(spark):
    readings = spark.createDataFrame(SENSED_ROWS, SENSED)
    with pytest.raises(ValueError, match="multiple"):
        windows.vital_panes(readings, timedelta(minutes=5), timedelta(minutes=2))


def test_late_readings_reach_all_their_sliding_windows(spark, tmp_path):
    """The second file's readings are late: one is in time for its last window, one for none."""
    folder = tmp_path / "r"
    folder.mkdir()
    timers.with_state_store(spark)
    span, slide = timedelta(minutes=5), timedelta(minutes=1)
    stream = spark.readStream.schema("SID string, ts timestamp, HR double").json(str(folder))
    panes = windows.vital_panes(stream, span, slide, "1 hour")

    def run(name, readings):
        text = "".join(f'{{"SID": "A", "ts": "2024-01-02T{at}.000Z", "HR": {hr}}}\n' for at, hr in readings)
        (folder / name).write_text(text)
        windows.write_updates(panes, str(tmp_path / "o"), str(tmp_path / "c"), True).awaitTermination()
        newest = windows.newest_windows(spark, str(tmp_path / "o"), panes)
        out = windows.sliding_vitals(newest, span, slide).collect()
        return {r["start"].strftime("%H:%M"): (r["n"], r["HR"]) for r in out if r["start"].hour == 8}

    assert run("1.json", [("08:59:10", 60), ("10:03:00", 70)]) == {f"08:{m}": (1, 60.0) for m in range(55, 60)}
    assert run("2.json", [("08:59:20", 80), ("08:58:40", 90)]) == {f"08:{m}": (2, 70.0) for m in range(55, 60)}
