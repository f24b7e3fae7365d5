"""State with event-time timers: silence, open and closed recordings, as they happen.

Each keeps a few numbers per SID and is sent on when something changes or when the watermark
passes a timer, so nothing has to be read twice. State and timers are kept by ``BUCKETS`` hash buckets of
SIDs: a call into Python costs milliseconds, and so there are few, whatever the number of SIDs. Streams need the RocksDB state store, which
``with_state_store`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATCHED = "SID string, last_seen timestamp, stale boolean, version long"
STRETCHES = "SID string, start timestamp, end timestamp, records long, closed boolean, version long"

#: Groups of SIDs or devices that share a state and a timer.
BUCKETS = 1024


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def _times(ms: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms", utc=True)


class _Watch(StatefulProcessor):
    """Newest time of a bucket's SIDs; a timer, ``limit`` ms after the earliest, says of which nothing has come since."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "sids array<string>, lasts array<long>, silent array<boolean>, version long")

    def _held(self) -> tuple[dict[str, tuple[int, bool]], int]:
        if not self.seen.exists():
            return {}, 0
        sids, lasts, silent, version = self.seen.get()
        return dict(zip(sids, zip(lasts, silent, strict=True), strict=True)), version

    def _keep(self, held: dict[str, tuple[int, bool]], version: int) -> None:
        self.seen.update((list(held), [x[0] for x in held.values()], [x[1] for x in held.values()], version))

    @staticmethod
    def _earliest(held: dict[str, tuple[int, bool]]) -> int | None:
        return min((last for last, silent in held.values() if not silent), default=None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, version = self._held()
        old, passed = self._earliest(held), timerValues.getCurrentWatermarkInMs()
        newest = pd.concat([part.groupby("SID")["at"].max() for part in rows]).groupby(level=0).max()
        later = {sid: (int(at), int(at) + self.limit <= passed) for sid, at in newest.items() if sid not in held or at > held[sid][0]}
        if not later:
            return
        held.update(later)
        new = self._earliest(held)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old + self.limit)
            if new is not None:
                self.handle.registerTimer(new + self.limit)
        self._keep(held, version + 1)
        yield self._rows(later, version + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, version = self._held()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        silent = {sid: (last, True) for sid, (last, told) in held.items() if not told and last + self.limit <= passed}
        held.update(silent)
        left = self._earliest(held)
        if left is not None:
            self.handle.registerTimer(left + self.limit)
        if silent:
            self._keep(held, version + 1)
            yield self._rows(silent, version + 1)

    @staticmethod
    def _rows(rows: dict[str, tuple[int, bool]], version: int) -> pd.DataFrame:
        last, stale = zip(*rows.values(), strict=True)
        return pd.DataFrame({"SID": list(rows), "last_seen": _times(list(last)), "stale": list(stale), "version": [version] * len(rows)})

    def close(self) -> None:
        pass


class _Stretches(StatefulProcessor):
    """The stretches of a bucket's SIDs that are still open; one timer, at the earliest end, closes what is over.

    A reading that comes late may join two stretches: the later one is withdrawn, as a row
    without records.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sids array<string>, starts array<long>, lasts array<long>, counts array<long>, version long")

    def _held(self) -> tuple[pd.DataFrame, int]:
        sids, starts, lasts, counts, version = self.open.get() if self.open.exists() else ([], [], [], [], 0)
        whole = {k: pd.Series(list(v), dtype="int64") for k, v in (("start", starts), ("last", lasts), ("n", counts))}
        return pd.DataFrame({"SID": pd.Series(list(sids), dtype=object), **whole}), version

    def _keep(self, held: pd.DataFrame, version: int) -> None:
        self.open.update((*(held[c].tolist() for c in ("SID", "start", "last", "n")), version))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, version = self._held()
        counted = pd.concat([part.groupby(["SID", "at"]).size() for part in rows]).reset_index(name="n")
        points = pd.DataFrame({"SID": counted["SID"], "start": counted["at"], "last": counted["at"], "n": counted["n"]})
        spans = pd.concat([held, points]).sort_values(["SID", "start"], ignore_index=True)
        before = spans.groupby("SID")["last"].cummax().groupby(spans["SID"]).shift()
        begins = before.isna() | (spans["start"] >= before.fillna(0).astype("int64") + self.gap)
        parts = spans.groupby(begins.cumsum())
        now = parts.agg(SID=("SID", "first"), start=("start", "first"), last=("last", "max"), n=("n", "sum"))
        now["closed"] = now["last"] + self.gap <= timerValues.getCurrentWatermarkInMs()
        both = now.merge(held, on=["SID", "start"], how="outer", suffixes=("", "_old"), indicator="found")
        changed = both[(both["found"] != "both") | (both["last"] != both["last_old"]) | (both["n"] != both["n_old"])]
        gone = changed["found"] == "right_only"
        told = pd.DataFrame({
            "SID": changed["SID"], "start": changed["start"], "last": changed["last"].where(~gone, changed["last_old"]).astype("int64"),
            "n": changed["n"].where(~gone, 0).astype("int64"), "closed": changed["closed"].where(~gone, True).astype(bool),
        })
        kept = now[~now["closed"]]
        self._wait(held, kept)
        self._keep(kept, version + 1)
        yield self._rows(told, version + 1)

    def _wait(self, before: pd.DataFrame, held: pd.DataFrame) -> None:
        """Moves the timer to the earliest end."""
        old, new = (int(part["last"].min()) if len(part) else None for part in (before, held))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old + self.gap)
            if new is not None:
                self.handle.registerTimer(new + self.gap)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, version = self._held()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ended = held["last"] + self.gap <= passed
        left, over = held[~ended], held[ended]
        if len(left):
            self.handle.registerTimer(int(left["last"].min()) + self.gap)
        if len(over):
            self._keep(left, version + 1)
            yield self._rows(over.assign(closed=True), version + 1)

    def _rows(self, rows: pd.DataFrame, version: int) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "SID": rows["SID"].tolist(),
                "start": _times(rows["start"].tolist()),
                "end": _times((rows["last"] + self.gap).tolist()),
                "records": pd.Series(rows["n"].tolist(), dtype="int64"),
                "closed": pd.Series(rows["closed"].tolist(), dtype=bool),
                "version": pd.Series([version] * len(rows), dtype="int64"),
            }
        )

    def close(self) -> None:
        pass


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def _keyed(readings: DataFrame, delay: str):
    rows = readings.filter(F.col("SID").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return rows.select(_bucket("SID"), "SID", "ts", F.unix_millis("ts").alias("at")).groupBy("bucket")


def watch(readings: DataFrame, limit: timedelta, delay: str = "1 hour") -> DataFrame:
    """A row when a SID is heard of later than before, and one with ``stale`` once the watermark is ``limit`` past that.

    ``version`` numbers the rows of a SID; the largest is the current one.
    """
    milliseconds = int(limit / timedelta(milliseconds=1))
    return _keyed(readings, delay).transformWithStateInPandas(_Watch(milliseconds), WATCHED, "Update", "EventTime")


def stretches(readings: DataFrame, gap: timedelta, delay: str = "1 hour") -> DataFrame:
    """Stretches without a silence of ``gap``: a row when one changes, and a ``closed`` one when its timer has passed.

    The source is read once: open stretches are among the rows. Readings behind the watermark do not count.
    """
    milliseconds = int(gap / timedelta(milliseconds=1))
    return _keyed(readings, delay).transformWithStateInPandas(_Stretches(milliseconds), STRETCHES, "Update", "EventTime")


def current(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key of what ``watch`` or ``stretches`` wrote."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("row"))
    return newest.select(*keys, "row.*")


class _Gate(StatefulProcessor):
    """The readings of a bucket's devices, held until the watermark has passed them and with it all messages up to their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "device string, SID string, begun long, ended long")
        self.waiting = handle.getListState("waiting", "device string, at long, row string")

    def _told(self, changes: pd.DataFrame) -> None:
        """The devices' recordings, with the new messages in."""
        spans = {(device, sid): [begun, ended] for device, sid, begun, ended in self.spans.get()} if self.spans.exists() else {}
        devices = [None if pd.isna(d) else d for d in changes["device"]]
        for device, sid, at, opens in zip(devices, changes["SID"], changes["at"], changes["opens"], strict=True):
            begun, ended = spans.get((device, sid), [None, None])
            at = int(at)
            if opens:
                begun = at if begun is None else min(begun, at)
            else:
                ended = at if ended is None else min(ended, at)
            spans[device, sid] = [begun, ended]
        self.spans.put([(*who, *span) for who, span in spans.items()])

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        changes, readings = parts[parts["SID"].notna()], parts[parts["row"].notna()]
        if len(changes):
            self._told(changes)
        if len(readings):
            devices = [None if pd.isna(d) else d for d in readings["device"]]
            held = [(device, int(at), row) for device, at, row in zip(devices, readings["at"], readings["row"], strict=True)]
            self.waiting.appendList(held)
            self.handle.registerTimer(min(at for _, at, _ in held) // 1000 + 1)
        yield pd.DataFrame({"SID": pd.Series([], dtype=str), "row": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        spans = list(self.spans.get()) if self.spans.exists() else []
        recordings: dict[str | None, list[tuple]] = {}
        for device, sid, begun, ended in spans:
            recordings.setdefault(device, []).append((sid, begun, ended))
        out = [
            (sid, row) for device, at, row in held if at < passed for sid, begun, ended in recordings.get(device, ())
            if begun is not None and begun <= at and (ended is None or at < ended)
        ]
        left = [x for x in held if x[1] >= passed]
        self._keep(self.waiting, left)
        if left:
            self.handle.registerTimer(min(at for _, at, _ in left) // 1000 + 1)
        self._keep(self.spans, [span for span in spans if span[3] is None or span[3] >= passed])  # the rest is over for all that may come
        yield pd.DataFrame(out, columns=["SID", "row"], dtype=str)

    def close(self) -> None:
        pass


_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def held_gate(readings: DataFrame, changes: DataFrame, terminal: tuple[str, ...], delay: str = "10 minutes", at: str = "timestamp") -> DataFrame:
    """Readings inside a recording of their ``device``, judged by a second stream of status messages.

    ``changes(device, SID, status, at)``: ``recording`` begins a recording, a ``terminal`` status ends it, others tell only the
    time. Both streams carry a watermark and the slower one counts: a reading that comes before its session's message
    waits for it, and goes out when all messages up to its time are in.
    """
    kept = readings.columns
    rows = readings.withWatermark(at, delay).select(
        "device", F.lit(None).cast("string").alias("SID"), F.lit(None).cast("boolean").alias("opens"),
        F.col(at).alias("when"), F.to_json(F.struct(*kept), _MICROS).alias("row"),
    )
    opens = F.when(F.col("status") == "recording", True).when(F.col("status").isin(*terminal), False)
    told = changes.withWatermark("at", delay).select(
        "device", F.when(opens.isNotNull(), F.col("SID")).alias("SID"), opens.alias("opens"), F.col("at").alias("when"), F.lit(None).cast("string").alias("row"),
    )
    both = rows.unionByName(told).select("*", F.unix_micros("when").alias("at"), _bucket("device")).groupBy("bucket")
    out = both.transformWithStateInPandas(_Gate(), "SID string, row string", "Append", "EventTime")
    parsed = F.from_json("row", readings.schema, _MICROS)
    return out.select("SID", parsed.alias("row")).select("SID", "row.*")
