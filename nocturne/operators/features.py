"""Readings to one feature row per recording or night."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.functions.numeric import no_nan, to_number
from nocturne.schemas import CHANNELS, EVENTS, STAGE, STAGES


def coerce_channels(df: DataFrame) -> DataFrame:
    """Every channel as DOUBLE; bad text, NaN and absent columns are NULL."""
    types = dict(df.dtypes)
    columns = {}
    for name in CHANNELS:
        if name not in types:
            columns[name] = F.lit(None).cast("double")
        elif types[name] == "string":
            columns[name] = to_number(F.col(name))
        else:
            columns[name] = no_nan(F.col(name).cast("double"))
    return df.withColumns(columns)


def channel_aggregates(channels: tuple[str, ...] = CHANNELS) -> list[Column]:
    out = []
    for name in channels:
        out += [
            F.avg(name).alias(f"{name}_mean"),
            F.stddev_samp(name).alias(f"{name}_std"),
            F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"),
        ]
    return out


def event_aggregates(columns: list[str]) -> list[Column]:
    """Cells that are present count, even a literal zero."""
    return [
        (F.count(c) if c in columns else F.lit(0).cast("bigint")).alias(f"{c}_count")
        for c in EVENTS
    ]


def event_rate() -> Column:
    total = sum((F.col(f"{c}_count") for c in EVENTS[1:]), F.col(f"{EVENTS[0]}_count"))
    return total / F.greatest(F.col("records"), F.lit(1))


def stage_aggregates(columns: list[str]) -> list[Column]:
    """Shares of each stage; other codes only count in the denominator.

    ``stage_present`` tells whether the row's file had a stage column at all: a
    recording without one has no shares, not a share of unknown rows.
    """
    if STAGE not in columns:
        return [F.lit(0.0).alias(f"sleep_stage_pct_{s}") for s in STAGES]
    missing = F.lit("Unknown")
    if "stage_present" in columns:
        missing = F.when(F.col("stage_present"), "Unknown")
    stage = F.coalesce(F.col(STAGE), missing)
    return [
        (F.count(F.when(stage == s, 1)) / F.count(F.lit(1))).alias(f"sleep_stage_pct_{s}")
        for s in STAGES
    ]


def recording_features(readings: DataFrame, keys: tuple[str, ...] = ("SID",)) -> DataFrame:
    """All per-recording features in one aggregate.

    Every aggregate has a partial form, so a recording that holds most of the
    rows is reduced where it is read and only small buffers are shuffled.
    """
    columns = readings.columns
    rows = coerce_channels(readings)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        *channel_aggregates(),
        *event_aggregates(columns),
        *stage_aggregates(columns),
    )
    counts_end = len(keys) + 1 + 4 * len(CHANNELS) + len(EVENTS)
    names = out.columns
    return out.withColumn("event_rate", event_rate()).select(
        *names[:counts_end], "event_rate", *names[counts_end:]
    )


def join_participants(features: DataFrame, participants: DataFrame) -> DataFrame:
    """Inner join on SID; duplicate participants fan out.

    Spark picks the strategy from the measured sizes: participants grow with the
    data, so no broadcast is forced.
    """
    return features.join(participants, "SID", "inner")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when the table is empty; reads at most one row."""
    if not df.head(1):
        raise ValueError(message)
    return df
