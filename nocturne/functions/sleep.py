"""Per-session sleep measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.functions.numeric import clamp

STAGE_FIELDS = {"wake": "W", "n1": "N1", "n2": "N2", "n3": "N3", "rem": "R"}


def sleep_efficiency(wake_share: Column, event_rate: Column) -> Column:
    wake = F.coalesce(wake_share, F.lit(0.0))
    rate = F.coalesce(event_rate, F.lit(0.0))
    return clamp(100.0 - wake * 100.0 - rate * 200.0, 0.0, 100.0)


def stage_percent(share: Column) -> Column:
    """Whole percent, halves to even."""
    return F.bround(F.coalesce(share, F.lit(0.0)) * 100, 0).cast("int")


def stage_percents(prefix: str = "sleep_stage_pct_") -> Column:
    return F.struct(
        *[stage_percent(F.col(prefix + code)).alias(name) for name, code in STAGE_FIELDS.items()]
    )
