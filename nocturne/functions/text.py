"""Durations, dates, JSON and search over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.functions.numeric import half_up

STATUSES = ("completed", "processing", "recording")


def safe_json(col: Column, schema: str, default: Column | None = None) -> Column:
    """Parse JSON; blank or broken text gives the default, else an empty array."""
    default = F.array().cast(schema) if default is None else default
    return F.coalesce(F.from_json(col, schema), default)


def minutes(seconds: Column) -> Column:
    return F.floor(F.coalesce(seconds, F.lit(0)) / 60).cast("int")


def hm_text(total_minutes: Column) -> Column:
    whole = total_minutes.cast("int")
    return F.format_string("%dh %dm", F.floor(whole / 60).cast("int"), whole % 60)


def parse_duration(col: Column) -> Column:
    """Minutes from ``7.5h``, from a leading whole number, else 0."""
    text = col.cast("string")
    hours = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*[hH]", 1).try_cast("double")
    whole = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.coalesce(half_up(hours * 60), whole, F.lit(0)).cast("bigint")


def known_status(col: Column) -> Column:
    return F.when(col.isin(*STATUSES), col).otherwise("completed")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def mentions(text: str, *cols: Column) -> Column:
    """Case-insensitive contains over any of the columns."""
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(F.contains(F.lower(col), F.lit(text.lower())), F.lit(False))
    return hit


def filled(col: Column) -> Column:
    """The text, or NULL where it is blank."""
    return F.when(F.trim(col) != "", col)
