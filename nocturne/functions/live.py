"""Channels derived from a heart-rate message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.functions.numeric import to_number


def message_bpm(value: Column) -> Column:
    """Beats per minute of a JSON message; NULL marks a message to reject.

    A missing ``bpm`` key counts as zero, a number in quotes is accepted, and
    an explicit null is an error.
    """
    fields = F.from_json(value, "map<string,string>")
    return F.when(F.map_contains_key(fields, "bpm"), to_number(fields["bpm"])).when(fields.isNotNull(), 0.0)


def derived_channels(bpm: Column) -> dict[str, Column]:
    """The eight sensor channels, in recording order.

    Fixed values: offsets and divisors of the derivation.
    """
    return {
        "BVP": 20.0 + F.pmod(bpm, F.lit(10.0)),
        "ACC_X": F.lit(0.5),
        "ACC_Y": F.lit(0.5),
        "ACC_Z": F.lit(0.5),
        "TEMP": 33.0 + F.pmod(bpm, F.lit(2.0)),
        "EDA": 2.0 + F.pmod(bpm, F.lit(3.0)),
        "HR": bpm,
        "IBI": F.when(bpm > 0, 60000.0 / bpm).otherwise(0.0),
    }
