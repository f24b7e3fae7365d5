"""Nightly rows and look-back sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.operators.features import recording_features
from nocturne.operators.ordered import in_chunks, slot_of
from nocturne.schemas import LABEL, NIGHT_FEATURES


def night_features(readings: DataFrame) -> DataFrame:
    """One feature row per SID and calendar night."""
    return recording_features(readings.withColumn("night", F.to_date("ts")), ("SID", "night"))


def with_night_index(nights: DataFrame, owner: str = "SID", night: str = "night") -> DataFrame:
    """1, 2, 3, … along the nights of each owner (one row per night)."""
    window = Window.partitionBy(owner).orderBy(night)
    return nights.withColumn("night_index", F.dense_rank().over(window))


def night_sequences(
    nights: DataFrame,
    window: int = 7,
    owner: str = "SID",
    order: str = "night_index",
    label: str = LABEL,
    features: tuple[str, ...] = NIGHT_FEATURES,
) -> DataFrame:
    """(owner, night, sequence, label): the ``window`` nights before each night.

    Rows with a missing feature or label are left out first; nights without a
    full look-back give no sequence.
    """
    complete = nights.dropna(subset=[*features, label])
    rows, parts = in_chunks(complete, [owner], [F.col(order)], slot_of(complete, order), window)
    frame = Window.partitionBy(*parts).orderBy(order).rowsBetween(-window, -1)
    built = rows.withColumn("sequence", F.collect_list(F.struct(*features)).over(frame))
    kept = built.filter((F.size("sequence") == window) & ~F.col("_halo"))
    return kept.select(owner, order, "sequence", F.col(label).cast("int").alias(label))
