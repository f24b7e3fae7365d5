"""Time series of one recording: resampling, runs and down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.operators.ordered import slot_of, with_position
from nocturne.schemas import CHANNELS, STAGE, STAGE_CODES


def stage_code(stage):
    code = F.lit(None).cast("int")
    for name, number in STAGE_CODES.items():
        code = F.when(stage == name, number).otherwise(code)
    return code


def hypnogram(readings: DataFrame, epoch: str = "5 minutes", keys: tuple[str, ...] = ("SID",)) -> DataFrame:
    """Most common stage per epoch, ties to the smallest name.

    Each partial state holds the handful of stage names, not the rows.
    """
    staged = readings.filter(F.col(STAGE).isNotNull())
    out = staged.groupBy(*keys, F.window("ts", epoch).alias("epoch")).agg(F.mode(STAGE, True).alias("stage"))
    return out.select(
        *keys,
        F.col("epoch.start").alias("start"),
        F.col("epoch.end").alias("end"),
        "stage",
        stage_code(F.col("stage")).alias("code"),
    )


def minute_series(
    readings: DataFrame, channels: tuple[str, ...] = CHANNELS, step: str = "1 minute"
) -> DataFrame:
    out = readings.groupBy("SID", F.window("ts", step).alias("at")).agg(
        *[F.avg(c).alias(c) for c in channels]
    )
    return out.select("SID", F.col("at.start").alias("ts"), *channels)


def stage_runs(epochs: DataFrame, keys: tuple[str, ...] = ("SID",)) -> DataFrame:
    """Consecutive epochs of one stage as (start, end, stage) intervals.

    The input has one row per key and epoch, so a key holds as many rows as
    its time span has epochs, however many readings it had.
    """
    window = Window.partitionBy(*keys).orderBy("start")
    same = (F.lag("stage").over(window) == F.col("stage")) & (F.lag("end").over(window) == F.col("start"))
    flagged = epochs.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = flagged.withColumn("_run", F.sum("_new").over(window))
    return numbered.groupBy(*keys, "_run", "stage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("epochs")
    ).drop("_run")


def downsample(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Every ``n``-th row of each series, the first one included."""
    placed = with_position(df, keys, [F.asc(c) for c in order], slot_of(df, order[0]), "_position")
    return placed.filter((F.col("_position") - 1) % n == 0).drop("_position")
