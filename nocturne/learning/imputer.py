"""Sensor channels predicted from heart rate alone, by one forest for all three.

A tree over one input parts a line of heart rates, so all it can ask of the readings are sums along
that line. They are taken once, on a fixed grid of rates and under every tree's resampling; the trees are then
grown from prefix sums, each split the one that lowers the summed variance of the three
channels most. The mean of the trees is again a step over the grid: a small table, which a reading looks up.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions.numeric import no_nan

TARGETS = ("EDA", "TEMP", "BVP")
#: Heart rates from 0 to ``TOP`` on a grid of ``1 / PER_BEAT``; those outside belong to its ends.
TOP, PER_BEAT = 1000, 8
#: Chance of 0, 1, 2, ... draws of a row when as many rows are drawn as there are (Poisson).
DRAWS = tuple(float(np.exp(-1.0) / np.prod(range(1, k + 1))) for k in range(8))


class Imputer(NamedTuple):
    """``steps[k]`` are the channels from the grid place ``places[k]`` on, up to the next one."""

    places: list[int]
    steps: list[list[float]]


def _rate(heart_rate: Column) -> Column:
    """The grid place of a rate; a place has the rates from its own up to the next."""
    return F.floor(F.greatest(F.least(heart_rate, F.lit(float(TOP))), F.lit(0.0)) * PER_BEAT).cast("int")


def _draws(tree: int, seed: int) -> Column:
    """How often a row is in a tree's sample, from a hash of the row and the tree."""
    u = F.pmod(F.xxhash64("HR", *TARGETS, F.lit(tree), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    out = F.lit(len(DRAWS) - 1)
    for k, limit in reversed(list(enumerate(np.cumsum(DRAWS)[:-1]))):
        out = F.when(u < float(limit), k).otherwise(out)
    return out.cast("double")


def rate_sums(readings: DataFrame, trees: int, seed: int) -> DataFrame:
    """``rate, tree, n`` and a sum of each channel: at most a row for each place of the grid and tree."""
    complete = readings.select("HR", *TARGETS).dropna()
    drawn = F.explode(F.array(*[F.struct(F.lit(k).alias("tree"), _draws(k, seed).alias("draws")) for k in range(trees)]))
    rows = complete.withColumn("rate", _rate(F.col("HR"))).withColumn("drawn", drawn).select("rate", "drawn.*", *TARGETS)
    return rows.filter("draws > 0").groupBy("rate", "tree").agg(
        F.sum("draws").alias("n"), *[F.sum(F.col("draws") * F.col(c)).alias(c) for c in TARGETS]
    )


def best_cut(n: np.ndarray, sums: np.ndarray) -> int | None:
    """The place before which to part a run of rates, by prefix sums; None if no cut lowers the variance."""
    left, total = np.cumsum(n)[:-1], n.sum()
    part, whole = np.cumsum(sums, axis=0)[:-1], sums.sum(axis=0)
    gain = (part**2 / left[:, None] + (whole - part) ** 2 / (total - left)[:, None]).sum(axis=1) - (whole**2).sum() / total
    return int(np.argmax(gain)) + 1 if len(gain) and gain.max() > 1e-12 * (whole**2).sum() / total else None


def grow(n: np.ndarray, sums: np.ndarray, depth: int) -> np.ndarray:
    """A tree's value at each of its rates."""
    cut = best_cut(n, sums) if depth else None
    if cut is None:
        return np.tile(sums.sum(axis=0) / n.sum(), (len(n), 1))
    return np.r_[grow(n[:cut], sums[:cut], depth - 1), grow(n[cut:], sums[cut:], depth - 1)]


def fit_imputer(readings: DataFrame, trees: int = 10, depth: int = 10, seed: int = 42) -> Imputer:
    """One pass over the four columns; what comes back is bounded by the grid."""
    found = rate_sums(readings, trees, seed).toPandas()
    if not len(found):
        return Imputer([], [])
    grid = np.unique(found["rate"].to_numpy())
    total = np.zeros((len(grid), len(TARGETS)))
    for _, tree in found.sort_values("rate").groupby("tree"):
        # a rate that this tree did not draw goes with the drawn rates that it is nearest to
        own, steps = tree["rate"].to_numpy(), grow(tree["n"].to_numpy(), tree[list(TARGETS)].to_numpy(), depth)
        total += steps[np.searchsorted((own[1:] + own[:-1]) / 2, grid, "left")]
    steps = total / found["tree"].nunique()
    fresh = np.r_[True, (steps[1:] != steps[:-1]).any(axis=1)]
    places = np.r_[0, (grid[1:] + grid[:-1] + 1) // 2]  # midway between the rates that a cut parts
    return Imputer(places[fresh].tolist(), steps[fresh].tolist())


def lookup(spark: SparkSession, imputer: Imputer) -> DataFrame:
    """``_place`` and the channels there, for every place of the grid that has any."""
    ends = [*imputer.places[1:], TOP * PER_BEAT + 1]
    rows = [(place, *step) for first, end, step in zip(imputer.places, ends, imputer.steps) for place in range(first, end)]
    return spark.createDataFrame(rows, "_place int, " + ", ".join(f"_{c} double" for c in TARGETS))


def impute(rows: DataFrame, imputer: Imputer) -> DataFrame:
    """Replaces the three channels where there is a pulse; an imputer of no readings keeps them. Works on streams too."""
    rate = no_nan(F.col("HR").cast("double"))
    keyed = rows.withColumn("_place", F.when(rate > 0, _rate(rate)))
    # at most a row for each place of the grid; rates crowd into few, so a shuffle would be skewed
    joined = keyed.join(F.broadcast(lookup(rows.sparkSession, imputer)), "_place", "left")
    cells = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in TARGETS}
    return joined.withColumns(cells).drop("_place", *[f"_{c}" for c in TARGETS]).select(*rows.columns)


def save_imputer(spark: SparkSession, imputer: Imputer, path: str) -> None:
    spark.createDataFrame([(json.dumps(imputer._asdict()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_imputer(spark: SparkSession, path: str) -> Imputer:
    return Imputer(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))
