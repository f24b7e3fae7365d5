"""Per-site summaries that merge without the raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_summary(df: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """(site, column, n_rows, n, mean, std, m2), one row per site and column."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        aggregates += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"a{i}"),
            F.stddev_samp(c).alias(f"s{i}"),
            F.var_pop(c).alias(f"v{i}"),
        ]
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("n"),
            F.col(f"a{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
            (F.col(f"v{i}") * F.col(f"n{i}")).alias("m2"),
        )
        for i, c in enumerate(columns)
    ]
    wide = df.groupBy(F.col(site).alias("site")).agg(*aggregates)
    return wide.select("site", "n_rows", F.explode(F.array(*items)).alias("item")).select(
        "site", "n_rows", "item.*"
    )


def merge_summaries(summary: DataFrame) -> DataFrame:
    """Global mean and sample std of each column from the site rows alone."""
    totals = summary.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"),
    )
    # One row per column name, a number fixed by the schema.
    spread = (
        summary.join(F.broadcast(totals), "column")
        .groupBy("column", "total", "centre")
        .agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("m2"))
    )
    return spread.select(
        "column",
        F.col("total").alias("n"),
        F.col("centre").alias("mean"),
        F.sqrt(F.try_divide(F.col("m2"), F.nullif(F.col("total") - 1, F.lit(0)).cast("double"))).alias("std"),
    )


def summary_maps(summary: DataFrame) -> DataFrame:
    """Export form: one row per site with maps of means and stds."""
    pairs = lambda name: F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("column", name)))
    ).alias(name)
    return summary.groupBy("site").agg(F.max("n_rows").alias("n_rows"), pairs("mean"), pairs("std"))
