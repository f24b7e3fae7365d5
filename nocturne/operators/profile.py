"""Data-quality profile: overview, missing cells, correlation, distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.functions.numeric import no_nan
from nocturne.operators.fill import most_frequent, numeric_columns, text_columns, value_counts
from nocturne.operators.select import quantiles

QUARTILES = [0.25, 0.5, 0.75]


def _long(row: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """One wide aggregate row to one row per column; ``fields`` maps name to prefix."""
    items = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"`{prefix}{i}`").alias(name) for name, prefix in fields.items()],
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*items)).alias("item")).select("item.*")


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column, worst first."""
    cells = [
        F.isnan(F.col(f"`{c}`")) | F.col(f"`{c}`").isNull() if kind in ("double", "float")
        else F.col(f"`{c}`").isNull()
        for c, kind in df.dtypes
    ]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(cell).alias(f"m{i}") for i, cell in enumerate(cells)]
    )
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("missing_count"),
            F.try_divide(F.col(f"m{i}") * 100.0, F.col("rows")).alias("missing_percent"),
        )
        for i, c in enumerate(df.columns)
    ]
    long = row.select(F.explode(F.array(*items)).alias("item")).select("item.*")
    return long.orderBy(F.desc("missing_percent"), F.asc("column"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    columns = numeric_columns(df) if columns is None else columns
    cells = {i: no_nan(F.col(f"`{c}`").cast("double")) for i, c in enumerate(columns)}
    fields = {"count": "c", "mean": "a", "std": "s", "min": "lo", "max": "hi"}
    aggregates = []
    for i, cell in cells.items():
        aggregates += [
            F.count(cell).alias(f"c{i}"),
            F.avg(cell).alias(f"a{i}"),
            F.stddev_samp(cell).alias(f"s{i}"),
            F.min(cell).alias(f"lo{i}"),
            F.max(cell).alias(f"hi{i}"),
        ]
    found = quantiles(df, columns, QUARTILES)
    known = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(found[c]).cast("array<double>"))])
    long = _long(df.agg(*aggregates), columns, fields).withColumn("_q", known[F.col("column")])
    names = [f"q{int(p * 100)}" for p in QUARTILES]
    quarters = {name: F.get("_q", F.lit(j)) for j, name in enumerate(names)}
    return long.withColumns(quarters).select("column", "count", "mean", "std", "min", *names, "max")


def describe_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, top and freq, one row per column; equal tops by text."""
    columns = text_columns(df) if columns is None else columns
    counts = value_counts(df, columns, "string")
    sizes = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique")
    )
    tops = most_frequent(df, columns).select("column", F.col("value").alias("top"), F.col("n").alias("freq"))
    return sizes.join(tops, "column")


def describe_all(df: DataFrame) -> DataFrame:
    """Both overviews in one table, absent measures NULL."""
    numeric, text = numeric_columns(df), text_columns(df)
    parts = []
    if numeric:
        parts.append(describe_numeric(df, numeric))
    if text:
        parts.append(describe_text(df, text))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    order = ["column", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return out.select(*[c for c in order if c in out.columns])


def _pair_sums(df: DataFrame, columns: list[str], shift: list[float]) -> DataFrame:
    """``i, j, n, x, xx, xy``: over the rows that have both cells, with the cells moved by ``shift``.

    A batch is one matrix of cells, noughts for the missing, and one of their presence; four
    products of these give the sums of every pair. A task sends one row a pair.
    """
    width = len(columns)
    kinds = [("i", "int"), ("j", "int"), *[(c, "double") for c in ("n", "x", "xx", "xy")]]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(cells)
            cells, mask = np.where(there, cells - shift, 0.0), there.astype(float)
            sums += np.stack([mask.T @ mask, cells.T @ mask, (cells * cells).T @ mask, cells.T @ cells])
        at = np.indices((width, width)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, *sums.reshape(4, -1))], names=[c for c, _ in kinds])

    rows = df.select(*[no_nan(F.col(f"`{c}`").cast("double")).alias(f"c{k}") for k, c in enumerate(columns)])
    parts = rows.mapInArrow(multiply, ", ".join(f"{c} {kind}" for c, kind in kinds))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c, _ in kinds[2:]])


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows that have both.

    Columns without variation there give NULL. The rows are read twice: for a value near the middle of each
    column, and for the sums of all pairs around it.
    """
    cells = [no_nan(F.col(f"`{c}`").cast("double")) for c in columns]
    middle = df.agg(*[F.percentile_approx(x, 0.5, 100) for x in cells]).first()
    sums = _pair_sums(df, columns, [m or 0.0 for m in middle])
    x = sums.select("i", "j", "n", "x", "xx", "xy")
    y = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    spread = lambda square, total: F.when(square - total * total / F.col("n") > 1e-12 * square, square - total * total / F.col("n"))
    both = spread(F.col("xx"), F.col("x")) * spread(F.col("yy"), F.col("y"))
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(both)
    names = F.array(*[F.lit(c) for c in columns])
    return x.filter("n > 0").join(y, ["i", "j"]).select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), r.alias("r")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows of class 0 and 1, zero where a class is absent."""
    row = df.agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)])
    items = [F.struct(F.lit(c).alias("label"), F.col(f"n{c}").alias("n")) for c in (0, 1)]
    return row.select(F.explode(F.array(*items)).alias("item")).select("item.*")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins, three to eight by distinct values, the last one closed."""
    cell = no_nan(F.col(f"`{column}`").cast("double"))
    ends = df.agg(F.min(cell).alias("low"), F.max(cell).alias("high")).first()
    # eight different values decide already: no full distinct
    few = df.select(cell.alias("value")).filter("value is not null").distinct().limit(8).count()
    bins = min(8, max(3, few))
    low, high = (ends["low"], ends["high"]) if few else (0.0, 1.0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    # least() alone would put missing cells into the last bin.
    place = F.when(cell.isNotNull(), F.least(F.floor((cell - low) / width), F.lit(bins - 1)))
    row = df.agg(*[F.count_if(place == b).alias(f"n{b}") for b in range(bins)])
    items = [
        F.struct(
            F.lit(b).alias("bin"),
            F.lit(low + b * width).alias("bin_low"),
            F.lit(low + (b + 1) * width).alias("bin_high"),
            F.col(f"n{b}").alias("n"),
        )
        for b in range(bins)
    ]
    return row.select(F.explode(F.array(*items)).alias("item")).select("item.*")
