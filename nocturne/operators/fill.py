"""Whole-column medians and missing-value fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.functions.numeric import no_nan
from nocturne.operators.select import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def value_counts(df: DataFrame, columns: list[str], value_type: str = "double") -> DataFrame:
    """(column, value, n) over the present cells of the given columns."""
    cell = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    (
                        no_nan(F.col(f"`{c}`").cast("double"))
                        if value_type == "double"
                        else F.col(f"`{c}`").cast(value_type)
                    ).alias("value"),
                )
                for c in columns
            ]
        )
    ).alias("cell")
    return (
        df.select(cell)
        .select("cell.column", "cell.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_medians(df: DataFrame, columns: list[str] | None = None) -> dict[str, float]:
    """Exact median of each column, missing cells ignored; one number per column."""
    columns = numeric_columns(df) if columns is None else columns
    found = quantiles(df, columns, [0.5])
    return {c: found[c][0] for c in columns if found[c][0] is not None}


def fit_fill(df: DataFrame) -> dict:
    """What ``apply_fill`` needs: medians for numbers, a text for texts."""
    return {"numbers": fit_medians(df), "text": "Unknown"}


def apply_fill(df: DataFrame, fill: dict) -> DataFrame:
    """Fill with stored values, so one new row is filled like the training rows."""
    columns = {}
    for c in numeric_columns(df):
        if c in fill["numbers"]:
            value = F.lit(fill["numbers"][c])
            columns[c] = F.coalesce(no_nan(F.col(f"`{c}`").cast("double")), value)
    for c in text_columns(df):
        columns[c] = F.coalesce(F.col(f"`{c}`"), F.lit(fill["text"]))
    return df.withColumns(columns)


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the most common text; ties go to the smallest."""
    counts = value_counts(df, columns, "string")
    ranked = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts.withColumn("_place", F.row_number().over(ranked))
        .filter("_place = 1")
        .select("column", "value", "n")
    )
