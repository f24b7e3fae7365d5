"""Participants, feature tables, service tables and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.functions.numeric import to_number
from nocturne.operators import columns as naming
from nocturne.operators.labels import clean_participants
from nocturne.schemas import LEADERBOARD, PREDICTIONS, SESSIONS, USERS

SERVICE = {"users": USERS, "sessions": SESSIONS, "predictions": PREDICTIONS}


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as text columns, names trimmed and without a BOM."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    return clean_participants(read_text_csv(spark, path))


def read_external_participants(
    spark: SparkSession, path: str, fallback: str | None = None, id_column: str | None = None
) -> DataFrame:
    """A foreign participant file in our columns; the fallback if it is absent."""
    try:
        raw = read_text_csv(spark, path)
    except AnalysisException:
        if fallback is None:
            raise
        raw = read_text_csv(spark, fallback)
    return clean_participants(naming.map_participants(raw, id_column))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no feature table at {path}: run preprocess first") from error
    if "SID" not in df.columns:
        raise ValueError(f"feature table at {path} has no SID column")
    return df


def read_service_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """users, sessions and predictions as Parquet; no password column is read."""
    root = folder.rstrip("/")
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in SERVICE.items()}


def read_service_jdbc(
    spark: SparkSession, options: dict[str, str], name: str, lower: int, upper: int, parts: int
) -> DataFrame:
    """One service table over JDBC, read in ranges of its id.

    Connection options come from the caller only; filters and columns are
    pushed to the database.
    """
    wanted = [f.name for f in SERVICE[name].fields]
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    ranged = reader.option("partitionColumn", "id").option("lowerBound", lower).option("upperBound", upper)
    return ranged.option("numPartitions", parts).load().select(*wanted)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard CSV; blank, NaN and unreadable cells are missing."""
    raw = read_text_csv(spark, path)
    return raw.select(
        *[
            (F.col(f.name) if isinstance(f.dataType, T.StringType) else to_number(F.col(f.name))).alias(f.name)
            for f in LEADERBOARD.fields
        ]
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Clinical report CSV; interval texts stay text, the rest become numbers."""
    raw = read_text_csv(spark, path)
    return raw.select(
        *[F.col(c) if "CI" in c else to_number(F.col(c)).alias(c) for c in raw.columns]
    )


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
