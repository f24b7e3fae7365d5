"""Reading the given tables, scratch tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.runtime import scratch_path

#: Rows, and estimated bytes, up to which a counted side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """About how many bytes a row takes: eight a number, 64 a text or digest, more for nested columns."""
    kinds = [f.dataType for f in df.schema.fields]
    return sum(8 if isinstance(k, (T.NumericType, T.BooleanType)) else 64 if isinstance(k, (T.StringType, T.BinaryType)) else 512 for k in kinds)


def counted_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored table whose counted rows fit, else the table as it is."""
    return F.broadcast(df) if df.count() <= min(limit, BROADCAST_BYTES // max(row_bytes(df), 1)) else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
