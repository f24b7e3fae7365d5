"""Ordered work that stays parallel when one key holds most of the rows.

A window partitioned by a key sorts that key in a single task. Here the order is cut into slots, a
function of the first ordering column that never falls along it (an hour of a time, a range of a
number, the first letters of a text). Work goes on inside a key's slot, and what the earlier slots add up
to comes from one small row a slot. It is the same way for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk for frames that look back.
CHUNK = 10_000


def slot_of(df: DataFrame, column: str) -> Column:
    """A slot for an ascending order that begins with ``column``."""
    kind, cell = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", cell)
    if isinstance(kind, T.IntegralType):
        return F.floor(cell / 1024)
    if isinstance(kind, T.NumericType):
        return F.floor(cell * 4096)
    return F.substring(cell, 1, 3) if isinstance(kind, T.StringType) else cell


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], slot: Column) -> DataFrame:
    """Totals per key up to each row along ``order``, which must be unique within a key."""
    slotted = df.withColumn("_slot", slot)
    totals = slotted.groupBy(*[F.col(f"`{key}`").alias(f"_key{i}") for i, key in enumerate(keys)], F.col("_slot").alias("_of_slot")).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()]
    )
    # one row per key and slot, so this window is small for any key
    earlier = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))]).orderBy("_of_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_before_{name}": F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)) for name in sums}
    offsets = totals.withColumns(before).drop(*[f"_sum_{name}" for name in sums])
    same = F.col("_slot").eqNullSafe(F.col("_of_slot"))
    for i, key in enumerate(keys):
        same = same & F.col(f"`{key}`").eqNullSafe(F.col(f"_key{i}"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return slotted.join(offsets, same).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_before_{name}") + F.sum(value).over(inside)).alias(name) for name, value in sums.items()],
    )


def with_position(df: DataFrame, keys: list[str], order: list[Column], slot: Column, name: str = "position") -> DataFrame:
    """1-based position within the key along a unique ``order``."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, slot)


def in_chunks(
    df: DataFrame, keys: list[str], order: list[Column], slot: Column, back: int, size: int = CHUNK
) -> tuple[DataFrame, list[str]]:
    """Rows ready for frames that look back at most ``back`` rows, and the columns to partition the frame by.

    A key is cut into chunks that repeat the last ``back`` rows of the chunk before, in
    rows marked ``_halo``; drop those after the frame ran.
    """
    size = max(size, 2 * back)
    placed = with_position(df, keys, order, slot, "_position")
    own = F.floor((F.col("_position") - 1) / size)
    tail = F.pmod(F.col("_position") - 1, F.lit(size)) >= size - back
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    rows = (
        placed.withColumn("_own", own)
        .withColumn("_chunk", F.explode(copies))
        .withColumn("_halo", F.col("_chunk") != F.col("_own"))
        .drop("_own", "_position")
    )
    return rows, [*keys, "_chunk"]
