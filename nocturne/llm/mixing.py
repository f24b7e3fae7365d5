"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in a fixed random order, are cut into blocks. A source of weight
``w`` out of ``cycle`` owns block ``k`` (from 0) with release ``floor(k * cycle / w)`` and
deadline ``ceil((k + 1) * cycle / w)``; each slot takes the released block of the earliest
deadline (ties: the smaller source name). No source is ever a whole block ahead of or
behind its share. The windows repeat every ``cycle`` slots, so one cycle is scheduled
(a fold over ``cycle`` slots in one row of at most ``cycle`` sources) and every block finds
its slot by arithmetic; the data are never scheduled one by one. A cycle has at least two slots a source, so the
fold grows with the square of the number of sources, and with nothing else.

A source that has run out leaves its slots empty and the others go on in schedule order:
no row is dropped and none repeated. Until the first source runs out, the shares hold to
less than one block.

The order inside a source is by the md5 of the id (then id, then text hash). Ranks come
from hash ranges: a source is split into as many ranges as its rows need, ranges are
counted, ranked each on its own and shifted by the sum of the earlier ones, so a source
with a third of all rows is many tasks' work. Where a range holds more than twice its rows, ids that more
than ``RANGE_ROWS`` rows of a source share (null is one) are found, and those rows take random places of their
own; they are written down once, so that a lost task cannot change the draw.

Defined cases: a null source is the source ``(none)``; null ids sort first unless there are as many as said;
equal rows take neighbouring places in some order. Given weights that sum to more than ``cycle`` are rounded to ``cycle``
parts, one at least for each source. An empty table gives no rows. Input columns named like
the added ones are replaced. A source without a given weight raises.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nocturne.llm.tables import counted_broadcast, stored

#: Slots of a schedule cycle, unless there are more than half as many sources.
CYCLE = 1000
BLOCK_ROWS = 100
#: Rows of a source for which a hash range is opened.
RANGE_ROWS = 20_000
NO_SOURCE = "(none)"

ADDED = ("source_rank", "block", "release", "deadline", "slot", "mix_order")


def natural_weights(counts: DataFrame, power: float = 0.5, cycle: int = CYCLE) -> DataFrame:
    """``mix_source, weight``: ``n`` of each source to the ``power``, as whole parts of ``cycle``, one at least.

    ``counts(mix_source, n)`` is one row a source, at most ``cycle`` of them. Parts are
    rounded down and what is left goes to the largest remainders (ties: the smaller name).
    """
    share = F.pow(F.col("n").cast("double"), F.lit(power))
    packed = counts.agg(F.array_sort(F.collect_list(F.struct("mix_source", share.alias("share")))).alias("sources"))
    total = F.aggregate("sources", F.lit(0.0), lambda t, s: t + s["share"])
    free = F.lit(cycle) - F.size("sources")
    exact = F.transform("sources", lambda s: F.struct(s["mix_source"].alias("mix_source"), (s["share"] * free / F.col("total")).alias("exact")))
    split = F.transform(
        "exact",
        lambda s: F.struct(
            (-F.round(s["exact"] - F.floor(s["exact"]), 9)).alias("order"), s["mix_source"].alias("mix_source"), F.floor(s["exact"]).alias("part")
        ),
    )
    left = free - F.aggregate("parts", F.lit(0).cast("long"), lambda t, s: t + s["part"])
    parts = packed.withColumn("total", total).withColumn("exact", exact).withColumn("parts", F.array_sort(split)).withColumn("left", left)
    placed = parts.select("left", F.posexplode("parts").alias("turn", "row"))
    extra = F.when(F.col("turn") < F.col("left"), 1).otherwise(0)
    return placed.select(F.col("row.mix_source").alias("mix_source"), (1 + F.col("row.part") + extra).cast("long").alias("weight"))


def schedule(weights: DataFrame) -> DataFrame:
    """``mix_source, weight, cycle, turn, at``: the slot in the cycle of each of a source's ``weight`` turns.

    ``weights(mix_source, weight)`` is one row a source; the cycle is the sum of the weights.
    """
    packed = weights.agg(F.array_sort(F.collect_list(F.struct("mix_source", "weight"))).alias("sources"), F.sum("weight").alias("cycle"))

    def picked(used: Column, slot: Column) -> Column:
        """Number, from 1, of the released source of the earliest deadline."""

        def better(best: Column, k: Column) -> Column:
            turn, weight = F.element_at(used, k), F.element_at("sources", k)["weight"]
            deadline = F.ceil((turn + 1) * F.col("cycle") / weight)
            wins = (F.floor(turn * F.col("cycle") / weight) <= slot) & (deadline < best["deadline"])
            return F.when(wins, F.struct(k.alias("k"), deadline.alias("deadline"))).otherwise(best)

        nothing = F.struct(F.lit(0).alias("k"), F.lit(1 << 62).cast("long").alias("deadline"))
        return F.aggregate(F.sequence(F.lit(1), F.size("sources")), nothing, better)["k"]

    def step(state: Column, slot: Column) -> Column:
        def take(state: Column, k: Column) -> Column:  # binds the pick, so it is found once
            used = F.transform(state["used"], lambda u, i: F.when(i + 1 == k, u + 1).otherwise(u))
            return F.struct(F.concat(state["picks"], F.array(k)).alias("picks"), used.alias("used"))

        return F.aggregate(F.array(picked(state["used"], slot)), state, take)

    start = F.struct(F.array_repeat(F.lit(0), 0).alias("picks"), F.transform("sources", lambda s: F.lit(0)).alias("used"))
    slots = F.sequence(F.lit(0), F.col("cycle").cast("int") - 1)
    picks = packed.filter("cycle > 0").select("sources", "cycle", F.aggregate(slots, start, step)["picks"].alias("picks"))
    placed = picks.select("sources", "cycle", F.posexplode("picks").alias("at", "k"))
    chosen = F.element_at("sources", F.col("k"))
    placed = placed.select(chosen["mix_source"].alias("mix_source"), chosen["weight"].alias("weight"), "cycle", "at")
    turn = F.row_number().over(Window.partitionBy("mix_source").orderBy("at")) - 1
    return placed.withColumn("turn", turn.cast("long"))


def _spread(docs: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with their hash range, and the rows of each range."""
    ranges = counts.select("mix_source", F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"))
    head = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
    spread = docs.join(F.broadcast(ranges), "mix_source").withColumn("mix_range", F.floor(head * F.col("ranges") / F.lit(1 << 32)))
    return spread, stored(spread.groupBy("mix_source", "mix_range").agg(F.count("*").alias("held")), "mix-ranges")


def _uncrowded(docs: DataFrame, spread: DataFrame, held: DataFrame) -> DataFrame | None:
    """``docs`` with keys of their own for rows of too frequent ids, written down; None if no range is crowded."""
    crowded = held.filter(F.col("held") > 2 * RANGE_ROWS).select("mix_source", "mix_range")
    if crowded.isEmpty():
        return None
    there = spread.join(F.broadcast(crowded), ["mix_source", "mix_range"], "left_semi")
    frequent = there.groupBy("mix_source", "mix_key").count().filter(F.col("count") > RANGE_ROWS)
    # at most a row for each RANGE_ROWS rows of the table
    frequent = counted_broadcast(stored(frequent.select("mix_source", "mix_key", F.lit(True).alias("frequent")), "mix-frequent"))
    own = F.md5(F.concat_ws("#", "mix_key", F.col("mix_tie").cast("string"), F.monotonically_increasing_id().cast("string")).cast("binary"))
    numbered = docs.withColumn("mix_own", own).join(frequent, ["mix_source", "mix_key"], "left")
    keyed = numbered.withColumn("mix_key", F.when(F.col("frequent"), F.col("mix_own")).otherwise(F.col("mix_key")))
    return stored(keyed.drop("mix_own", "frequent"), "mix-keyed")


def _ranked(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` with ``source_rank``: its place, from 0, in the source's fixed random order."""
    spread, held = _spread(docs, counts)
    again = _uncrowded(docs, spread, held)
    if again is not None:
        spread, held = _spread(again, counts)
    before = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("mix_source", "mix_range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("mix_source", "mix_range").orderBy("mix_key", "mix_tie")
    place = spread.withColumn("place", F.row_number().over(inside))
    return place.join(offsets, ["mix_source", "mix_range"]).withColumn("source_rank", F.col("offset") + F.col("place") - 1)


def mix(
    docs: DataFrame,
    weights: Mapping[str, int] | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    block_rows: int = BLOCK_ROWS,
    cycle: int = CYCLE,
) -> DataFrame:
    """``docs`` with ``source_rank, block, release, deadline, slot, mix_order``.

    ``weights`` are whole shares by source name, of sources without rows too; without them the shares are the square
    roots of the row counts, in ``cycle`` parts. Ordering by ``mix_order`` gives the mix; it
    is unique, with gaps where a source has run out.
    """
    kept = docs.drop(*ADDED)
    key = F.coalesce(F.md5(F.col(id_column).cast("string").cast("binary")), F.lit("0" * 32))
    keyed = kept.select(
        F.struct(*kept.columns).alias("row"),  # no input column meets one of this module's
        F.coalesce(F.col(source_column), F.lit(NO_SOURCE)).alias("mix_source"),
        key.alias("mix_key"),
        F.xxhash64(*kept.columns).alias("mix_tie"),
    )
    counts = stored(keyed.groupBy("mix_source").agg(F.count("*").alias("n")), "mix-counts")
    cycle = max(cycle, 2 * counts.count())
    if weights is None:
        shares = natural_weights(counts, cycle=cycle)
    else:
        known = docs.sparkSession.createDataFrame([(s, int(w)) for s, w in weights.items() if w > 0], "mix_source string, weight long")
        missing = counts.join(F.broadcast(known), "mix_source", "left_anti").count()
        if missing:
            raise ValueError(f"{missing} sources without a weight")
        shares = known
        if sum(w for w in weights.values() if w > 0) > max(cycle, 2 * len(weights)):
            shares = natural_weights(known.withColumnRenamed("weight", "n"), 1.0, max(cycle, 2 * len(weights)))
    turns = stored(schedule(shares), "mix-schedule")
    parts = turns.select("mix_source", "weight", "cycle").distinct()
    block = F.floor(F.col("source_rank") / block_rows)
    blocks = _ranked(keyed, counts).join(F.broadcast(parts), "mix_source").withColumn("block", block)
    placed = blocks.withColumn("turn", F.col("block") % F.col("weight")).join(
        F.broadcast(turns.select("mix_source", "turn", "at")), ["mix_source", "turn"]
    )
    slot = F.floor(F.col("block") / F.col("weight")) * F.col("cycle") + F.col("at")
    return placed.withColumn("slot", slot).select(
        "row.*",
        "source_rank",
        "block",
        F.floor(F.col("block") * F.col("cycle") / F.col("weight")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("cycle") / F.col("weight")).alias("deadline"),
        "slot",
        (F.col("slot") * block_rows + F.col("source_rank") % block_rows).alias("mix_order"),
    )
