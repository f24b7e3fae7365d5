"""Links of similar sets inside buckets, without all pairs of a bucket.

Given buckets of nodes and the whole set of every node, every link that could join two
components is found, and each comparison is made on whole sets. In a bucket nodes are cut by hash into
salted groups; each is compared with the hub of its group and the hubs with that of the bucket, so a bucket of n
nodes gives about n pairs and no group of rows grows to a hot bucket's size. Buckets whose nodes then lie in
different components compare all with the best linked node of their best linked component. What is left are nodes of one
reference in different components, and of those only pairs that could reach the similarity. In each
segment of the shingles' range it is known how many of a node's lie in the reference and how many do not, so two
nodes share at most the sum of the lesser numbers; and outside the reference no more than each
has that any other node has too. So a
large family of copies that differ too much from each other gives few pairs. A reference's nodes are
cut into blocks, and pairs of blocks meet as keys of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.components import components
from nocturne.llm.tables import counted_broadcast, stored

#: Groups of a bucket by hash.
SALTS = 64
#: Nodes of one reference that meet under one key.
FAN = 512
#: Parts of the range of 64-bit shingles in which shared ones are counted.
SEGMENTS = 32
_SHIFT = np.uint64(64 - 5)

#: Says of two whole sorted sets whether to compare them at all.
Filter = Callable[[np.ndarray, np.ndarray], bool]


def _salt(node: str, salts: Column | int) -> Column:
    return F.pmod(F.xxhash64(node), salts if isinstance(salts, Column) else F.lit(salts)).cast("long")


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """``key, blocks`` of the keys with more than ``FAN`` rows."""
    counted = rows.groupBy(key).count().filter(F.col("count") > FAN)
    return stored(counted.select(key, F.ceil(F.col("count") / FAN).cast("long").alias("blocks")), "crowded")


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, left, right`` of stored ``pairs(a, b)``; a set is sent once for each of its pairs, others are not sent."""
    asked = counted_broadcast(pairs)
    left = sets.withColumnRenamed("members", "left").join(asked, F.col("node") == F.col("a")).select("a", "b", "left")
    right = sets.withColumnRenamed("members", "right").join(asked, F.col("node") == F.col("b")).select("a", "b", "right")
    return left.join(right, ["a", "b"]).select("a", "b", "left", "right")


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column(2), batch.column(3), strict=True):
        yield np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)


def _links(common: int, x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    return 100 * common >= percent * (len(x) + len(y) - common)


def compared(pairs: DataFrame, sets: DataFrame, percent: int, sifted: Filter | None = None) -> DataFrame:
    """``a, b, linked`` of stored ``pairs(a, b)``, by the shingles that the whole sets have in common."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [
                (sifted is None or sifted(x, y)) and _links(len(np.intersect1d(x, y, assume_unique=True)), x, y, percent)
                for x, y in _sides(batch)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return stored(_met(pairs, sets).mapInArrow(compare, "a long, b long, linked boolean"), "compared")


def profiled(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked, inside, outside`` of stored ``pairs(a, b)``.

    The range of shingles is cut into ``SEGMENTS``: how many of ``b``'s in each are also in ``a``, and how many are not.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        count = lambda x: np.bincount((x >> _SHIFT).astype(np.int64), minlength=SEGMENTS).astype(np.int32)
        for batch in batches:
            linked, inside, outside = [], [], []
            for x, y in _sides(batch):
                shared = np.intersect1d(x, y, assume_unique=True)
                inside.append(count(shared))
                outside.append(count(y) - inside[-1])
                linked.append(_links(len(shared), x, y, percent))
            columns = [*batch.columns[:2], pa.array(linked, pa.bool_()), pa.array(inside, kind), pa.array(outside, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "inside", "outside"])

    schema = "a long, b long, linked boolean, inside array<int>, outside array<int>"
    return stored(_met(pairs, sets).mapInArrow(profile, schema), "profiled")


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs, hub first, whose sizes allow the similarity at all."""
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    fits = pairs.filter((F.col("node") != F.col("other")) & (100 * small >= percent * large))
    return stored(fits.select(F.col("other").alias("a"), F.col("node").alias("b")).distinct(), "pairs")


def _both_ways(done: DataFrame) -> DataFrame:
    return done.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        done.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )


def _mixed(buckets: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes lie in different components, with their labels."""
    held = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = held.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return stored(held.join(counted_broadcast(stored(mixed.select(key), "mixed-keys")), key), "mixed")


def alone(sets: DataFrame) -> DataFrame:
    """``node, alone``: how many shingles no other of these nodes has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, members in zip(*batch.columns, strict=True):
                held = np.frombuffer(members.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), node.as_py())), pa.array(held)], names=["node", "shingle"])

    spread_out = sets.select("node", "members").mapInArrow(spread, "node long, shingle long")
    once = spread_out.groupBy("shingle").agg(F.count("*").alias("held"), F.min("node").alias("node")).filter("held = 1")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(bucket, node, ...)`` whose bucket has more than one node; of buckets with the same nodes, one."""
    holders = rows.groupBy("bucket").agg(
        F.count("*").alias("held"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    )
    kept = holders.filter("held > 1").groupBy("held", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rows.join(counted_broadcast(stored(kept, "bucket-keys")), "bucket")


def settle(
    buckets: DataFrame, sets: DataFrame, percent: int, sifted: Filter | None = None, unshared: DataFrame | None = None
) -> DataFrame:
    """``node, label`` of every linked node: the smallest node of its component.

    ``buckets(bucket, node, n)``: nodes that may be linked share a bucket; ``n`` is the size of the set.
    ``sets(node, members)``: each such node's whole set as sorted 64-bit values. ``sifted`` must let every link pass. ``unshared(node, alone)``: what :func:`alone`
    gives for these sets, if it is known already.
    """
    salted = buckets.select("bucket", "node", "n", _salt("node", SALTS).alias("salt"))
    hubs = stored(salted.groupBy("bucket", "salt").agg(F.min(F.struct("node", "n")).alias("hub")), "hubs")
    heads = hubs.groupBy("bucket").agg(F.min("hub").alias("head"))
    name = lambda hub: [F.col(f"{hub}.node").alias("other"), F.col(f"{hub}.n").alias("other_n")]
    near = salted.join(hubs, ["bucket", "salt"]).select("node", "n", *name("hub"))
    far = hubs.join(heads, "bucket").select(F.col("hub.node").alias("node"), F.col("hub.n").alias("n"), *name("head"))
    done = compared(_ordered(near.unionByName(far), percent), sets, percent, sifted)
    labels = components(done.filter("linked").select("a", "b"))

    # buckets that fall apart: all are compared with the best linked node of their best linked component
    mixed = _mixed(buckets.select("bucket", "node", "n"), "bucket", labels)
    degrees = _both_ways(done.filter("linked")).groupBy("node").agg(F.count("*").alias("degree"))
    place = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("node")).alias("turn"), "n", "label")
    ranked = stored(mixed.join(degrees, "node", "left").select("bucket", "label", place.alias("place")), "ranked")
    best = ranked.groupBy("label").agg(F.max("place").alias("best"))
    best = best.select("label", (-F.col("best.turn")).alias("other"), F.col("best.n").alias("other_n"))
    references = ranked.groupBy("bucket").agg(F.max("place").alias("head")).select("bucket", F.col("head.label").alias("label"))
    references = stored(references.join(best, "label").select("bucket", "other", "other_n"), "references")
    referred = mixed.select("bucket", "node", "n").join(counted_broadcast(references), "bucket")
    referred = stored(referred.select("node", "n", "other", "other_n").distinct(), "referred")
    asked = stored(referred.select(F.col("other").alias("a"), F.col("node").alias("b")), "asked")
    profiles = profiled(asked, sets, percent)
    done = done.unionByName(profiles.filter("a <> b").select("a", "b", "linked"))
    labels = components(done.filter("linked").select("a", "b"))

    # nodes of one reference in different components that may still reach the similarity
    mixed = _mixed(referred.select("node", "n", "other"), "other", labels)
    if unshared is None:
        unshared = alone(sets.join(mixed.select("node").distinct(), "node", "left_semi"))
    parts = profiles.select(F.col("a").alias("other"), F.col("b").alias("node"), "inside", "outside")
    known = F.col("n") - F.coalesce("alone", F.lit(0))
    bounded = mixed.join(parts, ["other", "node"]).join(unshared, "node", "left").filter(100 * known >= percent * F.col("n"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda t, v: t + v)
    bounded = stored(bounded.withColumn("free", known - total("inside")).drop("alone"), "bounded")
    crowded = counted_broadcast(_cut(bounded, "other"))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    blocked = bounded.join(crowded, "other", "left").withColumn("own", _salt("node", blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    x = blocked.withColumn("block_y", every).withColumnRenamed("own", "block_x").alias("x")
    y = blocked.withColumn("block_x", every).withColumnRenamed("own", "block_y").alias("y")
    shared = lambda c: total(F.zip_with(f"x.{c}", f"y.{c}", lambda a, b: F.least(a, b)))
    at_most = shared("inside") + F.least(shared("outside"), "x.free", "y.free")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    possible = (100 * small >= percent * large) & ((100 + percent) * at_most >= percent * (small + large))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("other", "block_x", "block_y")]
    rest = x.join(y, same[0] & same[1] & same[2] & (F.col("x.label") < F.col("y.label")) & possible)
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    known = _both_ways(done).select(F.col("node").alias("a"), F.col("other").alias("b"))
    fresh = stored(rest.join(known, ["a", "b"], "left_anti"), "rest")
    done = done.unionByName(compared(fresh, sets, percent, sifted))
    return components(done.filter("linked").select("a", "b"))


def component_ids(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``set_digest, of_set``: the smallest doc_id of the component of each class of equal sets.

    ``nodes(node, set_digest, low_id)``: a class and its smallest doc_id; ``labels`` as :func:`settle` returns them.
    """
    labelled = stored(nodes.join(labels, "node", "left"), "labelled")
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("low_id").alias("least"))
    ids = labelled.join(counted_broadcast(stored(least, "least-ids")), "label", "left")
    return ids.select("set_digest", F.coalesce("least", "low_id").alias("of_set"))
