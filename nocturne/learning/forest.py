"""Path-dependent Shapley values of tree ensembles of any size.

A leaf's value counts for a coalition of features by the product over the features on
its path: one or nought for a known feature, by whether the row passes, and the share of training rows that
followed for an unknown one. With a probability ``t`` of being known, the product over all features but
one is a polynomial in ``t``, and its integral from 0 to 1 is that feature's Shapley weight of the leaf; a few
Gauss-Legendre points give the integral exactly.

A tree is walked once down and once up, a level at a time for a block of rows: down, each
node multiplies its parent's products by its own feature's factor, in place of the factor that feature had higher up;
up, the leaves' products are summed, and every edge takes what its feature decides below it. Work is nodes
times points, memory one tree and a block of rows. Trees are read from the saved model, packed one by one in
tasks, and sent to the rows in groups of about ``GROUP_NODES`` nodes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.learning.random_cuts import RandomCutsModel
from nocturne.runtime import scratch_path

PACKED = "tree int, size long, base double, packed binary"
#: Nodes sent to the tasks together; a larger tree is sent alone.
GROUP_NODES = 400_000
#: Nodes times rows that a task walks, where there are several groups.
TASK_NODES = 400_000_000
#: Numbers of a block of rows that a walk holds: nodes times points times rows.
BLOCK_NUMBERS = 2_000_000


def pack_tree(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """A tree as arrays over its nodes, a level after the other; node 0 is the root.

    ``nodes``: id, left, right, feature, threshold, categories (or null), weight, positive.
    """
    nodes = nodes.set_index("id").sort_index()
    ids, levels, level = [], [], np.array([nodes.index[0]])
    while len(level):
        ids.append(level)
        levels.append(len(level))
        inner = nodes.loc[level, ["left", "right"]].to_numpy()
        level = inner[inner[:, 0] >= 0].reshape(-1)
    order = np.concatenate(ids)
    nodes = nodes.loc[order]
    inner = nodes["left"].to_numpy() >= 0
    n = len(order)
    parent = np.full(n, -1, np.int64)
    parent[1:] = np.repeat(np.flatnonzero(inner), 2)  # children stand in their parents' order
    split = np.maximum(parent, 0)
    feature = nodes["feature"].to_numpy()[split].astype(np.int64)
    feature[0] = -1
    weight = nodes["weight"].to_numpy(float)
    share = weight / weight[split]
    ends = np.r_[0, np.cumsum(levels)]
    # nearest edge above that asks for the same feature
    last = np.full((1, int(feature.max(initial=0)) + 1), -1, np.int64)
    above = np.full(n, -1, np.int64)
    for low, high, start in zip(ends[1:-1], ends[2:], ends[:-2], strict=True):
        last = last[parent[low:high] - start]
        at = np.arange(high - low)
        above[low:high] = last[at, feature[low:high]]
        last[at, feature[low:high]] = np.arange(low, high)
        share[low:high] *= np.where(above[low:high] >= 0, share[above[low:high]], 1.0)
    deepest = 0
    count = np.zeros(n, np.int64)
    for low, high in zip(ends[1:-1], ends[2:], strict=True):
        count[low:high] = count[parent[low:high]] + (above[low:high] < 0)
        deepest = max(deepest, int(count[low:high].max()))
    sets = nodes["categories"].tolist()
    return {
        "ends": ends,
        "parent": parent,
        "feature": feature,
        "above": above,
        "share": share,
        "first": np.where(inner, 2 * np.cumsum(inner) - 1, -1),
        "left": np.r_[False, np.arange(1, n) % 2 == 1],
        "threshold": nodes["threshold"].to_numpy(float)[split],
        "categories": {int(k): np.array(s, float) for k, s in enumerate(sets) if s is not None and inner[k]},
        "leaf": ~inner,
        "value": (nodes["positive"].to_numpy(float) / weight),
        "features_on_a_path": np.array(deepest),
    }


def expected(tree: dict[str, np.ndarray]) -> float:
    """The tree's value when nothing is known."""
    share = np.where(tree["parent"] < 0, 1.0, tree["share"] / np.where(tree["above"] >= 0, tree["share"][tree["above"]], 1.0))
    for low, high in zip(tree["ends"][1:-1], tree["ends"][2:], strict=True):
        share[low:high] *= share[tree["parent"][low:high]]
    return float((share * tree["value"])[tree["leaf"]].sum())


def points_of(tree: dict[str, np.ndarray]) -> int:
    """Points at which the integrals over the tree's paths are exact."""
    return max(1, (int(tree["features_on_a_path"]) + 1) // 2)


def _passes(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Nodes x rows: whether the row goes from the parent to the node, for every node but the root."""
    column = x[:, np.maximum(tree["feature"], 0)].T
    goes_left = column <= tree["threshold"][:, None]
    for node, held in tree["categories"].items():
        children = slice(tree["first"][node], tree["first"][node] + 2)
        goes_left[children] = np.isin(column[children], held)
    return goes_left == tree["left"][:, None]


def tree_shapley(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Rows x features: what each feature adds to the tree's value."""
    rows, width = x.shape
    out = np.zeros((width, rows))
    parent, above, feature, ends = tree["parent"], tree["above"], tree["feature"], tree["ends"]
    n = len(parent)
    if n == 1:
        return out.T
    points, weights = np.polynomial.legendre.leggauss(points_of(tree))
    t, weights = (points + 1) / 2, weights / 2
    passed = _passes(tree, x)
    passed[0] = True
    for low, high in zip(ends[1:-1], ends[2:], strict=True):
        passed[low:high] &= np.where(above[low:high, None] >= 0, passed[above[low:high]], True)
    absent = tree["share"][:, None, None] * (1 - t)  # nodes x 1 x points
    factor = absent + passed[:, :, None] * t
    product = np.empty((n, rows, len(t)))
    product[0] = 1.0
    for low, high in zip(ends[1:-1], ends[2:], strict=True):
        here = np.arange(low, high)
        product[here] = product[parent[here]] * factor[here]
        again = here[above[here] >= 0]
        product[again] /= factor[above[again]]
    below = product  # from here on: sums of the leaves below, from the last level up
    below *= np.where(tree["leaf"], tree["value"], 0.0)[:, None, None]
    for low, high in reversed(list(zip(ends[1:-1], ends[2:], strict=True))):
        pairs = np.arange(low, high, 2)
        below[parent[pairs]] = below[pairs] + below[pairs + 1]
    own = below.copy()
    again = np.flatnonzero(above >= 0)
    if len(again):
        again = again[np.argsort(above[again], kind="stable")]
        starts = np.flatnonzero(np.r_[True, np.diff(above[again]) != 0])
        own[above[again[starts]]] -= np.add.reduceat(below[again], starts, axis=0)
    own /= factor
    change = (passed - tree["share"][:, None]) * (own @ weights)
    order = 1 + np.argsort(feature[1:], kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(feature[order]) != 0])
    out[feature[order[starts]]] = np.add.reduceat(change[order], starts, axis=0)
    return out.T


def packed_trees(df: DataFrame, model: Model) -> DataFrame:
    """``tree, size, base, packed`` of a fitted forest or single tree, from its saved form."""
    spark = df.sparkSession
    if isinstance(model, RandomCutsModel):
        trees = [pack_tree(nodes) for nodes in model.tables()]
        rows = [(k, len(tree["parent"]), expected(tree), pickle.dumps(tree)) for k, tree in enumerate(trees)]
        return spark.createDataFrame(rows, PACKED)
    path = scratch_path(spark, "forest")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    single = isinstance(model, DecisionTreeClassificationModel)
    nodes = stored.select(F.lit(0).alias("treeID"), "*") if single else stored.select("treeID", "nodeData.*")
    listed, sets = F.col("split.leftCategoriesOrThreshold"), F.col("split.numCategories") >= 0
    nodes = nodes.select(
        F.col("treeID").alias("tree"),
        "id",
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.coalesce(F.when(~sets, F.get(listed, F.lit(0))), F.lit(0.0)).alias("threshold"),
        F.when(sets, listed).alias("categories"),
        F.aggregate("impurityStats", F.lit(0.0), lambda a, v: a + v).alias("weight"),
        F.coalesce(F.get("impurityStats", F.lit(1)), F.lit(0.0)).alias("positive"),
    )

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        tree = pack_tree(table.drop_columns(["tree"]).to_pandas())
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.int32()),
            "size": pa.array([table.num_rows], pa.int64()),
            "base": pa.array([expected(tree)], pa.float64()),
            "packed": pa.array([pickle.dumps(tree)], pa.binary()),
        })

    trees = nodes.groupBy("tree").applyInArrow(pack, PACKED)
    return _kept(trees)


def _groups(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Trees, by number and size, in groups of about ``GROUP_NODES`` nodes."""
    groups, room = [], 0
    for tree, size in sizes:
        if not groups or size > room:
            groups.append([])
            room = GROUP_NODES
        groups[-1].append(tree)
        room -= size
    return groups


def forest_impacts(df: DataFrame, model: Model, features: str) -> tuple[DataFrame, float]:
    """``df`` with ``impacts array<double>``, and the value that impacts add to.

    Together they are the class-1 probability. A forest of several groups takes a pass of the
    rows for each, which adds to what the pass before it stored; rows are never shuffled by key.
    """
    spark = df.sparkSession
    trees = packed_trees(df, model)
    sizes = [(r["tree"], r["size"]) for r in trees.select("tree", "size").orderBy("tree").collect()]
    base = trees.agg(F.avg("base")).first()[0]
    groups = _groups(sizes)

    def added(rows: DataFrame, group: list[int]) -> DataFrame:
        packed = trees.filter(F.col("tree").isin(group)).select("packed").toLocalIterator()
        shared = spark.sparkContext.broadcast([bytes(r["packed"]) for r in packed])

        @F.pandas_udf("array<double>")
        def walk(vectors: pd.Series, so_far: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x = np.vstack(vectors.to_numpy()).astype(float)
            out = np.zeros_like(x)
            for packed in shared.value:
                tree = pickle.loads(packed)
                step = max(1, BLOCK_NUMBERS // (len(tree["parent"]) * points_of(tree)))
                for at in range(0, len(x), step):
                    out[at : at + step] += tree_shapley(tree, x[at : at + step])
            out /= len(sizes)
            return pd.Series([row if old is None else row + old for row, old in zip(out, so_far, strict=True)])

        return rows.withColumn("impacts", walk(vector_to_array(F.col(features)), F.col("impacts")))

    told = df.withColumn("impacts", F.lit(None).cast("array<double>"))
    if len(groups) > 1:
        told = _kept(told)
        work = told.count() * sum(size for _, size in sizes)
        told = told.repartition(max(told.rdd.getNumPartitions(), -(-work // TASK_NODES)))
    for place, group in enumerate(groups):
        told = added(told, group)
        if place + 1 < len(groups):
            told = _kept(told)
    return told, base


def _kept(rows: DataFrame) -> DataFrame:
    folder = scratch_path(rows.sparkSession, "impacts")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
