"""Hard negatives by exact search in a multiway hyperplane tree with distance ranges.

The tree is a GNAT: a node holds a few split points, and a vector belongs to the child of its
nearest one, so hyperplanes between split points cut the space. Split points come from a
bounded sample (``SAMPLE`` rows); every row is put into its leaf, and every leaf stores, over
all its rows, the range of the distances to each split point on its path and of the norms.
A subtree's ranges are those of its leaves. Rows are packed into blocks of one leaf inside the task that
read them, so a leaf with a third of the rows is many blocks.

A search window is a range of inner products. With the norms of a subtree it becomes an
annulus around the anchor; by the triangle inequality it limits the distance to each split
point, and a sibling whose range does not meet that limit is passed over with all below it.
What is left are pairs of anchor and leaf. Anchors of a leaf are packed as well, packs and
blocks meet by an equi-join on leaf, part and group of anchors (``CELL`` rows on either side,
so no cell grows with the data), and a pair of pack and block is one exact integer matrix product. A task keeps the best
``k`` of each window. Before the full search a share of the blocks is searched: the k-th score found there
narrows the window for the full search, which loses nothing, as ties stay inside.

First the positives (window without limits, same label), then the negatives (a window for
each positive, other labels). Tasks hold at most a pack, a block and bounded lists.

Defined cases: rows with a null id, null label, null vector, a null or non-finite entry, or a vector of another
length than the most frequent one take no part. Entries are held within 2**26 after scaling, so that a score fits a
long. Scores tie by id. Rows that share an anchor's id are not other rows; rows
that repeat count each; an anchor row that repeats is searched each time. No positive: no
rows; a positive whose window is empty (its score is negative): none. Empty table: none. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.llm.tables import stored
from nocturne.llm.vectors import common_length, exact_product, matrix, scaled, usable

SCALE = 256
LIMIT = 1 << 26
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percentages of the positive's.
LEAST, MOST = 30, 90

#: Rows from which the split points are chosen; they bound the tree, all rows are indexed.
SAMPLE = 4096
#: Split points of a node.
WAYS = 8
#: Rows of a leaf that the tree aims at, as far as the sample carries it.
LEAF_ROWS = 2048
#: Rows of a block, anchors of a pack.
BLOCK, PACK = 2048, 512
#: Rows, and anchors, of a cell of the join.
CELL = 131_072
#: Share of the rows searched first, and the rows that share has at least.
SEED_SHARE, SEED_ROWS = 1 / 32, 4096
#: Candidates that a task holds before it cuts them to the best of each window.
HELD = 400_000
FAR = 1 << 61


class Node(NamedTuple):
    points: np.ndarray
    #: Node or leaf numbers; a leaf is stored as ``-1 - leaf``.
    children: list[int]


class Tree(NamedTuple):
    nodes: list[Node]
    leaves: int
    #: Path of each leaf: (node, child) from the root.
    paths: list[list[tuple[int, int]]]

    @property
    def depth(self) -> int:
        return max(map(len, self.paths))


def points(df: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int, int]:
    """Rows that take part as ``vec_id, label, x``, the length of ``x``, and their number."""
    held = df.filter(F.col(vector_id).isNotNull() & F.col(label).isNotNull() & usable(vector))
    length, n = common_length(held, vector)
    x = scaled(vector, SCALE, LIMIT).cast("array<int>")
    rows = held.filter(F.size(vector) == length)
    return rows.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x")), length, n


def squared_distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    norms = lambda m: np.einsum("ij,ij->i", m, m)
    return norms(x)[:, None] + norms(p)[None] - 2 * exact_product(x, p.T)


def _spread(sample: np.ndarray, ways: int) -> np.ndarray:
    """Split points far from each other, greedily; fewer if the sample has fewer different rows."""
    chosen = [int(np.argmax(squared_distances(sample, sample[:1])[:, 0]))]
    nearest = squared_distances(sample, sample[chosen])[:, 0]
    while len(chosen) < ways and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared_distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def grow(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, ways: int = WAYS) -> Tree:
    """A tree over ``rows`` rows shaped by their ``sample``."""
    nodes: list[Node] = []
    paths: list[list[tuple[int, int]]] = []
    weight = rows / max(len(sample), 1)

    def add(held: np.ndarray, path: list[tuple[int, int]]) -> int:
        splits = _spread(held, ways) if len(held) * weight > leaf_rows and len(held) >= 2 * ways else held[:0]
        if len(splits) < 2:
            paths.append(path)
            return -len(paths)
        number = len(nodes)
        nodes.append(Node(splits, []))
        nearest = squared_distances(held, splits).argmin(axis=1)
        for child in range(len(splits)):
            nodes[number].children.append(add(held[nearest == child], [*path, (number, child)]))
        return number

    add(sample, [])
    return Tree(nodes, len(paths), paths)


def _descend(x: np.ndarray, tree: Tree, ways: int = WAYS) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each row and its squared distances to the split points of its path (-1 where there is none)."""
    leaf = np.zeros(len(x), np.int64)
    distances = np.full((len(x), max(tree.depth, 1), ways), -1, np.int64)
    work = [(0, 0, np.arange(len(x)))] if tree.nodes else []
    while work:
        number, level, at = work.pop()
        node = tree.nodes[number]
        found = squared_distances(x[at], node.points)
        distances[at, level, : found.shape[1]] = found
        nearest = found.argmin(axis=1)
        for child, below in enumerate(node.children):
            mine = at[nearest == child]
            if len(mine) and below < 0:
                leaf[mine] = -1 - below
            elif len(mine):
                work.append((below, level + 1, mine))
    return leaf, distances.reshape(len(x), -1)


_BLOCKS = (
    "leaf int, part long, seed boolean, size int, ids binary, labels binary, vectors binary, low_norm long, high_norm long, "
    "lows array<long>, highs array<long>"
)


def index(rows: DataFrame, length: int, n: int, tree: Tree) -> DataFrame:
    """All rows in blocks of one leaf, with ranges, over rows of that leaf, of norms and distances to the path's split points."""
    share = min(1.0, max(SEED_SHARE, SEED_ROWS / max(n, 1)))

    def block(leaf: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, known: dict) -> dict:
        draw = int(np.bitwise_xor.reduce((ids.view(np.uint64) + np.uint64(leaf + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16))
        return {
            "leaf": leaf,
            "part": draw >> 16,
            "seed": (draw & 0xFFFF) < share * 65536,
            "size": len(ids),
            "ids": ids.tobytes(),
            "labels": labels.tobytes(),
            "vectors": x.tobytes(),
            **known,
        }

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, count = None, {}, 0

        def flush(leaf: int) -> Iterator[pa.RecordBatch]:
            ids, labels, x, lows, highs = (np.concatenate(c) for c in zip(*held.pop(leaf), strict=True))
            (low_norm, *lows), (high_norm, *highs) = lows.min(axis=0).tolist(), highs.max(axis=0).tolist()
            known = {"low_norm": low_norm, "high_norm": high_norm, "lows": lows, "highs": highs}
            for at in range(0, len(ids), BLOCK):
                cut = slice(at, at + BLOCK)
                made = block(leaf, ids[cut], labels[cut], x[cut], known)
                yield pa.RecordBatch.from_pylist([made], schema)

        schema = pa.schema(
            [("leaf", pa.int32()), ("part", pa.int64()), ("seed", pa.bool_()), ("size", pa.int32())]
            + [(c, pa.binary()) for c in ("ids", "labels", "vectors")]
            + [("low_norm", pa.int64()), ("high_norm", pa.int64())]
            + [(c, pa.list_(pa.int64())) for c in ("lows", "highs")]
        )
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = matrix(batch.column(2), length)
            leaf, distances = _descend(x, tree)
            far = np.c_[np.einsum("ij,ij->i", x, x), distances]  # a task holds their ranges, not a row's own
            order = np.argsort(leaf, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                if len(mine):
                    of = far[mine]
                    piece = ids[mine], labels[mine], x[mine].astype(np.int32), of.min(axis=0, keepdims=True), of.max(axis=0, keepdims=True)
                    held.setdefault(int(leaf[mine[0]]), []).append(piece)
            count += len(ids)
            if count > 16 * BLOCK * 8:  # so much a task holds
                for number in list(held):
                    yield from flush(number)
                count = 0
        for number in list(held):
            yield from flush(number)

    return stored(rows.mapInArrow(pack, _BLOCKS), "negatives-blocks")


class Ranges(NamedTuple):
    """Per child of each node: ranges of squared distances to the node's split points, and of squared norms."""

    low: list[np.ndarray]
    high: list[np.ndarray]
    low_norm: list[np.ndarray]
    high_norm: list[np.ndarray]
    #: Rows of each leaf.
    sizes: list[int]


def ranges(blocks: DataFrame, tree: Tree) -> Ranges:
    """Ranges over all rows: a fixed number of sums for each leaf, joined up the tree."""
    width = max(tree.depth, 1) * WAYS
    bounds = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("lows", F.min), ("highs", F.max)) for k in range(width)]
    by_leaf = blocks.groupBy("leaf").agg(
        F.sum("size").alias("rows"), F.min("low_norm").alias("low_norm"), F.max("high_norm").alias("high_norm"), *bounds
    )
    none = lambda value: [np.full((len(n.children), len(n.children)), value) for n in tree.nodes]
    row = lambda value: [np.full(len(n.children), value) for n in tree.nodes]
    out = Ranges(none(np.inf), none(-np.inf), row(np.inf), row(-np.inf), [0] * tree.leaves)
    for r in by_leaf.collect():
        out.sizes[r["leaf"]] = r["rows"]
        for level, (node, child) in enumerate(tree.paths[r["leaf"]]):
            for k in range(len(tree.nodes[node].children)):
                at = level * WAYS + k
                out.low[node][child, k] = min(out.low[node][child, k], r[f"lows{at}"])
                out.high[node][child, k] = max(out.high[node][child, k], r[f"highs{at}"])
            out.low_norm[node][child] = min(out.low_norm[node][child], r["low_norm"])
            out.high_norm[node][child] = max(out.high_norm[node][child], r["high_norm"])
    return out


def surviving(x: np.ndarray, low: np.ndarray, high: np.ndarray, tree: Tree, known: Ranges) -> Iterator[tuple[int, np.ndarray]]:
    """``leaf, anchors``: which rows of ``x`` may have a partner there with a score in one of their windows."""
    norms = np.einsum("ij,ij->i", x, x).astype(float)
    work = [(0, np.arange(len(x)))] if tree.nodes else []
    if not tree.nodes:
        yield 0, np.flatnonzero((low <= high).any(axis=1))
    while work:
        number, at = work.pop()
        node = tree.nodes[number]
        away = np.sqrt(squared_distances(x[at], node.points).astype(float))
        slack = 1e-6 * (1 + away)
        for child, below in enumerate(node.children):
            if known.low_norm[number][child] > known.high_norm[number][child]:
                continue  # no row there
            # scores of the window to distances from the anchor, with the norms of this subtree
            near = norms[at, None] + known.low_norm[number][child] - 2.0 * high[at]
            far = norms[at, None] + known.high_norm[number][child] - 2.0 * low[at]
            open_ = (low[at] <= high[at]) & (far >= 0)
            near, far = np.sqrt(np.maximum(near, 0)), np.sqrt(np.maximum(far, 0))
            for k in range(away.shape[1]):
                to = away[:, k, None]
                inner, outer = np.sqrt(known.low[number][child, k]), np.sqrt(known.high[number][child, k])
                room = slack[:, k, None]
                open_ &= (outer + room >= np.maximum(to - far, near - to)) & (inner - room <= to + far)
            mine = at[open_.any(axis=1)]
            if len(mine) and below < 0:
                yield -1 - below, mine
            elif len(mine):
                work.append((below, mine))


class Index(NamedTuple):
    blocks: DataFrame
    length: int
    tree: Tree
    known: Ranges
    #: Groups that the anchors are cut into.
    groups: int


_PACKS = (
    "leaf int, part long, anchor_group long, keys binary, anchor_ids binary, anchor_labels binary, "
    "anchor_vectors binary, low binary, high binary"
)


def _route(anchors: DataFrame, held: Index) -> DataFrame:
    """Anchors in packs, one for each leaf (and part of it) that their windows can meet."""
    length, groups = held.length, held.groups
    # plain values: a class of this package would have to be on the workers to be read there
    plain = ([tuple(node) for node in held.tree.nodes], *held.tree[1:]), tuple(held.known)
    shared = anchors.sparkSession.sparkContext.broadcast(plain)
    schema = pa.schema(
        [("leaf", pa.int32()), ("part", pa.int64()), ("anchor_group", pa.int64())]
        + [(c, pa.binary()) for c in ("keys", "anchor_ids", "anchor_labels", "anchor_vectors", "low", "high")]
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (nodes, *rest), known = shared.value
        tree, known = Tree([Node(*node) for node in nodes], *rest), Ranges(*known)
        for batch in batches:
            keys, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = matrix(batch.column(3), length)
            low, high = (matrix(batch.column(k), len(batch.column(k).flatten()) // max(len(keys), 1)) for k in (4, 5))
            for leaf, mine in surviving(x, low, high, tree, known):
                for group in range(groups):
                    own = mine[keys[mine] % groups == group]
                    for at in range(0, len(own), PACK):
                        cut = own[at : at + PACK]
                        columns = [keys[cut], ids[cut], labels[cut], x[cut].astype(np.int32), low[cut], high[cut]]
                        packed = [pa.array([c.tobytes()], pa.binary()) for c in columns]
                        for part in range(max(1, -(-known.sizes[leaf] // CELL))):
                            where = [pa.array([v], f.type) for v, f in zip((leaf, part, group), schema, strict=False)]
                            yield pa.RecordBatch.from_arrays([*where, *packed], schema=schema)

    return anchors.select("anchor", "vec_id", "label", "x", "low", "high").mapInArrow(route, _PACKS)


_FOUND = "anchor long, place int, vec_id long, score long"


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Rows (anchor, place, score, id) cut to the ``k`` best of each anchor and place."""
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    starts = np.flatnonzero(fresh)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[rank < k]


def search(anchors: DataFrame, held: Index, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each window as ``anchor, place, vec_id, score, rank``.

    ``anchors(anchor, vec_id, label, x, low, high)``: ``low`` and ``high`` are arrays of one length, a window at
    each place. ``same``: partners have the anchor's label, else another one. A share of the blocks comes first, then
    all with the windows that leaves.
    """
    first = stored(_search(anchors, held.blocks.filter("seed"), held, same, k), "negatives-seeds")
    kth = first.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("kth"))
    raised = F.expr("transform(low, (l, i) -> greatest(l, coalesce(kth[i], l)))")
    return _search(anchors.join(kth, "anchor", "left").withColumn("low", raised).drop("kth"), held.blocks, held, same, k)


def _search(anchors: DataFrame, blocks: DataFrame, held: Index, same: bool, k: int) -> DataFrame:
    length = held.length

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, count = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                keys, ids, labels, x, low, high, other_ids, other_labels, others = (cell.as_buffer() for cell in row)
                keys, ids, labels, low, high, other_ids, other_labels = (
                    np.frombuffer(c, np.int64) for c in (keys, ids, labels, low, high, other_ids, other_labels)
                )
                x, others = (
                    np.frombuffer(c, np.int32).reshape(m, length).astype(np.int64) for c, m in ((x, len(keys)), (others, len(other_ids)))
                )
                low, high = low.reshape(len(keys), -1), high.reshape(len(keys), -1)
                scores = exact_product(x, others.T)
                fits = ((labels[:, None] == other_labels[None]) == same) & (ids[:, None] != other_ids[None])
                fits &= (scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
                a, b = np.nonzero(fits)
                values = scores[a, b].astype(np.int64)
                for place in range(low.shape[1]):
                    inside = np.flatnonzero((values >= low[a, place]) & (values <= high[a, place]))
                    if len(inside):
                        best.append(np.c_[keys[a[inside]], np.full(len(inside), place), values[inside], other_ids[b[inside]]])
                        count += len(inside)
                    if count > HELD:
                        best = [_best(best, k)]
                        count = len(best[0])
                        if count > HELD // 2:
                            yield table(best[0])
                            best, count = [], 0
        yield table(_best(best, k))

    def table(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 3]), pa.array(rows[:, 2])],
            names=["anchor", "place", "vec_id", "score"],
        )

    sizes = F.array(*[F.lit(max(1, -(-s // CELL))) for s in held.known.sizes])
    last = F.lit(held.groups - 1).cast("long")
    spread = blocks.withColumn("part", F.col("part") % F.get(sizes, F.col("leaf"))).withColumn(
        "anchor_group", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    # packs are many times what the anchors' files let Spark expect; neither side is ever gathered for a broadcast
    met = _route(anchors, held).join(spread.hint("merge"), ["leaf", "part", "anchor_group"])
    pairs = met.select("keys", "anchor_ids", "anchor_labels", "anchor_vectors", "low", "high", "ids", "labels", "vectors")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    return pairs.mapInArrow(score, _FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``df(vec_id, embedding, label)``.

    ``anchor`` says in SQL which rows are anchors.
    """
    rows, length, n = points(df)
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    held = [r["x"] for r in drawn.select("x").limit(SAMPLE).collect()]
    sample = np.array(held, np.int64).reshape(len(held), length)
    tree = grow(sample, n)
    blocks = index(rows, length, n, tree)
    known = ranges(blocks, tree)

    wide = {"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR))}
    chosen = stored(rows.filter(anchor).withColumn("anchor", F.monotonically_increasing_id()).withColumns(wide), "negatives-anchors")
    held = Index(blocks, length, tree, known, max(1, -(-chosen.count() // CELL)))
    near = stored(search(chosen, held, True, positives), "negatives-positives")

    ranked = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score")))  # at most `positives` of an anchor
    asked = near.groupBy("anchor").agg(ranked.alias("positives")).join(chosen.drop("low", "high"), "anchor")
    edges = {
        name: F.expr(f"transform(sequence(0, {positives - 1}), i -> coalesce(({edge}) div 100, {none}L))".replace("SCORE", "get(positives, i).score"))
        for name, edge, none in (
            ("low", f"{LEAST} * SCORE + pmod(-{LEAST} * SCORE, 100L)", FAR),
            ("high", f"{MOST} * SCORE - pmod({MOST} * SCORE, 100L)", -FAR),
        )
    }
    asked = stored(asked.withColumns(edges), "negatives-windows")
    found = search(asked.drop("positives"), held, False, negatives)
    named = found.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    named = named.join(asked.select("anchor", F.col("vec_id").alias("anchor_id"), "positives"), "anchor")
    positive = F.get("positives", F.col("place"))
    return named.select(
        "anchor_id",
        positive["vec_id"].alias("positive_id"),
        "rank",
        "negative_id",
        positive["score"].alias("positive_score"),
        "negative_score",
    )

