import math

import numpy as np

from nocturne.llm import negatives

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    held = [(*r, "s", 9) for r in rows]
    return spark.createDataFrame(held, "vec_id long, embedding array<double>, label int, score string, place int")


def brute(rows, every=100):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    lengths = [len(v) for _, v, _ in good]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    good = [(i, np.array([math.floor(256 * max(min(c, 2**18), -(2**18))) for c in v], object), label) for i, v, label in good if len(v) == usual]
    out = []
    for i, x, label in good:
        if i % every:
            continue
        others = [(-int((x * y).sum()) if len(x) else 0, j, other) for j, y, other in good if j != i]
        positives = sorted((s, j) for s, j, other in others if other == label)[:5]
        for p, j in positives:
            fits = sorted((s, k) for s, k, other in others if other != label and -30 * p <= -100 * s <= -90 * p)[:10]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, **more):
    return sorted(map(tuple, negatives.hard_negatives(table(spark, rows), **more).collect()))


def clustered(rng, n, centres, length=16, noise=0.25):
    middles = rng.standard_normal((centres, length))
    x = middles[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, length))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 60)
    monkeypatch.setattr(negatives, "SEED_ROWS", 200)
    monkeypatch.setattr(negatives, "CELL", 256)
    monkeypatch.setattr(negatives, "PACK", 3)
    rng = np.random.default_rng(5)
    rows = clustered(rng, 1500, 12)
    rows += [(2000 + i, rows[3][1], i % 4) for i in range(300)]  # one vector many times
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(6)
    rows = clustered(rng, 150, 3, 5)
    rows += [rows[100], rows[100], rows[7], (None, rows[1][1], 1), (200, None, 1), (300, rows[2][1], None), (400, [NAN] * 5, 1)]
    rows += [(500, [INF] * 5, 2), (600, [None] * 5, 2), (700, [1.0], 2), (800, [], 2), (900, [1e9, -1e9, 0.0, 1.0, 2.0], 2), (-100, rows[9][1], 3)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 0.0], 1)]) == []
    assert run(spark, [(0, [], 1), (1, [], 2)]) == []


def test_packs_meet_blocks_by_a_shuffle(spark, monkeypatch):
    """A pack for each leaf an anchor may meet: of 6 GB of vectors they filled the driver when Spark broadcast them."""
    plans, stored = [], negatives.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, label)

    monkeypatch.setattr(negatives, "stored", seen)
    rows = clustered(np.random.default_rng(8), 400, 4, 5)
    found = negatives.hard_negatives(table(spark, rows), "vec_id % 10 = 0")
    plans.append(found._jdf.queryExecution().toString())
    searches = [p.split("Physical Plan")[1] for p in plans if "anchor_group" in p]
    assert len(searches) == 4  # the first share and the whole, for positives and for negatives
    for plan in searches:
        assert "SortMergeJoin [leaf" in plan and "BroadcastHashJoin [leaf" not in plan
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)


def test_siblings_are_passed_over():
    rng = np.random.default_rng(7)
    rows = clustered(rng, 4000, 30, 8, 0.03)
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    tree = negatives.grow(x, len(x), 100)
    leaf, distances = negatives._descend(x, tree)
    known = negatives.Ranges(*[[] for _ in range(4)], [0] * tree.leaves)
    for number, node in enumerate(tree.nodes):
        m = len(node.children)
        for part in (known.low, known.high):
            part.append(np.zeros((m, m)))
        for part in (known.low_norm, known.high_norm):
            part.append(np.zeros(m))
        for child in range(m):
            mine = np.isin(leaf, [k for k, path in enumerate(tree.paths) if (number, child) in path])
            d = negatives.squared_distances(x[mine], node.points)
            norms = (x[mine] ** 2).sum(axis=1)
            known.low[number][child], known.high[number][child] = d.min(axis=0), d.max(axis=0)
            known.low_norm[number][child], known.high_norm[number][child] = norms.min(), norms.max()
    anchors = x[::50]
    scores = anchors @ x.T
    top = np.sort(scores, axis=1)[:, -8:]
    low, high = top[:, :1], top[:, -1:]
    visited = np.zeros((len(anchors), tree.leaves), bool)
    for number, mine in negatives.surviving(anchors, low, high, tree, known):
        visited[mine, number] = True
    a, b = np.nonzero((scores >= low) & (scores <= high))
    assert visited[a, leaf[b]].all()  # nothing is lost
    assert visited.mean() < 0.5 and tree.leaves > 20
