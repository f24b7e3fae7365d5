import math

import numpy as np
import pytest

from nocturne.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    rows = [(i, v, "x", 1.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, deviation double")


def brute(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    away = n * x - total
    centred = (away / n).astype(float)
    covariance = centred.T @ centred / n
    values, e = np.linalg.eigh(covariance)
    return n, (away * away).sum(axis=1), covariance, values[::-1], e.T[::-1]


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def check(spark, df, vectors, ids, wanted=whitening.COMPONENTS):
    n, deviation, covariance, values, _ = brute(vectors)
    model = whitening.fit(df)
    count = min(wanted, int((values > values[0] * len(values) * 2.0**-52).sum()))
    assert len(model.values) == count
    assert np.allclose(model.values, values[:count], rtol=1e-11)
    assert np.abs(model.vectors @ model.vectors.T - np.eye(count)).max() < 1e-10
    assert np.abs(model.vectors @ covariance - model.vectors * model.values[:, None]).max() < 1e-12 * values[0] * 10
    out = collected(whitening.whiten(df))
    assert sorted(out) == sorted(ids) and all(sorted(r) == list(range(1, count + 1)) for r in out.values())
    centred = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], float)
    centred -= centred.mean(axis=0)
    expected = centred @ (model.vectors / np.sqrt(model.values)[:, None]).T
    for place, i in enumerate(ids):
        for c, r in out[i].items():
            assert r["n"] == n and int(r["deviation"]) == deviation[place]
            assert abs(r["whitened"] - expected[place, c - 1]) < 1e-7
            assert r["explained"] == pytest.approx(values[c - 1] / np.trace(covariance), rel=1e-9)
            assert r["identity_error"] < 1e-6


def test_same_as_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((400, 40)) @ np.diag(np.linspace(3, 0.2, 40)) / 5).tolist()
    odd = [None, [None] * 40, [NAN, *good[0][1:]], [INF, *good[0][1:]], good[1][:39], []]
    df = table(spark, [*good, *odd, good[7], good[7]])
    check(spark, df, [*good, good[7], good[7]], [*range(400), 406, 407])


def test_repeated_eigenvalues_and_flat_directions(spark):
    # a cross: all axes have the same variance, two more dimensions are constant
    cross = [[s if i == k else 0.0 for i in range(10)] + [0.5, 0.25] for k in range(10) for s in (-2.0, 2.0)]
    check(spark, table(spark, cross), cross, list(range(20)))


def test_no_rows_of_no_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0


def test_far_entries_stay_exact(spark):
    far = [[1e300, 0.0, 3.0], [-1e300, 1.0, 2.0], [5.0, 7.0, 1e12]]
    held = [[max(min(c, 2.0**53 / 64), -(2.0**53) / 64) for c in v] for v in far]
    _, deviation, *_ = brute(held)
    out = collected(whitening.whiten(table(spark, far)))
    assert [int(out[i][1]["deviation"]) for i in range(3)] == list(deviation)


def test_inertia_counts_and_intervals():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((30, 30))
    a = a @ a.T
    values = np.linalg.eigvalsh(a)
    at = rng.uniform(0, values[-1], 50)
    assert (whitening.count_above(*whitening.tridiagonal(a), at) == (values[None] > at[:, None]).sum(axis=1)).all()
    cuts = whitening.intervals(a, 12, 4)
    assert sum(n for _, _, n in cuts) >= 12 and all(n == ((values > lo) & (values < hi)).sum() for lo, hi, n in cuts)
    for low, high, inside in cuts:
        found, vectors = whitening.feast(a, low, high, inside)
        assert np.allclose(found, values[(values > low) & (values < high)])
        assert np.allclose(vectors @ a, vectors * found[:, None])


def test_registered_query(spark, sf):
    out = queries.op11_whitening(spark, sf)
    assert dict(out.dtypes)["deviation"] == "bigint" and out.count() == 32 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert out.first()["identity_error"] < 1e-6
