"""Ordered work by slots gives the rows of a plain window, with a key that holds a third of them."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from nocturne.learning.preprocess import stratified_split
from nocturne.operators import fill, labels, metrics, ordered, profile, select, sequences, series, sessions
from nocturne.plans import adapters as a
from nocturne.plans import catalogue as c


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of the readings belong to one SID."""
    readings = a.readings(spark, sf)
    return readings.withColumn("SID", F.when(F.col("reading_id") % 3 == 0, "S0").otherwise(F.col("SID")))


def test_prefix_sums_against_python(spark):
    data = [(k, v, (v * 7) % 5 + 0.5) for k in ("a", None, "b") for v in range(50 if k == "a" else 7)]
    df = spark.createDataFrame(data, "k string, v int, w double")
    slot = -F.floor(F.col("v") / 6)
    got = rows(ordered.running_sums(df, ["k"], [F.col("v").desc()], {"n": F.lit(1), "s": F.col("w")}, slot), "k", "v")
    for key in ("a", None, "b"):
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: -r["v"])
        total = 0.0
        for place, r in enumerate(mine, start=1):
            total += r["w"]
            assert (r["n"], r["s"]) == (place, total)
    assert len(got) == len(data)


def test_downsample(skewed):
    got = rows(series.downsample(skewed, 5, ["SID"], ["ts", "reading_id"]).select("SID", "reading_id"), "SID", "reading_id")
    place = F.row_number().over(Window.partitionBy("SID").orderBy("ts", "reading_id"))
    plain = skewed.withColumn("place", place).filter("(place - 1) % 5 = 0").select("SID", "reading_id")
    assert got == rows(plain, "SID", "reading_id")


def test_trend_change(spark, sf, monkeypatch):
    joined = sessions.scored_sessions(a.sessions(spark, sf), a.predictions(spark, sf)).withColumn(
        "user_id", F.when(F.col("session_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))
    )
    names = ("user_id", "session_id", "l_linenumber", "l_partkey")
    run = lambda: rows(sessions.trend_change(joined, "probability", c.TREND_ORDER).select(*names, "trend_score", "trend_change"), *names)
    window = Window.partitionBy("user_id").orderBy(*c.TREND_ORDER)
    now, before = (F.avg("probability").over(window.rowsBetween(*ends)) for ends in ((-6, 0), (-13, -7)))
    plain = joined.select(*names, now.alias("trend_score"), (now - before).alias("trend_change"))
    whole = run()
    assert whole == rows(plain, *names)
    monkeypatch.setattr(sessions, "in_chunks", lambda *x: ordered.in_chunks(*x, 40))
    assert run() == whole


def test_night_sequences(spark, skewed, sf, monkeypatch):
    people = c.participants_clean(spark, sf).select("SID", "sleep_deprivation_label")
    nights = sequences.with_night_index(sequences.night_features(skewed)).join(people, "SID")
    run = lambda: rows(sequences.night_sequences(nights), "SID", "night_index")
    whole = run()
    monkeypatch.setattr(sequences, "in_chunks", lambda *x: ordered.in_chunks(*x, 15))
    assert run() == whole and whole
    per_sid = {}
    for r in rows(nights.dropna(subset=list(sequences.NIGHT_FEATURES))):
        per_sid[r["SID"]] = per_sid.get(r["SID"], 0) + 1
    assert len(whole) == sum(max(n - 7, 0) for n in per_sid.values())


def test_sequence_counts(spark):
    names = ", ".join(f"{f} double" for f in sequences.NIGHT_FEATURES)
    data = [
        (sid, i, *[float(i)] * 8, i % 2) for sid, n in (("a", 5), ("b", 7), ("c", 8), ("d", 10)) for i in range(n)
    ]
    df = spark.createDataFrame(data, f"SID string, night_index int, {names}, sleep_deprivation_label int")
    got = rows(sequences.night_sequences(df), "SID", "night_index")
    assert [(r["SID"], r["night_index"]) for r in got] == [("c", 7), ("d", 7), ("d", 8), ("d", 9)]
    assert [s["HR_mean"] for s in got[-1]["sequence"]] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    assert got[-1]["sleep_deprivation_label"] == 1


def test_roc_auc_against_pairs(spark):
    data = [(i % 3 == 0, (i * 7 % 11) / 11) for i in range(60)]
    df = spark.createDataFrame([(int(y), s) for y, s in data], "sleep_deprivation_label_gt int, probability_sleep_deprivation double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()["AUC_ROC"] == pytest.approx(wins)
    single = df.filter("sleep_deprivation_label_gt = 1")
    assert metrics.roc_auc(single).first()["AUC_ROC"] is None


def test_medians_and_quartiles(spark, sf):
    people = c.participants(spark, sf)
    names = fill.numeric_columns(people)
    kept = [r["AHI"] for r in people.collect() if r["AHI"] is not None]
    assert fill.fit_medians(people, ["AHI"])["AHI"] == statistics.median(kept)
    got = {r["column"]: [r[f"q{q}"] for q in (25, 50, 75)] for r in rows(profile.describe_numeric(people, names))}
    exact = people.agg(*[F.percentile(f"`{n}`", [0.25, 0.5, 0.75]).alias(n) for n in names]).first()
    assert got == {n: pytest.approx(exact[n]) for n in names}


@pytest.mark.parametrize("limits", [(10_000, 128), (300, 16), (3, 2), (1, 4)])
def test_order_statistics(spark, monkeypatch, limits):
    monkeypatch.setattr(select, "READ", limits[0])
    monkeypatch.setattr(select, "PIVOTS", limits[1])
    rng = random.Random(limits[0])
    draw = [lambda: rng.random() * 1e-9, lambda: rng.choice([0.0, 1.0]), lambda: rng.gauss(1e12, 3.0), lambda: 5.0, lambda: 10.0 ** rng.randint(-300, 300)]
    data = [tuple(None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else d() for d in draw) + (None,) for _ in range(700)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double")
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = select.quantiles(df, df.columns, points)
    for k, name in enumerate(df.columns):
        held = [r[k] for r in data if r[k] is not None and r[k] == r[k]]
        assert got[name] == (pytest.approx(list(np.quantile(held, points)), rel=1e-12) if held else [None] * 5)


def test_ranks_of_texts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(select, "READ", 2)
    monkeypatch.setattr(select, "PIVOTS", 3)
    texts = [f"S{i % 90:03d}" for i in range(200)] + ["S005"] * 300
    cells = spark.createDataFrame([(0, t) for t in texts] + [(4, "x")], "search int, value string")
    for rank in (0, 7, 250, 499):
        assert select.pick_ranks(cells, {0: rank, 4: 0, 7: 3}) == {0: sorted(texts)[rank], 4: "x"}
    assert select.pick_ranks(cells, {0: 500}) == {} and select.pick_ranks(cells, {}) == {}


def test_severity_cut(spark):
    base = "SID string, OAHI double, AHI double, `Arousal Index` double, Sleep_Disorders string, MEDICAL_HISTORY string"
    people = spark.createDataFrame([(f"S{i:02d}", float(i // 4), 1.0, 1.0, None, None) for i in range(21)], base)
    got = rows(labels.severity_label(people), "SID")
    score = {r["SID"]: r["severity"] for r in rows(labels.with_severity(people))}
    order = sorted(score, key=lambda s: (-score[s], s))
    assert {r["SID"] for r in got if r["sleep_deprivation_label"]} == set(order[:10])
    assert [r["sleep_deprivation_label"] for r in labels.severity_label(people.limit(1)).collect()] == [0]


def test_stratified_split(spark, sf):
    people = c.participants_clean(spark, sf)
    got = rows(stratified_split(people, "sleep_deprivation_label").select("SID", "is_test"), "SID")
    draw = F.md5(F.concat("SID", F.lit("#42")))
    window = Window.partitionBy("sleep_deprivation_label")
    cut = F.floor(F.count("*").over(window) * 0.4 + 0.5)
    plain = people.withColumn("place", F.row_number().over(window.orderBy(draw, "SID"))).select("SID", (F.col("place") <= cut).alias("is_test"))
    assert got == rows(plain, "SID")


def test_fill_keeps_all_missing_columns_and_one_row(spark):
    df = spark.createDataFrame([(1.0, None, None), (float("nan"), None, "x"), (3.0, None, "y")], "a double, b double, t string")
    fitted = fill.fit_fill(df)
    assert fitted["numbers"] == {"a": 2.0}
    assert [tuple(r) for r in fill.apply_fill(df, fitted).collect()] == [(1.0, None, "Unknown"), (2.0, None, "x"), (3.0, None, "y")]
    assert fill.apply_fill(df.limit(2).filter("isnan(a)"), fitted).first()["a"] == 2.0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, None, 9.0)], "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in profile.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and got[("b", "c")] == pytest.approx(1.0) and got[("c", "b")] == got[("b", "c")]
    assert len(got) == 9


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "x double")
    got = rows(profile.histogram(df, "x"), "bin")
    assert [r["n"] for r in got] == [1] * 7 + [2] and got[-1]["bin_high"] == 8.0
    flat = profile.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x")
    assert sorted((r["bin_low"], r["n"]) for r in flat.collect())[0][0] == 4.5 and flat.agg(F.sum("n")).first()[0] == 2
