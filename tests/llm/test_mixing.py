import pytest

from nocturne.llm import mixing


def docs(spark, counts):
    rows = [(i, s, "x") for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string, block string")


def test_windows_and_deviation(spark):
    weights = {"a": 5, "b": 3, "c": 2}
    out = mixing.mix(docs(spark, {"a": 500, "b": 300, "c": 200}), weights, block_rows=10).toPandas().sort_values("mix_order")
    assert len(out) == 1000 and out.mix_order.is_unique
    assert ((out.release <= out.slot) & (out.slot < out.deadline)).all()
    blocks = out.drop_duplicates("slot")
    for name, weight in weights.items():
        seen = (blocks.source == name).cumsum().to_numpy()
        due = (blocks.slot.to_numpy() + 1) * weight / 10
        assert (abs(seen - due) < 1).all()


def test_hot_source_ranks_are_dense(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    out = mixing.mix(docs(spark, {"a": 900, "b": 3, None: 40}), {"a": 1, "b": 1, "(none)": 1}, block_rows=4).toPandas()
    for _, part in out.groupby(out.source.fillna("(none)")):
        assert sorted(part.source_rank) == list(range(len(part)))


def test_nulls_ties_and_clashing_names(spark):
    rows = [(None, "a", 1, 7), (None, "a", 1, 7), (3, None, 2, 8), (3, None, 2, 8), (4, "a", None, 9)]
    table = spark.createDataFrame(rows, "doc_id long, source string, slot int, mix_source int")
    with pytest.raises(ValueError):
        mixing.mix(table, {"a": 1})
    out = mixing.mix(table.drop("mix_source"), block_rows=2).collect()
    assert len(out) == 5 and len({r["mix_order"] for r in out}) == 5
    assert mixing.mix(table.drop("mix_source").limit(0)).count() == 0


def test_same_order_for_other_partitions(spark):
    table = docs(spark, {"a": 60, "b": 40})
    one = {r["doc_id"]: r["mix_order"] for r in mixing.mix(table, block_rows=3).collect()}
    two = {r["doc_id"]: r["mix_order"] for r in mixing.mix(table.repartition(7), block_rows=3).collect()}
    assert one == two


def test_frequent_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "a" if i % 4 else "b") for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    spread = []
    kept = mixing._spread
    monkeypatch.setattr(mixing, "_spread", lambda *x: spread.append(kept(*x)) or spread[-1])
    out = mixing.mix(table, block_rows=5).toPandas()
    assert len(out) == 1200 and out.mix_order.is_unique
    for _, part in out.groupby("source"):
        assert sorted(part.source_rank) == list(range(len(part)))
    assert spread[0][1].agg({"held": "max"}).first()[0] > 100 and spread[-1][1].agg({"held": "max"}).first()[0] <= 40
    # the null ids and the repeated one lie all over the mix
    assert out[out.doc_id.isna()].mix_order.quantile(0.5) > 0.3 * out.mix_order.max()


def test_more_sources_than_slots(spark):
    counts = {f"s{i:04d}": 1 + i % 3 for i in range(1500)}
    out = mixing.mix(docs(spark, counts), block_rows=1).toPandas()
    assert len(out) == sum(counts.values()) and out.mix_order.is_unique
    assert ((out.release <= out.slot) & (out.slot < out.deadline)).all()


def test_large_weights_become_parts(spark):
    table = docs(spark, {"a": 60, "b": 20})
    out = mixing.mix(table, {"a": 3_000_000, "b": 1_000_000, "none here": 4}, block_rows=1, cycle=40).toPandas()
    assert out[out.mix_order < 40].source.value_counts().to_dict()["a"] in (29, 30)
    assert ((out.release <= out.slot) & (out.slot < out.deadline)).all()
