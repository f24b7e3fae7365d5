import duckdb
from nocturne.llm import oracles

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages_against_their_definitions(spark):
    """Each stage on what its predecessor kept, against the SQL of its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = dict(pipeline.STAGES)
    assert list(named) == ["language", "near_duplicates", "benchmark", "secrets", "mix"]
    told = named["language"](spark, docs, SF).toPandas()
    assert len(told) == docs.count()  # every given document has letters of a known language
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS FROM '{SF}/benchmark.parquet'")

    def kept_by(query, rule, documents):
        con.register("documents", documents)
        return set(con.execute(f"SELECT doc_id FROM ({oracles.ORACLES[query]}) WHERE {rule}").fetchdf()["doc_id"])

    one = named["near_duplicates"](spark, spark.createDataFrame(told), SF).toPandas()
    assert set(one.doc_id) == kept_by("op10_minhash", "kept", told)
    two = named["benchmark"](spark, spark.createDataFrame(one), SF).toPandas()
    assert set(two.doc_id) == kept_by("op5_decontaminate", "NOT contaminated", one)
    three = named["secrets"](spark, spark.createDataFrame(two), SF).toPandas()
    assert list(three.columns) == docs.columns and set(three.doc_id) == set(two.doc_id)
    assert not kept_by("op2_secrets", "n_assign + n_access + n_hex > 0", three)
    same = two.merge(three, on="doc_id")
    clean = kept_by("op2_secrets", "spans = ''", two)
    assert set(same[same.text_x == same.text_y].doc_id) == clean
    assert (three.n_chars == three.text.str.len()).all()
    four = named["mix"](spark, spark.createDataFrame(three), SF)
    assert four.count() == len(three)
    ran = pipeline.run(spark, SF)
    assert {tuple(r) for r in ran.select("doc_id", "text", "mix_order").collect()} == {
        tuple(r) for r in four.select("doc_id", "text", "mix_order").collect()
    }


def test_odd_rows_pass_through(spark):
    rows = [
        (1, "the cat and the hat " * 20, "en", "s", 3, "own", 0.5),
        (None, "the dog and the fog " * 20, "en", None, None, None, None),
        (3, None, "en", "s", 0, "own", 0.5),
        (4, "1234", "en", "s", 0, "own", 0.5),
        (5, "der hund und die katze password: abcdefghijklmnop " * 9, "de", "s", 9, "own", 0.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, stage_score double")
    names = docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns[: len(names)] == names and (name == "mix" or docs.columns == names)
    assert {r["doc_id"] for r in docs.collect()} == {1, None, 5}
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    """A copy or a contaminated row takes no other row of its id with it, null ids included."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, f"{own(1)} {item}"), (None, own(2)), (None, own(3)), (7, f"{own(4)} {item}"), (7, own(5)), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = dict(pipeline.STAGES)
    left = named["benchmark"](spark, docs, SF)
    assert left.columns == docs.columns
    assert {tuple(r) for r in left.collect()} == {rows[1], rows[2], rows[4], rows[5]}
    rows = [(1, own(1)), (2, own(1)), (2, own(2)), (None, own(1)), (None, own(3))]
    left = named["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_of_equal_rows_one_stays(spark, monkeypatch):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, own(1), "a"), (1, own(1), "b"), (1, own(2), "a"), (2, own(1), "a"), (None, own(3), "a"), (None, own(3), "a"), (4, None, "a"), (4, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    for _ in range(2):
        left = dict(pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()
        assert sorted((r["doc_id"], r["text"]) for r in left if r["text"] and r["doc_id"]) == [(1, own(1)), (1, own(2))]
        assert len(left) == 6 and left[0].__fields__ == docs.columns
        monkeypatch.setattr(pipeline, "counted_broadcast", lambda df: df)
