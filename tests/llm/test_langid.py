import math
import random

import numpy as np
from pyspark.sql import functions as F

from nocturne.llm import langid, queries


def test_held_out_accuracy(spark):
    out = queries.op8_langid(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.98


def test_counts_equal_brute_force(spark):
    rows = [("ab ab", "x"), ("ba é", "y"), ("aab", "x"), (None, "x"), ("zz", None), ("", "y")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), smoothing=0.5)
    assert model.languages == ["x", "y"]
    for k, lang in enumerate(model.languages):
        held = [0] * langid.BUCKETS
        for text, own in rows:
            if own == lang and text:
                for grams in langid._grams(text.lower()):
                    for g in grams:
                        held[g] += 1
        total = sum(held) + 0.5 * langid.BUCKETS
        assert all(abs(model.log_prob[k, b] - math.log((held[b] + 0.5) / total)) < 1e-4 for b in range(0, langid.BUCKETS, 97))


def test_blocks_do_not_change_grams(monkeypatch):
    whole = sorted(int(g) for part in langid._grams("the quick brown fox é𝄞") for g in part)
    monkeypatch.setattr(langid, "_BLOCK_CHARS", 4)
    assert sorted(int(g) for part in langid._grams("the quick brown fox é𝄞") for g in part) == whole


def test_batches_score_like_single_texts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc é𝄞ñ"), rng.integers(1, 60))) for _ in range(50)]
    grams, starts = langid.batch_grams(texts)
    ends = [*starts[1:], len(grams)]
    table = rng.normal(size=(5, langid.BUCKETS)).astype(np.float32)
    wanted = []
    for text, low, high in zip(texts, starts, ends):
        own = np.concatenate(list(langid._grams(text)))
        assert sorted(own) == sorted(grams[low:high])
        wanted.append(table[:, own].sum(axis=1, dtype=np.float64))
    for limit in (4_000_000, 200, 1):
        monkeypatch.setattr(langid, "GATHERED", limit)
        assert np.allclose(langid.summed(table, grams, starts), wanted, atol=1e-4)


def test_a_hundred_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD_LANGS", 7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(2)
    word = {k: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for k in range(100)}
    rows = [(" ".join(rng.choice(word[k]) for _ in range(40)), f"l{k:02d}") for k in range(100) for _ in range(3)]
    table = spark.createDataFrame(rows, "text string, lang string")
    for size in (langid.MATRIX_BYTES, 100 * 4 * 4096):
        model = langid.train(table, matrix_bytes=size)
        assert len(model.languages) == 100 and model.log_prob.nbytes <= size
        assert langid.identify(table, model).filter("lang = lang_pred").count() >= 295


def test_odd_texts_and_clashing_names(spark):
    model = langid.train(spark.createDataFrame([("the and of", "en"), ("der die und", "de")], "text string, lang string"))
    rows = [(1, None, 5.0), (2, "", 5.0), (3, "123 !?", 5.0), (None, "der und", 5.0), (5, "the of", 5.0), (5, "the of", 5.0), (6, "die " * 60_000, 5.0)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    found = [(r["doc_id"], r["lang_pred"]) for r in out]
    assert found == [(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en"), (5, "en"), (6, "de")]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_to_learn(spark):
    model = langid.train(spark.createDataFrame([], "text string, lang string"))
    out = langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()
    assert (out["lang_pred"], out["score"]) == ("und", 0.0)
