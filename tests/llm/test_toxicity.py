import math
import random
import re

import pytest
from pyspark.sql import functions as F

from nocturne.llm import queries, toxicity


def test_folding():
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("idіоt") == "idiot" and toxicity.fold("ｉｄｉｏｔ") == "idiot"
    assert toxicity.fold("1234 10.5") == "1234 10.5"
    for one, other in (("c1own", "clown"), ("1oser", "loser"), ("worth1ess", "worthless"), ("dis9usting", "disgusting"), ("u6ly", "ugly"), ("k!ll", "kill"), ("i|literate", "illiterate")):
        assert toxicity.fold(one) == toxicity.fold(other)


def test_score_by_brute_force(spark):
    """Every entry looked for in every word, every phrase in every pair of words."""
    lexicon = toxicity.Lexicon(
        {"ioser": 3.0, "^idio": 2.0, "idiot": 2.5, "^trash": 1.5, "scum": 4.0}, frozenset({"trash can", "pond scum"}), (-2.0, 0.7, 0.3, 1.1)
    )
    rng = random.Random(7)
    words = ["loser", "L0ser", "1oser", "idiot", "idiotic", "id1ot", "trash", "trashy", "can", "pond", "scum", "SCUM", "the", "a", "x1", "42"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "\n"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    out = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()
    got = {r["doc_id"]: r["score"] for r in out}
    for k, text in enumerate(texts):
        held = re.findall(r"[^\W_]+", toxicity.fold(text))
        total = hits = 0.0
        for at, word in enumerate(held):
            fits = [w for e, w in lexicon.weights.items() if (word.startswith(e[1:]) if e[0] == "^" else word == e)]
            pairs = {f"{held[at - 1]} {word}" if at else "", f"{word} {held[at + 1]}" if at + 1 < len(held) else ""}
            if fits and not pairs & lexicon.exceptions:
                total, hits = total + max(fits), hits + 1
        a, b, c, d = lexicon.curve
        logit = a + b * math.log1p(total) + c * math.log1p(100 * total / max(len(held), 1)) + d * (hits > 0)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_longest_weight_counts_once_and_exceptions_cancel():
    matcher = toxicity._matcher({"^scum": 2.0, "scumbag": 3.0, "trash": 4.0})
    assert toxicity._weigh(matcher, frozenset(), "Scumbag, TR4SH scu discum") == (7.0, 2, 4)
    assert toxicity._weigh(matcher, frozenset({"trash can"}), "trash can and trash man")[0] == 4.0
    assert toxicity._weigh(matcher, frozenset(), None) == (0, 0, 0)


def planted(n):
    rows = []
    for i in range(n):
        plain = " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(30 + i % 40))
        toxic = i % 4 == 0
        rows.append((i, plain + (" grobian" if toxic else "") + (" trash can" if i % 3 else "") + (" trash talk" if toxic else ""), int(toxic)))
    return rows


def test_learned_terms_and_exceptions(spark):
    rows = planted(400)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(table, table)
    assert "grobian" in lexicon.weights
    tests = [(1, "w1 w2 gr0bian"), (2, "w1 w2 w3"), (3, None), (4, ""), (None, "GROBIAN " * 3000), (2, "w1 w2 w3")]
    out = toxicity.score(spark.createDataFrame([(*t, 9) for t in tests], "doc_id long, text string, score int"), lexicon).collect()
    assert [r["predicted"] for r in out] == [1, 0, 0, 0, 1, 0] and all(0 <= r["score"] <= 1 for r in out)


def test_without_labels(spark):
    table = spark.createDataFrame([], "doc_id long, text string, toxic int")
    empty = toxicity.learn(table, table)
    assert toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), empty).first()["predicted"] == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op4_toxicity(spark, sf).join(labels, "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9
