import re
from collections import Counter

import numpy as np

from nocturne.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c",
    "Same line.\nSame line.\n\nSame line. \n",
    "w1|w2 ### $%& <é> \x0b\x0c a b c",
    "x y z " * 3000,
    "\n".join(f"line {i} of words that differ" for i in range(40)),
    "WORDS!! " * 80,
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_measures_are_exact(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 1), (4, TEXTS[4], 1)]
    out = quality.measures(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(out) == len(rows)
    for r, (doc_id, text, _) in zip(out, rows, strict=True):
        assert (r["doc_id"], *(r[c] for c in quality.MEASURES[:5])) == (doc_id, *brute(text))


def test_base_rule_and_missing_tables(spark):
    rows = list(enumerate(TEXTS))
    measured = quality.measures(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in quality.judge(measured).collect():
        n, *_, repeated = brute(TEXTS[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["posterior"] <= 1
    assert quality.judge(measured.limit(0)).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    votes = np.zeros((len(good), 5), int)
    for k, (when_good, when_bad) in enumerate([(0.8, 0.1), (0.7, 0.15)]):
        votes[:, k] = rng.random(len(good)) < np.where(good, when_good, when_bad)
    for k, (when_good, when_bad) in enumerate([(0.02, 0.5), (0.03, 0.6), (0.02, 0.4)]):
        votes[:, 2 + k] = -(rng.random(len(good)) < np.where(good, when_good, when_bad)).astype(int)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.estimate(patterns, counts.astype(float))
    assert ((posterior[index.reshape(-1)] >= 0.5) == good).mean() > 0.9


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op9_quality(spark, sf).join(labels, "doc_id").filter("not base_failed")
    right = out.selectExpr("avg(cast(kept = (quality = 1) as int))").first()[0]
    assert right > 0.95
