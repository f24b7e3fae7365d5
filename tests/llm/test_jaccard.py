import random

import numpy as np

from nocturne.llm import families, jaccard
from test_neardup import brute, family


def run(spark, docs):
    table = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, node string")
    return sorted(map(tuple, jaccard.jaccard_classes(table).collect()), key=str)


def expected(docs):
    return sorted((row[:3] for row in brute(docs, 80)), key=str)


def test_families_copies_and_odd_texts(spark):
    rng = random.Random(12)
    base = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    texts = family(rng, base(150), 60, 9) + family(rng, base(60), 40, 4) + family(rng, base(12), 30, 1) + family(rng, base(7), 20, 2)
    passage = base(60)
    texts += [" ".join(base(30) + passage + base(30)) for _ in range(40)]
    texts += [" ".join(base(80)) for _ in range(20)] + [texts[0]] * 12
    docs = [(i, t.upper() if i % 5 == 0 else t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "b a"), (None, "a b"), (None, None), (906, "é è " * 3)]
    docs += [(-3, "x y z x y z " * 4000), (907, "x y z x y z " * 4000)]
    docs += [(908, texts[3]), (908, texts[70]), (908, texts[3])]  # one id, two texts
    assert run(spark, docs) == expected(docs)


def test_chain_and_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(families, "FAN", 4)
    rng = random.Random(13)
    words = [f"c{k}" for k in range(100)]
    docs = []
    for i in range(25):
        docs.append((50 - i, " ".join(words)))
        words = words[2:] + [f"n{i}a", f"n{i}b"]
    docs += [(100 + i, t) for i, t in enumerate(family(rng, [f"w{k}" for k in range(90)], 80, 5))]
    assert run(spark, docs) == expected(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_linked_pair_fails_a_filter():
    rng = np.random.default_rng(2)
    tried = 0
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        pool = np.unique(rng.integers(0, 2**64, n + 40, dtype=np.uint64))
        rng.shuffle(pool)
        gone = int(rng.integers(0, n // 5 + 1))
        left = np.sort(pool[:n])
        right = np.sort(np.r_[pool[: n - gone], pool[n : n + int(rng.integers(0, n // 5 + 1))]])
        both = len(np.intersect1d(left, right))
        if 100 * both >= 80 * (len(left) + len(right) - both):
            tried += 1
            assert jaccard.passes(left, right, 80)
    assert tried > 1000


def test_unlike_sets_are_sifted_out():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, rng.integers(0, 2**64, 240, dtype=np.uint64)]) for _ in range(40)]
    assert sum(jaccard.passes(a, b, 80) for k, a in enumerate(sets) for b in sets[:k]) < 8  # a fifth of each is shared


def test_the_same_where_joins_shuffle(spark, monkeypatch):
    for module in (families, jaccard):
        monkeypatch.setattr(module, "counted_broadcast", lambda df: df)
    rng = random.Random(14)
    docs = list(enumerate(family(rng, [f"w{k}" for k in range(60)], 50, 4) + family(rng, [f"v{k}" for k in range(30)], 30, 3)))
    assert run(spark, docs + [(3, docs[3][1]), (None, "a b")]) == expected(docs + [(3, docs[3][1]), (None, "a b")])
