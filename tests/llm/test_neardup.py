import random
import re

import numpy as np

from nocturne.llm import neardup
from nocturne.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            low[root(k)] = min(low.get(root(k), doc_id), doc_id)
    out = []
    for k, (doc_id, _) in enumerate(docs):
        mine = None if doc_id is None else low[root(k)]
        out.append((doc_id, len(sets[k]), mine, mine == doc_id))
    return sorted(out, key=str)


def run(spark, docs):
    table = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, node string")
    return sorted(map(tuple, neardup.near_duplicates(table).collect()), key=str)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_copies_and_odd_texts(spark):
    rng = random.Random(11)
    base = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    texts = family(rng, base(150), 60, 9) + family(rng, base(60), 40, 4) + family(rng, base(12), 30, 1)
    texts += [" ".join(base(80)) for _ in range(20)] + [texts[0]] * 12
    docs = [(i, t.upper() if i % 5 == 0 else t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "b a"), (None, "a b"), (None, None), (906, "é è " * 3)]
    docs += [(-3, "x y z x y z " * 4000), (907, "x y z x y z " * 4000)]
    docs += [(908, texts[3]), (908, texts[70]), (908, texts[3])]  # one id, two texts
    docs += [(1, " ".join(base(90))), (1, lone := " ".join(base(90))), (930, lone + " more")]  # the second text's link must hold
    assert run(spark, docs) == brute(docs)


def test_chain_of_copies(spark):
    words = [f"c{k}" for k in range(100)]
    docs = []
    for i in range(25):
        docs.append((50 - i, " ".join(words)))
        words = words[2:] + [f"n{i}a", f"n{i}b"]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    left, right = np.unique(pool[:900]), np.unique(pool[100:1000])
    owner = np.r_[np.zeros(len(left), int), np.ones(len(right), int)]
    signature = neardup.super_minhash(np.r_[left, right], owner, 2, 256)
    assert abs((signature[0] == signature[1]).mean() - 0.8) < 0.08


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 40, 900)]
    alone = [neardup.super_minhash(s, np.zeros(len(s), int), 1, 64)[0] for s in sets]
    owner = np.repeat(np.arange(4), [len(s) for s in sets])
    assert (neardup.super_minhash(np.concatenate(sets), owner, 4, 64) == np.array(alone)).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(a, a + 1) for a in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    edges += [(900, 900)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
