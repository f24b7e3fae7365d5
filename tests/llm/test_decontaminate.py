import hashlib
import random
import re

from nocturne.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(docs, items, window=10):
    wins = {}
    for item_id, text in items:
        w = words(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if w else ():
            wins.setdefault(tuple(w[s : s + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                got = wins.get(tuple(w[s : s + size]))
                if got:
                    hit.update(range(s, s + size))
                    found |= got
        joined = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, pos string")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc string")
    return sorted(map(tuple, d.decontaminate(a, b, **more).collect()), key=str)


def test_random_texts_of_few_words(spark):
    rng = random.Random(5)
    vocabulary = ["A", "b", "É", "é", "x1", "the"]
    text = lambda n: rng.choice([" ", ". "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 6, 9]))) for i in range(8)] + [(90, None), (91, "..."), (92, "the b")]
    docs = [(i, "-" * (i % 2) + text(rng.randrange(0, 40))) for i in range(40)] + [(70, None), (71, ""), (3, "the b"), (72, "the b"), (72, "the b")]
    items.append((93, docs[5][1]))
    for window in (3, 4):
        assert run(spark, docs, items, window=window) == brute(docs, items, window)


def test_passage_in_many_documents_and_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(d, "counted_broadcast", lambda df: df)
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(i, f"Head{i} {passage.upper()}, tail") for i in range(60)] + [(100, "w1 w2 w3")]
    out = run(spark, docs, [(1, passage), (1, passage), (None, "tail")])
    assert out == brute(docs, [(1, passage), (None, "tail")])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_proximity_finds_reordered_words(spark):
    docs = spark.createDataFrame([(1, "x x d c b a x"), (2, "a " + "x " * 60 + "b c d"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    assert len({r["doc"] for r in d.proximity_matches(docs, items).collect()}) == 1


def brute_near(docs, items, span=20, window=10):
    out = set()
    for doc_id, text in docs:
        w = words(text)
        for item_id, passage in items:
            v = words(passage)
            size = min(window, len(v))
            for s in range(len(v) - size + 1) if v else ():
                terms = set(v[s : s + size])
                out |= {(doc_id, item_id, q + 1) for q in range(len(w)) if w[q] in terms and terms <= set(w[max(0, q - span + 1) : q + 1])}
    return out


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    item = lambda i, n: [rng.choice([f"t{i}x{k}", rng.choice(common)]) for k in range(n)]
    passages = [item(i, n) for i, n in enumerate([1, 4, 10, 15, 23, 40])] + [["c1", "c2"] * 8]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    docs = [(0, None), (1, ""), (2, " ".join(common * 9))]
    for i in range(3, 120):
        p = passages[rng.randrange(2, 7)]
        start = rng.randrange(max(1, len(p) - 9))  # any window, mostly not the first
        held = p[start : start + 10]
        rng.shuffle(held)
        filled = []
        for w in held:  # spread over about 10 to 25 positions
            filled += [w] + ["f"] * (rng.random() < rng.choice([0.1, 0.8])) * rng.randrange(1, 3)
        docs.append((i, " ".join(["h"] * rng.randrange(45) + filled + rng.choices(common, k=rng.randrange(40)))))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for span, window in ((20, 10), (12, 10), (5, 4)):
        expected = brute_near(docs, items, span, window)
        keys = {r["doc"]: r["doc_id"] for r in a.select("doc_id", d._row_key("doc_id").alias("doc")).collect()}
        got = {(keys[r["doc"]], r["item_id"], r["stop"]) for r in d.proximity_matches(a, b, span, window).collect()}
        assert got == expected
        rows = {r["doc_id"]: (r["n_near"], r["n_near_items"]) for r in d.proximity(a, b, span, window).collect()}
        of = {i: [x for x in expected if x[0] == i] for i, _ in docs}
        assert rows == {i: (len({x[2] for x in m}), len({x[1] for x in m})) for i, m in of.items()}
