import hashlib
import random

import pytest

from nocturne.llm import repeats


def brute(docs, length=50):
    """Documents in order of id; rows of one id never count for each other."""
    out, seen = [], {}
    for doc_id, text in docs:
        body = (text or "").encode()
        for p in range(len(body) - length + 1) if doc_id is not None else ():
            seen.setdefault(body[p : p + length], set()).add(doc_id)
    for doc_id, text in docs:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1) if doc_id is not None else ():
            if min(seen[body[p : p + length]]) < doc_id:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    table = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, chunk string")
    return sorted(map(tuple, repeats.deduplicate(table).drop("kept").collect()), key=str)


def test_cover_holds_every_difference():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


@pytest.mark.parametrize("chunk", [300, 8 << 20])
def test_shifted_repeats_nulls_and_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "BLOCK", 256)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijé ") for _ in range(n))
    passages = [noise(rng.randrange(40, 140)) for _ in range(6)]
    docs = [(i, noise(rng.randrange(0, 60)) + rng.choice(passages) + noise(rng.randrange(0, 9)) + rng.choice(passages)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 700), (103, "x" * 49), (104, "x" * 50), (105, docs[3][1]), (105, docs[4][1])]
    docs += [(None, docs[3][1]), (-7, docs[9][1]), (200, docs[9][1] * 3)]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_lengths_around_the_limit(spark):
    base = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(90))
    docs = [(1, base)] + [(n, "#" + base[k : k + n] + "%") for n in (49, 50, 51, 80) for k in (0, 3)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_lists_grow_as_the_corpus(spark, monkeypatch):
    def lists(total):
        chunk, buckets = repeats.sizes(total)
        return total / chunk * buckets

    for total in (1 << 30, 1 << 32, 1 << 35):
        assert lists(2 * total) < 2.1 * lists(total)
    # counted in a run: four times the corpus, four times the lists
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "PLAIN_BYTES", 10_000)
    made = []
    monkeypatch.setattr(repeats, "_answers", lambda df, step, real=repeats._answers: made.append(df.count()) or real(df, step))
    rng = random.Random(5)
    for n in (100, 400):
        docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(400))) for i in range(n)]
        run(spark, docs)
    assert made[2] < 5 * made[0]


def test_the_same_where_joins_shuffle(spark, monkeypatch):
    monkeypatch.setattr(repeats, "counted_broadcast", lambda df: df)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(120)) for _ in range(10)]
    docs = [(i, rng.choice(texts) + rng.choice(texts)) for i in range(30)] + [(40, texts[0]), (41, texts[0]), (None, texts[0])]
    assert run(spark, docs) == brute(docs)
