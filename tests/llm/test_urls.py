import math
from collections import Counter

from nocturne.llm import urls

ROWS = [
    (1, "http://a.example.org/fr/x?q#f"),
    (2, "https://example.org/es/1"),
    (3, "https://www.EXAMPLE.org/en/17"),
    (4, "http://example.org"),
    (5, "http://x.com/fr/9"),
    (6, "http://x.com/de/9"),
    (7, "http://notorg/x"),
    (8, None),
    (9, "no scheme"),
    (10, "http://q.net/fr/8#://z"),
    (10, "http://q.net/fr/8#://z"),
    (11, "a://b\n/c"),
    (12, ""),
]


def test_rules_hosts_and_paths(spark):
    table = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, host string")
    out = [r for r in urls.judge(table).collect()]
    assert len(out) == len(ROWS)
    by_id = {r["page_id"]: r for r in out}
    assert [by_id[i]["rule"] for i in range(1, 8)] == ["org/", "example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/", None]
    assert (by_id[3]["host"], by_id[3]["path"]) == ("www.example.org", "/en/17")
    assert (by_id[8]["host"], by_id[8]["path"], by_id[9]["host"]) == ("", "", "")
    assert (by_id[10]["host"], by_id[10]["path"]) == ("q.net", "/fr/8")
    assert {r["verdict"] for r in out} <= {"allow", "block"}
    assert urls.judge(table.limit(0)).count() == 0


def model(texts, order):
    """Witten-Bell probabilities by direct counting."""
    seen = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = "\x02" * order + t + "\x03"
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[k][t[i - k : i + 1]] += 1

    def p(window):
        value = 1 / urls.ALPHABET
        for k in range(order + 1):
            pair = window[order - k :]
            same = {w: n for w, n in seen[k].items() if w[:-1] == pair[:-1]}
            if same:
                value = (seen[k][pair] + len(same) * value) / (sum(same.values()) + len(same))
        return value

    return p


def test_ratio_equals_brute_force(spark):
    good, bad, other = ["a.org/xx", "b.org/xy"], ["c.com/de", "cc.com/de/1"], ["a.org/de", "zzz"]
    order, counts = 2, Counter()
    rows = {}
    for side, texts in (("good", good), ("bad", bad), (None, other)):
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for i in range(order, len(t)):
                counts[t[i - order : i + 1], side] += 1
                rows[t[i - order : i + 1]] = None
    table = spark.createDataFrame([(w, counts[w, "good"], counts[w, "bad"]) for w in rows], "window string, good long, bad long")
    g, b = model(good, order), model(bad, order)
    out = urls.window_scores(table, order).collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r["ratio"] - (math.log(g(r["window"])) - math.log(b(r["window"])))) < 1e-9


def test_threshold_separates(spark):
    rows = [(c, g) for c, g in [(-50, False)] * 9 + [(-10, True)] * 1 + [(5, False)] * 1 + [(30, True)] * 9]
    assert urls._threshold(spark.createDataFrame(rows, "cell int, good boolean")) in (-0.1, 0.3)
    assert urls._threshold(spark.createDataFrame([], "cell int, good boolean")) == 0.0


def test_the_same_where_joins_shuffle(spark, monkeypatch):
    table = spark.createDataFrame(ROWS, "page_id long, url string")
    pick = lambda: sorted(map(tuple, urls.judge(table).drop("score").collect()), key=str)
    plain = pick()
    monkeypatch.setattr(urls, "counted_broadcast", lambda df: df)
    assert pick() == plain
