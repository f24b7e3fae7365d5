"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule judges are the examples: allowed ones train one model, blocked ones the
other. A model gives the next character of ``host + path`` from up to ``ORDER`` characters
before it; orders are blended by Witten-Bell smoothing (an order weighs as much as its
context was seen more often than it had different successors), down to a uniform
distribution, so the order used varies with the evidence. The score is the difference of
the two log-likelihoods divided by the length. A quarter of the examples, by md5 of the
URL, is kept from the models and calibrates the threshold: the hundredth that gives the
best sum of both classes' hit rates.

Counts are one table of character windows, one row a distinct window, from which all lower
orders are summed; URLs with equal host and path are counted and scored once. No part of it
is held by the driver but the threshold.

Defined cases: null URL or one without ``://``: host and path are empty, no rule fits, the
models judge the empty text. Repeated rows: judged each. Without examples of both kinds the
threshold is 0 and the models are what they are. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nocturne.llm.tables import counted_broadcast, stored

ORDER = 3
#: Characters of the uniform distribution below all orders.
ALPHABET = 256
#: Verdict, and host with path, of the rules in use.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruling(rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(size, rule, verdict)`` of the longest fitting rule of ``host`` and ``path``, or null."""
    fits = []
    for verdict, rule in rules:
        domain, slash, rest = rule.partition("/")
        own = (F.col("host") == domain) | F.col("host").endswith("." + domain)
        held = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(own & F.col("path").startswith(slash + rest), held))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _windows(order: int) -> tuple[Column, Column]:
    """The padded text's characters, and all runs of ``order + 1`` of them (column ``chars``)."""
    padded = F.concat(F.lit(_START * order), "host", "path", F.lit(_END))
    chars = F.regexp_extract_all(padded, F.lit("(?s)(.)"), F.lit(1))
    last = F.size("chars") - order
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("chars", i, order + 1), ""))
    return chars, windows


def window_scores(counts: DataFrame, order: int) -> DataFrame:
    """``window, ratio`` for every window of ``counts(window, good, bad)``: log of the two models' ratio.

    Windows have ``order + 1`` characters; those never seen in an example have zero counts.
    """
    known = None
    for k in range(order + 1):
        ending = F.substring("window", order + 1 - k, k + 1)
        pairs = counts.groupBy(ending.alias("pair")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = F.substring("pair", 1, k) if k else F.lit("")
        contexts = pairs.groupBy(context.alias("context")).agg(
            F.sum("good").alias("good_all"),
            F.count_if(F.col("good") > 0).alias("good_kinds"),
            F.sum("bad").alias("bad_all"),
            F.count_if(F.col("bad") > 0).alias("bad_kinds"),
        )
        held = pairs.withColumn("context", context).join(contexts, "context")
        if known is None:
            held = held.withColumns({"good_below": F.lit(1 / ALPHABET), "bad_below": F.lit(1 / ALPHABET)})
        else:
            below = known.select(F.col("pair").alias("tail"), F.col("good_p").alias("good_below"), F.col("bad_p").alias("bad_below"))
            held = held.withColumn("tail", F.substring("pair", 2, k)).join(below, "tail")

        def blended(side: str) -> Column:
            seen, every, kinds, below = (F.col(f"{side}{x}") for x in ("", "_all", "_kinds", "_below"))
            return F.when(every + kinds == 0, below).otherwise((seen + kinds * below) / (every + kinds))

        known = held.select("pair", blended("good").alias("good_p"), blended("bad").alias("bad_p"))
    return known.select(F.col("pair").alias("window"), (F.log("good_p") - F.log("bad_p")).alias("ratio"))


def _threshold(examples: DataFrame) -> float:
    """Of ``examples(cell, good)``: the cell from which on allowing is best; the lowest of equals."""
    cells = examples.groupBy("cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # at most 2001 cells: scores are clipped before they are rounded
    order = Window.partitionBy(F.lit(0)).orderBy("cell")
    upward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rated = cells.select(
        "cell",
        (F.sum("good").over(upward) / F.sum("good").over(every)).alias("hit"),
        (F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(every)).alias("stop"),
    ).filter("hit is not null and stop is not null")
    best = rated.orderBy(F.desc(F.round(F.col("hit") + F.col("stop"), 9)), "cell").first()
    return float(best["cell"]) / 100 if best else 0.0


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages(page_id, url)``."""
    host, path = parts()
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("ruling", ruling(rules))
    calibrates = F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 1).isin("0", "1", "2", "3")
    texts = ruled.select("host", "path", F.col("ruling.verdict").alias("verdict")).distinct().withColumn("calibrates", calibrates)
    texts = stored(texts, "urls")

    chars, windows = _windows(order)
    spread = texts.withColumn("chars", chars).select("host", "path", "verdict", "calibrates", F.explode(windows).alias("window"))
    trains = ~F.col("calibrates")
    counts = spread.groupBy("window").agg(
        F.count_if(trains & (F.col("verdict") == "allow")).alias("good"), F.count_if(trains & (F.col("verdict") == "block")).alias("bad")
    )
    ratios = stored(window_scores(stored(counts, "url-windows"), order), "url-ratios")
    scored = spread.join(counted_broadcast(ratios), "window").groupBy("host", "path", "verdict", "calibrates").agg(F.avg("ratio").alias("score"))
    scored = stored(scored, "url-scores")

    cell = F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")) * 100).cast("int")
    scored = scored.withColumn("cell", cell)
    examples = scored.filter("calibrates and verdict is not null").select("cell", (F.col("verdict") == "allow").alias("good"))
    limit = round(_threshold(examples) * 100)
    judged = scored.select("host", "path", "score", F.when(F.col("cell") >= limit, "allow").otherwise("block").alias("by_model"))
    return ruled.join(judged, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("ruling.rule").alias("rule"),
        F.coalesce("ruling.verdict", "by_model").alias("verdict"),
        "score",
    )
