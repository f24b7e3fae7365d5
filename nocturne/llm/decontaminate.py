"""Benchmark decontamination through a positional inverted index of the corpus.

The index is a written table of postings: term, document, position, for every token of the
corpus whose term occurs in a benchmark item (no other token can take part in a match). A
benchmark window is looked up from its rarest terms: their postings, less the term's offset
in the item, give diagonals (document, item, shift); diagonals that enough rare terms agree
on are intersected with the postings of all terms of the item, and runs of neighbouring
positions are the exact phrase matches. Proximity matches use the same kind of postings: all
distinct words of any window of an item inside a span of the document, in any order. They are
a report of their own (``proximity``); ``contaminated`` means phrases.

Everything is DataFrame operations; a side is broadcast only after its stored rows were
counted (``BROADCAST_ROWS``), else joins shuffle.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``window``
consecutive item words; an item of fewer, but not none, is one window.

Defined cases: null or empty text has no words. Repeated document rows get equal results;
repeated items count once. Null ids are ids like any other; a null item_id is left out of
``items_sha256`` but counted. Documents without a match have zeros. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nocturne.llm.tables import counted_broadcast, stored

WINDOW = 10
#: Rarest terms of each window that a diagonal must agree with before all terms are looked at.
RARE_TERMS = 2

#: Separators: the complement of word characters, A-Z counting as word characters here.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(word: Column) -> Column:
    """A-Z only: words of single-byte characters by ``lower``, others character by character."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _tokens(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, pos, term``: positions ascend by one inside a text (a leading gap shifts all alike)."""
    words = rows.select(*keys, F.posexplode(F.split("text", _GAPS)).alias("pos", "word")).filter("word <> ''")
    return words.select(*keys, "pos", _ascii_lower(F.col("word")).alias("word"))


def _row_key(id_column: str) -> Column:
    # a hash leaves nulls out: without the flags, a null id and a null text could take each other's place
    return F.xxhash64(F.col(id_column).isNull(), F.col(id_column).cast("string"), F.col("text").isNull(), "text")


def _word_count() -> Column:
    """Parts between gaps that are not empty: one pass of the text, several times as fast as counting matches."""
    return F.size(F.filter(F.split(F.coalesce("text", F.lit("")), _GAPS), lambda word: word != "")).cast("long")


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """``item, item_id, size, need, pos, word``: positions from 0; ``need`` words make a match."""
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct().withColumn("item", _row_key("item_id"))
    order = Window.partitionBy("item").orderBy("pos")
    tokens = _tokens(rows, "item", "item_id").withColumn("pos", F.row_number().over(order) - 1)
    return tokens.withColumn("size", F.count("*").over(Window.partitionBy("item"))).withColumn(
        "need", F.least("size", F.lit(window))
    )


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index: ``term, doc, pos`` of all tokens of ``docs(doc, text)`` in ``vocabulary(word, term)``."""
    return stored(_tokens(docs, "doc").join(vocabulary, "word").select("term", "doc", "pos"), "postings")


def _anchors(items: DataFrame, frequencies: DataFrame, rare: int) -> DataFrame:
    """``term, item, pos, agree``: the rarest terms' places of every window that can occur at all."""
    known = items.join(frequencies, "term", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    starts = known.select("item", "size", "need", "pos", "term", "held", F.explode(
        F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("need") + 1), F.least("pos", F.col("size") - F.col("need")))
    ).alias("start"))
    order = Window.partitionBy("item", "start").orderBy("held", "pos")
    ranked = starts.withColumn("turn", F.row_number().over(order)).withColumn(
        "least", F.min("held").over(Window.partitionBy("item", "start"))
    )
    chosen = ranked.filter((F.col("turn") <= rare) & (F.col("least") > 0))
    return chosen.select("term", "item", "pos", F.least("need", F.lit(rare)).alias("agree")).distinct()


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE_TERMS) -> DataFrame:
    """``doc, item, item_id, start, stop``: maximal runs of item words in a document, one diagonal each.

    ``docs`` has ``doc_id, text``; ``doc`` is the row key of its rows. Positions are word
    numbers of the document, ``stop`` exclusive, shifted alike within one document.
    """
    items = stored(_items(benchmark, window).withColumn("term", F.xxhash64("word")), "items")
    vocabulary = stored(items.select("word", "term").distinct(), "vocabulary")
    index = postings(docs.select(_row_key("doc_id").alias("doc"), "text"), counted_broadcast(vocabulary))
    frequencies = stored(index.groupBy("term").agg(F.count("*").alias("held")), "frequencies")

    places = items.select("term", "item", "pos", "size", "need")
    anchors = stored(_anchors(places, frequencies, rare), "anchors")
    found = index.withColumnRenamed("pos", "at").join(counted_broadcast(anchors), "term")
    diagonals = found.groupBy("doc", "item", (F.col("at") - F.col("pos")).alias("shift")).agg(
        F.count_distinct("pos").alias("met"), F.first("agree").alias("agree")
    )
    diagonals = stored(diagonals.filter("met >= agree").select("doc", "item", "shift"), "diagonals")

    wanted = diagonals.join(counted_broadcast(places), "item").select(
        "doc", "item", "shift", "need", (F.col("pos") + F.col("shift")).alias("pos"), "term"
    )
    wanted = stored(wanted, "wanted")
    met = index.join(counted_broadcast(wanted), ["doc", "pos", "term"]).select("doc", "item", "shift", "need", "pos").distinct()
    turn = F.row_number().over(Window.partitionBy("doc", "item", "shift").orderBy("pos"))
    runs = met.withColumn("run", F.col("pos") - turn).groupBy("doc", "item", "shift", "run", "need").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count("*").alias("n")
    )
    names = items.select("item", "item_id").distinct()
    return runs.filter("n >= need").join(names, "item").select("doc", "item", "item_id", "start", "stop")


def _near_sets(items: DataFrame) -> DataFrame:
    """``item, first, term, size``: the distinct terms of every window of every item, and their number."""
    first = F.explode(
        F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("need") + 1), F.least("pos", F.col("size") - F.col("need")))
    )
    sets = items.select("item", "term", first.alias("first")).distinct()
    return sets.withColumn("size", F.count("*").over(Window.partitionBy("item", "first")))


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, span: int = 20, window: int = WINDOW, rare: int = RARE_TERMS
) -> DataFrame:
    """``doc, item, item_id, stop``: ends (exclusive) of spans that hold a window of an item in any order.

    A match ends at a document word of the window when all distinct terms of the window, any
    window of the item, lie in the ``span`` positions up to it. ``docs`` and positions as in
    ``phrase_matches``. A span lies in two neighbouring blocks of ``span`` positions; where
    those hold the rarest terms of a window, the terms of the item in both are swept in
    order: a term is live from where it stands until it comes again, or ``span`` positions on.
    """
    items = stored(_items(benchmark, window).withColumn("term", F.xxhash64("word")), "near-items")
    vocabulary = stored(items.select("word", "term").distinct(), "near-vocabulary")
    index = postings(docs.select(_row_key("doc_id").alias("doc"), "text").distinct(), counted_broadcast(vocabulary))
    index = index.withColumn("block", F.floor(F.col("pos") / span))
    frequencies = stored(index.groupBy("term").agg(F.count("*").alias("held")), "near-frequencies")

    sets = stored(_near_sets(items), "near-sets")
    known = sets.join(frequencies, "term", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    same = Window.partitionBy("item", "first")
    ranked = known.withColumn("turn", F.row_number().over(same.orderBy("held", "term"))).withColumn("least", F.min("held").over(same))
    rarest = ranked.filter((F.col("turn") <= rare) & (F.col("least") > 0)).groupBy("item", "first").agg(
        F.array_sort(F.collect_list("term")).alias("terms")
    )
    rarest = rarest.select("item", "terms").distinct()  # neighbouring windows mostly share their rarest terms
    anchors = rarest.select("item", F.xxhash64("terms").alias("rarest"), F.size("terms").alias("agree"), F.explode("terms").alias("term"))
    anchors = stored(anchors, "near-anchors")
    found = index.join(counted_broadcast(anchors), "term").select(
        "doc", "item", "rarest", "agree", "term", F.explode(F.array(F.col("block") - 1, "block")).alias("block")
    )
    blocks = found.groupBy("doc", "item", "rarest", "agree", "block").agg(F.count_distinct("term").alias("met"))
    blocks = blocks.filter("met = agree").select("doc", "item", F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    blocks = stored(blocks.distinct(), "near-blocks")

    terms = stored(sets.select("item", "term").distinct(), "near-terms")
    places = index.join(counted_broadcast(blocks), ["doc", "block"]).join(counted_broadcast(terms), ["item", "term"])
    again = F.lead("pos").over(Window.partitionBy("doc", "item", "term").orderBy("pos"))
    until = F.least(F.coalesce(again, F.col("pos") + span), F.col("pos") + span)
    places = stored(places.select("doc", "item", "term", "pos", until.alias("until")), "near-places")
    lives = places.join(counted_broadcast(sets), ["item", "term"])
    # windows of which a term is missing altogether need no sweep
    whole = lives.groupBy("doc", "item", "first", "size").agg(F.count_distinct("term").alias("met")).filter("met = size")
    lives = lives.join(whole.select("doc", "item", "first"), ["doc", "item", "first"])
    turns = F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("step")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("step"))))
    turns = lives.select("doc", "item", "first", "size", turns.alias("turn")).groupBy("doc", "item", "first", "size", "turn.at")
    turns = turns.agg(F.sum("turn.step").alias("step"))
    live = F.sum("step").over(Window.partitionBy("doc", "item", "first").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ends = turns.withColumn("live", live).filter("live = size").select("doc", "item", (F.col("at") + 1).alias("stop")).distinct()
    return ends.join(items.select("item", "item_id").distinct(), "item").select("doc", "item", "item_id", "stop")


def proximity(docs: DataFrame, benchmark: DataFrame, span: int = 20, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, n_near, n_near_items, near_sha256``."""
    matches = stored(proximity_matches(docs, benchmark, span, window), "near-matches")
    hits = matches.groupBy("doc").agg(
        F.count_distinct("stop").cast("long").alias("n_near"),
        F.count_distinct("item").cast("long").alias("n_near_items"),
        F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"),
    )
    return docs.select("doc_id", _row_key("doc_id").alias("doc")).join(hits, "doc", "left").select(
        "doc_id",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("near_sha256"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE_TERMS, carried: Sequence[str] = ()
) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Columns named in ``carried`` are passed on.
    """
    matches = stored(phrase_matches(docs, benchmark, window, rare), "matches")
    before = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), "start")))
    hits = matches.withColumn("fresh", fresh).groupBy("doc").agg(
        F.sum("fresh").cast("long").alias("n_hit"),
        F.count_distinct("item").cast("long").alias("n_items"),
        F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"),
    )
    counted = docs.select("doc_id", _word_count().alias("n_words"), _row_key("doc_id").alias("doc"), *carried)
    n_hit, n_items = F.coalesce("n_hit", F.lit(0)), F.coalesce("n_items", F.lit(0))
    return counted.join(hits, "doc", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *carried,
    )
