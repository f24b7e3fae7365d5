"""Exact Jaccard join of documents on word n-grams, by prefix filters under several global orders.

A document's set is its distinct shingles of five lower-cased words, as 64-bit hashes. In any one
order of all shingles, two sets that link share at least ``l`` of their first
``n - required + l`` shingles (``n`` the size of a set, ``required`` the least overlap a partner must have).
What is compared has passed the filters of several orders: the hash values from the
beginning, from a third and from two thirds of their range (so that the prefixes of a set hardly overlap), and one
that begins with rare shingles.

1. Under the first order, a set stays if enough shingles of its prefix occur in the prefix of a different
   set. That takes one shuffle of the prefixes, where a frequent shingle is a row for each part of the input.
2. The sets that stay are collected, and those go whose shingles no other of them has make a link impossible. The shingles of the rest are counted on a fixed number of slots; the order by
   those counts puts frequent shingles last (any function of a shingle is an order, so nothing rests on the counts).
   The shingles of the shortest prefix under it that several sets hold are buckets.
3. Inside buckets pairs are compared as :mod:`families` does, each with the
   prefixes under the three hash orders first and the whole sets after that.

Nothing is sampled: no link between two different texts that joins components is lost, but for chance meetings of
64-bit hashes. The result is a class for each document; pairs inside a class are not listed.

Defined cases: null, empty or blank text: no shingles, linked with nothing. Fewer words
than a shingle: the whole sequence is the one shingle. Null doc_id: counted, linked with
nothing, component null. Rows that repeat or share an id: one row each, with the component of their set.
Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.arrays import mix, shingle_sets, slices, text_buffer
from nocturne.llm.families import alone, component_ids, settle, shared_buckets
from nocturne.llm.tables import counted_broadcast, stored

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Where in the range of hashes each order begins.
ORDERS = (0, (1 << 64) // 3, 2 * (1 << 64) // 3)
#: Shingles that a task settles together.
PART = 1_000_000
#: Bytes of text that a task works on at a time, longer texts apart.
SLICE = 1 << 18
#: Slots on which shingles are counted for the order by rarity, and the parts in which their sums are made.
SLOTS, SEGMENTS = 1 << 20, 64
#: A prefix is longer than the shortest by this share of the set; so many shared shingles it then must have.
EXTRA = 5


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of ``n`` that a linked set may lack."""
    return n - -(-percent * n // 100)


def extra(n: np.ndarray) -> np.ndarray:
    return 1 + EXTRA * n // 100


def needed(n: str, percent: int) -> Column:
    """Shared shingles that the long prefix of a set of ``n`` has with any set it links with."""
    return F.expr(f"1 + {EXTRA} * (({percent} * {n} + 99) div 100) div 100")


def prefix(members: np.ndarray, start: int, length: int) -> np.ndarray:
    """The first ``length`` of the sorted ``members`` in the order that begins at ``start``."""
    at = int(np.searchsorted(members, np.uint64(start)))
    return np.r_[members[at : at + length], members[: max(0, length - (len(members) - at))]]


def passes(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sets share enough of their prefixes under every order."""
    n = np.array([len(left), len(right)])
    short = int(min(extra(n)))
    reach = spare(n, percent) + short
    return all(
        len(np.intersect1d(prefix(left, s, reach[0]), prefix(right, s, reach[1]), assume_unique=True)) >= short for s in ORDERS
    )


def _digests(hashes: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Two order-free sums over each set, as 16 bytes; the first 8 are its key."""
    sums = np.zeros((n_docs, 2), np.uint64)
    np.add.at(sums[:, 0], owner, mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
    np.add.at(sums[:, 1], owner, mix(hashes ^ np.uint64(0x9E6C63D0876A9A47)))
    return sums


def _sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles, the end points of each text's, their numbers and the digests."""
    hashes, owner = shingle_sets(*text_buffer(texts), shingle)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return hashes, ends, np.diff(ends), _digests(hashes, owner, len(texts))


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, set_digest, set_key`` row by row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                _, _, sizes, digests = _sets_of(part.column(1), shingle)
                held = [sizes.astype(np.int64), [d.tobytes() for d in digests], digests[:, 0].view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, held)], names=["doc_id", "n_shingles", "set_digest", "set_key"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_digest binary, set_key long")


def _long_prefixes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``shingle, set_key, held``: the long prefix of every set under the first order.

    A task settles among ``PART`` shingles at a time what it can: a shingle that several sets there hold is one row
    without a key, and so many of a set's shingles are one row without a shingle. A frequent
    shingle is so a row a part, whatever the number of its holders.
    """
    names = ["shingle", "set_key", "held"]

    def rows(shingles: np.ndarray, keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(shingles.view(np.int64)), pa.array(keys, mask=held < 0), pa.array(np.abs(held))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def settled(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, keys = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])  # a set that was met twice
        tokens, keys = tokens[fresh], keys[fresh]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        several = np.diff(np.r_[starts, len(tokens)]) > 1
        alone = starts[~several]
        yield rows(tokens[alone], keys[alone], np.zeros(len(alone), np.int64))
        yield rows(tokens[starts[several]], np.zeros(several.sum(), np.int64), np.full(several.sum(), -1, np.int64))
        counted, held = np.unique(keys[np.repeat(several, np.diff(np.r_[starts, len(tokens)]))], return_counts=True)
        yield rows(mix(counted.view(np.uint64)), counted, held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                hashes, ends, sizes, digests = _sets_of(part.column(1), shingle)
                length = np.minimum(sizes, spare(sizes, percent) + extra(sizes))
                length[sizes == 0] = 0
                at = np.repeat(ends[:-1] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                parts.append((hashes[at], np.repeat(digests[:, 0].view(np.int64), length)))
                size += len(at)
                if size > PART:
                    yield from settled(parts)
                    parts, size = [], 0
        if size:
            yield from settled(parts)

    return docs.select("doc_id", "text").mapInArrow(spread, "shingle long, set_key long, held long")


def _held_by_others(prefixes: DataFrame) -> DataFrame:
    """``set_key, held``: how many shingles of the prefix lie in the prefix of a different set.

    A set that lies in several parts is counted in each, so ``held`` may be too large, never too small. One shuffle, by shingle; a task reads its shingles in order and keeps the one it stands at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            here = [batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy(), batch.column(2).to_numpy()]
            here.append(np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False)))
            if last is not None:
                here = [np.r_[a, b] for a, b in zip(last, here, strict=True)]
            cut = int(np.searchsorted(here[0], here[0][-1])) if len(here[0]) else 0
            told = [c[:cut] for c in here]
            last = [c[cut:] for c in here]
            if cut:
                yield counted(*told)
        if last is not None and len(last[0]):
            yield counted(*last)

    def counted(tokens: np.ndarray, keys: np.ndarray, held: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        lengths = np.diff(np.r_[starts, len(tokens)])
        posting = held == 0
        several = np.maximum.reduceat(open_, starts)
        low = np.minimum.reduceat(np.where(posting, keys, np.iinfo(np.int64).max), starts)
        high = np.maximum.reduceat(np.where(posting, keys, np.iinfo(np.int64).min), starts)
        shared = np.repeat(several | (low < high), lengths) & posting
        one = np.where(posting, shared, held)
        one[open_] = 0
        some = one > 0
        found, place = np.unique(keys[some], return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(np.bincount(place, one[some], len(found)).astype(np.int64))], names=["set_key", "held"]
        )

    dealt = prefixes.repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(scan, "set_key long, held long").groupBy("set_key").agg(F.sum("held").alias("held"))


def _collected(texts: DataFrame, shingle: int) -> DataFrame:
    """``set_digest, members``: whole sets, sorted, 8 bytes a shingle."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                hashes, ends, _, digests = _sets_of(part.column(1), shingle)
                members = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(members, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["set_digest", "members"])

    return texts.select("doc_id", "text").mapInArrow(collect, "set_digest binary, members binary")


def _load(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each of ``SLOTS`` slots; a fixed size, whatever the input."""
    width = SLOTS // SEGMENTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for members in batch.column(0):
                np.add.at(load, _slot(np.frombuffer(members.as_buffer(), np.uint64)), 1)
        parts = pa.ListArray.from_arrays(pa.array(range(0, SLOTS + 1, width), pa.int32()), pa.array(load))
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), parts], names=["segment", "load"])

    def total(table: pa.Table) -> pa.Table:
        load = sum(chunk.flatten().to_numpy().reshape(-1, width).sum(axis=0) for chunk in table.column("load").chunks)
        whole = pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(load))
        return pa.table({"segment": table.column("segment")[:1], "load": whole})

    kind = "segment int, load array<long>"
    found = sets.select("members").mapInArrow(add, kind).groupBy("segment").applyInArrow(total, kind).collect()
    out = np.zeros(SLOTS, np.int64)
    for row in found:
        out[row["segment"] * width : (row["segment"] + 1) * width] = row["load"]
    return out


def _slot(members: np.ndarray) -> np.ndarray:
    return (mix(members) % np.uint64(SLOTS)).astype(np.int64)


def _rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``bucket, node``: the shortest prefix of every set, shingles on rarely used slots first."""
    shared = sets.sparkSession.sparkContext.broadcast(_load(sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        for batch in batches:
            for node, members in zip(*batch.columns, strict=True):
                held = np.frombuffer(members.as_buffer(), np.uint64)
                order = np.lexsort((held, load[_slot(held)]))
                taken = held[order[: int(spare(len(held), percent)) + 1]]
                columns = [pa.array(taken.view(np.int64)), pa.array(np.full(len(taken), node.as_py()))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node"])

    return sets.select("node", "members").mapInArrow(spread, "bucket long, node long")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    A component's id is its smallest doc_id.
    """
    signed = stored(_signed(docs, shingle), "jaccard-signed")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_digest")
    nodes = classes.agg(F.min("doc_id").alias("low_id"), F.first("n_shingles").alias("n"), F.first("set_key").alias("set_key"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")

    held = _held_by_others(_long_prefixes(docs.filter("doc_id is not null"), shingle, percent))
    staying = nodes.join(held, "set_key").filter(F.col("held") >= needed("n", percent))
    staying = stored(staying.select("node", "set_digest", "low_id", "n"), "jaccard-staying")

    wanted = counted_broadcast(staying.select(F.col("low_id").alias("doc_id")))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    collected = _collected(texts, shingle).join(counted_broadcast(staying.select("set_digest", "node")), "set_digest")
    sets = stored(collected.select("node", "members"), "jaccard-sets")
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # a row that repeats
        sets = stored(sets.dropDuplicates(["node"]), "jaccard-sets")

    unshared = stored(alone(sets), "jaccard-alone")
    enough = 100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")
    left = stored(staying.join(unshared, "node", "left").filter(enough).select("node", "n"), "jaccard-left")
    sets = stored(sets.join(counted_broadcast(left.select("node")), "node"), "jaccard-sets")

    buckets = shared_buckets(stored(_rare_prefixes(sets, percent), "jaccard-prefixes"))
    buckets = stored(buckets.join(left, "node").select("bucket", "node", "n"), "jaccard-buckets")
    labels = settle(buckets, sets, percent, lambda x, y: passes(x, y, percent), unshared)

    ids = component_ids(nodes.select("node", "set_digest", "low_id"), labels)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    return signed.join(ids, "set_digest", "left").select("doc_id", "n_shingles", own.alias("component_id"))
