"""Removal of repeated byte strings, by difference-cover samples and suffix buckets.

Every byte that lies in a ``LENGTH``-byte string which also starts in a document with a
smaller doc_id is removed. The suffixes of a corpus cannot all be sorted at once, nor can
their prefixes be shuffled; so the work follows difference-cover blockwise construction:

1. Cover samples. Positions whose offset in its document falls, modulo ``PERIOD``, into a
   difference cover are sampled: any two equal strings share a sampled pair of places within
   ``PERIOD`` bytes, however they are shifted. Keys of ``LENGTH - PERIOD + 1`` bytes at the
   samples are sent to key-range buckets, and each bucket is sorted on its own; what comes
   back to a chunk of documents is one bit a key: does it lie in another document.
2. Suffix buckets. Only suffixes with a repeated cover sample among their first places can
   have an equal prefix elsewhere. Their prefix keys (64 bits for ``LENGTH`` bytes) go to buckets; a bucket
   is sorted alone and tells each chunk which prefixes start in a smaller document.
3. Each chunk marks the bytes that its removable suffixes cover.

Whole texts that equal one of a smaller doc_id are settled first, by their digest: all their
bytes go, and no other document needs them. A chunk is a few MB (:func:`sizes`) of whole documents held as one compressed row. Equal keys
of a chunk are sent once, so a passage that lies in a third of all documents costs a bucket
one entry a chunk. Lists are sorted, difference-coded and compressed. Chunks and buckets grow with the root of a large
corpus, so the lists, one for a chunk and bucket, grow as the corpus does and not with its
square; the chunk rows are shuffled once.

Prefix ranks stand for 64-bit hashes: with n candidate suffixes, two unequal prefixes of the
corpus meet with probability about n * n / 2 ** 65. Cover keys are shorter on purpose;
a chance meeting there only sends a few suffixes more.

Defined cases: null or empty text: no bytes. Rows of one doc_id never remove each other's
bytes. A null doc_id has no order: nothing is removed from or by such a row. Texts shorter
than ``LENGTH`` are kept. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.arrays import mix, powers, text_buffer
from nocturne.llm.tables import counted_broadcast, stored

LENGTH = 50
#: A perfect difference cover: every difference modulo 31 occurs among these offsets.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
CHUNK = 4 << 20
#: Corpus bytes for which a bucket of cover keys, or of suffix keys, is opened.
BUCKET_BYTES = 8 << 20
#: Corpus bytes up to which chunks and buckets have these sizes; beyond, both grow with the root of the corpus,
#: so that the lists of chunks for buckets grow as the corpus does, until they have grown this much.
PLAIN_BYTES, MOST_GROWTH = 1 << 30, 16

#: Bytes worked on at a time inside a chunk.
BLOCK = 1 << 18

_KEY = LENGTH - PERIOD + 1


def _squeeze(values: np.ndarray) -> bytes:
    """Ascending values as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    return _squeeze_plain(steps)


def _squeeze_plain(values: np.ndarray) -> bytes:
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand_plain(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def _expand(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand_plain(blob), dtype=np.uint64)


def _window_hashes(data: np.ndarray, low: int, places: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` bytes at ascending ``places``, all within a block that starts at ``low``."""
    if not len(places):
        return np.zeros(0, np.uint64)
    part = data[low : int(places[-1]) + length]
    up, down = powers(len(part) + 1)
    summed = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=summed[1:])
    at = places - low
    return mix((summed[at + length] - summed[at]) * down[at])


def _samples(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, owning documents and key hashes of all cover samples of a chunk."""
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    starts = np.r_[0, ends[:-1]]
    places, owners, hashes = [], [], []
    for low in range(0, len(data), BLOCK):
        at = np.arange(low, min(low + BLOCK, len(data)))
        owner = np.searchsorted(ends, at, "right")
        keep = covered[(at - starts[owner]) % PERIOD] & (at + _KEY <= ends[owner])
        at, owner = at[keep], owner[keep]
        places.append(at.astype(np.int32))
        owners.append(owner.astype(np.int32))
        hashes.append(_window_hashes(data, low, at, _KEY))
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(owners), np.concatenate(hashes)


class _Keys:
    """Distinct keys of a chunk: sorted values, smallest owner, held by several, index of each occurrence."""

    def __init__(self, hashes: np.ndarray, owners: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        at = np.flatnonzero(fresh)
        self.values = ranked[at]
        self.index = np.empty(len(ranked), np.int32)
        self.index[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del ranked, fresh
        held = ids[owners[order]]
        self.least = np.minimum.reduceat(held, at) if len(at) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(held, at) if len(at) else np.zeros(0, np.int64)


def _edges(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each key range of ``bits``-bit values begins in a sorted list."""
    limits = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(values, limits, "left"), len(values)]


def sizes(total: int) -> tuple[int, int]:
    """Bytes of a chunk, and the number of buckets, for a corpus of ``total`` bytes."""
    growth = min(MOST_GROWTH, max(1.0, math.sqrt(total / PLAIN_BYTES)))
    return int(CHUNK * growth), max(1, math.ceil(total / (BUCKET_BYTES * growth)))


def _unpack(blob: bytes, ends: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return data, np.frombuffer(ends, np.int64), np.frombuffer(ids, np.int64)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, ids, ends, data`` rows of about ``chunk_bytes`` of whole documents."""

    def row(chunk: int, ids: list, texts: list) -> pa.RecordBatch:
        data = b"".join(texts)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        held = [[chunk], [np.array(ids, np.int64).tobytes()], [ends.tobytes()], [zstandard.ZstdCompressor(level=6).compress(data)]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, kinds, strict=True)], names=["chunk", "ids", "ends", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                if ids and size + len(text) > chunk_bytes:
                    yield row(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield row(number, ids, texts)

    return docs.mapInArrow(pack, "chunk long, ids binary, ends binary, data binary")


_LISTS = "bucket int, chunk long, n int, keys binary, owners binary, ids binary"
_REPLIES = "chunk long, step int, bucket int, n int, bits binary"


def _lists(chunk: int, keys: _Keys, bits: int, buckets: int, ids: np.ndarray | None) -> pa.RecordBatch:
    """One row a key range: the chunk's keys there, with their smallest owners if ``ids`` are given."""
    edges = _edges(keys.values, bits, buckets)
    rows = []
    known, place = (np.unique(keys.least, return_inverse=True)) if ids is not None else (None, None)
    for k in np.flatnonzero(np.diff(edges)).tolist():  # no more rows than keys, however many the buckets
        low, high = int(edges[k]), int(edges[k + 1])
        owners = table = None
        if ids is not None:
            used, local = np.unique(place[low:high], return_inverse=True)
            owners = _squeeze_plain(local.astype(np.uint64))
            table = zstandard.ZstdCompressor(level=1).compress(known[used].tobytes())
        rows.append((k, chunk, high - low, _squeeze(keys.values[low:high]), owners, table))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "n", "keys", "owners", "ids"]
    )


def _answers(lists: DataFrame, step: int) -> DataFrame:
    """Sort each bucket alone; a bit for each key of each list.

    Step 1: the key lies in another chunk too. Step 2: it starts in a smaller document of another chunk.
    """

    def sort_bucket(table: pa.Table) -> pa.Table:
        parts = [_expand(x) for x in table.column("keys").to_pylist()]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        flag = np.zeros(len(values), bool)
        if step == 1:
            several = ~fresh
            several[:-1] |= ~fresh[1:]
            flag[order] = several
        else:
            owner = np.concatenate(
                [
                    np.frombuffer(zstandard.ZstdDecompressor().decompress(i), np.int64)[_expand_plain(o).astype(np.int64)]
                    for o, i in zip(table.column("owners").to_pylist(), table.column("ids").to_pylist(), strict=True)
                ]
            )[order]
            at = np.flatnonzero(fresh)
            least = np.minimum.reduceat(owner, at)[np.cumsum(fresh) - 1]
            flag[order] = least < owner
        ends = np.cumsum([len(x) for x in parts])
        bits = [np.packbits(flag[e - len(x) : e]).tobytes() for e, x in zip(ends, parts, strict=True)]
        n = len(parts)
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "step": pa.array([step] * n, pa.int32()),
                "bucket": table.column("bucket"),
                "n": table.column("n"),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return lists.groupBy("bucket").applyInArrow(sort_bucket, _REPLIES)


def _flags(replies: pa.Table, step: int, n: int) -> np.ndarray:
    """The answers of one step, joined in key order."""
    rows = sorted((b, m, x) for s, b, m, x in zip(*(replies.column(c).to_pylist() for c in ("step", "bucket", "n", "bits")), strict=True) if s == step)
    flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m).astype(bool) for _, m, x in rows]) if rows else np.zeros(0, bool)
    assert len(flags) == n, "answers do not fit the chunk"
    return flags


def _suffixes(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, replies: pa.Table, bits: int) -> tuple[np.ndarray, _Keys]:
    """Places and keys of the suffixes with a cover sample that lies in several documents."""
    places, owners, hashes = _samples(data, ends)
    hashes >>= np.uint64(64 - bits)
    samples = _Keys(hashes, owners, ids)
    del hashes, owners
    shared = _flags(replies, 1, len(samples.values)) | (samples.least < samples.most)
    repeated = places[shared[samples.index]].astype(np.int64)
    del samples, shared, places
    reach = PERIOD - 1
    found, keys = [], []
    for low in range(0, len(data), BLOCK):
        high = min(low + BLOCK, len(data))
        at = np.arange(low, high)
        owner = np.searchsorted(ends, at, "right")
        keep = at + LENGTH <= ends[owner]
        near = repeated[np.searchsorted(repeated, low) : np.searchsorted(repeated, high + reach)]
        change = np.zeros(high - low + 1, np.int32)
        np.add.at(change, np.clip(near - reach - low, 0, high - low), 1)
        np.add.at(change, np.clip(near + 1 - low, 0, high - low), -1)
        keep &= np.cumsum(change[:-1]) > 0
        at = at[keep]
        found.append(at)
        keys.append(_window_hashes(data, low, at, LENGTH))
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    hashed = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return at, _Keys(hashed, np.searchsorted(ends, at, "right"), ids)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of ``docs(doc_id long, text)``.

    ``kept`` holds the remaining bytes. ``n_spans`` counts maximal removed runs.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "text", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    groups = rows.filter(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("held"))
    firsts = stored(groups.filter("held > 1").select("digest", "first_id"), "equal-texts")
    known = counted_broadcast(firsts)
    marked = rows.join(known, "digest", "left")
    copies = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    own = marked.filter(F.col("doc_id").isNotNull() & ~copies).select("doc_id", "text")
    if known is firsts:  # rows come out of a shuffle: in an order that a lost task would not repeat
        own = own.sortWithinPartitions("doc_id", "text")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    chunk_bytes, buckets = sizes(total)
    texts = _chunks(own, chunk_bytes).groupBy("chunk")
    bits = min(64, max(8, 10 + math.ceil(math.log2(max(total, 2) * len(COVER) / PERIOD))))

    def cover_lists(text: pa.Table) -> pa.Table:
        data, ends, ids = _unpack(*(text.column(c)[0].as_py() for c in ("data", "ends", "ids")))
        _, owners, hashes = _samples(data, ends)
        keys = _Keys(hashes >> np.uint64(64 - bits), owners, ids)
        return pa.Table.from_batches([_lists(text.column("chunk")[0].as_py(), keys, bits, buckets, None)])

    def suffix_lists(text: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = text.column("chunk")[0].as_py()
        data, ends, ids = _unpack(*(text.column(c)[0].as_py() for c in ("data", "ends", "ids")))
        _, keys = _suffixes(data, ends, ids, replies, bits)
        return pa.Table.from_batches([_lists(chunk, keys, 64, buckets, ids)])

    def remove(text: pa.Table, replies: pa.Table) -> pa.Table:
        data, ends, ids = _unpack(*(text.column(c)[0].as_py() for c in ("data", "ends", "ids")))
        places, keys = _suffixes(data, ends, ids, replies, bits)
        smaller = _flags(replies, 2, len(keys.values))
        owner = ids[np.searchsorted(ends, places, "right")]
        gone = places[smaller[keys.index] | (keys.least[keys.index] < owner)]
        removed = np.zeros(len(data) + 1, bool)
        for k in range(0, len(gone), BLOCK):  # runs of neighbouring suffixes as one span
            part = gone[k : k + BLOCK]
            cut = np.flatnonzero(np.diff(part) > 1) + 1
            for low, high in zip(part[np.r_[0, cut]], part[np.r_[cut - 1, len(part) - 1]], strict=True):
                removed[low : high + LENGTH] = True
        rows, start = [], 0
        for doc_id, end in zip(ids.tolist(), ends.tolist(), strict=True):
            flags = removed[start:end]
            kept = data[start:end][~flags].tobytes()
            spans = int(np.count_nonzero(flags[1:] & ~flags[:-1])) + int(bool(len(flags) and flags[0]))
            rows.append((doc_id, end - start, int(flags.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            start = end
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # one plan: the shuffle of the chunks, and that of the first answers, serve all its parts
    first = _answers(texts.applyInArrow(cover_lists, _LISTS), 1).repartition("chunk")
    second = _answers(texts.cogroup(first.groupBy("chunk")).applyInArrow(suffix_lists, _LISTS), 2)
    replies = first.unionByName(second)
    judged = texts.cogroup(replies.groupBy("chunk")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    def settled(kept: DataFrame, removed, spans: int, left) -> DataFrame:
        return kept.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "n_bytes",
            removed.cast("long").alias("n_removed"),
            F.lit(spans).cast("long").alias("n_spans"),
            F.sha2(left, 256).alias("kept_sha256"),
            left.alias("kept"),
        )

    unordered = settled(rows.filter("doc_id is null"), F.lit(0), 0, body)
    whole = settled(marked.filter(copies), F.col("n_bytes"), 1, F.lit("").cast("binary"))
    return judged.unionByName(whole).unionByName(unordered)
