"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union.

A document's set is its distinct shingles of five lower-cased words. Every shingle
walks a random permutation of the registers; its j-th step offers ``j + fraction`` to
one register, so the registers of a document share the permutation ranks, which lowers
the variance against independent hashes, and a document stops as soon as no register
can fall any more. Registers are cut into bands; documents of equal bands are candidates.

Documents of equal sets are one node, named by a number of its own and not by an id. Bands
with the same nodes are one bucket. Inside buckets :mod:`families` finds every link that
can join two components, without all pairs of a bucket; each comparison is made on whole sets.

Defined cases: null, empty or blank text: no shingles, linked with nothing. Fewer words
than a shingle: the whole sequence is the one shingle. Null doc_id: counted, linked with
nothing, component null, kept. Repeated rows and rows that share an id, of one text or
several: one row each, the component of their set. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.arrays import mix, shingle_sets, slices, text_buffer
from nocturne.llm.families import component_ids, settle, shared_buckets
from nocturne.llm.tables import counted_broadcast, stored

REGISTERS = 128
BAND = 4
SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75

_STEP = np.uint64(0x632BE59BD9B4E019)
_STEPS = np.arange(1, 257, dtype=np.uint64) * _STEP


def super_minhash(hashes: np.ndarray, owner: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """``n_docs`` rows of registers; step number in the top byte, fraction below it."""
    signature = np.full((n_docs, registers), np.iinfo(np.uint64).max, np.uint64)
    flat = signature.reshape(-1)
    places = np.tile(np.arange(registers, dtype=np.uint8), (len(hashes), 1))
    element, base = np.arange(len(hashes)), owner * registers
    running = np.unique(owner)
    for j in range(registers):
        draw = mix(hashes[element] + _STEPS[j])
        other = j + (mix(draw ^ _STEP) % np.uint64(registers - j)).astype(np.int64)
        register = places[element, other]
        places[element, other] = places[element, j]
        offer = (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8))
        np.minimum.at(flat, base[element] + register, offer)
        # a later step offers at least j + 1: done once every register lies below that
        running = running[(signature[running].max(axis=1) >> np.uint64(56)) > j]
        if not len(running):
            break
        if len(running) < n_docs:
            still = np.zeros(n_docs, bool)
            still[running] = True
            element = element[still[owner[element]]]
    return signature


def _bands(signature: np.ndarray, width: int) -> np.ndarray:
    n_docs, registers = signature.shape
    count = registers // width
    parts = signature[:, : count * width].reshape(n_docs, count, width)
    hashed = np.broadcast_to(mix(np.arange(1, count + 1, dtype=np.uint64)), (n_docs, count)).copy()
    for k in range(width):
        hashed = mix(hashed + parts[:, :, k])
    return hashed.view(np.int64)


def _digests(hashes: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Two order-free sums over each set, as 16 bytes."""
    sums = np.zeros((n_docs, 2), np.uint64)
    np.add.at(sums[:, 0], owner, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    np.add.at(sums[:, 1], owner, mix(hashes ^ np.uint64(0x14057B7EF767814F)))
    return sums


def _list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


_SIGNED = "doc_id {}, n_shingles long, set_digest binary, bands array<long>"


def signatures(
    docs: DataFrame, registers: int = REGISTERS, band: int = BAND, shingle: int = SHINGLE, carried: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, n_shingles, set_digest, bands`` and ``carried`` of ``docs(doc_id, text)``, row by row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                n = part.num_rows
                hashes, owner = shingle_sets(*text_buffer(part.column(1)), shingle)
                sizes = np.bincount(owner, minlength=n)
                bands = _bands(super_minhash(hashes, owner, n, registers), band)
                held = sizes > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([x.tobytes() for x in _digests(hashes, owner, n)], pa.binary()),
                        _list_column(bands[held], np.where(held, bands.shape[1], 0)),
                        *part.columns[2:],
                    ],
                    names=["doc_id", "n_shingles", "set_digest", "bands", *carried],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select("doc_id", "text", *carried).mapInArrow(sign, _SIGNED.format(kind) + more)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``set_digest, members``: each document's whole set, sorted, 8 bytes a shingle."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                n = part.num_rows
                hashes, owner = shingle_sets(*text_buffer(part.column(1)), shingle)
                ends = np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.tobytes() for x in _digests(hashes, owner, n)], pa.binary()),
                        pa.array([hashes[ends[i] : ends[i + 1]].tobytes() for i in range(n)], pa.binary()),
                    ],
                    names=["set_digest", "members"],
                )

    return docs.mapInArrow(collect, "set_digest binary, members binary")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    registers: int = REGISTERS,
    band: int = BAND,
    shingle: int = SHINGLE,
    carried: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    The defaults find a pair of similarity 0.75 with probability above 0.99999. A
    component's id is its smallest doc_id; ``kept`` marks the row that carries it.
    Columns named in ``carried`` are passed on.
    """
    signed = stored(signatures(docs, registers, band, shingle, carried), "signatures")
    docs = docs.select("doc_id", "text")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_digest")
    nodes = classes.agg(F.min("doc_id").alias("low_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = stored(shared_buckets(nodes.select(F.explode("bands").alias("bucket"), "node", "n")), "buckets")

    named = nodes.select("node", "set_digest", "low_id")
    met = stored(named.join(buckets.select("node").distinct(), "node", "left_semi"), "met")
    texts = docs.join(counted_broadcast(met.select(F.col("low_id").alias("doc_id"))), "doc_id", "left_semi")
    sets = _sets(texts, shingle).join(counted_broadcast(met.select("set_digest", "node")), "set_digest")
    sets = stored(sets.select("node", "members").dropDuplicates(["node"]), "sets")
    classes = component_ids(named, settle(buckets, sets, percent))

    own = F.when(F.col("doc_id").isNull(), None)
    return (
        signed.select("doc_id", "n_shingles", "set_digest", *carried)
        .join(classes, "set_digest", "left")
        .select("doc_id", "n_shingles", *carried, own.otherwise(F.coalesce("of_set", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
