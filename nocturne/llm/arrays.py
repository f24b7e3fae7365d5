"""Whole texts as flat numpy arrays inside a task: buffers, word hashes, document shingles.

A batch of texts is one byte buffer with document offsets. Work goes over blocks of
about ``BLOCK`` bytes, so the memory of a task does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each; the last table is kept."""
    n = max(BLOCK, 1 << max(n - 1, 0).bit_length())
    if n in _POWERS:
        return _POWERS[n]
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    _POWERS.clear()
    _POWERS[n] = np.cumprod(up), np.cumprod(down)
    return _POWERS[n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins. Null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, text: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def _table(chars: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(chars)] = True
    return held


SPACE = _table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _cuts(data: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Blocks of ``data[start:stop]`` that end after white space, so no word is cut."""
    while stop - start > BLOCK:
        space = np.flatnonzero(SPACE[data[start : start + BLOCK]])
        end = start + BLOCK
        if len(space):
            end = start + int(space[-1]) + 1
        else:  # one word longer than a block
            while end < stop and not SPACE[data[end]]:
                end += 1
        yield start, end
        start = end
    if stop > start:
        yield start, stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased if asked, and its document's index."""
    hashes, owners = [], []
    first, last = int(offsets[0]), int(offsets[-1])
    for start, stop in _cuts(data, first, last):
        block = data[start:stop]
        inside = ~SPACE[block]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = offsets[(offsets >= start) & (offsets < stop)] - start
        begins[edge] |= inside[edge]
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        up, down = powers(len(block))
        worth = ((LOWER[block] if lower else block).astype(np.uint64) + np.uint64(1)) * up[: len(block)]
        worth[~inside] = 0
        hashes.append(mix(np.add.reduceat(worth, at) * down[at]))
        owners.append(np.searchsorted(offsets, at + start, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words of each document, sorted by document and hash.

    A document of fewer words has its whole word sequence as one shingle; one
    without words has none.
    """
    words, owner = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    counts = np.bincount(owner, minlength=n_docs)
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64))
    n = max(len(words) - size + 1, 0)
    hashed = np.zeros(n, np.uint64)
    for k in range(size):
        hashed += mix(words[k : k + n] ^ seeds[k])
    whole = owner[:n] == owner[size - 1 : size - 1 + n] if n else np.zeros(0, bool)
    hashed, holder = mix(hashed[whole]), owner[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = np.isin(owner, short)
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        part = mix(words[few] ^ seeds[place[few]]) + np.uint64(1)
        sums = np.zeros(n_docs, np.uint64)
        np.add.at(sums, owner[few], part)
        hashed, holder = np.r_[hashed, mix(sums[short])], np.r_[holder, short]
    order = np.lexsort((hashed, holder))
    hashed, holder = hashed[order], holder[order]
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (holder[1:] != holder[:-1])
    return hashed[fresh], holder[fresh]
