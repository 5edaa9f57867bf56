"""Vectorised word, shingle and window hashing of Arrow string columns.

The functions work on the UTF-8 buffer of a whole Arrow chunk with numpy, so
the cost for a word is a few nanoseconds and no Python object is made for it.
A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``.  All hashes are 64
bits wide and do not depend on the process, so executors agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of the hash functions.
_BASE = 0x9E3779B97F4A7C15
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text hashed at once; bounds the memory of the scratch arrays.
CHUNK_BYTES = 1_000_000

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each; those of a chunk are kept, longer ones made anew."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > CHUNK_BYTES + 1:
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive documents: ``first[i]:first[i + 1]`` are those of document i."""

    first: np.ndarray  # int64, documents + 1
    start: np.ndarray  # int64, byte offsets into data
    end: np.ndarray
    hash: np.ndarray  # uint64
    data: np.ndarray  # uint8, as it was before lower-casing

    @property
    def doc(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string array; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(column: pa.Array, lower: bool = False, marks: bytes = b"\x20\x09\x0a\x0b\x0c\x0d") -> Words:
    """Words of every document with their hashes; lower folds A-Z before hashing."""
    raw, at = text_bytes(column)
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), none, none, none.astype(np.uint64), raw)
    table = np.ones(256, bool)
    table[list(marks)] = False
    inside = table[raw]
    edge = np.zeros(n + 1, bool)  # documents end words too
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n + 1)
    folded = raw
    if lower:
        folded = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * _STEP))
    return Words(np.searchsorted(start, at).astype(np.int64), start, end, h, raw)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether its document has as many."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        out[: n - k] = out[: n - k] * _STEP + h[k:]
    last = np.repeat(words.first[1:], np.diff(words.first))
    return mix(out), np.arange(n) + width <= last


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, whole documents only."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        gone = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, gone + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document: hashes sorted within documents, and offsets.

    A document of fewer than ``width`` words has its whole sequence as its one
    shingle; one without words has none.
    """
    docs = len(words.first) - 1
    h, full = windows(words, width)
    doc = words.doc
    h, doc = h[full], doc[full]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, i in enumerate(short):
            v = counts[i : i + 1].astype(np.uint64)
            for k in range(words.first[i], words.first[i + 1]):
                v = v * _STEP + words.hash[k : k + 1]
            extra[j] = v[0]
        h, doc = np.concatenate([h, mix(extra)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(docs + 1)).astype(np.int64)


def join_words(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every document, joined by one space."""
    start, size = words.start[kept], (words.end - words.start)[kept]
    per_doc = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[words.first]
    stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
    total = int(stops[-1])
    at = np.arange(total) - np.repeat(stops[:-1] - start, size + 1)
    space = np.zeros(total, bool)
    space[stops[1:] - 1] = True
    at[space] = 0
    out = words.data[at] if len(words.data) else np.zeros(0, np.uint8)
    out[space] = 32
    # the space after each document's last word goes
    filled = np.diff(per_doc) > 0
    drop = stops[per_doc[1:]][filled] - 1
    mask = np.ones(total, bool)
    mask[drop] = False
    offsets = stops[per_doc] - np.concatenate([np.zeros(1, np.int64), np.cumsum(filled)])
    return pa.Array.from_buffers(pa.large_string(), len(per_doc) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[mask])])
