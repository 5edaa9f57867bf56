"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks, which are the index, and
every rolling window of a block's width probes it.  A repeat of ``width`` words
holds a whole block of the document it repeats if ``width >= 2 * block - 1``,
wherever it lies, so blocks that no other window equals can be left out.  Hits
are extended to ``width`` words on either side, and consecutive repeats merge
into maximal spans.

Documents are dealt into chunks by a hash of their id; one shuffle of the text
serves all three scans.  Windows travel as packed arrays, each distinct hash of
a chunk once, so a passage that many documents share costs a few bytes a chunk
and no task meets all its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import wordhash as wh
from civicspark.llm.common import grouped_rows, partition_blobs, parts_for, tasks_for, unpack, with_schema

_LOW = 18  # low bits of a hash that choose its part; the others identify it there


def _windowed(table: pa.Table, text: str, id_col: str, width: int, block: int):
    """(slice, words, ids by word, windows of ``width``, their places) of documents that can hold a repeat."""
    for batch in table.select([id_col, text]).combine_chunks().to_batches():
        for part in wh.chunks(batch, text):
            words = wh.split_words(part.column(1))
            ids = part.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = words.doc
            long = (np.diff(words.first) >= width) & known
            number = np.nan_to_num(ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield part, words, doc, number, long[doc]


def _anchor_codes(h: np.ndarray, parts: int) -> np.ndarray:
    low = h & np.uint64((1 << _LOW) - 1)
    return (h >> np.uint64(_LOW)) * np.uint64(parts) + low % np.uint64(parts)


def _pack48(values: np.ndarray) -> list[np.ndarray]:
    return [values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint16)]


def _unpack48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


def _send_anchors(table, text, id_col, width, block, parts):
    """Distinct rolling windows of a chunk: part and packed rows (hash, is a block, is repeated here)."""
    hashes, blocks = [], []
    for _, words, doc, _, usable in _windowed(table, text, id_col, width, block):
        h, full = wh.windows(words, block)
        full &= usable
        place = np.arange(len(h)) - words.first[doc]
        hashes.append(h[full])
        blocks.append(place[full] % block == 0)
    if not hashes:
        return []
    h, is_block = np.concatenate(hashes), np.concatenate(blocks)
    order = np.argsort(h, kind="stable")
    h, is_block = h[order], is_block[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return []
    any_block = np.maximum.reduceat(is_block.astype(np.uint8), first)
    again = (np.diff(np.r_[first, len(h)]) > 1).astype(np.uint8)
    h = h[first]
    flags = (any_block | (again << 1)).astype(np.uint64)
    packed = ((h >> np.uint64(_LOW)) << np.uint64(2)) | flags
    part = ((h & np.uint64((1 << _LOW) - 1)) % np.uint64(parts)).astype(np.int64)
    return list(partition_blobs(part, _pack48(packed)))


def _meet_anchors(batches):
    """For every part, the windows that equal a block elsewhere, answered to each chunk that has them."""
    for (part,), held in grouped_rows(batches, ["part"]):
        chunks, values = [], []
        for batch in held:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = _unpack48(*unpack(blob, [np.uint32, np.uint16]))
                chunks.append(np.full(len(x), chunk, np.int32))
                values.append(x)
        chunk, value = np.concatenate(chunks), np.concatenate(values)
        key, flags = value >> np.uint64(2), (value & np.uint64(3)).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        key, flags, chunk = key[order], flags[order], chunk[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        seen = np.bitwise_or.reduceat(flags, first)
        hit = np.repeat((seen & 1 > 0) & ((count > 1) | (seen & 2 > 0)), count)
        if hit.any():
            blobs = list(partition_blobs(chunk[hit].astype(np.int64), _pack48(key[hit])))
            yield {"chunk": [c for c, _ in blobs], "part": [part] * len(blobs), "rows": [x for _, x in blobs]}


def _hit_windows(words, usable, block, width, hits, parts):
    """Places from which ``width`` words hold a hit of the anchors."""
    h, full = wh.windows(words, block)
    hit = full & usable & np.isin(_anchor_codes(h, parts), hits)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
    n = len(h)
    stop = np.minimum(np.arange(n) + (width - block + 1), n)
    return total[stop] - total[:-1] > 0


def _send_windows(table, answers, text, id_col, width, block, parts):
    """Distinct extended windows of a chunk at anchor hits, with the least and greatest id that start one."""
    hits = [np.zeros(0, np.uint64)]
    for part, blob in zip(answers.column("part").to_pylist(), answers.column("rows").to_pylist()):
        hits.append(_unpack48(*unpack(blob, [np.uint32, np.uint16])) * np.uint64(parts) + np.uint64(part))
    hits = np.concatenate(hits)
    hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, words, doc, number, usable in _windowed(table, text, id_col, width, block):
        h, full = wh.windows(words, width)
        full &= usable
        full &= _hit_windows(words, usable, block, width, hits, parts)
        hashes.append(h[full])
        ids.append(number[doc[full]])
    h, number = np.concatenate(hashes), np.concatenate(ids)
    if not len(h):
        return []
    order = np.lexsort((number, h))
    h, number = h[order], number[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    least, most = number[first], number[np.r_[first[1:], len(h)] - 1]
    h = h[first]
    press = zstandard.ZstdCompressor(level=1)
    where = (h % np.uint64(parts)).astype(np.int64)
    return [(p, press.compress(x)) for p, x in partition_blobs(where, [h, least, most - least])]


def _meet_windows(batches):
    """For every part, windows that start in a smaller id than a chunk's greatest, answered to that chunk."""
    for (part,), held in grouped_rows(batches, ["part"]):
        chunks, columns = [], []
        for batch in held:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = unpack(zstandard.ZstdDecompressor().decompress(blob), [np.uint64, np.int64, np.int64])
                chunks.append(np.full(len(x[0]), chunk, np.int64))
                columns.append(x)
        chunk = np.concatenate(chunks)
        h, least, spread = (np.concatenate(x) for x in zip(*columns))
        most = least + spread
        order = np.argsort(h, kind="stable")
        h, least, most, chunk = h[order], least[order], most[order], chunk[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        lowest = np.repeat(np.minimum.reduceat(least, first), np.diff(np.r_[first, len(h)]))
        tell = lowest < most
        if tell.any():
            press = zstandard.ZstdCompressor(level=1)
            blobs = list(partition_blobs(chunk[tell], [h[tell], lowest[tell]]))
            yield {"chunk": [c for c, _ in blobs], "part": [part] * len(blobs), "rows": [press.compress(x) for _, x in blobs]}


def _remove(table, answers, text, id_col, width, block, keep_text):
    """Documents of a chunk without the words of repeated windows."""
    hashes, lowest = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob in answers.column("rows").to_pylist():
        h, least = unpack(zstandard.ZstdDecompressor().decompress(blob), [np.uint64, np.int64])
        hashes.append(h)
        lowest.append(least)
    known, lowest = np.concatenate(hashes), np.concatenate(lowest)
    order = np.argsort(known)
    known, lowest = known[order], lowest[order]
    for part, words, doc, number, usable in _windowed(table, text, id_col, width, block):
        h, full = wh.windows(words, width)
        full &= usable
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            full &= (known[at] == h) & (lowest[at] < number[doc])
        else:
            full[:] = False
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, np.flatnonzero(full), 1)
        np.add.at(change, np.flatnonzero(full) + width, -1)
        gone = np.cumsum(change)[:-1] > 0
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])
        edge = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (doc[1:] == doc[:-1])]) if len(gone) else np.zeros(0, np.int64)
        stop = np.flatnonzero(gone & ~np.r_[gone[1:] & (doc[1:] == doc[:-1]), False]) + 1 if len(gone) else edge
        place = words.first[doc[edge]] if len(edge) else edge
        spans = pa.StructArray.from_arrays([pa.array(edge - place), pa.array(stop - place)], ["start", "stop"])
        span_off = np.searchsorted(edge, words.first).astype(np.int32)
        yield {
            id_col: part.column(0), "n_words": np.diff(words.first), "n_removed": total[words.first[1:]] - total[words.first[:-1]],
            "kept_text": wh.join_words(words, ~gone).cast(pa.string()), "spans": pa.ListArray.from_arrays(span_off, spans),
        }


def substring_dedup(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 13, block: int = 7
) -> DataFrame:
    """Documents without the words of passages that start in a document of a smaller id.

    Returns one row for each row of ``docs``: ``id_col``, ``n_words``,
    ``n_removed``, ``kept_text`` (the kept words, joined by one space) and
    ``spans`` (word places ``start`` to ``stop`` of the maximal exact repeats
    that were removed).  A word goes if a window of ``width`` words around it also
    starts in a document of a smaller id, judged on the input.  Null, empty and
    short texts lose nothing; a null id neither loses nor removes; rows that
    repeat an id do not remove each other's words.  Other columns are not read.
    """
    if width < 2 * block - 1:
        raise ValueError("a repeat of width words must hold a whole block: width >= 2 * block - 1")
    n = parts_for(docs)
    parts = min(2 * n, 1 << _LOW)
    chunk = F.pmod(F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)) + F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(0) % 1024, F.lit(n))
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text)).withColumn("chunk", chunk.cast("int")).repartition(tasks_for(n), "chunk")
    blobs = "chunk int, part int, rows binary"
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("rows", pa.binary())])

    def rows(found, which):
        return pa.table({"chunk": pa.array([which] * len(found), pa.int32()), "part": pa.array([p for p, _ in found], pa.int32()), "rows": pa.array([x for _, x in found], pa.binary())})

    def send_anchors(key, table):
        return rows(_send_anchors(table, text, id_col, width, block, parts), key[0].as_py())

    def send_windows(key, table, answers):
        return rows(_send_windows(table, answers, text, id_col, width, block, parts) if table.num_rows else [], key[0].as_py())

    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    out = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(kind))])

    def remove(key, table, answers):
        found = _remove(table, answers, text, id_col, width, block, True) if table.num_rows else []
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in out], schema=out) for x in found], schema=out)

    def met(sent, function):
        return (
            sent.repartition(tasks_for(n), "part").sortWithinPartitions("part").mapInArrow(with_schema(function, schema), blobs)
            .repartition(tasks_for(n), "chunk")
        )

    anchors = met(base.groupBy("chunk").applyInArrow(send_anchors, blobs), _meet_anchors)
    windows = met(base.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, blobs), _meet_windows)
    return base.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(
        remove, f"{id_col} long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, stop: long>>"
    )
