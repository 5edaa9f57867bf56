"""Benchmark decontamination by greedy string tiling.

Karp-Rabin hashes of every run of ``seed`` words of the benchmark are joined to
those of the documents.  For a document and an item that share seeds, the
longest match of unmarked words is marked again and again until none of at
least ``seed`` words is left.  The share of an item's words that are marked
tells contamination, so passages whose parts come in another order count whole.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import wordhash as wh
from civicspark.llm.common import give_back, keep

#: Bytes of benchmark text in a block that is broadcast; more items take more blocks, one after the other.
BLOCK_BYTES = 32_000_000
#: White space and ASCII punctuation end a word.
_MARKS = bytes(x for x in range(128) if not chr(x).isalnum() and chr(x) not in "_")
_TILING = "array<struct<item_id: long, item_words: int, covered: int, tiles: array<struct<item_start: int, doc_start: int, length: int>>>>"


def tile(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]] | tuple, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) of greedy string tiling.

    seeds: places in the item and in the document where ``least`` words agree.
    Ties in length go to the smaller start in the item, then in the document.
    """
    i, j = seeds
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    ends = np.r_[cut[1:], len(i)]
    heap = [(-(int(b - a) + least - 1), int(i[a]), int(j[a])) for a, b in zip(cut, ends)]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        free = ~(in_item[a : a + size] | in_doc[b : b + size])
        if free.all():
            in_item[a : a + size] = in_doc[b : b + size] = True
            out.append((a, b, size))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for x, y in edges.reshape(-1, 2):
            if y - x >= least:
                heapq.heappush(heap, (-int(y - x), a + int(x), b + int(x)))
    return out


@dataclass
class Block:
    """Items of the benchmark and their sorted seeds of ``seed`` words."""

    seed: int
    ids: list[int]
    words: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _blocks(ids: list, texts: list, seed: int) -> list[Block]:
    """The items of a block; those of fewer than ``seed`` words have all their words as their seed."""
    sizes = np.diff(wh.split_words(pa.array(texts, pa.string()), lower=True, marks=_MARKS).first)
    own = {width: np.flatnonzero(np.minimum(sizes, seed) == width) for width in range(1, seed + 1)}
    return [_block([ids[i] for i in at], [texts[i] for i in at], width) for width, at in own.items() if len(at)]


def _block(ids: list, texts: list, seed: int) -> Block:
    words = wh.split_words(pa.array(texts, pa.string()), lower=True, marks=_MARKS)
    h, full = wh.windows(words, seed)
    doc = words.doc
    place = np.arange(len(h)) - words.first[doc]
    order = np.argsort(h[full], kind="stable")
    each = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])]
    return Block(seed, ids, each, h[full][order], doc[full][order], place[full][order])


def _match(block: Block, words: wh.Words) -> dict[int, list[tuple]]:
    """(item, tiles) of every document of a slice that shares a seed with an item."""
    if not len(block.hash):
        return {}
    h, full = wh.windows(words, block.seed)
    at = np.minimum(np.searchsorted(block.hash, h), len(block.hash) - 1)
    hit = np.flatnonzero(full & (block.hash[at] == h))
    if not len(hit):
        return {}
    low, high = np.searchsorted(block.hash, h[hit], "left"), np.searchsorted(block.hash, h[hit], "right")
    which = np.repeat(hit, high - low)
    entry = np.repeat(low, high - low) + np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    doc = words.doc[which]
    item, i, j = block.item[entry], block.place[entry], which - words.first[doc]
    order = np.lexsort((item, doc))
    doc, item, i, j = doc[order], item[order], i[order], j[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)])
    out: dict[int, list[tuple]] = {}
    for a, b in zip(cut, np.r_[cut[1:], len(doc)]):
        d, t = int(doc[a]), int(item[a])
        text = words.hash[words.first[d] : words.first[d + 1]]
        out.setdefault(d, []).append((t, tile(block.words[t], text, (i[a:b], j[a:b]), block.seed)))
    return out


def with_tilings(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    seed: int = 5, least_coverage: float = 0.5, column: str = "tilings", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with an array of the benchmark items that each row holds.

    An entry has ``item_id``, ``item_words``, ``covered`` (words of the item under
    tiles) and the ``tiles``; items below ``least_coverage`` are left out, so a
    clean row has an empty array.  Words are runs of letters and digits with A-Z
    folded.  An item of fewer than ``seed`` words is found where all of them stand
    in a row; items of a null id or without words are never found; null or empty
    texts hold none; each row is judged by itself, so repeated rows
    and null ids get their own result.  A column named ``column`` is replaced.

    The benchmark is broadcast in blocks of ``block_bytes`` of text.  Where it has
    several, the rows are written after each, so a task holds one block at a time.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != column]
    rows = docs.select(*names).withColumn(column, F.array().cast(_TILING))
    items = benchmark.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int32()), ("covered", pa.int32()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])))]))
    for k in range(blocks):
        part = sorted(items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).distinct().collect())  # about block_bytes of text
        shared = spark.sparkContext.broadcast(_blocks([r.id for r in part], [r.text for r in part], seed))

        def run(batches, shared=shared):
            for batch in batches:
                for piece in wh.chunks(batch, text):
                    words = wh.split_words(piece.column(piece.schema.get_field_index(text)).cast(pa.string()), lower=True, marks=_MARKS)
                    last = piece.schema.get_field_index(column)
                    found = piece.column(last).to_pylist()
                    for block in shared.value:
                        for d, hits in _match(block, words).items():
                            for t, tiles in hits:
                                covered, n = sum(x[2] for x in tiles), len(block.words[t])
                                if covered >= least_coverage * n:
                                    entry = [{"item_start": a, "doc_start": b, "length": size} for a, b, size in tiles]
                                    found[d].append({"item_id": block.ids[t], "item_words": n, "covered": covered, "tiles": entry})
                    columns = list(piece.columns)
                    columns[last] = pa.array(found, kind)
                    yield pa.RecordBatch.from_arrays(columns, piece.schema.names)
            give_back()

        rows = rows.mapInArrow(run, schema)
        if k + 1 < blocks:
            rows = keep(rows, "tilings")
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; see :func:`with_tilings`."""
    return with_tilings(docs, benchmark, text, column="__tilings", **options).where(F.size("__tilings") == 0).drop("__tilings")
