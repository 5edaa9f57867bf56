"""Ranked lexical search over an index of shards.

A shard holds some megabytes of text of one task's documents: its documents
sorted by id, and for each term the sorted places of the documents that hold
it, as gaps and counts in variable-length bytes.  A query reads the postings of
its terms only.  In each shard, the posting lists of an item are merged
document-at-a-time: a heap yields the least block of documents that any list
goes on in, all lists of that block are added up, and its documents are
finished before the next block is looked at.  The best documents stay in a
heap of bounded size keyed by score, then document, which goes on from shard to
shard of a task; a last ranking merges the heaps of all tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm import wordhash as wh
from civicspark.llm.common import give_back, grouped_rows, keep

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 6_000_000
#: Documents of a block of postings, a power of two.
BLOCK_DOCS = 4_096
#: Bytes of items that are searched at once; more items take more passes over the index.
QUERY_BYTES = 8_000_000
#: ASCII characters other than letters and digits end a term.
_MARKS = [x for x in range(128) if not chr(x).isalnum()]
_INSIDE = np.ones(256, bool)
_INSIDE[_MARKS] = False

_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())])
_INDEX_DDL = "shard long, term string, docs long, tokens long, data binary"
_HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_HITS_DDL = "item_id long, doc_id long, score long"


def encode_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the high bit on all but a number's last byte; and the bytes of each number."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1) << np.uint64(7 * k) if k < 9 else values >> np.uint64(63) > 0
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        more = np.flatnonzero(sizes > k)
        part = (values[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[more] + k] = part.astype(np.uint8) | np.where(sizes[more] > k + 1, np.uint8(128), np.uint8(0))
    return out, sizes


def decode_varints(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`encode_varints`, as int64."""
    end = np.flatnonzero(data < 128)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    sizes = end - start + 1
    out = np.zeros(len(end), np.int64)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        more = np.flatnonzero(sizes > k)
        out[more] |= (data[start[more] + k] & 127).astype(np.int64) << (7 * k)
    return out


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of an array of texts, A-Z lower-cased, and the place of each term's text."""
    raw, at = wh.text_bytes(texts)
    n = len(raw)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    inside = _INSIDE[raw]
    edge = np.zeros(n + 1, bool)  # texts end terms too
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    start = np.flatnonzero(starts)
    letters = raw[inside]
    letters = letters + np.where((letters >= 65) & (letters <= 90), np.uint8(32), np.uint8(0))
    # a term's letters stand together once all marks are gone
    offsets = np.r_[np.cumsum(inside)[start] - 1, len(letters)].astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return terms, np.searchsorted(at, start, side="right") - 1


def _shard(shard: int, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
    """The rows of a shard: one for its documents, then one for each term."""
    terms, doc = split_terms(texts)
    if not len(terms):
        return None
    lengths = np.bincount(doc, minlength=len(ids))
    held = np.flatnonzero(lengths)
    order = held[np.argsort(ids[held], kind="stable")]
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    coded = terms.dictionary_encode()
    names = coded.dictionary.cast(pa.string())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique(code * len(order) + place[doc], return_counts=True)
    code, at = np.divmod(key, len(order))
    first = np.r_[True, code[1:] != code[:-1]]
    gaps = np.where(first, at, np.diff(at, prepend=0))
    pairs = np.empty(2 * len(at), np.int64)
    pairs[0::2], pairs[1::2] = gaps, tf
    data, sizes = encode_varints(pairs)
    starts = np.flatnonzero(first)
    cuts = np.r_[0, np.cumsum(sizes)][np.r_[2 * starts, len(sizes)]]
    sorted_ids = ids[order]
    head, _ = encode_varints(np.r_[np.diff(sorted_ids), lengths[order]])
    document_row = sorted_ids[:1].astype(np.int64).tobytes() + head.tobytes()
    postings = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    n = len(starts) + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, shard, np.int64)),
            pa.concat_arrays([pa.array([None], pa.string()), names]),
            pa.array(np.r_[len(order), np.diff(np.r_[starts, len(at)])], pa.int64()),
            pa.array(np.r_[lengths.sum(), np.zeros(n - 1, np.int64)], pa.int64()),
            pa.concat_arrays([pa.array([document_row], pa.binary()), postings.cast(pa.binary())]),
        ],
        schema=_INDEX,
    )


def _shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            return _shard(task << 32 | count, ids, pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held]))

        for batch in batches:
            for piece in wh.chunks(batch, "text"):
                held.append(piece)
                size += piece.column(1).nbytes
                if size >= shard_bytes:
                    if (rows := close()) is not None:
                        yield rows
                    count, held, size = count + 1, [], 0
        if held and (rows := close()) is not None:
            yield rows
        give_back()

    return run


@dataclass
class Index:
    """Rows of shards: ``term`` is null in the row of a shard's documents."""

    rows: DataFrame
    n_docs: int
    n_tokens: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """An index of every whole text, written to the shared folder: one pass over ``docs``, without a shuffle.

    Documents without an id, without a text or without a term take no part.
    Each of repeated rows is a document.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = keep(rows.mapInArrow(_shards(shard_bytes), _INDEX_DDL), "lexical-index")
    total = index.where("term IS NULL").agg(F.sum("docs"), F.sum("tokens")).first()
    return Index(index, total[0] or 0, total[1] or 0)


@dataclass
class Queries:
    """Items of one pass: their ids, and the (number, repeats) of their terms."""

    ids: list[int]
    terms: list[list[tuple[int, int]]]
    weights: np.ndarray
    n_docs: int
    n_tokens: int


class Best:
    """The k best documents of an item seen so far: a heap keyed by score, then by smaller id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.heap: list[tuple[int, int]] = []

    @property
    def floor(self) -> int:
        """Least score that can still come in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents in the order of their ids."""
        at = np.flatnonzero(scores >= self.floor)
        if len(at) > self.k:
            got = scores[at]
            cut = np.partition(got, len(got) - self.k)[len(got) - self.k]
            above, equal = at[got > cut], at[got == cut]
            at = np.r_[above, equal[: self.k]]
        for score, doc in zip(scores[at].tolist(), ids[at].tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -doc))
            elif (score, -doc) > self.heap[0]:
                heapq.heapreplace(self.heap, (score, -doc))


class Shard:
    """The decoded postings of the queries' terms in one shard."""

    def __init__(self, batches: list[pa.RecordBatch], queries: Queries) -> None:
        number = np.concatenate([b.column("number").to_numpy(zero_copy_only=False) for b in batches])
        docs = np.concatenate([b.column("docs").to_numpy(zero_copy_only=False) for b in batches])
        data = [x for b in batches for x in b.column("data").to_pylist()]
        head = data[0]  # rows are sorted, and the documents have number -1
        n = int(docs[0])
        numbers = decode_varints(np.frombuffer(head, np.uint8, len(head) - 8, 8))
        self.ids = np.cumsum(np.r_[np.frombuffer(head, np.int64, 1), numbers[: n - 1]])
        # the scale of a document: 75 hundredths of its length by the mean, and 25 of the mean
        scale = 75 + (25 * numbers[n - 1 :] * queries.n_docs) // queries.n_tokens
        pairs = decode_varints(np.frombuffer(b"".join(data[1:]), np.uint8))
        gaps, tf = pairs[0::2], pairs[1::2]
        term, sizes = number[1:], docs[1:]
        self.cut = np.r_[0, np.cumsum(sizes)]
        summed = np.cumsum(gaps)
        start = self.cut[:-1]
        self.place = summed - np.repeat(summed[start] - gaps[start], sizes) if len(sizes) else gaps
        self.gain = np.repeat(queries.weights[term], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 12 * scale[self.place]))
        self.slot = {int(t): k for k, t in enumerate(term)}
        # blocks of each list: its postings of one block of documents
        block = np.repeat(np.arange(len(sizes)), sizes) * (n // BLOCK_DOCS + 1) + self.place // BLOCK_DOCS
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        self.edge = np.r_[edge, len(block)]
        self.block = self.place[edge] // BLOCK_DOCS
        self.first_block = np.searchsorted(edge, self.cut)

    def search(self, terms: list[tuple[int, int]], best: Best) -> None:
        """Merge the posting lists of one item, a block of documents at a time."""
        lists = [(self.slot[t], repeats) for t, repeats in terms if t in self.slot]
        heap = [(int(self.block[self.first_block[s]]), int(self.first_block[s]), int(self.first_block[s + 1]), r) for s, r in lists]
        heapq.heapify(heap)
        while heap:
            now = heap[0][0]
            low = now * BLOCK_DOCS
            scores = np.zeros(min(BLOCK_DOCS, len(self.ids) - low), np.int64)
            while heap and heap[0][0] == now:
                _, at, end, repeats = heap[0]
                part = slice(self.edge[at], self.edge[at + 1])
                scores[self.place[part] - low] += self.gain[part] if repeats == 1 else repeats * self.gain[part]
                if at + 1 < end:
                    heapq.heapreplace(heap, (int(self.block[at + 1]), at + 1, end, repeats))
                else:
                    heapq.heappop(heap)
            best.offer(scores, self.ids[low : low + len(scores)])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best = [Best(k) for _ in queries.ids]
        for _, rows in grouped_rows(batches, ["shard"]):
            shard = Shard(rows, queries)
            for terms, found in zip(queries.terms, best):
                shard.search(terms, found)
        hits = [(item, -doc, score) for item, found in zip(queries.ids, best) for score, doc in found.heap]
        columns = zip(*hits) if hits else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_HITS)
        give_back()

    return run


def _blocks_of_items(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of ``size`` bytes of text, read by the driver one after the other."""
    held, total = [], 0
    for row in items.toLocalIterator(prefetchPartitions=True):
        held.append((row.item_id, row.text))
        total += len(row.text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def search(index: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    An item's score of a document sums, over the item's terms with repeats,
    w * ((10**9 * tf) div (1000 * tf + 12 * m)) in 64-bit integers, with
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L:
    N documents with L terms, n terms in the document, df documents with the
    term, tf of them in this one.  Documents without score are not returned.

    Items without an id, text or term have no result, repeated items count once,
    and of different texts of one id the least in order counts.  Repeated rows
    of a document are ranked each.  Items are taken in blocks of
    ``query_bytes``, each with a pass over the postings of its terms; so many
    bytes bound what is broadcast.
    """
    spark = index.rows.sparkSession
    chosen = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(item_id).cast("long").alias("item_id")).agg(F.min(text).alias("text"))
    found = spark.createDataFrame([], _HITS_DDL)
    for number, block in enumerate(_blocks_of_items(chosen.orderBy("item_id"), query_bytes)):
        hits = _search_block(index, block, k)
        found = hits if number == 0 else keep(found, "lexical-hits").union(hits)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, block: list[tuple[int, str]], k: int) -> DataFrame:
    spark = index.rows.sparkSession
    terms, item = split_terms(pa.array([t for _, t in block], pa.string()))
    coded = terms.dictionary_encode()
    names = coded.dictionary.to_pylist()
    asked = spark.createDataFrame(list(enumerate(names)), "number int, term string")
    matched = index.rows.where("term IS NOT NULL").join(F.broadcast(asked), "term")
    counted = np.zeros(len(names), np.int64)
    for number, docs in matched.groupBy("number").agg(F.sum("docs")).toLocalIterator():
        counted[number] = docs
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(df) + 1))) for df in counted], np.int64)
    repeats = [Counter() for _ in block]
    for at, code in zip(item.tolist(), coded.indices.to_pylist()):
        repeats[at][code] += 1
    queries = Queries([i for i, _ in block], [sorted(r.items()) for r in repeats], weights, index.n_docs, index.n_tokens)
    heads = index.rows.where("term IS NULL").select("shard", F.lit(-1).alias("number"), "docs", "data")
    lists = matched.select("shard", "number", "docs", "data").union(heads)
    dealt = lists.repartition("shard").sortWithinPartitions("shard", "number")
    return dealt.mapInArrow(_search(spark.sparkContext.broadcast(queries), k), _HITS_DDL)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """:func:`search` of ``items`` (item_id, text) over an index of ``docs`` (doc_id, text); other columns are ignored."""
    return search(build_index(docs), items, k)
