"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook, so the pair of codes
names one of K * K cells.  A query takes cells by the summed nearness of their
two centroids, with a heap over the pairs, until they hold a set share of the
rows, and all entries of these cells are ranked by their exact inner product.
Cells of many rows are cut into blocks, and blocks dealt into groups of bounded
size; a query visits the groups that hold its cells.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicspark.llm.common import keep, runs, with_schema

#: Rows that the codebooks are fitted on, at most, and centroids of each half.
SAMPLE_ROWS, CENTROIDS = 20_000, 128
#: Share of all rows that a query's cells hold at least.
SHARE = 0.4
#: Rows of a block of a cell, and of a group of blocks, about.
BLOCK_ROWS, GROUP_ROWS = 4_000, 16_000
_QUERIES = 256
#: Queries whose cells a task picks.
ASKED_ROWS = 200


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of the usable vectors: not null, finite, not zero, of ``dim`` components."""
    column = column.cast(pa.list_(pa.float64()))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(np.bincount(size[size > 0]).argmax()) if (size > 0).any() else 0
    at = np.flatnonzero((size == dim) & (dim > 0))
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    fine = np.isfinite(values).all(1) & (values != 0).any(1)
    return at[fine], values[fine]


def _kmeans(rows: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    centers = rows[np.random.default_rng(5).choice(len(rows), k, replace=False)].copy()
    for _ in range(turns):
        code = _nearest(rows, centers)
        for j in range(k):
            if (code == j).any():
                centers[j] = rows[code == j].mean(0)
    return centers


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (2 * rows @ centers.T - (centers * centers).sum(1)).argmax(1) if len(rows) else np.zeros(0, np.int64)


@dataclass
class MultiIndex:
    """Codebooks of the two halves, rows of each cell, and where cells' blocks lie."""

    dim: int
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None

    def cells(self, rows: np.ndarray) -> np.ndarray:
        half = self.dim // 2
        return _nearest(rows[:, :half], self.first) * len(self.second) + _nearest(rows[:, half:], self.second)

    def arrange(self, counts: np.ndarray) -> None:
        """Number the blocks of cells in order and deal them into groups."""
        self.counts = counts
        self.blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.blocks)])
        rows = np.repeat(counts / self.blocks, self.blocks)
        self.group = (np.cumsum(rows) // GROUP_ROWS).astype(np.int64)

    def visit(self, query: np.ndarray, share: float, least: int = 0) -> list[int]:
        """Non-empty cells in the order of summed inner products of their centroids, until they hold ``share`` of the rows and ``least`` rows."""
        half = self.dim // 2
        a, b = self.first @ query[:half], self.second @ query[half:]
        one, two = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[one], b[two]
        n, wanted, got, out = len(b), max(share * self.counts.sum(), least), 0, []
        heap, depth = [(-(a[0] + b[0]), 0, 0)], np.zeros(len(a), np.int64)
        while heap and got < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(one[i] * n + two[j])
            if self.counts[cell]:
                out.append(cell)
                got += int(self.counts[cell])
            # row i goes on to the right; the next row starts when row i is first taken
            if j + 1 < n:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return out


def fit_index(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> MultiIndex:
    """Codebooks from at most ``sample_rows`` rows, chosen by a hash of their id."""
    total = vectors.count()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(total)) < sample_rows)
    table = rows.limit(sample_rows).toArrow().combine_chunks().sort_by("id")
    values = table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
    _, sample = matrix(values)
    dim = sample.shape[1]
    if not len(sample):
        return MultiIndex(0, np.zeros((1, 0)), np.zeros((1, 0)))
    order = np.lexsort(sample.T[::-1])
    sample = sample[order]
    half, k = dim // 2, min(centroids, len(sample))
    return MultiIndex(dim, _kmeans(sample[:, :half], k), _kmeans(sample[:, half:], k))


def _top(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int):
    """For each query the k best (score, id): exact products, ties to smaller ids."""
    out_q, out_id, out_score = [], [], []
    for i in range(len(own)):
        line = scores[i]
        some = np.flatnonzero(line > -np.inf)
        if len(some) > k:
            edge = np.partition(line[some], len(some) - k)[len(some) - k]
            some = some[line[some] >= edge - 1e-9 * max(1.0, abs(edge))]
        exact = (rows[some] * queries[i]).sum(1)
        best = np.lexsort((ids[some], -exact))[:k]
        out_q.append(np.full(len(best), own[i]))
        out_id.append(ids[some][best])
        out_score.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, column: str = "embedding", id_col: str = "vec_id", share: float = SHARE,
) -> DataFrame:
    """The ``k`` candidates of largest inner product that each query finds: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are rows like those of ``vectors``; a candidate of the query's own id
    is never returned.  Ties go to the smaller id.  Rows that repeat an id and
    vector count once.  Null ids, and vectors that are null, zero, of another
    length than most, or hold a null or non-finite component take no part; of
    several usable vectors of one id the least asks, in the order of arrays; with
    fewer than ``k`` candidates all of them are returned.  ``share`` of 1 is an
    exact search.  Other columns are not read.
    """
    index = fit_index(vectors, column, id_col)
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if not index.dim:
        return spark.createDataFrame([], out)
    books = spark.sparkContext.broadcast(index)

    def coded(batches):
        for batch in batches:
            at, rows = matrix(batch.column(1), books.value.dim)
            if len(at):
                yield {"id": batch.column(0).take(pa.array(at)), "cell": books.value.cells(rows), "v": [r.tobytes() for r in rows]}

    kinds = pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("v", pa.binary())])
    pick = lambda df: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    entries = keep(pick(vectors).mapInArrow(with_schema(coded, kinds), "id long, cell int, v binary").dropDuplicates(), "entries")
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for row in entries.groupBy("cell").count().collect():  # at most CENTROIDS ** 2 rows
        counts[row["cell"]] = row["count"]
    index.arrange(counts)
    # a query's own id takes no part, whatever vectors it has
    own_rows = entries.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    placed = spark.sparkContext.broadcast(index)

    def entry_rows(batches):
        held = placed.value
        for batch in batches:
            cell, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            block = held.start[cell] + (ids * 2654435761 % (1 << 31)) % held.blocks[cell]
            n = len(cell)
            yield {"group": held.group[block], "kind": np.zeros(n, np.int32), "id": ids, "v": batch.column(2), "cells": [x.tobytes() for x in cell[:, None]]}

    def query_rows(batches):
        held = placed.value
        for batch in batches:
            at, rows = matrix(batch.column(1), held.dim)
            for number, v in zip(batch.column(0).take(pa.array(at)).to_pylist(), rows):
                cells = np.array(held.visit(v, share, k + own_rows), np.int32)
                # every group that holds a block of a cell gets the query with its cells there
                count = held.blocks[cells]
                block = np.repeat(held.start[cells], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                group, cell = held.group[block], np.repeat(cells, count)
                found = [(int(g), np.unique(cell[group == g]).astype(np.int32)) for g in np.unique(group)]
                yield {"group": [g for g, _ in found], "kind": [1] * len(found), "id": [number] * len(found), "v": [v.tobytes()] * len(found), "cells": [c.tobytes() for _, c in found]}

    shape = pa.schema([("group", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("cells", pa.binary())])
    names = "group long, kind int, id long, v binary, cells binary"
    # of several vectors of one id the least usable one asks
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    asked = pick(queries).where((F.size("v") == index.dim) & usable).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.repartition(queries.count() // ASKED_ROWS + 1, "id")
    rows = entries.mapInArrow(with_schema(entry_rows, shape), names).union(asked.mapInArrow(with_schema(query_rows, shape), names))

    def search(batches):
        dim, cells = placed.value.dim, len(placed.value.counts)
        group, held, ids = None, [], None
        for (g, kind), part in runs(batches, ["group", "kind"]):
            number = part.column(2).to_numpy()
            v = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(len(number), dim)
            if kind == 0:
                if g != group:
                    group, held, ids = g, [], None
                held.append((number, np.frombuffer(b"".join(part.column(4).to_pylist()), np.int32), v))
                continue
            if g != group:
                continue
            if ids is None:  # the group's entries are complete; rows that repeat id and vector count once
                ids, cell, rows = (np.concatenate(x) for x in zip(*held))
                whole = np.concatenate([ids[:, None].view(np.uint8), rows.view(np.uint8)], axis=1)
                _, fresh = np.unique(whole.view(f"V{whole.shape[1]}"), return_index=True)
                ids, cell, rows, held = ids[fresh], cell[fresh], rows[fresh], []
            visited = part.column(4).to_pylist()
            for low in range(0, len(number), _QUERIES):
                q, own = v[low : low + _QUERIES], number[low : low + _QUERIES]
                scores = q @ rows.T
                for i in range(len(q)):
                    inside = np.zeros(cells, bool)
                    inside[np.frombuffer(visited[low + i], np.int32)] = True
                    scores[i, ~inside[cell] | (ids == own[i])] = -np.inf
                yield dict(zip(("query_id", "vec_id", "score"), _top(scores, ids, q, rows, own, k)))

    found = rows.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(
        with_schema(search, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

