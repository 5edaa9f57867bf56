"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast join may hold, about 10 MB; a side with more rows is shuffled.
BROADCAST_ROWS = 250_000
#: Counted rows of ids that are worth a task.
TASK_ROWS = 20_000
#: Tasks of a stage at most, for the driver's sake; beyond that a task takes more groups, not larger ones.
MOST_TASKS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, an own one for a local session, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='civicspark-')}"
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The written table survives lost executors, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows, in no more tasks than TASK_ROWS asks for."""
    tasks = rows // TASK_ROWS + 1
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of ``df``: the planner's estimate, which is file sizes for a scan, or else those of its strings, summed."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 60:  # the planner's default, where it knows nothing, is larger
        return estimate
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    total = df.agg(F.sum(sum(strings, F.lit(8).cast("long")))).first()[0]
    return int(total or 0)


def parts_for(df: DataFrame, bytes_each: int = 8_000_000) -> int:
    """Groups that hold about ``bytes_each`` of stored input, at least the session's number of partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, input_bytes(df) // bytes_each + 1)


def tasks_for(parts: int) -> int:
    """Tasks that work on so many groups, each on one after the other: as many, up to MOST_TASKS."""
    return max(1, min(MOST_TASKS, parts))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of equal keys, in the order of the batches; a key's rows may come in several slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(c[a].item() for c in columns), batch.slice(a, b - a)


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """All slices of each key of a partition sorted by the keys; one key is held at a time."""
    now, held = None, []
    for key, part in runs(batches, keys):
        if key != now:
            if held:
                yield now, held
            now, held = key, []
        held.append(part)
    if held:
        yield now, held


def partition_blobs(part: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Split parallel arrays by ``part``: each part's values, array after array, as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    arrays = [a[order] for a in arrays]
    for a, b in zip(starts, [*starts[1:], len(part)] if len(part) else []):
        yield int(part[a]), b"".join(x[a:b].tobytes() for x in arrays)


def unpack(blob: bytes, types: list) -> list[np.ndarray]:
    """The arrays of one blob made by :func:`partition_blobs`."""
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(blob) // sum(sizes), 0, []
    for t, size in zip(types, sizes):
        out.append(np.frombuffer(blob, t, n, at))
        at += n * size
    return out


def give_back() -> None:
    """Return this worker's free memory to the machine: a reused worker would hold its largest task's until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def with_schema(function: Callable, schema: pa.Schema) -> Callable:
    """A mapInArrow function from one that yields dicts of columns; free memory is given back at a task's end."""

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        give_back()

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` hangs on one ``v`` and no ``v`` hangs on anything."""
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    ends = ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("rows"), F.count("v").alias("hung"))
    return sized(ends, 2 * edges.count()).where("low < high or (hung > 0 and rows > hung)").limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40, roots: bool = True) -> DataFrame:
    """Smallest id reachable from every id that has an edge: columns ``id``, ``component``.

    Without ``roots``, the smallest ids themselves have no row.

    Alternates large-star and small-star steps, each a shuffle of the edges, until
    the edges are stars; ids are never collected.  Every step ends in a written
    table, so lost executors cost one step at most.  Hot ids are safe: a step
    aggregates ``min`` before it shuffles, and the join that follows may split
    skewed partitions.
    """
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    settled = now.limit(1).count() == 0
    for _ in range(rounds):
        if settled:
            break
        rows = 2 * now.count()
        both = now.union(now.select("v", "u"))
        least = sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows)
        # large star: every larger neighbour hangs on the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: smaller neighbours and the node itself hang on the smallest
        small_least = sized(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(small_least, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small_least.select("u", F.col("m").alias("v"))
        )
        now = keep(sized(after.distinct(), rows), "edges")
        settled = _are_stars(now)
    if not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(now.select("v", "v").distinct()) if roots else members
