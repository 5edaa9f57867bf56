"""Increments: streams that end in tables in versions, running counters, and phases that are run once.

A batch may be repeated after a failure, so every write here gives the same
table when it is told the same batch twice.  A table belongs to one checkpoint:
batches are numbered by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import merge as M
from civicspark.sources.shared import keep
from civicspark.sources.versions import VersionedTable

Batch = Callable[[DataFrame, int], None]


def files(spark: SparkSession, path: str, schema, at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder, at most ``at_once`` of them in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def drain_by(stream: DataFrame, write: Batch, checkpoint: str) -> None:
    """Give ``write`` the batches of all that is there and stop; a later call takes up where this one ended."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merging(table: VersionedTable, how: Callable[[DataFrame, DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame] | None = None) -> Batch:
    """Merge what ``make`` makes of a batch into a table; ``how`` has to give the same table for rows it was given before."""

    def write(batch: DataFrame, number: int) -> None:
        table.merge(keep(make(batch) if make else batch, "batch"), how)

    return write


def counting(table: VersionedTable, key: str) -> Batch:
    """Add up how often each key came: ``key``, ``n`` and ``batch``, the last batch that was added to it.

    A batch is counted before it is merged, so a key that holds a large part of
    all rows is one row of the merge.  A key to which a batch was added already
    stays as it is.  Null is a key.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(key).agg(F.count("*").alias("n")).withColumn("batch", F.lit(number).cast("long"))
        table.merge(keep(counts, "counts"), add)

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        told = old.select(F.col(key).alias("__key"), F.col("n").alias("__n"), F.col("batch").alias("__batch"), F.lit(True).alias("__old"))
        both = told.join(new.withColumn("__new", F.lit(True)), F.col("__key").eqNullSafe(F.col(key)), "full_outer")
        fresh = F.col("__new").isNotNull() & (F.col("__batch").isNull() | (F.col("batch") > F.col("__batch")))
        return both.select(
            F.when(F.col("__old"), F.col("__key")).otherwise(F.col(key)).alias(key),
            (F.coalesce("__n", F.lit(0)) + F.when(fresh, F.col("n")).otherwise(0)).cast("long").alias("n"),
            F.when(fresh, F.col("batch")).otherwise(F.col("__batch")).alias("batch"),
        )

    return write


def sweeping(found: VersionedTable, swept: VersionedTable, id_col: str, scan: Callable[[DataFrame], DataFrame]) -> Batch:
    """Scan documents that were not swept, replace what was found in them, and then note them as swept.

    A failure between both writes has the documents scanned again, which finds the
    same.  A document that comes again later is not scanned; of rows of one id in a batch the first in the order of all columns counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        documents = M.first_by(batch, [id_col], [F.col(c) for c in batch.columns])
        if swept.version():
            documents = documents.join(swept.read().select(id_col), id_col, "left_anti")
        documents = keep(documents, "to-sweep")
        found.merge(keep(scan(documents), "found"), lambda old, new: M.replace_groups(old, new, [id_col]))
        done = documents.select(id_col, F.lit(number).cast("long").alias("batch"))
        swept.merge(done, lambda old, new: M.replace_groups(old, new, [id_col]))

    return write


@dataclass
class Phase:
    """A step of a run: ``run`` returns how many rows it wrote; ``pending`` tells whether there is new work for a phase that was done."""

    name: str
    run: Callable[[], int]
    pending: Callable[[], bool] | None = None
    critical: bool = False


def run_phases(state: VersionedTable, phases: list[Phase], force: bool = False, only: list[str] | None = None) -> list[tuple[str, str]]:
    """Run phases in order and note each in ``state`` (``name``, ``rows``, ``runs``) once it is done; (name, ok, skipped or failed) of each.

    A phase that was done is skipped unless it has pending work or all are
    forced.  A failed phase is not noted, so the next run repeats it; if it is
    critical, the run ends with it.
    """
    spark, said = state.spark, []
    for phase in phases:
        if only is not None and phase.name not in only:
            continue
        done = {r["name"]: r.runs for r in state.read().collect()} if state.version() else {}  # a row for each phase
        if phase.name in done and not force and not (phase.pending and phase.pending()):
            said.append((phase.name, "skipped"))
            continue
        try:
            rows = phase.run()
        except Exception as fault:
            print(f"phase {phase.name} failed: {fault}")
            said.append((phase.name, "failed"))
            if phase.critical:
                break
            continue
        note = spark.createDataFrame([(phase.name, int(rows), done.get(phase.name, 0) + 1)], "name string, rows long, runs long")
        state.merge(note, lambda old, new: M.replace_groups(old, new, ["name"]))
        said.append((phase.name, "ok"))
    return said


# Days that a sync looks back, by tier, and ahead.
WEEKLY_BACK, DAILY_BACK, AHEAD = 30, 3, 14


def sync_window(today: Column, tier: Column) -> Column:
    """First and last day, both included, that a sync of a tier (``weekly``, else daily) takes in."""
    back = F.when(tier.eqNullSafe("weekly"), WEEKLY_BACK).otherwise(DAILY_BACK)
    return F.struct(F.date_sub(today, back).alias("first"), F.date_add(today, AHEAD).alias("last"))
