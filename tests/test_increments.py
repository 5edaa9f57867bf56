"""Drains, counters that bear repeated batches, sweeps, phases."""

import pytest
from civicspark.sources.versions import VersionedTable
from civicspark.streaming import increments as I
from pyspark.sql import functions as F


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def land(spark, path, values):
    spark.createDataFrame(values, "id long, article long").coalesce(1).write.mode("append").parquet(path)


def test_a_killed_batch_is_not_counted_twice(spark, tmp_path):
    path, schema = f"{tmp_path}/in", "id long, article long"
    land(spark, path, [(1, 7), (2, 7), (3, None)])
    counts = VersionedTable(spark, f"{tmp_path}/counts", ["article"], 2)
    count, killed = I.counting(counts, "article"), []

    def breaks_once(batch, number):
        count(batch, number)
        if not killed:
            killed.append(number)
            raise OSError("killed behind the write")

    with pytest.raises(Exception, match="killed"):
        I.drain_by(I.files(spark, path, schema), breaks_once, f"{tmp_path}/c")
    assert rows(counts.read().select("article", "n")) == [(7, 2), (None, 1)]
    for _ in range(2):
        I.drain_by(I.files(spark, path, schema), breaks_once, f"{tmp_path}/c")
        assert rows(counts.read().select("article", "n")) == [(7, 2), (None, 1)]
    land(spark, path, [(4, 7), (5, 8), (6, None)])
    I.drain_by(I.files(spark, path, schema), breaks_once, f"{tmp_path}/c")
    assert rows(counts.read().select("article", "n")) == [(7, 3), (8, 1), (None, 2)]


def test_two_drains_equal_one_run(spark, tmp_path):
    values = [(k, k % 5) for k in range(40)]
    path, whole = f"{tmp_path}/in", VersionedTable(spark, f"{tmp_path}/whole", ["article"], 3)
    I.counting(whole, "article")(spark.createDataFrame(values, "id long, article long"), 0)
    parts = VersionedTable(spark, f"{tmp_path}/parts", ["article"], 3)
    for lot in (values[:13], values[13:]):
        for k in range(0, len(lot), 9):
            land(spark, path, lot[k : k + 9])
        I.drain_by(I.files(spark, path, "id long, article long", 1), I.counting(parts, "article"), f"{tmp_path}/c")
    assert rows(parts.read().select("article", "n")) == rows(whole.read().select("article", "n"))


def test_documents_are_swept_once(spark, tmp_path):
    found, swept = VersionedTable(spark, f"{tmp_path}/f", ["id"], 2), VersionedTable(spark, f"{tmp_path}/s", ["id"], 2)
    scanned = []

    def scan(documents):
        scanned.extend(sorted(r.id for r in documents.collect()))
        return documents.select("id", F.explode(F.split("text", " ")).alias("word"))

    write = I.sweeping(found, swept, "id", scan)
    batch = lambda values: spark.createDataFrame(values, "id long, text string")
    write(batch([(1, "a b"), (2, None), (1, "z")]), 0)
    first = rows(found.read())
    assert first == [(1, "a"), (1, "b")]
    write(batch([(1, "a b"), (2, None), (1, "z")]), 0)  # the same batch again
    write(batch([(2, "late"), (3, "c")]), 1)  # 2 was swept
    write(batch([]), 2)
    assert rows(found.read()) == [*first, (3, "c")] and scanned == [1, 2, 3] and swept.read().count() == 3


def test_a_break_between_found_and_swept_scans_again(spark, tmp_path):
    found, swept = VersionedTable(spark, f"{tmp_path}/f", ["id"], 2), VersionedTable(spark, f"{tmp_path}/s", ["id"], 2)
    scan = lambda d: d.select("id", F.upper("text").alias("word"))
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    merge, swept.merge = swept.merge, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        I.sweeping(found, swept, "id", scan)(batch, 0)
    swept.merge = merge
    I.sweeping(found, swept, "id", scan)(batch, 0)
    assert rows(found.read()) == [(1, "A"), (2, "B")] and swept.read().count() == 2


def test_merging_makes_rows_of_batches(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", ["id"], 2)
    write = I.merging(table, lambda old, new: old.union(new).distinct(), lambda b: b.select("id", (F.col("article") * 2).alias("twice")))
    batch = spark.createDataFrame([(1, 2), (3, 4)], "id long, article long")
    write(batch, 0), write(batch, 0)
    assert rows(table.read()) == [(1, 4), (3, 8)]


def test_phases_are_run_once(spark, tmp_path):
    state, ran, work = VersionedTable(spark, f"{tmp_path}/p", ["name"], 1), [], [False]

    def phase(name, fails=lambda: False, **more):
        def run():
            if fails():
                raise OSError(name)
            ran.append(name)
            return len(ran)

        return I.Phase(name, run, **more)

    broken = [True]
    phases = [phase("a"), phase("b", lambda: broken[0], critical=True), phase("c", pending=lambda: work[0])]
    assert I.run_phases(state, phases) == [("a", "ok"), ("b", "failed")]
    broken[0] = False
    assert I.run_phases(state, phases) == [("a", "skipped"), ("b", "ok"), ("c", "ok")]
    work[0] = True
    assert I.run_phases(state, phases) == [("a", "skipped"), ("b", "skipped"), ("c", "ok")]
    assert I.run_phases(state, phases, force=True, only=["a"]) == [("a", "ok")]
    assert {r["name"]: r.runs for r in state.read().collect()} == {"a": 2, "b": 1, "c": 2} and ran == ["a", "b", "c", "c", "a"]


def test_windows(spark):
    one = spark.range(1).select(I.sync_window(F.lit("2024-03-01").cast("date"), F.lit("weekly")).alias("w"), I.sync_window(F.lit("2024-03-01").cast("date"), F.lit(None).cast("string")).alias("d"))
    got = one.select(F.col("w.first").cast("string"), F.col("w.last").cast("string"), F.col("d.first").cast("string"), F.col("d.last").cast("string")).first()
    assert tuple(got) == ("2024-01-31", "2024-03-15", "2024-02-27", "2024-03-15")
