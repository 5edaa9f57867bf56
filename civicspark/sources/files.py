"""Readers and sinks of the civic files: reports, JSON pages, JSON lines and keyed CSV tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV report of string columns without NUL characters, title row, row of column names, and blank rows.

    The title row has its first column only; the row of names is told by its
    texts, so a large file may be split.  Missing columns are null.
    """
    rows = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), header=False, mode="PERMISSIVE")
    clean = rows.select(*[F.nullif(F.trim(F.translate(c, "\x00", "")), F.lit("")).alias(c) for c in columns])
    names = reduce(lambda a, b: a & b, [F.lower(c).eqNullSafe(F.lit(c.lower())) for c in columns])
    filled = F.size(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    return clean.where(~names & (filled > (1 if len(columns) > 1 else 0)))


def read_feature_pages(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    """Rows of saved JSON pages ``{"features": [{"attributes": {...}, "geometry": {"x", "y"}}]}``: attributes and point.

    attributes: their schema in DDL.
    """
    schema = f"features array<struct<attributes: struct<{attributes}>, geometry: struct<x: double, y: double>>>, exceededTransferLimit boolean"
    pages = spark.read.json(path, schema=schema, multiLine=True)
    return pages.select(F.explode("features").alias("f")).select("f.attributes.*", F.col("f.geometry.x").alias("x"), F.col("f.geometry.y").alias("y"))


def page_offsets(total: int, size: int) -> list[int]:
    """Offsets of the pages that hold ``total`` rows, at least one page."""
    return list(range(0, max(total, 1), size))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are none are left out."""
    rows = spark.read.schema(f"{schema}, __bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad")
    names = [c for c in rows.columns if c != "__bad"]
    return rows.where(F.col("__bad").isNull() & reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])).select(*names)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append to the CSV table at ``path`` those rows whose keys it lacks, once each; returns the table.

    Null keys count as empty texts, as CSV does not tell them apart.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{c}` string" for c in rows.columns)
    filled = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    table = lambda: filled(spark.read.csv(path, schema=schema))
    new = filled(rows).dropDuplicates(keys)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        new = new.join(table().select(*keys), keys, "left_anti").select(*rows.columns)
    new.write.mode("append").csv(path)
    return table()


def between(rows: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows whose ISO date lies from ``first`` to ``last``, both included; an end that is None is open."""
    rows = rows.where(F.col(column) >= first) if first else rows
    return rows.where(F.col(column) <= last) if last else rows
