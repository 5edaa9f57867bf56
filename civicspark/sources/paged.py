"""Saved answers of map services: pages of features by offset, of one layer or several.

A page is a file ``<offset>.json`` or a file in a folder ``offset=<offset>``,
of the form ``{"features": [{"attributes": {...}, "geometry": {...}}],
"exceededTransferLimit": true}``.  A layer ends with its first page that is empty
or does not exceed the limit; what lies behind it is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.sources.shared import keep

_GEOMETRY = "struct<x: double, y: double, rings: array<array<array<double>>>>"


class BrokenPages(ValueError):
    """Pages that cannot be read, or that have to be there and are not."""


def _pages(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    """``file``, ``offset`` and ``page`` of every file below a folder; a page that is no JSON or tells an error has no features."""
    schema = f"features array<struct<attributes: struct<{attributes}>, geometry: {_GEOMETRY}>>, exceededTransferLimit boolean, error string"
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    offset = F.coalesce(F.nullif(F.regexp_extract(file, r"offset=(\d+)/", 1), F.lit("")), F.nullif(F.regexp_extract(file, r"(\d+)\.json$", 1), F.lit("")))
    return files.select(file.alias("file"), offset.cast("long").alias("offset"), F.from_json("value", schema).alias("page"))


def _fault(page: Column) -> Column:
    return F.when(page["error"].isNotNull(), "error").when(page["features"].isNull(), "broken")


def read_layer(spark: SparkSession, path: str, attributes: str, limit: int | None = None) -> DataFrame:
    """Rows of a layer: ``offset``, the attributes (a schema in DDL) and ``geometry``; of the first ``limit`` places only, if given.

    Pages up to the end that are broken, tell an error, or are missing raise
    :class:`BrokenPages` with their names.  Headers of the pages are read first and
    kept in the shared folder; rows are read once, where they are wanted.
    """
    pages = _pages(spark, path, attributes)
    heads = keep(pages.where("offset is not null").select("file", "offset", F.size(F.coalesce("page.features", F.array())).alias("n"), F.coalesce("page.exceededTransferLimit", F.lit(False)).alias("more"), _fault(F.col("page")).alias("fault")), "page-heads")
    last = heads.where("fault is null and (n = 0 or not more)").agg(F.min("offset")).first()[0]
    inside = heads if last is None else heads.where(F.col("offset") <= last)
    inside = inside if limit is None else inside.where(F.col("offset") < limit)
    due = inside.where("fault is null and n > 0 and more").select((F.col("offset") + F.col("n")).alias("offset"))
    due = due if limit is None else due.where(F.col("offset") < limit)
    faults = inside.where("fault is not null").select(F.concat_ws(" ", "fault", "file").alias("what"))
    faults = faults.union(due.join(inside.select("offset"), "offset", "left_anti").select(F.concat(F.lit("missing offset "), "offset")))
    named = sorted(r.what for r in faults.limit(20).collect())
    if named:
        raise BrokenPages(f"{path}: {', '.join(named)}")
    read = pages if last is None else pages.where(F.col("offset") <= last)
    rows = read.select("offset", F.posexplode("page.features").alias("place", "f"))
    if limit is not None:
        rows = rows.where(F.col("offset") + F.col("place") < limit)
    return rows.select("offset", "f.attributes.*", F.col("f.geometry").alias("geometry"))


def read_layers(spark: SparkSession, layers: dict[str, tuple[str, str]], limit: int | None = None) -> DataFrame:
    """Rows of several layers (name to path and attributes), with ``layer``; attributes that a layer lacks are null.

    limit: of each layer.
    """
    each = [read_layer(spark, path, attributes, limit).withColumn("layer", F.lit(name)) for name, (path, attributes) in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def write_pages(rows: DataFrame, path: str, place: str, size: int, geometry: Column | None = None, attributes: list[str] | None = None) -> None:
    """Save rows as pages of ``size`` features; ``place`` numbers the rows from 0 without gaps."""
    names = attributes or [c for c in rows.columns if c != place]
    shape = F.lit(None).cast(_GEOMETRY) if geometry is None else geometry
    feature = F.struct(F.struct(*names).alias("attributes"), shape.alias("geometry"))
    dealt = rows.select((F.floor(F.col(place) / size) * size).alias("offset"), F.struct(F.col(place).alias("place"), feature.alias("f")).alias("row"))
    total = rows.agg(F.max(place)).first()[0]
    whole = dealt.groupBy("offset").agg(F.transform(F.array_sort(F.collect_list("row"), lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1)), lambda r: r["f"]).alias("features"))
    text = F.to_json(F.struct("features", (F.col("offset") + size <= F.lit(total)).alias("exceededTransferLimit")))
    whole.select("offset", text.alias("value")).write.mode("append").partitionBy("offset").text(path)
