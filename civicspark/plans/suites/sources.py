"""Pages of map services and other saved files, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.plans.registry import query
from civicspark.sources import paged as D
from civicspark.sources.shared import fresh_path


def _saved(t, table: str, key: str, name: str, size: int, shape=None) -> str:
    """Rows of a table, numbered by their dense key, as pages in the shared folder."""
    path = fresh_path(t._spark, f"layer-{table}")
    rows = getattr(t, table).select(F.col(key).alias("place"), F.col(key).alias("ID"), F.col(name).alias("NAME"), *([] if table == "customer" else [F.lit(table).alias("KIND")]))
    D.write_pages(rows, path, "place", size, shape, [c for c in rows.columns if c != "place"])
    return path


def _point():
    return F.struct((F.col("ID") / 2).alias("x"), F.col("ID").cast("double").alias("y"), F.lit(None).cast("array<array<array<double>>>").alias("rings"))


@query("s5", """SELECT 'homes' AS layer, c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS kind, c_custkey / 2 AS x FROM customer UNION ALL SELECT 'plants', s_suppkey, s_name, 'supplier', NULL FROM supplier""")
def s5(t):
    """Rows of two layers with different attributes, from their pages."""
    layers = {
        "homes": (_saved(t, "customer", "c_custkey", "c_name", 100, _point()), "ID bigint, NAME string"),
        "plants": (_saved(t, "supplier", "s_suppkey", "s_name", 30), "ID bigint, NAME string, KIND string"),
    }
    rows = D.read_layers(t._spark, layers)
    return rows.select("layer", F.col("ID").alias("id"), F.col("NAME").alias("name"), F.col("KIND").alias("kind"), F.col("geometry.x").alias("x"))


@query("s6", """SELECT c_custkey // 64 * 64 AS "offset", count(*) AS rows, sum(c_custkey)::BIGINT AS ids, sum(c_custkey)::DOUBLE AS y FROM customer GROUP BY 1""")
def s6(t):
    """Rows of each page of one layer of points, in which nothing is missing."""
    rows = D.read_layer(t._spark, _saved(t, "customer", "c_custkey", "c_name", 64, _point()), "ID bigint, NAME string")
    return rows.groupBy("offset").agg(F.count("*").alias("rows"), F.sum("ID").alias("ids"), F.sum("geometry.y").alias("y"))
