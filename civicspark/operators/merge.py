"""Upserts, replaces and propagated deletes as new snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in a total order."""
    names = df.columns
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__place = 1").select(*names)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], newest: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Rows of ``current`` overwritten by the newest change of their key; changes of new keys are added.

    ``keep`` names columns in which an existing row's value stays.
    """
    latest = first_by(changes, keys, newest)
    columns = current.columns
    a, b = current.alias("a"), latest.alias("b")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.withColumn("__old", F.lit(1)).alias("a").join(b.withColumn("__new", F.lit(1)).alias("b"), match, "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        stays = old if c in (keep or []) else old & ~new
        return F.when(stays, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    return joined.select(*[value(c) for c in columns])


def replace_groups(current: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """All rows of the groups that come in are replaced by the incoming ones."""
    return current.join(incoming.select(*group).distinct(), group, "left_anti").unionByName(incoming)


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows of keys that are not there yet, each key once."""
    return first_by(incoming, keys, [F.col(c) for c in incoming.columns]).join(current, keys, "left_anti")


def propagate_deletes(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` whose key is still in ``source``."""
    return target.join(source.select(*keys).distinct(), keys, "left_semi")


def incremental(source: DataFrame, column: str, mark) -> DataFrame:
    """Rows beyond a high-water mark; all rows without one."""
    return source if mark is None else source.where(F.col(column) > mark)


def repoint(edges: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Ids in ``columns`` replaced by the survivor that ``mapping`` (victim, survivor) names."""
    for c in columns:
        pairs = mapping.select(F.col("victim").alias(c), F.col("survivor").alias("__survivor"))
        edges = edges.join(pairs, c, "left").withColumn(c, F.coalesce("__survivor", c)).drop("__survivor")
    return edges.select(*edges.columns)
