"""Every registered query of the civic engine and its SQL, by name."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.plans.projection import Tables, with_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``, with equal SQL where there is any."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_prefix(sql)
        return function

    return register


def cases(name: str, arguments: str, rows: list[tuple]):
    """Register a function of columns over a table of cases: every order takes one of them, by its key.

    rows: the arguments, named and typed in ``arguments``, and the text of the
    value that the function has to give.
    """
    values = ", ".join("(%d, %s)" % (k, "NULL" if row[-1] is None else "'" + row[-1].replace("'", "''") + "'") for k, row in enumerate(rows))
    sql = f"SELECT o_orderkey, value FROM orders JOIN (VALUES {values}) AS c(k, value) ON k = o_orderkey % {len(rows)}"

    def register(function: Callable):
        def run(t: Tables) -> DataFrame:
            given = t._spark.createDataFrame([(k, *row[:-1]) for k, row in enumerate(rows)], f"k int, {arguments}")
            names = given.columns[1:]
            joined = t.orders.select("o_orderkey", (F.col("o_orderkey") % len(rows)).cast("int").alias("k")).join(F.broadcast(given), "k")  # a few cases
            return joined.select("o_orderkey", function(*[F.col(c) for c in names]).cast("string").alias("value"))

        run.__doc__ = function.__doc__
        query(name, sql)(run)
        return function

    return register


def load() -> None:
    """Import the query modules, which register themselves."""
    from civicspark.plans import suites

    for module in pkgutil.iter_modules(suites.__path__):
        importlib.import_module(f"civicspark.plans.suites.{module.name}")


