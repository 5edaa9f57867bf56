"""Permit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import permits as P
from civicspark.plans.registry import query

_DEDUP = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(permit_number, row_hash), coalesce(permit_square_feet, '') ORDER BY permit_issue_date, row_hash) AS rn FROM permits) x WHERE rn = 1)"""
_SUMS = "count(*) AS permits, sum(TRY_CAST(permit_square_feet AS DOUBLE))::BIGINT AS square_feet, sum(TRY_CAST(permit_valuation AS DOUBLE))::BIGINT AS valuation"


@query("w1", f"WITH {_DEDUP} SELECT permit_number, row_hash, permit_square_feet, permit_issue_date, normalized_category FROM d")
def w1(t):
    """Permits once for each number and size, the earliest issue."""
    return P.deduplicated(t.permits).select("permit_number", "row_hash", "permit_square_feet", "permit_issue_date", "normalized_category")


# the chosen categories are a condition on the permits, so they are deduplicated among themselves
@query("a15", f"""WITH {_DEDUP.replace("FROM permits", "FROM permits WHERE normalized_category IN ('Commercial', 'Residential', 'Trade', 'Infrastructure')")}, k AS (SELECT unnest(['Commercial', 'Residential', 'Trade', 'Infrastructure']) AS normalized_category), s AS (SELECT normalized_category, {_SUMS} FROM d GROUP BY 1)
  SELECT k.normalized_category, coalesce(permits, 0) AS permits, coalesce(square_feet, 0) AS square_feet, coalesce(valuation, 0) AS valuation FROM k LEFT JOIN s USING (normalized_category)""")
def a15(t):
    """Totals of chosen categories, zero where there is none."""
    return P.category_totals(t.permits, ["Commercial", "Residential", "Trade", "Infrastructure"])


@query("a16", f"WITH {_DEDUP} SELECT normalized_category, work_type, {_SUMS} FROM d GROUP BY 1, 2")
def a16(t):
    """Totals by category and work type."""
    return P.totals(t.permits, "normalized_category", "work_type")


@query("a17", f"""WITH {_DEDUP} SELECT substring(permit_issue_date, 1, 4) AS issue_year, count(*) AS permits, round(avg(TRY_CAST(permit_square_feet AS DOUBLE)), 2) AS avg_square_feet,
  sum(TRY_CAST(permit_valuation AS DOUBLE))::BIGINT AS valuation FROM d GROUP BY 1""")
def a17(t):
    """Permits by year of issue."""
    rows = P.deduplicated(t.permits).groupBy(F.substring("permit_issue_date", 1, 4).alias("issue_year"))
    return rows.agg(F.count("*").alias("permits"), F.round(F.avg(P.number(F.col("permit_square_feet"))), 2).alias("avg_square_feet"), F.sum(P.number(F.col("permit_valuation"))).cast("long").alias("valuation"))


@query("f44", "SELECT row_hash, sha256(concat(coalesce(permit_number, ''), '||', permit_square_feet, '||', permit_issue_date)) AS stable_hash FROM permits")
def f44(t):
    """Stable hash of a permit's fields."""
    return t.permits.select("row_hash", P.row_hash(F.col("permit_number"), F.col("permit_square_feet"), F.col("permit_issue_date")).alias("stable_hash"))


@query("f30", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def f30(t):
    """Dates of millisecond stamps in both of their notations."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, ms).otherwise(F.concat(F.lit("/Date("), ms, F.lit(")/")))
    return t.events.select("event_id", P.arcgis_date(raw).alias("day"))


@query("f32", "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders")
def f32(t):
    """Currency texts back to numbers."""
    text = F.concat(F.lit("$"), F.format_number(F.round("o_totalprice", 2), 2))
    return t.orders.select("o_orderkey", P.number(text).alias("amount"))


@query("f33", "SELECT c_custkey, round(degrees(c_acctbal * 1000 / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(c_acctbal * 100 / 6378137.0)) - pi() / 2), 6) AS lat FROM customer")
def f33(t):
    """Web Mercator to degrees."""
    rows = t.customer.select("c_custkey", P.web_mercator(F.col("c_acctbal") * 1000, F.col("c_acctbal") * 100).alias("p"))
    return rows.select("c_custkey", "p.lon", "p.lat")


@query("w11", "SELECT DISTINCT l_orderkey, l_partkey FROM permits")
def w11(t):
    """Permits once for each key of a chunk."""
    return t.permits.select("l_orderkey", "l_partkey").dropDuplicates(["l_orderkey", "l_partkey"])


@query("s8", """WITH b AS (SELECT min(o_orderdate)::DATE AS low, max(o_orderdate)::DATE + 1 AS high FROM orders),
c AS (SELECT d::DATE AS d, least(d::DATE + 180, high) AS e FROM (SELECT unnest(generate_series(low, high - 1, INTERVAL 180 DAY)) AS d, high FROM b) x)
SELECT CAST(d AS STRING) AS chunk_start, CAST(e AS STRING) AS chunk_end, count(o_orderkey) AS orders FROM c LEFT JOIN orders ON o_orderdate::DATE >= d AND o_orderdate::DATE < e GROUP BY 1, 2""")
def s8(t):
    """Half-open chunks of 180 days from the first order to the last, with their orders."""
    day = F.col("o_orderdate").cast("date")
    dates = t.orders.select(day.alias("day"), "o_orderkey")
    bounds = dates.agg(F.min("day").alias("low"), F.date_add(F.max("day"), 1).alias("high"))
    starts = bounds.select(F.explode(F.sequence("low", F.date_sub("high", 1), F.expr("interval 180 days"))).alias("start"), "low", "high")
    chunks = starts.select("start", F.least(F.date_add("start", 180), "high").alias("end"), F.floor(F.date_diff("start", "low") / 180).alias("chunk"))
    counted = dates.join(F.broadcast(bounds), F.lit(True)).groupBy(F.floor(F.date_diff("day", "low") / 180).alias("chunk")).agg(F.count("*").alias("orders"))
    found = chunks.join(counted, "chunk", "left")
    return found.select(F.col("start").cast("string").alias("chunk_start"), F.col("end").cast("string").alias("chunk_end"), F.coalesce("orders", F.lit(0)).alias("orders"))
