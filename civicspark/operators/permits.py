"""Permit cleaning, dedup and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.merge import first_by


def number(value: Column) -> Column:
    """A numeric text with currency marks as a double, null where it is none."""
    return F.nullif(F.regexp_replace(value, "[$,\\s]", ""), F.lit("")).try_cast("double")


def arcgis_date(value: Column) -> Column:
    """``/Date(ms)/``, 13-digit milliseconds or an ISO date as ``YYYY-MM-DD``."""
    ms = F.coalesce(F.nullif(F.regexp_extract(value, r"^/Date\((-?\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"^(\d{13})$", 1), F.lit("")))
    iso = F.nullif(F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd"), iso)


def web_mercator(x: Column, y: Column) -> Column:
    """(longitude, latitude) of Web Mercator metres."""
    r = 6378137.0
    return F.struct(F.round(F.degrees(x / r), 6).alias("lon"), F.round(F.degrees(2 * F.atan(F.exp(y / r)) - F.pi() / 2), 6).alias("lat"))


def row_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``||``, nulls as empty."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def deduplicated(permits: DataFrame) -> DataFrame:
    """The earliest issue of each (number or row hash, square feet)."""
    keys = [F.coalesce("permit_number", "row_hash"), F.coalesce("permit_square_feet", F.lit(""))]
    return first_by(permits, keys, [F.col("permit_issue_date"), F.col("row_hash")])


def totals(permits: DataFrame, *groups: str) -> DataFrame:
    """Count, square feet and valuation of deduplicated permits by group."""
    return deduplicated(permits).groupBy(*groups).agg(
        F.count("*").alias("permits"), F.sum(number(F.col("permit_square_feet"))).cast("long").alias("square_feet"), F.sum(number(F.col("permit_valuation"))).cast("long").alias("valuation")
    )


def category_totals(permits: DataFrame, categories: list[str]) -> DataFrame:
    """Totals of the chosen categories; one without a permit appears with zeros."""
    chosen = permits.sparkSession.createDataFrame([(c,) for c in categories], "normalized_category string")
    found = totals(permits.where(F.col("normalized_category").isin(categories)), "normalized_category")
    return chosen.join(found, "normalized_category", "left").fillna(0, ["permits", "square_feet", "valuation"])
