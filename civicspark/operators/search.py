"""Full-text search over an inverted index, with weights and ranks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of fields, as PostgreSQL's defaults.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def terms(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits; no stemming."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def build_index(docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Rows of (id, field weight class, term, position); ``fields`` maps a column to A, B or C."""
    parts = [docs.select(F.col(id_col).alias("id"), F.lit(w).alias("weight"), F.posexplode(terms(F.col(c))).alias("position", "term")) for c, w in fields.items()]
    return reduce(DataFrame.unionByName, parts)


def parse_query(text: str) -> list[tuple[bool, bool, list[str]]]:
    """(excluded, prefix, words) of each part: words, "phrases", -exclusions and prefixes*."""
    out = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        words = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        if words:
            out.append((bool(minus), not phrase and word.endswith("*"), words))
    return out


def search(index: DataFrame, query: str) -> DataFrame:
    """``id`` and ``rank`` of documents that match every part of the query and none of its exclusions.

    A part's weight is the sum over its occurrences by field; the rank is r / (r + 1).
    Each part filters the index by term before anything is shuffled.
    """
    found, excluded = None, []
    for minus, prefix, words in parse_query(query):
        first = index.where(F.col("term").startswith(words[0]) if prefix else F.col("term") == words[0])
        for k, word in enumerate(words[1:], 1):
            after = index.where(F.col("term") == word).select("id", "weight", (F.col("position") - k).alias("position"))
            first = first.join(after, ["id", "weight", "position"], "left_semi")
        if minus:
            excluded.append(first.select("id").distinct())
            continue
        value = reduce(lambda out, w: F.when(F.col("weight") == w, WEIGHTS[w]).otherwise(out), WEIGHTS, F.lit(0.0))
        part = first.groupBy("id").agg(F.sum(value).alias("r"))
        found = part if found is None else found.join(part.withColumnRenamed("r", "r2"), "id").select("id", (F.col("r") + F.col("r2")).alias("r"))
    if found is None:
        return index.select("id", F.lit(0.0).alias("rank")).limit(0)
    for ids in excluded:
        found = found.join(ids, "id", "left_anti")
    return found.select("id", F.round(F.col("r") / (F.col("r") + 1), 6).alias("rank"))


def headline(text: Column, word: str, around: int = 40) -> Column:
    """The text around the first occurrence of a word."""
    at = F.locate(word, F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word))))


def ilike_any(columns: list[str], words: list[str]) -> Column:
    """Whether any word occurs in any column, whatever the case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{w}%"), F.lit(False)) for c in columns for w in words])
