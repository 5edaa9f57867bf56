"""Ranked search in stored indexes, with filters and headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import search_index as S
from civicspark.plans.registry import query
from civicspark.sources.shared import fresh_path


def _parts(t, attributes=("p_size",)):
    """An index of parts, built in two goes: half of them first, then what is new."""
    fields = {"p_type": "A", "p_name": "B", "p_brand": "C"}
    index = S.build(t.part.where("p_partkey % 2 = 0"), "p_partkey", fields, fresh_path(t._spark, "parts"), attributes)
    S.add(index, t.part, "p_partkey", attributes)
    return index


_PART_WORDS = "list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')"


@query("x1", """WITH k AS (SELECT p_partkey AS id, p_name, CASE WHEN p_type = 'SMALL' THEN 1.0 ELSE 0 END + CASE WHEN p_name LIKE 'small %' THEN 0.4 ELSE 0 END AS r FROM part WHERE p_name NOT LIKE '% ring' AND p_size < 25)
SELECT id, round(r / (r + 1), 6)::DOUBLE AS rank, CASE WHEN p_name LIKE 'small %' THEN regexp_replace(p_name, '^small', '<b>small</b>') END AS headline FROM k WHERE r > 0 ORDER BY r DESC, id LIMIT 50""")
def x1(t):
    """The 50 best of a filtered search over weighted fields, with an exclusion and headlines."""
    index = _parts(t)
    return S.headlines(S.search(index, "small -ring", 50, "p_size < 25"), index, t.part, "p_partkey", "p_name")


@query("x1_phrase", """SELECT p_partkey AS id, round(0.4 / 1.4, 6)::DOUBLE AS rank FROM part WHERE p_name = 'small ring' ORDER BY id LIMIT 500""")
def x1_phrase(t):
    """Phrase search."""
    return S.search(_parts(t), '"small ring"', 500).drop("places")


@query("x2", """WITH k AS (SELECT p_partkey AS id, p_name, CASE WHEN p_type = 'SMALL' THEN 1.0 ELSE 0 END + CASE WHEN p_name LIKE 'small %' THEN 0.4 ELSE 0 END + 0.2 AS r FROM part WHERE (p_type = 'SMALL' OR p_name LIKE 'small %') AND p_retailprice >= 950)
SELECT id, round(r / (r + 1), 6)::DOUBLE AS rank, CASE WHEN p_name LIKE 'small %' THEN regexp_replace(p_name, '^small', '<b>small</b>') END AS headline FROM k ORDER BY r DESC, id LIMIT 40""")
def x2(t):
    """Articles by three weighted fields, both words needed, of one status, with headlines."""
    index = _parts(t, ("p_retailprice",))
    return S.headlines(S.search(index, "small brand", 40, F.col("p_retailprice") >= 950), index, t.part, "p_partkey", "p_name")


@query("x3", """WITH t AS (SELECT id, list_filter(regexp_split_to_array(text_content, '[^A-Za-z0-9]+'), lambda w: w <> '') AS w FROM supporting_documents WHERE source <> 'src0'),
g AS (SELECT id, w, list_transform(w, lambda x: lower(x)) AS l FROM t), c AS (SELECT id, w, l, len(list_filter(l, lambda x: x = 'the')) AS a, len(list_filter(l, lambda x: x = 'with')) AS b, len(list_filter(l, lambda x: x = 'les')) AS n FROM g),
k AS (SELECT id, w, 0.4 * a + 0.4 * b AS r, greatest(least(list_position(l, 'the'), list_position(l, 'with')) - 5, 1) AS s FROM c WHERE a > 0 AND b > 0 AND n = 0 ORDER BY r DESC, id LIMIT 30)
SELECT id, round(r / (r + 1), 6)::DOUBLE AS rank, array_to_string(list_transform(w[s:s + 14], lambda x: CASE WHEN lower(x) IN ('the', 'with') THEN '<b>' || x || '</b>' ELSE x END), ' ') AS headline FROM k""")
def x3(t):
    """The 30 best documents of a filtered search with an exclusion, with headlines."""
    docs = t.supporting_documents
    index = S.build(docs, "id", {"text_content": "B"}, fresh_path(t._spark, "documents"), ("source",))
    return S.headlines(S.search(index, "the with -les", 30, "source <> 'src0'"), index, docs, "id", "text_content")


@query("x4", f"SELECT p_partkey AS id, len({_PART_WORDS})::BIGINT AS terms, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS generation FROM part")
def x4(t):
    """Words of each part's name in the index, and the generation that added them."""
    rows = _parts(t).postings().select("generation", F.explode("docs").alias("d"))
    of_name = F.size(F.filter("d.places", lambda p: F.floor(p / (1 << 40)) == 1)).cast("long")
    return rows.groupBy(F.col("d.id").alias("id"), "generation").agg(F.sum(of_name).alias("terms"))


@query("f70", f"""WITH k AS (SELECT p_partkey AS id, {_PART_WORDS} AS w, lower(p_type) AS kind FROM part),
r AS (SELECT id, 0.4 * len(list_filter(w, lambda x: starts_with(x, 'sm') OR x = 'ring')) + CASE WHEN starts_with(kind, 'sm') THEN 1.0 ELSE 0 END AS r FROM k WHERE list_contains(w, 'ring') AND (starts_with(kind, 'sm') OR len(list_filter(w, lambda x: starts_with(x, 'sm'))) > 0) AND NOT array_to_string(w, ' ') LIKE '%large ring%')
SELECT id, round(r / (r + 1), 6)::DOUBLE AS rank FROM r ORDER BY r DESC, id LIMIT 300""")
def f70(t):
    """A query of a prefix, a word and an excluded phrase."""
    return S.search(_parts(t), 'sm* ring -"large ring"', 300).drop("places")
