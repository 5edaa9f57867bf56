"""Merges, replication, search, entity resolution and streaming-like queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import merge as M
from civicspark.operators import resolve as R
from civicspark.operators import search as S
from civicspark.plans.registry import query
from civicspark.streaming.views import trending


def _old_new(t):
    """A table and its changes: later lines of an order update earlier ones."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_shipdate").cast("string").alias("day"))
    first = M.first_by(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("day", "l_partkey", "l_quantity")])
    return first.where("day < '1997-01-01'"), rows.where("day >= '1996-06-01'")


_OLD_NEW = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS STRING) AS day FROM lineitem),
o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, day FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY day, l_partkey, l_quantity) AS rn FROM r) x WHERE rn = 1 AND day < '1997-01-01'),
c AS (SELECT * FROM r WHERE day >= '1996-06-01'),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, day FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY day DESC, l_partkey, l_quantity) AS rn FROM c) x WHERE rn = 1)"""


@query("d1", f"WITH {_OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)")
def d1(t):
    """Upsert by key, the newest change wins."""
    old, new = _old_new(t)
    return M.upsert(old, new, ["l_orderkey", "l_linenumber"], [F.desc("day"), F.col("l_partkey"), F.col("l_quantity")])


@query("d3", f"WITH {_OLD_NEW} SELECT * FROM c UNION ALL SELECT * FROM o WHERE l_orderkey NOT IN (SELECT l_orderkey FROM c)")
def d3(t):
    """Replace all rows of the orders that come in."""
    old, new = _old_new(t)
    return M.replace_groups(old, new, ["l_orderkey"])


@query("d12", f"WITH {_OLD_NEW} SELECT n.l_orderkey, n.l_linenumber, coalesce(o.l_partkey, n.l_partkey) AS l_partkey, n.l_quantity, n.day FROM n LEFT JOIN o USING (l_orderkey, l_linenumber) UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)")
def d12(t):
    """Upsert that keeps a column of rows that were there."""
    old, new = _old_new(t)
    return M.upsert(old, new, ["l_orderkey", "l_linenumber"], [F.desc("day"), F.col("l_partkey"), F.col("l_quantity")], keep=["l_partkey"])


@query("d17", """SELECT CASE WHEN source_entity_id % 10 = 3 THEN source_entity_id - 1 ELSE source_entity_id END AS source_entity_id, target_entity_id, relationship_type FROM entity_relationships""")
def d17(t):
    """Edges of merged entities point to the survivors."""
    mapping = t.persons.where("id % 10 = 3").select(F.col("id").alias("victim"), (F.col("id") - 1).alias("survivor"))
    return M.repoint(t.entity_relationships, mapping, ["source_entity_id"])


@query("d20", "SELECT event_id, list_extract([2, 4, 8, 16], least(event_id % 40 // 4, 3)::INT + 1) AS wait_days FROM events")
def d20(t):
    """Days until the next check, by age."""
    waits = F.array(*[F.lit(x) for x in (2, 4, 8, 16)])
    age = F.least(F.floor((F.col("event_id") % 40) / 4), F.lit(3)).cast("int")
    return t.events.select("event_id", F.element_at(waits, age + 1).alias("wait_days"))


@query("i9", """SELECT w AS window_start, w + INTERVAL 24 HOUR AS window_end, article_id, count(*) AS views FROM (
  SELECT article_id, unnest(generate_series(date_trunc('hour', viewed_at) - INTERVAL 23 HOUR, date_trunc('hour', viewed_at), INTERVAL 1 HOUR)) AS w FROM page_views) x GROUP BY 1, 2, 3""")
def i9(t):
    """Views in sliding windows of a day."""
    return trending(t.page_views, "article_id", "viewed_at")


@query("i9_all", """SELECT w AS window_start, w + INTERVAL 24 HOUR AS window_end, article_id, count(*) AS views FROM (
  SELECT article_id, unnest(generate_series(date_trunc('hour', viewed_at) - INTERVAL 23 HOUR, date_trunc('hour', viewed_at), INTERVAL 1 HOUR)) AS w FROM page_views) x GROUP BY 1, 2, 3""")
def i9_all(t):
    """Views of all articles in sliding windows of a day."""
    return trending(t.page_views, "article_id", "viewed_at")


@query("p10", "SELECT meeting_id, agenda_item_number FROM agenda_items WHERE title ILIKE '%Widget%' OR title ILIKE '%economy%' OR item_text ILIKE '%Widget%' OR item_text ILIKE '%economy%'")
def p10(t):
    """Items that hold any of several words."""
    return t.agenda_items.where(S.ilike_any(["title", "item_text"], ["Widget", "economy"])).select("meeting_id", "agenda_item_number")


@query("p11", "SELECT id, name FROM entities WHERE name ILIKE '%00012%' ORDER BY name LIMIT 21")
def p11(t):
    """Entities by part of a name, one more than a page to tell truncation."""
    return t.entities.where(F.col("name").ilike("%00012%")).orderBy("name").limit(21).select("id", "name")


@query("e14", """WITH n AS (SELECT min(p_partkey) AS id, concat(p_name, ' ', p_brand) AS name FROM part GROUP BY 2),
w AS (SELECT id, lower(name) AS name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM n),
p AS (SELECT a.id, b.id AS other, greatest(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))),
  CASE WHEN (contains(a.name, b.name) OR contains(b.name, a.name)) AND least(length(a.name), length(b.name)) > 0.25 * greatest(length(a.name), length(b.name)) THEN 0.85 ELSE 0 END) AS score FROM w a JOIN w b ON a.id < b.id)
SELECT id, other, round(score, 4)::DOUBLE AS score FROM p WHERE score >= 0.85""")
def e14(t):
    """Pairs of the distinct names of parts that are variations of each other."""
    names = t.part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    return R.similar_pairs(names, "id", "name", 0.85)


@query("e14_merge")
def e14_merge(t):
    """Merge map of name variations over the whole table: the most ordered part survives."""
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = t.part.join(counts, "p_partkey", "left").select("p_partkey", "p_type", F.coalesce("n", F.lit(0)).alias("mentions"))
    return R.merge_variations(rows, "p_partkey", "p_type", "mentions")


@query("e15", """WITH m AS (SELECT c_mktsegment AS block, c_custkey AS id, count(o_orderkey) AS mentions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT block, arg_max(id, mentions * 1000000 - id) AS survivor FROM m GROUP BY 1) SELECT m.id AS victim, b.survivor FROM m JOIN b USING (block) WHERE m.id <> b.survivor""")
def e15(t):
    """Merge map of blocks: the most mentioned survives."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = t.customer.join(counts, "c_custkey", "left").select(F.col("c_mktsegment").alias("block"), F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("mentions"))
    return R.merge_map(rows, "block", "id", "mentions")


@query("j7", "SELECT a.id AS id1, b.id AS id2 FROM entities a JOIN entities b ON substring(a.normalized_name, 1, 17) = substring(b.normalized_name, 1, 17) AND a.id < b.id AND a.entity_type <> b.entity_type")
def j7(t):
    """Same name, other type."""
    key = F.substring("normalized_name", 1, 17).alias("k")
    a = t.entities.select(key, F.col("id").alias("id1"), F.col("entity_type").alias("t1"))
    b = t.entities.select(key, F.col("id").alias("id2"), F.col("entity_type").alias("t2"))
    return a.join(b, "k").where("id1 < id2 and t1 <> t2").select("id1", "id2")


@query("f64", """WITH n AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_type), ' ')) AS a, list_distinct(string_split(lower(p_name), ' ')) AS b FROM part)
SELECT id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS score FROM n""")
def f64(t):
    """Token Jaccard of two names."""
    return t.part.select(F.col("p_partkey").alias("id"), F.round(R.jaccard(R.tokens(F.col("p_type")), R.tokens(F.col("p_name"))), 6).alias("score"))


