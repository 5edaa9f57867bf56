"""Increments: drains of streams into tables in versions, running counters, sweeps, phases and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import entity_graph as G
from civicspark.operators import minutes as X
from civicspark.operators import phrases as P
from civicspark.plans.registry import query
from civicspark.sources.shared import fresh_path, keep
from civicspark.sources.versions import VersionedTable
from civicspark.streaming import increments as I


def _in_two_lots(rows, id_col: str, write, at_once: int = 4) -> None:
    """Drain even ids, then odd ones, out of a folder that grows, and then once more without anything new."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "landing")
    checkpoint = fresh_path(spark, "drain")
    for lot in (0, 1):
        rows.where(F.col(id_col) % 2 == lot).repartition(8, id_col).write.mode("append").parquet(path)
        I.drain_by(I.files(spark, path, rows.schema, at_once), write, checkpoint)
    I.drain_by(I.files(spark, path, rows.schema, at_once), write, checkpoint)


@query("s17", "SELECT article_id, count(*) AS n FROM page_views GROUP BY 1")
def s17(t):
    """Running view counts by article, as page views come in."""
    counts = VersionedTable(t._spark, fresh_path(t._spark, "views"), ["article_id"])
    _in_two_lots(t.page_views.select("id", "article_id"), "id", I.counting(counts, "article_id"))
    return counts.read().select("article_id", "n")


def _swept(t, rows, id_col: str, scan):
    found = VersionedTable(t._spark, fresh_path(t._spark, "found"), [id_col])
    swept = VersionedTable(t._spark, fresh_path(t._spark, "swept"), [id_col])
    _in_two_lots(rows, id_col, I.sweeping(found, swept, id_col, scan), at_once=16)
    return found.read()


@query("i4_sweep", """WITH s AS (SELECT unnest(['the', 'und', 'les']) AS phrase), d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ' AS body FROM documents)
SELECT doc_id, phrase, ((length(body) - length(replace(body, ' ' || phrase || ' ', ''))) // length(' ' || phrase || ' '))::BIGINT AS hits FROM d, s WHERE contains(body, ' ' || phrase || ' ')""")
def i4_sweep(t):
    """Known phrases of documents, swept once each as documents come in."""
    known = t._spark.createDataFrame([(p,) for p in ("the", "und", "les")], "phrase string")
    scan = lambda d: P.phrase_hits(d, "doc_id", "text", known, "phrase").groupBy("doc_id", "phrase").agg(F.count("*").alias("hits"))
    return _swept(t, t.documents.select("doc_id", "text"), "doc_id", scan)


@query("i5", """SELECT item_id, CASE WHEN item_text LIKE '%denied%' THEN 'denial' WHEN item_text LIKE '%filed%' THEN 'filing' ELSE 'approval' END AS event_type, 0.7::DOUBLE AS confidence FROM (
  SELECT meeting_id * 10 + CAST(agenda_item_number AS BIGINT) AS item_id, min(item_text) AS item_text FROM agenda_items GROUP BY 1) d""")
def i5(t):
    """Events of item texts, taken out once each as items come in."""
    rows = t.agenda_items.select((F.col("meeting_id") * 10 + F.col("agenda_item_number").cast("long")).alias("item_id"), "item_text").groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    scan = lambda d: X.events(d, "item_id", "item_text", {"denied": "denial", "filed": "filing", "carried": "approval"}).select("item_id", "event_type", "confidence")
    return _swept(t, rows, "item_id", scan)


@query("i1", """SELECT 'bodies' AS name, count(*) AS rows, 1::BIGINT AS runs FROM nation UNION ALL SELECT 'entities', count(*), 1 FROM customer UNION ALL SELECT 'mentions', count(*), 1 FROM orders""")
def i1(t):
    """Phases of two runs: the first breaks at one of them, the second runs what is left."""
    state, broken = VersionedTable(t._spark, fresh_path(t._spark, "phases"), ["name"], 1), []

    def copy(name: str, rows):
        def run() -> int:
            if name == "entities" and not broken:
                broken.append(name)
                raise OSError("the table is not there yet")
            return keep(rows, name).count()

        return I.Phase(name, run, critical=True)

    phases = [copy("bodies", t.public_bodies), copy("entities", t.entities), copy("mentions", t.entity_mentions)]
    for _ in range(3):
        I.run_phases(state, phases)
    return state.read()


@query("i6", """WITH m AS (SELECT c_custkey AS id, c_custkey // 2 AS k, c_custkey % 2 AS side, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT a.id AS person, b.id AS firm, a.n <= 2 AND b.n > 3 * a.n AS turned FROM m a JOIN m b ON a.k = b.k AND a.side = 0 AND b.side = 1)
SELECT CASE WHEN turned THEN person ELSE firm END AS victim, CASE WHEN turned THEN firm ELSE person END AS survivor, 2 AS runs FROM p""")
def i6(t):
    """The resolver runs again only when entities have come that it has not seen."""
    spark = t._spark
    counts = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("mentions"))
    kind = F.when(F.col("id") % 2 == 0, "person").otherwise("law_firm")
    rows = t.entities.select("id", F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("normalized_name"), kind.alias("entity_type")).join(counts, "id", "left").withColumn("resolved", F.lit(False))
    entities = VersionedTable(spark, fresh_path(spark, "entities"), ["normalized_name"])
    merges = VersionedTable(spark, fresh_path(spark, "merges"), ["victim"])
    state = VersionedTable(spark, fresh_path(spark, "phases"), ["name"], 1)

    def resolve() -> int:
        found = keep(G.type_conflicts(entities.read()), "conflicts")
        merges.replace(found)
        entities.replace(entities.read().withColumn("resolved", F.lit(True)))
        return found.count()

    resolver, said = I.Phase("resolver", resolve, pending=lambda: not entities.read().where("not resolved").isEmpty()), []
    entities.replace(rows.where("id % 3 > 0"))
    for _ in range(2):
        said += I.run_phases(state, [resolver])
    entities.merge(keep(rows.where("id % 3 = 0"), "new-entities"), lambda old, new: old.unionByName(new))
    said += I.run_phases(state, [resolver])
    return merges.read().withColumn("runs", F.lit(said.count(("resolver", "ok"))))


@query("i10", """SELECT meeting_id, meeting_date, CASE WHEN public_body_id % 5 = 0 THEN 'weekly' ELSE 'daily' END AS tier FROM meetings
WHERE CAST(meeting_date AS DATE) BETWEEN DATE '1996-06-15' - CASE WHEN public_body_id % 5 = 0 THEN 30 ELSE 3 END AND DATE '1996-06-29'""")
def i10(t):
    """Meetings that a sync of mid-June 1996 takes in, by tier."""
    rows = t.meetings.select("meeting_id", "meeting_date", F.when(F.col("public_body_id") % 5 == 0, "weekly").otherwise("daily").alias("tier"))
    window = I.sync_window(F.lit("1996-06-15").cast("date"), F.col("tier"))
    return rows.where(F.col("meeting_date").cast("date").between(window["first"], window["last"]))
