"""Joins, windows, sorting, sets and aggregates that the other suites leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import text as T
from civicspark.operators import merge as M
from civicspark.operators import permits as P
from civicspark.operators import resolve as R
from civicspark.operators import search as S
from civicspark.operators import votes as V
from civicspark.operators.merge import first_by
from civicspark.plans.registry import query


@query("j1", "SELECT v.member_id, count(*) AS votes FROM member_votes v JOIN agenda_item_votes i ON i.id = v.agenda_item_vote_id WHERE i.motion_result <> 'withdrawn' GROUP BY 1")
def j1(t):
    """Votes on items that were not withdrawn."""
    items = t.agenda_item_votes.where("motion_result <> 'withdrawn'").select(F.col("id").alias("agenda_item_vote_id"))
    return t.member_votes.join(items, "agenda_item_vote_id").groupBy("member_id").agg(F.count("*").alias("votes"))


@query("j2", "SELECT count(*) AS votes FROM member_votes v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE m.meeting_date >= '1998-01-01'")
def j2(t):
    """Meetings are joined only for a date."""
    return V.dated(t.member_votes, t.meetings, start="1998-01-01").agg(F.count("*").alias("votes"))


@query("j3", """SELECT i.id, m.meeting_date, g.n FROM agenda_item_votes i LEFT JOIN (SELECT meeting_id, count(*) AS n FROM agenda_items GROUP BY 1) g ON g.meeting_id = i.meeting_id
  LEFT JOIN meetings m ON m.body = i.body AND m.meeting_id = i.meeting_id""")
def j3(t):
    """Left joins on one and on two keys."""
    items = t.agenda_items.groupBy("meeting_id").agg(F.count("*").alias("n"))
    rows = t.agenda_item_votes.join(items, "meeting_id", "left").join(t.meetings.select("body", "meeting_id", "meeting_date"), ["body", "meeting_id"], "left")
    return rows.select("id", "meeting_date", "n")


@query("j4", """SELECT v.member_id, v.agenda_item_vote_id, p.name, m.meeting_date FROM member_votes v JOIN persons p ON p.id = v.member_id LEFT JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id
  ORDER BY m.meeting_date DESC, v.agenda_item_vote_id, v.member_id LIMIT 40""")
def j4(t):
    """Inner and left joins, then the newest rows."""
    names = t.persons.select(F.col("id").alias("member_id"), "name")
    dates = t.meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "meeting_date")
    rows = t.member_votes.join(names, "member_id").join(dates, "agenda_item_vote_id", "left")
    return rows.select("member_id", "agenda_item_vote_id", "name", "meeting_date").orderBy(F.desc("meeting_date"), "agenda_item_vote_id", "member_id").limit(40)


@query("j9", "SELECT m.meeting_id FROM meetings m LEFT JOIN agenda_items i ON i.meeting_id = m.meeting_id WHERE i.meeting_id IS NULL")
def j9(t):
    """Meetings without items."""
    return t.meetings.join(t.agenda_items, "meeting_id", "left_anti").select("meeting_id")


@query("j11", """SELECT e.id, e.source_type, m.meeting_date AS at FROM entity_mentions e JOIN meetings m ON m.meeting_id = e.source_id WHERE e.source_type = 'agenda_item'
  UNION ALL SELECT e.id, e.source_type, d.document_type FROM entity_mentions e JOIN supporting_documents d ON d.id = e.source_id WHERE e.source_type = 'supporting_document'""")
def j11(t):
    """The join key's meaning depends on a type."""
    mentions = t.entity_mentions.select("id", "source_type", "source_id")
    items = mentions.where("source_type = 'agenda_item'").join(t.meetings.select(F.col("meeting_id").alias("source_id"), F.col("meeting_date").alias("at")), "source_id")
    docs = mentions.where("source_type = 'supporting_document'").join(t.supporting_documents.select(F.col("id").alias("source_id"), F.col("document_type").alias("at")), "source_id")
    return items.unionByName(docs).select("id", "source_type", "at")


@query("j12", "SELECT b.body_code, coalesce((SELECT min(p.name) FROM persons p WHERE p.public_body_id = b.id), 'none') AS first_person FROM public_bodies b")
def j12(t):
    """A correlated least value, aggregated before the join."""
    least = t.persons.groupBy(F.col("public_body_id").alias("id")).agg(F.min("name").alias("name"))
    return t.public_bodies.join(least, "id", "left").select("body_code", F.coalesce("name", F.lit("none")).alias("first_person"))


@query("j15", "SELECT DISTINCT m.meeting_id FROM meetings m JOIN agenda_items i USING (meeting_id) WHERE i.title LIKE '%PROMO%'")
def j15(t):
    """Meetings with any item of a tag."""
    return t.meetings.select("meeting_id").join(t.agenda_items.where(F.col("title").contains("PROMO")), "meeting_id", "left_semi")


@query("j18", "SELECT DISTINCT target_entity_id AS id FROM entity_relationships WHERE target_entity_id NOT IN (SELECT id FROM entities WHERE entity_type = 'person')")
def j18(t):
    """Ids that are not known yet."""
    return M.insert_missing(t.entities.where("entity_type = 'person'").select("id"), t.entity_relationships.select(F.col("target_entity_id").alias("id")), ["id"])


@query("j19", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def j19(t):
    """Keys of a copy that its source lacks."""
    return t.orders.where("o_orderstatus = 'F'").join(t.orders.where("o_totalprice > 100000").select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


@query("j21", """WITH n AS (SELECT c_number, body, count(*) AS items FROM agenda_item_votes GROUP BY 1, 2)
SELECT a.c_number, a.body AS body1, b.body AS body2, a.items * b.items AS links FROM n a JOIN n b ON a.c_number = b.c_number AND a.body < b.body""")
def j21(t):
    """Pairs of bodies that share a case, with how many pairs of their items it links."""
    rows = t.agenda_item_votes.where("c_number is not null and body is not null").groupBy("c_number", "body").agg(F.count("*").alias("items"))
    a, b = rows.withColumnsRenamed({"body": "body1", "items": "items1"}), rows.withColumnsRenamed({"body": "body2", "items": "items2"})
    return a.join(b, "c_number").where("body1 < body2").select("c_number", "body1", "body2", (F.col("items1") * F.col("items2")).alias("links"))


@query("j21_bodies", "SELECT DISTINCT c_number, body FROM agenda_item_votes WHERE body IS NOT NULL AND c_number IN (SELECT c_number FROM agenda_item_votes GROUP BY 1 HAVING count(DISTINCT body) > 1)")
def j21_bodies(t):
    """Bodies of every case that several bodies share."""
    rows = t.agenda_item_votes.where("c_number is not null and body is not null").select("c_number", "body").distinct()
    return rows.join(rows.groupBy("c_number").count().where("count > 1").select("c_number"), "c_number", "left_semi")


@query("a3", "SELECT agenda_item_vote_id, sum(CASE WHEN raw_vote = 'Aye' THEN 1 ELSE 0 END)::BIGINT AS yes_votes, sum(CASE WHEN raw_vote = ' Nay ' THEN 1 ELSE 0 END)::BIGINT AS no_votes FROM member_votes GROUP BY 1")
def a3(t):
    """Conditional sums."""
    return V.tallies(V.normalized(t.member_votes)).select("agenda_item_vote_id", "yes_votes", "no_votes")


@query("a10", """SELECT m.body, count(*) AS split_items FROM (SELECT agenda_item_vote_id FROM member_votes GROUP BY 1 HAVING count(*) FILTER (WHERE raw_vote = 'Aye') > 0 AND count(*) FILTER (WHERE raw_vote = ' Nay ') > 0) s
  JOIN meetings m ON m.meeting_id = s.agenda_item_vote_id GROUP BY 1""")
def a10(t):
    """Split items by body."""
    split = V.tallies(V.normalized(t.member_votes)).where("is_split").select(F.col("agenda_item_vote_id").alias("meeting_id"))
    return split.join(t.meetings.select("meeting_id", "body"), "meeting_id").groupBy("body").agg(F.count("*").alias("split_items"))


@query("a12", "SELECT source, count(*) AS docs, sum(length(text_content))::BIGINT AS chars FROM supporting_documents GROUP BY 1 HAVING count(*) > 10")
def a12(t):
    """Document text by source."""
    return t.supporting_documents.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text_content")).alias("chars")).where("docs > 10")


@query("a20", "SELECT agenda_item_vote_id, count(*) FILTER (WHERE raw_vote = 'abstained') AS abstain_votes, count(*) AS total_votes FROM member_votes GROUP BY 1")
def a20(t):
    """Vote tally of each item."""
    return V.tallies(V.normalized(t.member_votes)).select("agenda_item_vote_id", "abstain_votes", "total_votes")


@query("a21", """SELECT p_name AS name, count(*) AS frequency, count(DISTINCT m.body) AS bodies, string_agg(DISTINCT i.agenda_item_number, ',' ORDER BY i.agenda_item_number) AS places FROM agenda_items i JOIN part ON p_partkey = i.part_id JOIN meetings m USING (meeting_id) GROUP BY 1 HAVING count(*) >= 3""")
def a21(t):
    """Candidates with their bodies and places, of three or more mentions."""
    rows = t.agenda_items.join(t.part.select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name")), "part_id").join(t.meetings.select("meeting_id", "body"), "meeting_id")
    found = rows.groupBy("name").agg(F.count("*").alias("frequency"), F.countDistinct("body").alias("bodies"), F.array_join(F.array_sort(F.collect_set("agenda_item_number")), ",").alias("places"))
    return found.where("frequency >= 3")


@query("a23", "SELECT category, count(*) AS failures, min(event_id) AS first_id FROM (SELECT event_id, regexp_extract(concat('[', upper(event_type), '] x'), '^\\[(\\w+)\\]', 1) AS category FROM events) x GROUP BY 1")
def a23(t):
    """Failures by their category tag."""
    tagged = t.events.select("event_id", F.regexp_extract(T.tag_error(F.lit("x"), F.upper("event_type")), r"^\[(\w+)\]", 1).alias("category"))
    return tagged.groupBy("category").agg(F.count("*").alias("failures"), F.min("event_id").alias("first_id"))


@query("a24", "SELECT CASE WHEN n = y THEN 'tie' WHEN y > n THEN 'passed' ELSE 'failed' END AS result, count(*) AS items FROM (SELECT agenda_item_vote_id, count(*) FILTER (WHERE raw_vote = 'Aye') AS y, count(*) FILTER (WHERE raw_vote = ' Nay ') AS n FROM member_votes GROUP BY 1) x GROUP BY 1")
def a24(t):
    """Items by the outcome of their votes."""
    yes, no = F.col("yes_votes"), F.col("no_votes")
    return V.tallies(V.normalized(t.member_votes)).groupBy(F.when(yes == no, "tie").when(yes > no, "passed").otherwise("failed").alias("result")).agg(F.count("*").alias("items"))


@query("a25", "SELECT event_type AS tag, count(*) AS uses FROM events GROUP BY 1")
def a25(t):
    """Uses of each tag."""
    return t.events.groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("uses"))


@query("a26", "SELECT count(*) FILTER (WHERE sync_status = 'complete') AS complete, count(*) FILTER (WHERE sync_status = 'partial') AS partial, count(*) FILTER (WHERE sync_status = 'pending') AS pending FROM meetings")
def a26(t):
    """All state counts in one pass."""
    return t.meetings.agg(*[F.count_if(F.col("sync_status") == s).alias(s) for s in ("complete", "partial", "pending")])


@query("a27", "SELECT o_orderstatus AS part, count(*) AS source_rows, count(*) FILTER (WHERE o_totalprice <= 100000) AS copy_rows, count(*) FILTER (WHERE o_totalprice > 100000) AS missing FROM orders GROUP BY 1")
def a27(t):
    """Row counts of a table and its copy."""
    source = t.orders.groupBy(F.col("o_orderstatus").alias("part")).agg(F.count("*").alias("source_rows"))
    copy = t.orders.where("o_totalprice <= 100000").groupBy(F.col("o_orderstatus").alias("part")).agg(F.count("*").alias("copy_rows"))
    return source.join(copy, "part", "left").fillna(0, ["copy_rows"]).withColumn("missing", F.col("source_rows") - F.col("copy_rows"))


@query("p5", "SELECT meeting_id, member_id FROM meeting_members WHERE NOT present AND member_id = 7")
def p5(t):
    """Optional conditions joined by and."""
    conditions = {"present": False, "member_id": 7, "meeting_id": None}
    rows = t.meeting_members
    for name, value in conditions.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.select("meeting_id", "member_id")


@query("p9", "SELECT meeting_id, agenda_item_number, title FROM agenda_items WHERE (title ILIKE '%ring%' OR item_text ILIKE '%ring%' OR agenda_item_number ILIKE '%ring%') AND quantity >= 30 ORDER BY meeting_id, agenda_item_number, title, item_text OFFSET 10 LIMIT 10")
def p9(t):
    """Substring search over several columns with a filter, one page."""
    rows = t.agenda_items.where(S.ilike_any(["title", "item_text", "agenda_item_number"], ["ring"]) & (F.col("quantity") >= 30))
    return rows.orderBy("meeting_id", "agenda_item_number", "title", "item_text").offset(10).limit(10).select("meeting_id", "agenda_item_number", "title")


@query("p12", "SELECT id, entity_type FROM entities WHERE entity_type NOT IN ('agency', 'case') AND name LIKE '%1'")
def p12(t):
    """Exclusions and a dynamic condition."""
    return t.entities.where(~F.col("entity_type").isin("agency", "case") & F.col("name").endswith("1")).select("id", "entity_type")


@query("p19", "SELECT meeting_id FROM meetings WHERE sync_status = 'complete' AND title <> '' AND meeting_date >= '2001-01-01'")
def p19(t):
    """Meetings whose documents are due for a check."""
    return t.meetings.where((F.col("sync_status") == "complete") & (F.col("title") != "") & (F.col("meeting_date") >= "2001-01-01")).select("meeting_id")


@query("p21", "SELECT count(*) > 0 AS there FROM (SELECT 1 FROM events WHERE user_id = 3 LIMIT 1) x")
def p21(t):
    """Whether any row exists."""
    return t.events.where("user_id = 3").limit(1).agg((F.count("*") > 0).alias("there"))


@query("p22", "SELECT meeting_id, count(*) AS items, string_agg(agenda_item_number, ',' ORDER BY agenda_item_number) AS places FROM agenda_items WHERE title LIKE 'PROMO%' GROUP BY 1")
def p22(t):
    """Items by the beginning of a text, listed for each meeting."""
    rows = t.agenda_items.where(F.col("title").startswith("PROMO")).groupBy("meeting_id")
    return rows.agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_list("agenda_item_number")), ",").alias("places"))


@query("p23", "SELECT id, body FROM agenda_item_votes WHERE c_number ILIKE '%-26-1%'")
def p23(t):
    """Cases by part of their number."""
    return t.agenda_item_votes.where(F.col("c_number").ilike("%-26-1%")).select("id", "body")


@query("w3", "SELECT member_id, min(meeting_id) AS meeting_id FROM meeting_members GROUP BY 1")
def w3(t):
    """One row for each member, in a fixed order."""
    return first_by(t.meeting_members, ["member_id"], [F.col("meeting_id")]).select("member_id", "meeting_id")


@query("w4", "SELECT DISTINCT l_orderkey, l_partkey, normalized_category FROM permits")
def w4(t):
    """Distinct rows of a key."""
    return t.permits.select("l_orderkey", "l_partkey", "normalized_category").dropDuplicates(["l_orderkey", "l_partkey"])


@query("w6", "SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY length(text_content) DESC, id) AS rn FROM supporting_documents) x WHERE rn = 1")
def w6(t):
    """The longest document of each source."""
    return first_by(t.supporting_documents, ["source"], [F.desc(F.length("text_content")), F.col("id")]).select("source", "id")


@query("w7", "SELECT source_entity_id, min(target_entity_id) AS target_entity_id FROM entity_relationships WHERE source_entity_id NOT IN (SELECT person_id FROM body_memberships WHERE term_end IS NULL) GROUP BY 1")
def w7(t):
    """First edges of ids that are not there yet."""
    held = t.body_memberships.where("term_end is null").select(F.col("person_id").alias("source_entity_id"))
    return M.insert_missing(held, t.entity_relationships.select("source_entity_id", "target_entity_id"), ["source_entity_id"])


@query("w10", "SELECT person_id, term_start FROM (SELECT person_id, min(term_start) AS term_start FROM body_memberships GROUP BY 1) x ORDER BY person_id OFFSET 10 LIMIT 10")
def w10(t):
    """Members once each, deduplicated before the page is cut."""
    return t.body_memberships.groupBy("person_id").agg(F.min("term_start").alias("term_start")).orderBy("person_id").offset(10).limit(10)


@query("w12", """SELECT meeting_id, topic FROM (SELECT meeting_id, topic, row_number() OVER (PARTITION BY meeting_id ORDER BY place) AS rn FROM (
  SELECT meeting_id, 1 AS place, 'housing' AS topic FROM agenda_items WHERE title LIKE '%PROMO%' UNION ALL SELECT meeting_id, 2, 'water' FROM agenda_items WHERE title LIKE '%LARGE%' UNION ALL SELECT meeting_id, 3, 'roads' FROM agenda_items WHERE title LIKE '%ECONOMY%') a) b WHERE rn = 1""")
def w12(t):
    """The first topic of each meeting in order of priority."""
    topic = lambda place, name, word: F.when(F.col("title").contains(word), F.struct(F.lit(place).alias("place"), F.lit(name).alias("topic")))
    rows = t.agenda_items.select("meeting_id", F.coalesce(topic(1, "housing", "PROMO"), topic(2, "water", "LARGE"), topic(3, "roads", "ECONOMY")).alias("hit")).where("hit is not null")
    return rows.groupBy("meeting_id").agg(F.min("hit").alias("hit")).select("meeting_id", "hit.topic")


@query("t2", "SELECT person_id, term_end FROM body_memberships ORDER BY term_end DESC NULLS LAST, person_id LIMIT 30")
def t2(t):
    """Descending with nulls last."""
    return t.body_memberships.orderBy(F.desc_nulls_last("term_end"), "person_id").limit(30).select("person_id", "term_end")


@query("t4", "SELECT id, name FROM entities ORDER BY id LIMIT 11")
def t4(t):
    """A page and one row more, which tells that there is another."""
    return t.entities.orderBy("id").limit(10 + 1).select("id", "name")


@query("t5", "SELECT p_partkey, p_name FROM part ORDER BY length(p_name), p_name, p_partkey LIMIT 10")
def t5(t):
    """By length."""
    return t.part.orderBy(F.length("p_name"), "p_name", "p_partkey").limit(10).select("p_partkey", "p_name")


@query("t10", "SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def t10(t):
    """The next rows after a key."""
    return t.events.where("event_id > 500").orderBy("event_id").limit(100).select("event_id")


@query("u4", "SELECT agenda_item_vote_id FROM member_votes WHERE member_id = 1 INTERSECT SELECT agenda_item_vote_id FROM member_votes WHERE member_id = 2")
def u4(t):
    """Items on which both members voted."""
    of = lambda k: t.member_votes.where(F.col("member_id") == k).select("agenda_item_vote_id")
    return of(1).intersect(of(2))


@query("u6", "SELECT 'event' AS kind, event_id AS id, CAST(NULL AS STRING) AS title FROM events UNION ALL SELECT 'meeting', meeting_id, title FROM meetings")
def u6(t):
    """Rows of different shapes together."""
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    meetings = t.meetings.select(F.lit("meeting").alias("kind"), F.col("meeting_id").alias("id"), "title")
    return events.unionByName(meetings, allowMissingColumns=True)


@query("u6_all", "SELECT 'event' AS kind, event_id AS id, CAST(NULL AS STRING) AS title FROM events UNION ALL SELECT 'meeting', meeting_id, title FROM meetings")
def u6_all(t):
    """All rows of different shapes together."""
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    return events.unionByName(t.meetings.select(F.lit("meeting").alias("kind"), F.col("meeting_id").alias("id"), "title"), allowMissingColumns=True)


@query("u7", "SELECT 'entity' AS scope, id FROM entities WHERE name ILIKE '%00042%' UNION ALL SELECT 'person', id FROM persons WHERE name ILIKE '%00042%'")
def u7(t):
    """One search over several tables."""
    scope = lambda name, df: df.where(S.ilike_any(["name"], ["00042"])).select(F.lit(name).alias("scope"), "id")
    return scope("entity", t.entities).union(scope("person", t.persons))


@query("f31", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def f31(t):
    """Dates with a time of twelve hours."""
    raw = F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/yyyy h:mm:ss a")
    return t.orders.select("o_orderkey", F.date_format(F.try_to_timestamp(raw, F.lit("M/d/yyyy h:mm:ss a")), "yyyy-MM-dd").alias("day"))


@query("f36", "SELECT meeting_id, coalesce(nullif(trim(title), ''), meeting_type) AS label FROM meetings")
def f36(t):
    """The first value that is not blank."""
    return t.meetings.select("meeting_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "meeting_type").alias("label"))


@query("f65", "SELECT p_partkey AS id, p_partkey % 3 = 0 AS same FROM part")
def f65(t):
    """Names of the same tokens in another order, of one token more, and of another token."""
    words, kind = F.split("p_name", " "), F.col("p_partkey") % 3
    other = F.array_join(F.reverse(words), ", ")
    other = F.when(kind == 0, other).when(kind == 1, F.concat(other, F.lit(" extra"))).otherwise(F.concat(words[0], F.lit(" elsewhere")))
    return t.part.select(F.col("p_partkey").alias("id"), R.same_sorted(R.tokens(F.col("p_name")), R.tokens(other)).alias("same"))


@query("f66", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 0.85 ELSE 0.0 END::DOUBLE AS score FROM customer")
def f66(t):
    """Score of a name inside another, on either side, inside one more than four times as long, and in none."""
    kind, longer = F.col("c_custkey") % 4, F.concat("c_name", F.lit(" Inc"))
    a = F.when(kind == 1, longer).otherwise(F.col("c_name"))
    b = F.when(kind == 0, longer).when(kind == 1, F.col("c_name")).when(kind == 2, F.concat("c_name", F.lpad(F.lit("x"), 60, "y"))).otherwise(F.reverse("c_name"))
    return t.customer.select("c_custkey", R.contained(a, b).cast("double").alias("score"))


@query("a22", "SELECT normalized_category AS name, count(*) AS frequency FROM permits GROUP BY 1 HAVING count(*) >= 5 ORDER BY frequency DESC, name")
def a22(t):
    """Candidates by frequency."""
    return t.permits.groupBy(F.col("normalized_category").alias("name")).agg(F.count("*").alias("frequency")).where("frequency >= 5").orderBy(F.desc("frequency"), "name")


@query("d19", "SELECT p.row_hash, m.body FROM permits p LEFT JOIN meetings m ON m.meeting_id = p.l_orderkey")
def d19(t):
    """A column filled from another table."""
    bodies = t.meetings.select(F.col("meeting_id").alias("l_orderkey"), "body")
    return t.permits.join(bodies, "l_orderkey", "left").select("row_hash", "body")


@query("f40", "SELECT permit_number, TRY_CAST(permit_square_feet AS DOUBLE) AS square_feet, TRY_CAST(permit_valuation AS DOUBLE) AS valuation FROM permits")
def f40(t):
    """Numbers of a permit row."""
    return t.permits.select("permit_number", P.number(F.col("permit_square_feet")).alias("square_feet"), P.number(F.col("permit_valuation")).alias("valuation"))
