"""Meetings, bodies, filters, aggregates, sorting and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicspark.functions import text as T
from civicspark.operators.merge import first_by
from civicspark.operators.votes import percent, ratio
from civicspark.plans.registry import query
from civicspark.sources.shared import parts_for

_M = "meeting_id, body, meeting_date"


@query("p1", f"SELECT {_M} FROM meetings WHERE meeting_date BETWEEN '1996-01-01' AND '1996-06-30'")
def p1(t):
    """Meetings within inclusive ISO dates."""
    return t.meetings.where(F.col("meeting_date").between("1996-01-01", "1996-06-30")).select("meeting_id", "body", "meeting_date")


@query("p2", f"SELECT {_M} FROM meetings WHERE sync_status IN ('partial', 'pending')")
def p2(t):
    """Meetings of chosen states."""
    return t.meetings.where(F.col("sync_status").isin("partial", "pending")).select("meeting_id", "body", "meeting_date")


@query("p3", f"SELECT {_M} FROM meetings WHERE sync_status IN ('failed', 'partial')")
def p3(t):
    """Meetings to load again."""
    return t.meetings.where(F.col("sync_status").isin("failed", "partial")).select("meeting_id", "body", "meeting_date")


@query("p4", "SELECT member_id, present FROM meeting_members WHERE meeting_id = 7")
def p4(t):
    """Attendance of one meeting."""
    return t.meeting_members.where("meeting_id = 7").select("member_id", "present")


@query("p6", "SELECT agenda_item_vote_id FROM member_votes GROUP BY 1 HAVING count(DISTINCT CASE WHEN raw_vote IN ('Aye', ' Nay ') THEN raw_vote END) = 2")
def p6(t):
    """Items with votes on both sides."""
    sides = F.countDistinct(F.when(T.normalize_vote("raw_vote").isin("yes", "no"), T.normalize_vote("raw_vote")))
    return t.member_votes.groupBy("agenda_item_vote_id").agg(sides.alias("sides")).where("sides = 2").select("agenda_item_vote_id")


@query("p7", "SELECT b.body_code, b.display_name FROM public_bodies b JOIN jurisdictions j ON j.id = b.jurisdiction_id WHERE j.slug = 'asia'")
def p7(t):
    """Bodies of a jurisdiction."""
    asia = t.jurisdictions.where("slug = 'asia'").select(F.col("id").alias("jurisdiction_id"))
    return t.public_bodies.join(F.broadcast(asia), "jurisdiction_id").select("body_code", "display_name")


@query("p8", """SELECT meeting_id, body, meeting_date, meeting_type FROM meetings WHERE meeting_type = 'Formal' AND meeting_date >= '1997-01-01' AND NOT regexp_matches(title, '(?i)\\bcancel(led|ed)?\\b')
  ORDER BY meeting_date DESC, meeting_id OFFSET 20 LIMIT 20""")
def p8(t):
    """A page of meetings by type and date without the canceled ones."""
    rows = t.meetings.where((F.col("meeting_type") == "Formal") & (F.col("meeting_date") >= "1997-01-01") & ~T.is_canceled("title"))
    return rows.select("meeting_id", "body", "meeting_date", "meeting_type").orderBy(F.desc("meeting_date"), "meeting_id").offset(20).limit(20)


@query("p13", "SELECT DISTINCT meeting_id, substring(item_text, 1, 20) AS head FROM agenda_items WHERE (item_text LIKE '%PROMO%' OR item_text LIKE '%ECONOMY%') AND item_text NOT LIKE '%denied'")
def p13(t):
    """Items that hold a keyword in its case."""
    text = F.col("item_text")
    rows = t.agenda_items.where((text.contains("PROMO") | text.contains("ECONOMY")) & ~text.endswith("denied"))
    return rows.select("meeting_id", F.substring(text, 1, 20).alias("head")).distinct()


@query("p14", "SELECT meeting_id, agenda_item_number FROM agenda_items WHERE lower(title) LIKE '%small%' OR lower(title) LIKE '%gizmo%'")
def p14(t):
    """Items that hold a policy word."""
    return t.agenda_items.where(T.any_contains("title", ["small", "gizmo"])).select("meeting_id", "agenda_item_number")


@query("p15", "SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 24 HOUR GROUP BY 1")
def p15(t):
    """Failures of the day before a given instant."""
    since = F.lit("2024-01-29 00:00:00").cast("timestamp") - F.expr("interval 24 hours")
    return t.events.where((F.col("event_type") == "error") & (F.col("ts") >= since)).groupBy("user_id").agg(F.count("*").alias("failures"))


@query("p16", f"SELECT {_M} FROM meetings WHERE meeting_date >= '2001-06-01'")
def p16(t):
    """Meetings from a day on."""
    return t.meetings.where(F.try_to_date("meeting_date", "yyyy-MM-dd") >= F.lit("2001-06-01").cast("date")).select("meeting_id", "body", "meeting_date")


@query("p17", "SELECT id, name FROM persons WHERE length(name) < 40 AND NOT regexp_matches(name, '000000001') ORDER BY length(name), name LIMIT 5")
def p17(t):
    """Shortest names without a mark."""
    return t.persons.where((F.length("name") < 40) & ~F.col("name").rlike("000000001")).orderBy(F.length("name"), "name").limit(5).select("id", "name")


@query("p18", "SELECT meeting_id FROM meetings WHERE title LIKE '%CANCELED%'")
def p18(t):
    """Canceled meetings."""
    return t.meetings.where(T.is_canceled("title")).select("meeting_id")


@query("p20", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') ORDER BY c_custkey")
def p20(t):
    """Ids that were not used yet."""
    used = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(used, "c_custkey", "left_anti").distinct().orderBy("c_custkey")


@query("p24", "SELECT person_id FROM body_memberships WHERE term_end IS NOT DISTINCT FROM NULL")
def p24(t):
    """Null-safe comparison."""
    return t.body_memberships.where(F.col("term_end").eqNullSafe(F.lit(None))).select("person_id")


@query("a1", "SELECT sync_status, count(*) AS meetings, coalesce(sum(n), 0)::BIGINT AS items FROM meetings m LEFT JOIN (SELECT meeting_id, count(*) AS n FROM agenda_items GROUP BY 1) i USING (meeting_id) GROUP BY 1")
def a1(t):
    """Meetings and items by state."""
    counts = t.agenda_items.groupBy("meeting_id").agg(F.count("*").alias("n"))
    return t.meetings.join(counts, "meeting_id", "left").groupBy("sync_status").agg(F.count("*").alias("meetings"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))


@query("a2", "SELECT member_id, count(*) AS votes FROM member_votes GROUP BY 1 HAVING count(*) >= 5")
def a2(t):
    """Members with five votes or more."""
    return t.member_votes.groupBy("member_id").agg(F.count("*").alias("votes")).where("votes >= 5")


@query("a4", "SELECT body, count(DISTINCT meeting_type) AS types, count(DISTINCT meeting_date) AS days FROM meetings GROUP BY 1")
def a4(t):
    """Distinct types and days of each body."""
    return t.meetings.groupBy("body").agg(F.countDistinct("meeting_type").alias("types"), F.countDistinct("meeting_date").alias("days"))


@query("a6", "SELECT entity_id, min(mention_date) AS first_mention, max(mention_date) AS last_mention, count(*) AS mentions FROM entity_mentions GROUP BY 1")
def a6(t):
    """First and last mention of each entity."""
    return t.entity_mentions.groupBy("entity_id").agg(F.min("mention_date").alias("first_mention"), F.max("mention_date").alias("last_mention"), F.count("*").alias("mentions"))


@query("a7", "SELECT entity_type, count(*) AS entities FROM entities GROUP BY 1 HAVING count(*) >= 3")
def a7(t):
    """Types of three or more entities."""
    return t.entities.groupBy("entity_type").agg(F.count("*").alias("entities")).where("entities >= 3")


@query("a8", "SELECT lang, count(*) AS docs, count(text) AS with_text, count(*) FILTER (WHERE length(text) > 2000) AS long_texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def a8(t):
    """Text inventory by language."""
    n = F.length("text")
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.count("text").alias("with_text"), F.count_if(n > 2000).alias("long_texts"), F.sum(n).alias("chars"))


@query("a9", """SELECT body, round(100.0 * count(*) FILTER (WHERE sync_status = 'complete') / nullif(count(*), 0), 1)::DOUBLE AS complete_pct, count(*) AS meetings FROM meetings GROUP BY 1 HAVING count(*) > 50
  ORDER BY complete_pct DESC, body LIMIT 20""")
def a9(t):
    """Bodies with the largest share of complete meetings."""
    rows = t.meetings.groupBy("body").agg(percent(F.count_if(F.col("sync_status") == "complete"), F.count("*")).alias("complete_pct"), F.count("*").alias("meetings"))
    return rows.where("meetings > 50").orderBy(F.desc("complete_pct"), "body").limit(20)


@query("a11", """SELECT signal, body, count(*) AS hits FROM (SELECT 'denied' AS signal, m.body FROM agenda_items i JOIN meetings m USING (meeting_id) WHERE item_text LIKE '%denied%'
  UNION ALL SELECT 'carried', m.body FROM agenda_items i JOIN meetings m USING (meeting_id) WHERE item_text LIKE '%carried%'
  UNION ALL SELECT 'filed', m.body FROM agenda_items i JOIN meetings m USING (meeting_id) WHERE item_text LIKE '%filed%') x GROUP BY 1, 2 HAVING count(*) > 5""")
def a11(t):
    """Keyword hits of each body, all signals in one pass."""
    words = F.array(*[F.lit(w) for w in ("denied", "carried", "filed")])
    rows = t.agenda_items.select("meeting_id", F.explode(F.filter(words, lambda w: F.col("item_text").contains(w))).alias("signal"))
    return rows.join(t.meetings.select("meeting_id", "body"), "meeting_id").groupBy("signal", "body").agg(F.count("*").alias("hits")).where("hits > 5")


@query("a13", "SELECT count(*) AS empty_meetings FROM meetings m WHERE sync_status = 'complete' AND NOT EXISTS (SELECT 1 FROM agenda_items i WHERE i.meeting_id = m.meeting_id)")
def a13(t):
    """Complete meetings without items."""
    return t.meetings.where("sync_status = 'complete'").join(t.agenda_items, "meeting_id", "left_anti").agg(F.count("*").alias("empty_meetings"))


@query("a14", """SELECT article_id, count(*) AS views FROM page_views WHERE viewed_at > (SELECT max(viewed_at) FROM page_views) - INTERVAL 24 HOUR GROUP BY 1 ORDER BY views DESC, article_id LIMIT 10""")
def a14(t):
    """Articles viewed most in the last day."""
    latest = t.page_views.agg(F.max("viewed_at").alias("latest"))
    rows = t.page_views.join(F.broadcast(latest), F.col("viewed_at") > F.col("latest") - F.expr("interval 24 hours"))
    return rows.groupBy("article_id").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "article_id").limit(10)


@query("a18", "SELECT body, count(*) AS meetings, count(*) FILTER (WHERE title = '') AS untitled, min(meeting_date) AS first_day, max(meeting_date) AS last_day FROM meetings GROUP BY 1")
def a18(t):
    """Integrity figures of each body."""
    return t.meetings.groupBy("body").agg(F.count("*").alias("meetings"), F.count_if(F.col("title") == "").alias("untitled"), F.min("meeting_date").alias("first_day"), F.max("meeting_date").alias("last_day"))


@query("a19", """SELECT v.member_id, m.body, min(m.meeting_date) AS since, count(*) AS votes FROM member_votes v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def a19(t):
    """Memberships inferred from three or more votes."""
    dates = t.meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "body", "meeting_date")
    return t.member_votes.join(dates, "agenda_item_vote_id").groupBy("member_id", "body").agg(F.min("meeting_date").alias("since"), F.count("*").alias("votes")).where("votes >= 3")


@query("a28", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a28(t):
    """A value of lenient JSON."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("a29", "SELECT body, max(meeting_date) AS latest, count(*) AS meetings FROM meetings GROUP BY 1")
def a29(t):
    """Latest meeting and count of each body in one pass."""
    return t.meetings.groupBy("body").agg(F.max("meeting_date").alias("latest"), F.count("*").alias("meetings"))


@query("j5", "SELECT count(*) AS rows, count(DISTINCT meeting_id) AS meetings FROM meetings m LEFT JOIN public_bodies b ON b.id = m.public_body_id OR b.body_code = m.body")
def j5(t):
    """Join by id or else by code, each meeting once."""
    by_id = t.public_bodies.select(F.col("id").alias("public_body_id"), F.col("display_name").alias("by_id"))
    by_code = t.public_bodies.select(F.col("body_code").alias("body"), F.col("display_name").alias("by_code")).dropDuplicates(["body"])
    rows = t.meetings.join(F.broadcast(by_id), "public_body_id", "left").join(F.broadcast(by_code), "body", "left").withColumn("name", F.coalesce("by_id", "by_code"))
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("meeting_id").alias("meetings"))


@query("j6", "SELECT e.id, x.first_mention, x.last_mention FROM entities e LEFT JOIN (SELECT entity_id, min(mention_date) AS first_mention, max(mention_date) AS last_mention FROM entity_mentions GROUP BY 1) x ON x.entity_id = e.id")
def j6(t):
    """Mention dates of every entity, aggregated before the join."""
    dates = t.entity_mentions.groupBy(F.col("entity_id").alias("id")).agg(F.min("mention_date").alias("first_mention"), F.max("mention_date").alias("last_mention"))
    return t.entities.select("id").join(dates, "id", "left")


@query("j8", "SELECT person_id, public_body_id FROM body_memberships b WHERE NOT EXISTS (SELECT 1 FROM member_votes v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE v.member_id = b.person_id AND m.public_body_id = b.public_body_id AND m.meeting_date >= '2001-07-01')")
def j8(t):
    """Memberships without a vote as evidence."""
    meetings = t.meetings.where("meeting_date >= '2001-07-01'").select(F.col("meeting_id").alias("agenda_item_vote_id"), "public_body_id")
    votes = t.member_votes.join(meetings, "agenda_item_vote_id")
    return t.body_memberships.select("person_id", "public_body_id").join(votes.select(F.col("member_id").alias("person_id"), "public_body_id"), ["person_id", "public_body_id"], "left_anti")


@query("j10", "SELECT m.meeting_id FROM meetings m WHERE EXISTS (SELECT 1 FROM agenda_items i WHERE i.meeting_id = m.meeting_id AND i.quantity > 49)")
def j10(t):
    """Meetings that have a large item."""
    return t.meetings.join(t.agenda_items.where("quantity > 49"), "meeting_id", "left_semi").select("meeting_id")


@query("j13", """SELECT m.meeting_id, b.person_id FROM meetings m JOIN body_memberships b ON b.public_body_id = m.public_body_id AND b.term_start <= m.meeting_date AND (b.term_end IS NULL OR b.term_end >= m.meeting_date)""")
def j13(t):
    """Members whose term covers a meeting's day."""
    valid = (F.col("term_start") <= F.col("meeting_date")) & (F.col("term_end").isNull() | (F.col("term_end") >= F.col("meeting_date")))
    # the meetings of a body on a day have the same members: runs of a member and repeated lists of meetings, which files pack into a small part
    # dealt by the size of the orders: their days are a few MB, which the planner would put into a few tasks
    dealt = t.meetings.select("public_body_id", "meeting_date", "meeting_id").repartition(parts_for(t.orders, 1_000_000), "public_body_id", "meeting_date")
    days = dealt.groupBy("public_body_id", "meeting_date").agg(F.collect_list("meeting_id").alias("meetings"))
    return days.join(t.body_memberships, "public_body_id").where(valid).select(F.explode("meetings").alias("meeting_id"), "person_id")


@query("j20", "SELECT source, max(length(text_content)) AS chars, count(*) AS docs FROM supporting_documents GROUP BY 1")
def j20(t):
    """The longest text of each group of documents."""
    best = t.supporting_documents.groupBy("source").agg(F.max_by("text_content", F.length("text_content")).alias("text"), F.count("*").alias("docs"))
    return best.select("source", F.length("text").alias("chars"), "docs")


@query("j22", "SELECT meeting_id, agenda_item_number, title FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY CAST(agenda_item_number AS INT) DESC, title DESC, item_text DESC) AS rn FROM agenda_items) x WHERE rn = 1")
def j22(t):
    """The last item of each meeting."""
    return first_by(t.agenda_items, ["meeting_id"], [F.col("agenda_item_number").cast("int").desc(), F.desc("title"), F.desc("item_text")]).select("meeting_id", "agenda_item_number", "title")


@query("w2", "SELECT person_id, public_body_id, term_start FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY term_start DESC, public_body_id) AS rn FROM body_memberships) x WHERE rn = 1")
def w2(t):
    """Latest term of each person."""
    return first_by(t.body_memberships, ["person_id"], [F.desc("term_start"), F.col("public_body_id")]).select("person_id", "public_body_id", "term_start")


@query("w5", "SELECT entity_id, id, mention_date FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY mention_date DESC, id) AS rn FROM entity_mentions) x WHERE rn = 1 ORDER BY mention_date DESC, entity_id LIMIT 100")
def w5(t):
    """Timeline: the latest mention of each entity, newest 100."""
    return first_by(t.entity_mentions, ["entity_id"], [F.desc("mention_date"), F.col("id")]).select("entity_id", "id", "mention_date").orderBy(F.desc("mention_date"), "entity_id").limit(100)


@query("w8", "SELECT entity_type, id, mentions FROM (SELECT e.entity_type, e.id, count(*) AS mentions, row_number() OVER (PARTITION BY e.entity_type ORDER BY count(*) DESC, e.id) AS rn FROM entities e JOIN entity_mentions m ON m.entity_id = e.id GROUP BY 1, 2) x WHERE rn <= 5")
def w8(t):
    """The five most mentioned entities of each type."""
    counts = t.entity_mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"))
    order = Window.partitionBy("entity_type").orderBy(F.desc("mentions"), "id")
    return t.entities.join(counts, "id").withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("entity_type", "id", "mentions")


@query("w9", "SELECT body, meeting_date, meeting_type, meeting_id FROM (SELECT *, row_number() OVER (PARTITION BY meeting_date, body, meeting_type ORDER BY meeting_id) AS rn FROM meetings) x WHERE rn = 1")
def w9(t):
    """The first meeting of each day, body and type."""
    return first_by(t.meetings, ["meeting_date", "body", "meeting_type"], [F.col("meeting_id")]).select("body", "meeting_date", "meeting_type", "meeting_id")


@query("t1", "SELECT person_id, term_end FROM body_memberships ORDER BY term_end ASC NULLS LAST, person_id LIMIT 30")
def t1(t):
    """Nulls last."""
    return t.body_memberships.orderBy(F.asc_nulls_last("term_end"), "person_id").limit(30).select("person_id", "term_end")


@query("t3", "SELECT meeting_id, (SELECT greatest(1, ceil(count(*) / 50.0))::BIGINT FROM meetings) AS pages FROM meetings ORDER BY meeting_id OFFSET 100 LIMIT 50")
def t3(t):
    """A page and the number of pages."""
    pages = t.meetings.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 50.0)).cast("long").alias("pages"))
    return t.meetings.select("meeting_id").orderBy("meeting_id").offset(100).limit(50).join(F.broadcast(pages))


@query("t6", "SELECT display_name FROM public_bodies ORDER BY body_type <> 'council', display_name LIMIT 10")
def t6(t):
    """Councils first."""
    return t.public_bodies.orderBy(F.col("body_type") != "council", "display_name").limit(10).select("display_name")


@query("t9", "SELECT meeting_date, count(*) AS meetings, min(body) AS first_body FROM meetings WHERE meeting_date LIKE '1997-03-%' GROUP BY 1")
def t9(t):
    """A month's calendar."""
    return t.meetings.where(F.col("meeting_date").startswith("1997-03-")).groupBy("meeting_date").agg(F.count("*").alias("meetings"), F.min("body").alias("first_body"))


@query("u1", "SELECT source_entity_id AS a, target_entity_id AS b FROM entity_relationships WHERE relationship_type = 'REPRESENTS' UNION SELECT target_entity_id, source_entity_id FROM entity_relationships WHERE relationship_type = 'REPRESENTS'")
def u1(t):
    """Both directions of a relation."""
    edges = t.entity_relationships.where("relationship_type = 'REPRESENTS'").select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    return edges.union(edges.select("b", "a")).distinct()


@query("u2", "SELECT DISTINCT body, meeting_type FROM meetings")
def u2(t):
    """Types of each body."""
    return t.meetings.select("body", "meeting_type").distinct()


@query("u3", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def u3(t):
    """Keys on one side only."""
    return t.orders.select("o_orderkey").subtract(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")))


@query("f2", """SELECT id, CASE WHEN motion_result = '' THEN 'approved' WHEN motion_result = 'withdrawn' THEN 'withdrawn' WHEN motion_result LIKE 'Deny%' THEN 'denied' WHEN motion_result LIKE 'approve%' THEN 'approved' ELSE 'continued' END AS result FROM agenda_item_votes""")
def f2(t):
    """Short form of motion results."""
    return t.agenda_item_votes.select("id", T.normalize_motion_result("motion_result").alias("result"))


@query("f3", "SELECT meeting_id, meeting_type AS kind FROM meetings")
def f3(t):
    """Meeting types, from texts around them."""
    return t.meetings.select("meeting_id", T.normalize_meeting_type(F.concat(F.lower("meeting_type"), F.lit(" meeting")), F.lit(None).cast("string")).alias("kind"))


@query("f6", """SELECT meeting_id, concat(meeting_type, ' Meeting — ', strftime(CAST(meeting_date AS DATE), '%b %-d, %Y')) AS name FROM meetings""")
def f6(t):
    """Display names."""
    return t.meetings.select("meeting_id", T.meeting_display_name("meeting_type", "meeting_date", F.lit("")).alias("name"))


@query("f7", "SELECT id, substring(c_number, 1, length(c_number) - 3) AS base, substring(c_number, length(c_number) - 1) AS revision FROM agenda_item_votes")
def f7(t):
    """Parts of C-numbers."""
    return t.agenda_item_votes.select("id", T.c_number_parts("c_number").alias("p")).select("id", "p.base", "p.revision")


@query("f9", """SELECT meeting_id, agenda_item_number, CASE WHEN item_text LIKE '%received and filed' THEN 'informational' WHEN item_text LIKE '%was denied' THEN 'denied' ELSE 'approved' END AS state FROM agenda_items""")
def f9(t):
    """State of items from their text."""
    return t.agenda_items.select("meeting_id", "agenda_item_number", T.lifecycle("item_text").alias("state"))


@query("f25", "SELECT id, concat(source, '.example.org') AS domain FROM supporting_documents")
def f25(t):
    """Domains of document links."""
    return t.supporting_documents.select("id", T.url_domain("document_url").alias("domain"))


@query("f26", "SELECT id, CASE WHEN id % 3 = 0 THEN 'pdf' WHEN id % 3 = 1 THEN 'docx' ELSE '' END AS extension FROM supporting_documents")
def f26(t):
    """Extensions of document links."""
    return t.supporting_documents.select("id", T.file_extension("document_url").alias("extension"))


@query("f47", "SELECT r_name, replace(lower(r_name), ' ', '-') AS slug FROM region")
def f47(t):
    """Slugs."""
    return t.region.select("r_name", T.slug("r_name").alias("slug"))


@query("f49", "SELECT meeting_id, CAST(CAST(date_trunc('week', CAST(meeting_date AS DATE)) AS DATE) AS STRING) AS week_start, CAST(last_day(CAST(meeting_date AS DATE)) AS STRING) AS month_end FROM meetings")
def f49(t):
    """Week and month of a meeting."""
    day = F.col("meeting_date").cast("date")
    return t.meetings.select("meeting_id", F.date_trunc("week", day).cast("date").cast("string").alias("week_start"), F.last_day(day).cast("string").alias("month_end"))


@query("f62", "SELECT doc_id, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2000 THEN 'medium' WHEN length(text) < 8000 THEN 'long' ELSE 'very_long' END AS bucket FROM documents")
def f62(t):
    """Length buckets."""
    return t.documents.select("doc_id", T.length_bucket(F.length("text")).alias("bucket"))


@query("q1", """SELECT 'orphan_items' AS name, count(*) AS bad FROM agenda_items i WHERE NOT EXISTS (SELECT 1 FROM meetings m WHERE m.meeting_id = i.meeting_id)
  UNION ALL SELECT 'untitled_meetings', count(*) FROM meetings WHERE title IS NULL OR title = '' UNION ALL SELECT 'duplicate_meetings', count(*) - count(DISTINCT meeting_id) FROM meetings
  UNION ALL SELECT 'votes_without_result', count(*) FROM agenda_item_votes WHERE motion_result IS NULL OR motion_result = ''""")
def q1(t):
    """Data-integrity counts."""
    one = lambda name, df: df.select(F.lit(name).alias("name"), F.col("bad"))
    orphans = t.agenda_items.join(t.meetings, "meeting_id", "left_anti").agg(F.count("*").alias("bad"))
    titles = t.meetings.agg(F.count_if(F.coalesce("title", F.lit("")) == "").alias("bad"), (F.count("*") - F.countDistinct("meeting_id")).alias("twice"))
    results = t.agenda_item_votes.agg(F.count_if(F.coalesce("motion_result", F.lit("")) == "").alias("bad"))
    return one("orphan_items", orphans).union(one("untitled_meetings", titles)).union(one("duplicate_meetings", titles.select(F.col("twice").alias("bad")))).union(one("votes_without_result", results))


@query("a5", "SELECT body, count(DISTINCT sponsor_id) AS sponsors, count(DISTINCT part_id) AS parts, count(*) FILTER (WHERE quantity > 25) AS large FROM agenda_items JOIN meetings USING (meeting_id) GROUP BY 1")
def a5(t):
    """Two distinct counts and a conditional one by body."""
    rows = t.agenda_items.join(t.meetings.select("meeting_id", "body"), "meeting_id")
    return rows.groupBy("body").agg(F.countDistinct("sponsor_id").alias("sponsors"), F.countDistinct("part_id").alias("parts"), F.count_if(F.col("quantity") > 25).alias("large"))


@query("m7", """SELECT tp, fp, fn, round(tp * 1.0 / nullif(tp + fp, 0), 4) AS precision_, round(tp * 1.0 / nullif(tp + fn, 0), 4) AS recall_ FROM (
  SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn FROM labels) x""")
def m7(t):
    """Precision and recall from counts."""
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    counts = t.labels.agg(F.count_if(good & clean).alias("tp"), F.count_if(~good & clean).alias("fp"), F.count_if(good & ~clean).alias("fn"))
    return counts.withColumns({"precision_": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall_": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
