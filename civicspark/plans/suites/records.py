"""Persisting, watermarks, matching, detail pages and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import records as R
from civicspark.operators import resolve as V
from civicspark.operators import search as S
from civicspark.operators.votes import both_ways
from civicspark.plans.registry import cases, query
from civicspark.sources.shared import parts_for


@query("d2", """WITH old AS (SELECT body, meeting_id, meeting_date, CASE WHEN meeting_id % 2 = 0 THEN 99 END AS jurisdiction_id FROM meetings WHERE meeting_date < '1998-01-01'),
r AS (SELECT * FROM old UNION ALL SELECT body, meeting_id, meeting_date, NULL FROM meetings WHERE meeting_date >= '1997-06-01' AND meeting_id NOT IN (SELECT meeting_id FROM old))
SELECT r.body, meeting_id, meeting_date, coalesce(b.jurisdiction_id, r.jurisdiction_id)::INT AS jurisdiction_id FROM r LEFT JOIN public_bodies b ON b.body_code = r.body AND b.id % 5 > 0""")
def d2(t):
    """Meetings found or created, with the jurisdiction of their body."""
    old = t.meetings.where("meeting_date < '1998-01-01'").withColumn("jurisdiction_id", F.when(F.col("meeting_id") % 2 == 0, 99))
    bodies = t.public_bodies.where("id % 5 > 0").select(F.col("body_code").alias("body"), "jurisdiction_id")
    return R.get_or_create_meetings(old, t.meetings.where("meeting_date >= '1997-06-01'"), bodies)


_CASES = "CASE meeting_id % 5 WHEN 0 THEN 'z-' || meeting_id % 700 WHEN 1 THEN 'CPA' || meeting_id % 300 WHEN 2 THEN 'Gpa-' || meeting_id % 50 WHEN 3 THEN ' P' || meeting_id % 90 ELSE ' ' END"


@query("d5", f"""WITH i AS (SELECT upper(trim({_CASES})) AS case_number, title, meeting_date, meeting_id FROM meetings)
SELECT case_number, CASE WHEN case_number LIKE 'CPA%' THEN 'CPA' WHEN case_number LIKE 'Z%' THEN 'Z' WHEN case_number LIKE 'GPA%' THEN 'GPA' ELSE '' END AS case_type, replace(case_number, '-', ' ') AS normalized_case_number,
  arg_min(coalesce(title, ''), (meeting_date, meeting_id)) AS description, count(*) AS events, min(meeting_date) AS first_event FROM i WHERE case_number <> '' GROUP BY case_number""")
def d5(t):
    """Cases of agenda items, with type and first title."""
    key, k = F.col("meeting_id"), F.col("meeting_id") % 5
    number = F.when(k == 0, F.concat(F.lit("z-"), key % 700)).when(k == 1, F.concat(F.lit("CPA"), key % 300)).when(k == 2, F.concat(F.lit("Gpa-"), key % 50)).when(k == 3, F.concat(F.lit(" P"), key % 90)).otherwise(" ")
    return R.case_rows(t.meetings.withColumn("case_number", number), "title", "meeting_date", "meeting_id")


@query("d8", """WITH p AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'kevin n' || id ELSE 'ann lee n' || id END AS known FROM persons WHERE id % 3 = 0),
a AS (SELECT id AS asked, CASE WHEN id % 5 = 0 THEN 'n' || id || ' kevin' WHEN id % 5 = 1 THEN 'Ann Lee N' || id WHEN id % 5 = 2 THEN 'n' || id WHEN id % 5 = 3 THEN 'Jane N' || id ELSE 'Zoe ' || id END AS name FROM persons),
b AS (SELECT a.*, (SELECT min(p.id) FROM p WHERE p.known = lower(a.name)) AS exact_id FROM a),
w AS (SELECT asked, name, unnest(list_distinct(string_split(lower(name), ' '))) AS word FROM a),
m AS (SELECT w.asked, min(p.id) AS near FROM w JOIN p ON length(w.word) >= 3 AND (p.known LIKE '% ' || w.word OR p.known LIKE w.word || ' %') GROUP BY 1),
f AS (SELECT b.name, exact_id, near, len(list_intersect(list_distinct(string_split(lower(b.name), ' ')), list_distinct(string_split(p.known, ' ')))) AS shared, len(string_split(b.name, ' ')) AS n
  FROM b LEFT JOIN m USING (asked) LEFT JOIN p ON p.id = m.near)
SELECT name, coalesce(exact_id, CASE WHEN n = 1 OR shared >= 2 THEN near END) AS person_id FROM f""")
def d8(t):
    """People found by name, or null for those to create."""
    key = F.col("id").cast("string")
    known = t.persons.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("kevin n"), key)).otherwise(F.concat(F.lit("ann lee n"), key)).alias("normalized_name"))
    k = F.col("id") % 5
    name = F.when(k == 0, F.concat(F.lit("n"), key, F.lit(" kevin"))).when(k == 1, F.concat(F.lit("Ann Lee N"), key)).when(k == 2, F.concat(F.lit("n"), key)).when(k == 3, F.concat(F.lit("Jane N"), key)).otherwise(F.concat(F.lit("Zoe "), key))
    return R.find_people(t.persons.select(name.alias("name")), known)


@query("d9", """SELECT member_id AS person_id, public_body_id, min(meeting_date) AS term_start, CASE WHEN body = 'bos' THEN 'elected' ELSE 'appointed' END AS selection_method
  FROM meeting_members JOIN meetings USING (meeting_id) WHERE NOT EXISTS (SELECT 1 FROM body_memberships b WHERE b.person_id = member_id AND b.public_body_id = meetings.public_body_id) GROUP BY 1, 2, 4""")
def d9(t):
    """Memberships that attendance asks for."""
    attended = t.meeting_members.join(t.meetings, "meeting_id").select(F.col("member_id").alias("person_id"), "public_body_id", "body", "meeting_date")
    return R.missing_memberships(attended, t.body_memberships)


@query("d14", """SELECT c_custkey, c_name FROM customer t WHERE NOT EXISTS (SELECT 1 FROM customer i WHERE i.c_custkey % 7 = 0 AND i.c_custkey + CASE WHEN i.c_custkey % 2 = 0 THEN 1 ELSE 0 END <> t.c_custkey AND i.c_name = t.c_name)""")
def d14(t):
    """Rows that no incoming row meets in its unique name under another key."""
    key = F.col("c_custkey")
    incoming = t.customer.where("c_custkey % 7 = 0").select((key + F.when(key % 2 == 0, 1).otherwise(0)).alias("c_custkey"), "c_name")
    return R.without_conflicts(t.customer.select("c_custkey", "c_name"), incoming, ["c_custkey"], ["c_name"])


@query("d18", """SELECT person_id, public_body_id FROM body_memberships b WHERE NOT EXISTS (SELECT 1 FROM member_votes v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE v.member_id = b.person_id AND m.public_body_id = b.public_body_id AND m.meeting_date < '1995-06-01')
  AND NOT EXISTS (SELECT 1 FROM meeting_members a JOIN meetings m USING (meeting_id) WHERE a.present AND a.member_id = b.person_id AND m.public_body_id = b.public_body_id AND m.meeting_date >= '2001-06-01')""")
def d18(t):
    """Memberships without a vote or attendance."""
    of = lambda rows: rows.select(F.col("member_id").alias("person_id"), "public_body_id")
    votes = t.member_votes.join(t.meetings.where("meeting_date < '1995-06-01'").select(F.col("meeting_id").alias("agenda_item_vote_id"), "public_body_id"), "agenda_item_vote_id")
    attended = t.meeting_members.where("present").join(t.meetings.where("meeting_date >= '2001-06-01'"), "meeting_id")
    return R.suspect_memberships(t.body_memberships, of(votes), of(attended)).select("person_id", "public_body_id")


@query("v23", """SELECT p.id AS member_id, p.name, m.meeting_id AS agenda_item_vote_id, 'inferred_absent' AS attendance_status FROM meetings m JOIN persons p USING (public_body_id)
  WHERE NOT EXISTS (SELECT 1 FROM member_votes v WHERE v.member_id = p.id AND v.agenda_item_vote_id = m.meeting_id)""")
def v23(t):
    """Members of a body who cast no vote in one of its meetings."""
    bodies = t.meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "public_body_id")
    members = t.persons.select(F.col("id").alias("member_id"), "name", "public_body_id")
    return R.infer_absent(bodies, members, t.member_votes, "agenda_item_vote_id", "public_body_id").select("member_id", "agenda_item_vote_id", "name", "attendance_status")


_MARKS = "marks AS (SELECT body, max(meeting_id) AS mark FROM meetings WHERE meeting_date < '1998-01-01' AND public_body_id % 4 > 0 GROUP BY 1)"


@query("i3", f"WITH {_MARKS} SELECT m.body, m.meeting_id FROM meetings m LEFT JOIN marks USING (body) WHERE mark IS NULL OR m.meeting_id > mark")
def i3(t):
    """Meetings beyond their body's watermark."""
    marks = t.meetings.where("meeting_date < '1998-01-01' and public_body_id % 4 > 0").groupBy("body").agg(F.max("meeting_id").alias("mark"))
    return R.beyond_marks(t.meetings.select("body", "meeting_id"), marks, "body", "meeting_id")


@query("i2", f"WITH {_MARKS} SELECT body, max(mark) AS mark FROM (SELECT body, mark FROM marks UNION ALL SELECT body, meeting_id FROM meetings WHERE sync_status = 'complete') x GROUP BY 1")
def i2(t):
    """Watermarks after a run."""
    marks = t.meetings.where("meeting_date < '1998-01-01' and public_body_id % 4 > 0").groupBy("body").agg(F.max("meeting_id").alias("mark"))
    return R.moved_marks(marks, t.meetings.where("sync_status = 'complete'"), "body", "meeting_id")


@query("i4", "SELECT id FROM supporting_documents WHERE id > 20 AND length(text_content) > 0 AND document_type <> 'en' ORDER BY id LIMIT 50")
def i4(t):
    """A batch of documents that were not swept yet, beyond the watermark."""
    fresh = t.supporting_documents.where((F.col("id") > 20) & (F.length("text_content") > 0) & (F.col("document_type") != "en"))
    return fresh.orderBy("id").limit(50).select("id")


@query("i8", """SELECT CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN greatest(max(CAST(ts AS DATE)::VARCHAR), '2024-01-02') ELSE '2024-01-02' END AS checkpoint, count(*) FILTER (WHERE event_type = 'error') AS skipped, side
  FROM (SELECT *, 'all' AS side FROM events UNION ALL SELECT *, 'clean' FROM events WHERE event_type <> 'error') x GROUP BY side""")
def i8(t):
    """Checkpoints of a copy with and one without skipped rows."""
    rows = t.events.select(F.to_date("ts").cast("string").alias("day"), (F.col("event_type") == "error").alias("skipped"))
    run = lambda df, side: R.next_checkpoint(df, "day", "skipped", "2024-01-02").withColumn("side", F.lit(side))
    return run(rows, "all").union(run(rows.where("not skipped"), "clean"))


@query("i12", "SELECT id, CASE WHEN id BETWEEN 50 AND 120 OR id % 3 = 0 THEN NULL ELSE 'done' END AS swept FROM supporting_documents")
def i12(t):
    """Documents of a range of ids marked to be swept again."""
    swept = F.when(F.col("id") % 3 > 0, "done")
    return t.supporting_documents.select("id", F.when(~F.col("id").between(50, 120), swept).alias("swept"))


@query("i7_pending", """SELECT document_type, count(*) AS documents, count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM labels)) AS pending FROM supporting_documents GROUP BY 1""")
def i7_pending(t):
    """Documents without a label, by type."""
    known = t.labels.select(F.col("doc_id").alias("id"), F.lit(True).alias("known")).distinct()
    return t.supporting_documents.join(known, "id", "left").groupBy("document_type").agg(F.count("*").alias("documents"), F.count_if(F.col("known").isNull()).alias("pending"))


@query("j14", """SELECT a.member_id AS member_id, b.member_id AS other_id, count(*) AS common, count(*) FILTER (WHERE a.raw_vote = b.raw_vote) AS same FROM member_votes a JOIN member_votes b USING (agenda_item_vote_id) WHERE a.member_id <> b.member_id GROUP BY 1, 2""")
def j14(t):
    """Pairs of members with their common items and equal votes."""
    a = t.member_votes
    b = a.select("agenda_item_vote_id", F.col("member_id").alias("other_id"), F.col("raw_vote").alias("other_vote"))
    pairs = a.join(b, "agenda_item_vote_id").where("member_id < other_id").select("member_id", "other_id", (F.col("raw_vote") == F.col("other_vote")).alias("alike"))
    return both_ways(pairs, "member_id", "other_id", parts_for(a), [F.count("*").alias("common"), F.count_if("alike").alias("same")])


_NAMES = "SELECT DISTINCT concat(p_type, ' ', p_name) AS name FROM part UNION SELECT DISTINCT concat(p_name, 's') FROM part UNION SELECT DISTINCT concat(p_name, ', ', p_type) FROM part"


@query("j16", f"""WITH n AS (SELECT row_number() OVER (ORDER BY name) AS id, lower(name) AS name FROM ({_NAMES}) x), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM n),
p AS (SELECT a.name AS a, b.name AS b, greatest(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), CASE WHEN (contains(a.name, b.name) OR contains(b.name, a.name))
  AND least(length(a.name), length(b.name)) > 0.25 * greatest(length(a.name), length(b.name)) THEN 0.85 ELSE 0 END) AS score FROM w a JOIN w b ON a.name < b.name)
SELECT a, b, round(score, 4)::DOUBLE AS score FROM p WHERE score >= 0.66""")
def j16(t):
    """Pairs of similar names at a lower threshold, among names of three forms."""
    form = lambda *c: t.part.select(F.lower(F.concat(*c)).alias("name"))
    names = form("p_type", F.lit(" "), "p_name").union(form("p_name", F.lit("s"))).union(form("p_name", F.lit(", "), "p_type")).distinct().select(F.col("name").alias("id"), "name")
    return V.similar_pairs(names, "id", "name", 0.66).select(F.col("id").alias("a"), F.col("other").alias("b"), "score")


@query("j17", """WITH a AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat(p_name, ' ', lower(p_type)) ELSE concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' x') END AS name FROM part),
e AS (SELECT min(p_partkey) AS id, p_name AS known FROM part GROUP BY 2), p AS (SELECT name, id, known, least(length(name), length(known)) / greatest(length(name), length(known)) AS share,
  list_distinct(list_filter(string_split(name, ' '), lambda w: length(w) > 2)) AS a, list_distinct(list_filter(string_split(known, ' '), lambda w: length(w) > 2)) AS b FROM a, e)
SELECT name, id AS entity_id, round(CASE method WHEN 'exact' THEN 0.95 WHEN 'contained' THEN 0.7 * share ELSE 0.6 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS confidence, method FROM (
  SELECT *, CASE WHEN name = known THEN 'exact' WHEN (contains(name, known) OR contains(known, name)) AND share >= 0.6 THEN 'contained' WHEN len(list_intersect(a, b)) >= 2 THEN 'partial' END AS method FROM p) x WHERE method IS NOT NULL""")
def j17(t):
    """Entities that extracted names match."""
    k, words = F.col("p_partkey") % 3, F.split("p_name", " ")
    names = t.part.select(F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", "p_name", F.lower("p_type"))).otherwise(F.concat_ws(" ", words[1], words[0], F.lit("x"))).alias("name"))
    return R.match_entities(names, t.part.groupBy(F.col("p_name").alias("normalized_name")).agg(F.min("p_partkey").alias("id")))


@query("v27", """SELECT v.c_number, count(*) AS items, count(DISTINCT m.body) AS bodies, min(m.meeting_date) AS first_date, max(m.meeting_date) AS last_date,
  string_agg(m.body || ' ' || m.meeting_date || ' ' || v.motion_result, '; ' ORDER BY m.meeting_date, v.id) AS history FROM agenda_item_votes v JOIN meetings m USING (meeting_id) GROUP BY 1""")
def v27(t):
    """Detail of every case: its history over bodies and dates."""
    rows = t.agenda_item_votes.select("c_number", "id", "meeting_id", "motion_result").join(t.meetings.select("meeting_id", "body", "meeting_date"), "meeting_id")
    line = F.concat_ws(" ", "body", "meeting_date", "motion_result")
    found = rows.groupBy("c_number").agg(
        F.count("*").alias("items"), F.countDistinct("body").alias("bodies"), F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date"),
        F.array_sort(F.collect_list(F.struct("meeting_date", "id", line.alias("line")))).alias("lines"),
    )
    return found.select("c_number", "items", "bodies", "first_date", "last_date", F.array_join(F.transform("lines", lambda x: x["line"]), "; ").alias("history"))


@query("v28", """WITH i AS (SELECT meeting_id, count(*) AS items, string_agg(agenda_item_number || '. ' || title, '; ' ORDER BY CAST(agenda_item_number AS INT), title) AS agenda FROM agenda_items GROUP BY 1),
a AS (SELECT meeting_id, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS absent FROM meeting_members GROUP BY 1),
v AS (SELECT agenda_item_vote_id AS meeting_id, count(*) FILTER (WHERE raw_vote = 'Aye') AS yes_votes, count(*) FILTER (WHERE raw_vote = ' Nay ') AS no_votes FROM member_votes GROUP BY 1)
SELECT m.meeting_id, b.display_name, j.name AS jurisdiction, m.meeting_date, coalesce(items, 0) AS items, coalesce(agenda, '') AS agenda, coalesce(present, 0) AS present, coalesce(absent, 0) AS absent, coalesce(yes_votes, 0) AS yes_votes, coalesce(no_votes, 0) AS no_votes
FROM meetings m JOIN public_bodies b ON b.id = m.public_body_id JOIN jurisdictions j ON j.id = b.jurisdiction_id LEFT JOIN i USING (meeting_id) LEFT JOIN a USING (meeting_id) LEFT JOIN v USING (meeting_id)""")
def v28(t):
    """Detail of every meeting: body, jurisdiction, agenda in order, attendance and votes."""
    line = F.struct(F.col("agenda_item_number").cast("int").alias("n"), "title")
    items = t.agenda_items.groupBy("meeting_id").agg(F.count("*").alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat_ws(". ", x["n"].cast("string"), x["title"])), "; ").alias("agenda"))
    there = t.meeting_members.groupBy("meeting_id").agg(F.count_if(F.col("present")).alias("present"), F.count_if(~F.col("present")).alias("absent"))
    votes = t.member_votes.groupBy(F.col("agenda_item_vote_id").alias("meeting_id")).agg(F.count_if(F.col("raw_vote") == "Aye").alias("yes_votes"), F.count_if(F.col("raw_vote") == " Nay ").alias("no_votes"))
    bodies = t.public_bodies.join(t.jurisdictions.select(F.col("id").alias("jurisdiction_id"), F.col("name").alias("jurisdiction")), "jurisdiction_id").select(F.col("id").alias("public_body_id"), "display_name", "jurisdiction")
    rows = t.meetings.join(bodies, "public_body_id").join(items, "meeting_id", "left").join(there, "meeting_id", "left").join(votes, "meeting_id", "left")
    counts = ["items", "present", "absent", "yes_votes", "no_votes"]
    return rows.fillna(0, counts).fillna("", ["agenda"]).select("meeting_id", "display_name", "jurisdiction", "meeting_date", "agenda", *counts)


@query("v29", """WITH m AS (SELECT entity_id, count(*) AS mentions, count(DISTINCT source_type) AS sources, min(mention_date) AS first_seen, max(mention_date) AS last_seen FROM entity_mentions GROUP BY 1),
o AS (SELECT source_entity_id AS id, count(*) AS outgoing FROM entity_relationships GROUP BY 1), i AS (SELECT target_entity_id AS id, count(*) AS incoming, count(DISTINCT relationship_type) AS kinds FROM entity_relationships GROUP BY 1),
n AS (SELECT id, string_agg(source_type || ':' || c, ' ' ORDER BY source_type) AS by_source FROM (SELECT entity_id AS id, source_type, count(*) AS c FROM entity_mentions GROUP BY 1, 2) x GROUP BY 1)
SELECT e.id, e.name, e.entity_type, coalesce(mentions, 0) AS mentions, coalesce(sources, 0) AS sources, first_seen, last_seen, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(kinds, 0) AS kinds, coalesce(by_source, '') AS by_source
FROM entities e LEFT JOIN m ON m.entity_id = e.id LEFT JOIN o ON o.id = e.id LEFT JOIN i ON i.id = e.id LEFT JOIN n ON n.id = e.id""")
def v29(t):
    """Profile of every entity: mentions by source, dates, and relationships both ways."""
    by_source = t.entity_mentions.groupBy("entity_id", "source_type").agg(F.count("*").alias("n"), F.min("mention_date").alias("low"), F.max("mention_date").alias("high"))
    cell = F.array_sort(F.collect_list(F.concat_ws(":", "source_type", F.col("n").cast("string"))))
    mentions = by_source.groupBy(F.col("entity_id").alias("id")).agg(F.sum("n").alias("mentions"), F.count("*").alias("sources"), F.min("low").alias("first_seen"), F.max("high").alias("last_seen"), F.array_join(cell, " ").alias("by_source"))
    outgoing = t.entity_relationships.groupBy(F.col("source_entity_id").alias("id")).agg(F.count("*").alias("outgoing"))
    incoming = t.entity_relationships.groupBy(F.col("target_entity_id").alias("id")).agg(F.count("*").alias("incoming"), F.countDistinct("relationship_type").alias("kinds"))
    rows = t.entities.join(mentions, "id", "left").join(outgoing, "id", "left").join(incoming, "id", "left")
    counts = ["mentions", "sources", "outgoing", "incoming", "kinds"]
    return rows.fillna(0, counts).fillna("", ["by_source"]).select("id", "name", "entity_type", *counts, "first_seen", "last_seen", "by_source")


@query("m7_binary", """WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (WHERE y = 1 AND p = 0)::DOUBLE AS fn
  FROM (SELECT quality AS y, CASE WHEN doc_id % 7 > 1 THEN quality ELSE 1 - quality END AS p FROM labels) x), r AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM c)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(p1, 4) AS precision_1, round(r1, 4) AS recall_1, round(2 * p1 * r1 / (p1 + r1), 4) AS f1_1, round(p0, 4) AS precision_0, round(r0, 4) AS recall_0, round(2 * p0 * r0 / (p0 + r0), 4) AS f1_0,
  round((2 * p1 * r1 / (p1 + r1) + 2 * p0 * r0 / (p0 + r0)) / 2, 4) AS macro_f1, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy FROM r""")
def m7_binary(t):
    """Metrics of a binary classifier."""
    rows = t.labels.select("quality", F.when(F.col("doc_id") % 7 > 1, F.col("quality")).otherwise(1 - F.col("quality")).alias("predicted"))
    return R.binary_metrics(rows, "quality", "predicted")


_PROBS = "SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS a, (event_id % 7) / 7.0::DOUBLE AS b, (event_id % 3) / 3.0::DOUBLE AS c FROM events"


@query("m8", f"""SELECT event_id, round((a + b + c) / 3, 6) AS mean_probability, CASE WHEN (a + b + c) / 3 >= 0.5 THEN 1 ELSE 0 END AS mean_label, round((2 * a + b + 5 * c) / 8, 6) AS weighted_probability, CASE WHEN (2 * a + b + 5 * c) / 8 >= 0.5 THEN 1 ELSE 0 END AS weighted_label,
  CASE WHEN (a >= 0.5)::INT + (b >= 0.5)::INT + (c >= 0.5)::INT >= 2 THEN 1 ELSE 0 END AS majority_label FROM ({_PROBS}) x""")
def m8(t):
    """Ensembles of three classifiers: mean, weighted mean and majority."""
    key = F.col("event_id")
    rows = t.events.select("event_id", ((key % 10) / 10.0).alias("a"), ((key % 7) / 7.0).alias("b"), ((key % 3) / 3.0).alias("c"))
    found = R.ensemble(rows, ["a", "b", "c"], [2.0, 1.0, 5.0])
    return found.select("event_id", F.round("mean_probability", 6).alias("mean_probability"), "mean_label", F.round("weighted_probability", 6).alias("weighted_probability"), "weighted_label", "majority_label")


@query("t7", "SELECT id, name, mentions FROM (SELECT e.id, e.name, count(m.id) AS mentions FROM entities e LEFT JOIN entity_mentions m ON m.entity_id = e.id GROUP BY 1, 2) x ORDER BY mentions DESC, name LIMIT 40")
def t7(t):
    """Entities in one of four orders, chosen when the plan is made."""
    rows = t.entities.select("id", "name").join(t.entity_mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions")), "id", "left").fillna(0, ["mentions"])
    orders = {"name": [F.col("name")], "name_desc": [F.desc("name")], "mentions": [F.desc("mentions"), F.col("name")], "mentions_asc": [F.col("mentions"), F.col("name")]}
    return rows.orderBy(*orders["mentions"]).limit(40)


@query("u5", "SELECT l_orderkey, l_partkey FROM permits UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 49")
def u5(t):
    """Rows of two tables in the columns that both have."""
    other = t.lineitem.where("l_quantity > 49").select("l_partkey", "l_orderkey", "l_tax")
    names = R.common_columns(t.permits.select("permit_number", "l_orderkey", "l_partkey"), other)
    return t.permits.select(*names).unionByName(other.select(*names))


@cases("e5", "code string", [("tempe-cc", "tempe"), ("phoenix-council", "phoenix"), ("pz", "pz"), ("mesa-pz", "pz"), ("unknown", None), (None, None)])
def e5(code):
    """Groups of patterns by body: its own, the commission's, or that of its city."""
    return F.when((code == "pz") | code.endswith("-pz"), "pz").when(F.substring_index(code, "-", 1).isin("tempe", "phoenix"), F.substring_index(code, "-", 1))


@cases("e27", "body string", [
    ("Motion to Approve Items 5A1, 6 made by Councilmember Keating and seconded by Vice Mayor Hodge; Aye: 7; Nay: 0; Absent: none. For: Woods, Hodge and Keating. Motion to deny item 7 made by Mayor Woods Aye: 3; Nay: 4; For: Woods",
     "5A1 Keating Hodge 7-0 Woods,Hodge,Keating;6 Keating Hodge 7-0 Woods,Hodge,Keating;7 Woods  3-4 Woods"),
    ("Motion to adjourn made by Mayor Woods", ""), (None, ""),
])
def e27(body):
    """Votes of action summaries, item by item."""
    line = lambda m, item: F.concat_ws(" ", item, m["mover"], F.coalesce(m["seconder"], F.lit("")), F.concat_ws("-", m["ayes"].cast("string"), m["nays"].cast("string")), F.array_join(m["voters"], ","))
    return F.array_join(F.flatten(F.transform(R.summary_motions(body), lambda m: F.transform(m["items"], lambda item: line(m, item)))), ";")
