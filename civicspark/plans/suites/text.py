"""Text, name and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import names as N
from civicspark.functions import text as T
from civicspark.operators import minutes as X
from civicspark.plans.registry import query


@query("f1", "SELECT agenda_item_vote_id, member_id, CASE raw_vote WHEN 'Aye' THEN 'yes' WHEN ' Nay ' THEN 'no' ELSE 'abstain' END AS vote FROM member_votes")
def f1(t):
    """Canonical votes."""
    return t.member_votes.select("agenda_item_vote_id", "member_id", T.normalize_vote("raw_vote").alias("vote"))


@query("f12", """SELECT meeting_id, agenda_item_number, 'HEARING' AS kind, count(*) AS items FROM agenda_items GROUP BY 1, 2""")
def f12(t):
    """Kinds of hearings."""
    return t.agenda_items.groupBy("meeting_id", "agenda_item_number", N.hearing_kind(F.col("item_text")).alias("kind")).agg(F.count("*").alias("items"))


@query("f13", "SELECT c_custkey, lower(replace(c_name, '#', '')) AS key FROM customer")
def f13(t):
    """Keys of persons' names, titles and roles removed."""
    return t.customer.select("c_custkey", N.person_key(F.concat(F.lit("Commissioner "), "c_name", F.lit(", Vice Chair"))).alias("key"))


@query("f14", "SELECT c_custkey, concat('smith and ', lower(replace(replace(c_name, '#', ''), '-', ''))) AS key FROM customer")
def f14(t):
    """Keys of firms' names, legal form removed."""
    return t.customer.select("c_custkey", N.entity_key(F.concat(F.lit("The Smith & "), "c_name", F.lit(" L.L.C."))).alias("key"))


@query("f15", "SELECT p_partkey, p_partkey % 2 = 0 AS firm FROM part")
def f15(t):
    """Firms by their name."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Holdings LLC").otherwise(""))
    return t.part.select("p_partkey", N.is_firm(name).alias("firm"))


@query("f24", "SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS chars FROM documents")
def f24(t):
    """Text without control characters."""
    return t.documents.select("doc_id", F.length(T.clean_control("text")).alias("chars"))


@query("f27", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'TRANSIENT' WHEN event_id % 4 = 1 THEN 'CODE' WHEN event_id % 4 = 2 THEN 'DATA' ELSE 'UNKNOWN' END AS category FROM events")
def f27(t):
    """Categories of errors."""
    kind = F.col("event_id") % 4
    message = F.when(kind == 0, "Connection RESET by peer").when(kind == 1, "KeyError: 'x'").when(kind == 2, "unknown body").otherwise("odd")
    return t.events.select("event_id", T.error_category(message).alias("category"))


@query("f29", "SELECT event_id, concat('[', upper(event_type), '] boom') AS message FROM events")
def f29(t):
    """Category tags, set once."""
    once = T.tag_error(F.lit("boom"), F.upper("event_type"))
    return t.events.select("event_id", T.tag_error(once, F.lit("OTHER")).alias("message"))


@query("f46", "SELECT meeting_id, meeting_date AS day FROM meetings")
def f46(t):
    """Dates of three notations."""
    d = F.col("meeting_date").cast("date")
    raw = F.when(F.col("meeting_id") % 3 == 0, F.date_format(d, "M/d/yyyy")).when(F.col("meeting_id") % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return t.meetings.select("meeting_id", N.iso_date(raw).alias("day"))


@query("f48", "SELECT id, replace(normalized_name, ' ', '-') AS slug FROM persons")
def f48(t):
    """Member slugs."""
    return t.persons.select("id", F.replace("normalized_name", F.lit(" "), F.lit("-")).alias("slug"))


@query("f57", "SELECT o_orderkey, concat('Z-', o_orderkey % 900 + 100, '-26') AS cases FROM orders")
def f57(t):
    """Case numbers in a text."""
    number = F.concat(F.lit("Z-"), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit("-26"))
    text = F.concat(F.lit("Case "), number, F.lit(" and again "), F.lower(number))
    return t.orders.select("o_orderkey", F.array_join(N.case_numbers(text), ",").alias("cases"))


@query("f58", "SELECT o_orderkey, concat(o_orderkey % 900 + 100, '-12-', o_orderkey % 800 + 100, 'A') AS parcels FROM orders")
def f58(t):
    """Parcel numbers in a text."""
    number = F.concat_ws("-", (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit("12"), F.concat((F.col("o_orderkey") % 800 + 100).cast("string"), F.lit("A")))
    return t.orders.select("o_orderkey", F.array_join(N.parcel_numbers(F.concat(F.lit("APN "), number, F.lit(", x"))), ",").alias("parcels"))


@query("f60", "SELECT p_partkey, replace(lower(p_type), ' ', '_') AS key FROM part")
def f60(t):
    """Lookup keys of verbs."""
    return t.part.select("p_partkey", N.verb_key(F.replace("p_type", F.lit(" "), F.lit(" \n "))).alias("key"))


@query("f61", "SELECT id, CASE WHEN id % 3 = 0 THEN 'vice_chair' WHEN id % 3 = 1 THEN 'staff' ELSE 'presenter' END AS role FROM persons")
def f61(t):
    """Roles from patterns and titles."""
    title = F.when(F.col("id") % 3 == 0, "Vice Chair").when(F.col("id") % 3 == 1, "Senior Planner")
    return t.persons.select("id", N.role_of(F.lit("eol"), title).alias("role"))


@query("e21", """SELECT o_orderkey, 'Smith' AS mover, 'Jones' AS seconder, 'passed' AS result, (o_orderkey % 7 + 1)::INT AS yes_votes, (o_orderkey % 3)::INT AS no_votes FROM orders""")
def e21(t):
    """Motions out of minutes."""
    tally = F.concat((F.col("o_orderkey") % 7 + 1).cast("string"), F.lit("-"), (F.col("o_orderkey") % 3).cast("string"))
    text = F.concat(F.lit("Opening. Motion by Smith, seconded by Jones, to approve.\nThe motion carried "), tally, F.lit("."))
    return X.motions(t.orders.select("o_orderkey", text.alias("minutes")), "o_orderkey", "minutes").select("o_orderkey", "mover", "seconder", "result", "yes_votes", "no_votes")


@query("f71", """SELECT o_orderkey, n AS number, concat('Item ', n) AS title FROM orders, (SELECT unnest([1, 2, 3]) AS n) x""")
def f71(t):
    """Numbered items; a number out of turn begins none."""
    text = F.lit("1. Item 1\ntext\n7. not next\n2) Item 2\n3. Item 3")
    return X.numbered_items(t.orders.select("o_orderkey", text.alias("body")), "o_orderkey", "body")


@query("e7", """SELECT meeting_id, agenda_item_number, count(*) FILTER (WHERE item_text LIKE '%denied%') AS denials, count(*) FILTER (WHERE item_text LIKE '%filed%') AS filings FROM agenda_items GROUP BY 1, 2""")
def e7(t):
    """Events out of item texts."""
    rows = t.agenda_items.select(F.struct("meeting_id", "agenda_item_number", F.monotonically_increasing_id().alias("row")).alias("key"), "item_text")
    found = X.events(rows, "key", "item_text", {"denied": "denial", "filed": "filing", "carried": "approval"})
    return found.groupBy("key.meeting_id", "key.agenda_item_number").agg(F.count_if(F.col("event_type") == "denial").alias("denials"), F.count_if(F.col("event_type") == "filing").alias("filings"))


@query("m5", "SELECT user_id % 2 AS side, count(*) AS rows FROM events GROUP BY 1")
def m5(t):
    """Folds by hash cover every row."""
    return X.split_80_10_10(t.events, "event_id").groupBy((F.col("user_id") % 2).alias("side")).agg(F.count("fold").alias("rows"))


@query("m4", "SELECT lang, least(count(*), 20) AS rows FROM documents GROUP BY 1")
def m4(t):
    """A stratified sample of 20 documents of each language."""
    return X.sample_by_stratum(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 20).groupBy("lang").agg(F.count("*").alias("rows"))


@query("d10", """SELECT meeting_id, CASE WHEN sync_status = 'complete' THEN 0 ELSE 3 END AS retries, CASE WHEN sync_status <> 'complete' THEN '[TRANSIENT] timeout' END AS last_error FROM meetings""")
def d10(t):
    """Retry counts and errors after an attempt: a complete one clears them, others count on."""
    done = F.col("sync_status") == "complete"
    error = T.tag_error(F.lit("timeout"), T.error_category(F.lit("timeout")))
    return t.meetings.select("meeting_id", F.when(done, 0).when(F.col("sync_status").isin("manual_review", "no_agenda"), 0).otherwise(F.lit(2) + 1).alias("retries"), F.when(~done, error).alias("last_error"))


@query("d16", "SELECT sync_status, CASE sync_status WHEN 'partial' THEN 'pending' ELSE sync_status END AS next_status, count(*) AS meetings FROM meetings GROUP BY 1, 2")
def d16(t):
    """Next states of stuck meetings."""
    after = F.when(F.col("sync_status").isin("partial", "failed"), "pending").otherwise(F.col("sync_status"))
    return t.meetings.groupBy("sync_status", after.alias("next_status")).agg(F.count("*").alias("meetings"))


@query("i7", "SELECT count(*) FILTER (WHERE doc_id > 100) AS pending, count(*) AS docs FROM documents")
def i7(t):
    """Rows beyond a high-water mark."""
    return t.documents.agg(F.count_if(F.col("doc_id") > 100).alias("pending"), F.count("*").alias("docs"))


@query("m5_folds", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT * FROM (SELECT user_id, 'train' AS fold, n * 8 // 10 AS rows FROM n UNION ALL SELECT user_id, 'val', n // 10 FROM n UNION ALL SELECT user_id, 'test', n - n * 8 // 10 - n // 10 FROM n) x WHERE rows > 0""")
def m5_folds(t):
    """Rows of every stratum and fold of the 80/10/10 split."""
    return X.split_80_10_10(t.events, "event_id", ["user_id"]).groupBy("user_id", "fold").agg(F.count("*").alias("rows"))
