"""Names and spans in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import phrases as P
from civicspark.operators import spans as S
from civicspark.plans.registry import query
from civicspark.sources.shared import parts_for

_LETTERS = "translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"


def _names(t):
    """First and last names of customers, dealt over tasks: their file is small for what is read out of the texts made of it."""
    letters = F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")
    rows = t.customer.select("c_custkey").repartition(parts_for(t.customer, 1_000_000), "c_custkey")
    return rows.select("c_custkey", F.concat(F.lit("Ann"), letters).alias("first"), F.concat(F.lit("Lee"), letters).alias("last"))


@query("e6", f"""WITH n AS (SELECT c_custkey, c_custkey % 5 AS k, concat('Ann', {_LETTERS}) AS f, concat('Lee', {_LETTERS}) AS l FROM customer),
m AS (SELECT *, CASE k WHEN 0 THEN 'field' WHEN 1 THEN 'ampersand' WHEN 2 THEN 'org_keyword' WHEN 3 THEN 'legal_suffix' ELSE 'person_role' END AS family,
  CASE k WHEN 0 THEN f || ' ' || l WHEN 1 THEN f || ' & ' || l WHEN 2 THEN f || ' ' || l || ' Homes' WHEN 3 THEN f || ' ' || l || ', LLC' ELSE f || ' ' || l END AS name,
  CASE k WHEN 0 THEN 'case of é; Owner: ' WHEN 4 THEN 'it was presented by ' ELSE 'told of ' END AS lead FROM n)
SELECT c_custkey, name, CASE k WHEN 1 THEN lower(f || ' and ' || l) WHEN 2 THEN lower(name) ELSE lower(f || ' ' || l) END AS normalized_name, family, length(lead) AS start, length(lead) + length(name) AS "end",
  substring(lead || name || ' and so on, as told at length', greatest(length(lead) - CASE k WHEN 0 THEN 7 WHEN 4 THEN 13 ELSE 0 END - 40, 0) + 1, length(lead) + length(name) + 60) AS context FROM m""")
def e6(t):
    """Candidate names of five families, with places and contexts."""
    k, f, l = F.col("c_custkey") % 5, F.col("first"), F.col("last")
    text = (
        F.when(k == 0, F.concat(F.lit("case of é; Owner: "), f, F.lit(" "), l)).when(k == 1, F.concat(F.lit("told of "), f, F.lit(" & "), l)).when(k == 2, F.concat(F.lit("told of "), f, F.lit(" "), l, F.lit(" Homes")))
        .when(k == 3, F.concat(F.lit("told of "), f, F.lit(" "), l, F.lit(", LLC"))).otherwise(F.concat(F.lit("it was presented by "), f, F.lit(" "), l))
    )
    return S.candidates(_names(t).select("c_custkey", F.concat(text, F.lit(" and so on, as told at length")).alias("text")), "c_custkey", "text")


@query("e9", f"""WITH n AS (SELECT c_custkey, concat('Ann', {_LETTERS}, ' Lee', {_LETTERS}) AS name FROM customer)
SELECT c_custkey, name, role, pattern, start, confidence::DOUBLE AS confidence FROM n JOIN (VALUES (0, 'presenter', 'dash_name_role', 12, 0.8), (1, 'applicant', 'applicant', 11, 0.95), (2, 'staff', 'staff_call', 12, 0.9), (3, 'presenter', 'presented_by', 16, 0.85), (4, 'presenter', 'eol', 12, 0.6), (5, 'participant', 'line_role', 7, 0.75), (6, 'participant', 'info_name', 17, 0.7))
  AS p(k, role, pattern, start, confidence) ON c_custkey % 7 = k""")
def e9(t):
    """Names in event texts by seven patterns."""
    name, k = F.concat_ws(" ", "first", "last"), F.col("c_custkey") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("The plan. – "), name, F.lit(", Director"))).when(k == 1, F.concat(F.lit("Applicant: "), name, F.lit("; twice, applicant "), name)).when(k == 2, F.concat(F.lit("Staff call: "), name, F.lit(" told")))
        .when(k == 3, F.concat(F.lit("is presented by "), name, F.lit(" to all"))).when(k == 4, F.concat(F.lit("It is said. "), name, F.lit("\nMonday Morning")))
        .when(k == 5, F.concat(F.lit("a line\n"), name, F.lit(", Planner of the town"))).otherwise(F.concat(F.lit("For Information: "), name, F.lit(" and more")))
    )
    return S.names(_names(t).select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("m6")
def m6(t):
    """Phrases of capital words in whole documents that no assumed name touches; assumed names are those before a comma."""
    spans = S.find(F.col("text"), r"([A-Z][a-z]+)(?=,)", "known")
    return S.negative_spans(t.documents.select("doc_id", "text", spans.alias("known")), "doc_id", "text", "known", 15)


@query("m6_free", """WITH w AS (SELECT doc_id, length(text) AS n, coalesce(len(regexp_extract_all(text, '[A-Z]+')), 0) AS runs, len(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM documents WHERE length(text) > 0)
SELECT doc_id, runs, capitals, n - capitals AS free_chars FROM w""")
def m6_free(t):
    """Runs of capitals of every document, what they cover, and what their complement covers."""
    found = S.find(F.col("text"), "([A-Z]+)", "capitals")
    size = lambda spans: F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    rows = t.documents.where("length(text) > 0").select("doc_id", F.length("text").alias("n"), found.alias("s"))
    return rows.select("doc_id", F.size("s").alias("runs"), size(F.col("s")).alias("capitals"), size(S.complement(F.col("s"), F.col("n"))).alias("free_chars"))


@query("e3", f"""WITH n AS (SELECT c_custkey, {_LETTERS} AS x FROM customer), r AS (
  SELECT c_custkey, 'Ann' || x || ' Lee' || x AS name, 'person' AS entity_type, CASE c_custkey % 2 WHEN 0 THEN 'applicant' ELSE 'staff' END AS role, 80 AS confidence FROM n
  UNION ALL SELECT c_custkey, 'Acme' || x || ' Works', 'organization', 'known_org', 95 FROM n WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 'ZON-12-' || (c_custkey + 10), 'case', 'reference', 95 FROM n)
SELECT c_custkey, name, lower(name) AS normalized_name, entity_type, role, confidence FROM r""")
def e3(t):
    """People, known organizations and case numbers of documents; organizations by one automaton over all their names."""
    rows = _names(t).withColumn("x", F.substring("first", 4, 20))
    label = F.when(F.col("c_custkey") % 2 == 0, "1. Applicant: ").otherwise("Staff Contact: ")
    org = F.when(F.col("c_custkey") % 3 < 2, F.concat(F.lit("told to ACME"), "x", F.lit(" works, twice to Acme"), "x", F.lit(" Works"))).otherwise(F.concat(F.lit("told to Acme"), "x", F.lit(" Workshop")))
    text = F.concat(F.lit("Minutes\n"), label, "first", F.lit(" "), "last", F.lit("\n"), org, F.lit("; see zon-12-"), F.col("c_custkey") + 10, F.lit("."))
    known = rows.select(F.concat(F.lit("Acme"), "x", F.lit(" Works")).alias("name"), F.lit("organization").alias("entity_type"))
    return P.document_entities(rows.select("c_custkey", text.alias("text")), "c_custkey", "text", known)


@query("x5_signals", """WITH s AS (SELECT unnest(['the', 'que', 'und', 'les', 'with']) AS phrase), d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ' AS body FROM documents)
SELECT doc_id, phrase, ((length(body) - length(replace(body, ' ' || phrase || ' ', ''))) // length(' ' || phrase || ' '))::BIGINT AS hits FROM d, s WHERE contains(body, ' ' || phrase || ' ')""")
def x5_signals(t):
    """How often signal words stand in whole documents."""
    signals = t._spark.createDataFrame([(p,) for p in ("the", "que", "und", "les", "with")], "phrase string")
    return P.phrase_hits(t.documents, "doc_id", "text", signals, "phrase").groupBy("doc_id", "phrase").agg(F.count("*").alias("hits"))
