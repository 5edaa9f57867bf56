"""The civic schema as views of star-schema tables, one definition for Spark and for plain SQL.

Each view is a SELECT over base tables and earlier views.  :class:`Tables` builds
them lazily as DataFrames; :func:`with_prefix` turns those that a statement names
into common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "jurisdictions": "SELECT r_regionkey AS id, replace(lower(r_name), ' ', '-') AS slug, r_name AS name FROM region",
    "public_bodies": """SELECT n_nationkey AS id, replace(lower(n_name), ' ', '_') AS body_code, replace(lower(n_name), ' ', '-') AS slug,
        n_name AS display_name, n_regionkey AS jurisdiction_id, CASE WHEN n_nationkey % 3 = 0 THEN 'council' WHEN n_nationkey % 3 = 1 THEN 'board' ELSE 'commission' END AS body_type FROM nation""",
    "persons": "SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', ' ')) AS normalized_name, s_nationkey AS public_body_id FROM supplier",
    "body_memberships": """SELECT s_suppkey AS person_id, s_nationkey AS public_body_id, CASE WHEN s_suppkey % 2 = 0 THEN '1995-01-01' ELSE '1997-01-01' END AS term_start,
        CASE WHEN s_suppkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE '1999-12-31' END AS term_end FROM supplier""",
    "meetings": """SELECT o_orderkey AS meeting_id, replace(lower(n_name), ' ', '_') AS body, n_nationkey AS public_body_id, substring(CAST(o_orderdate AS STRING), 1, 10) AS meeting_date,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Special' WHEN '2-HIGH' THEN 'Executive' WHEN '3-MEDIUM' THEN 'Formal' ELSE 'Informal' END AS meeting_type,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'pending' END AS sync_status,
        CASE WHEN o_orderkey % 17 = 0 THEN 'Meeting CANCELED' WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Session ', CAST(o_orderkey AS STRING)) END AS title
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "member_votes": """SELECT agenda_item_vote_id, member_id, CASE l_returnflag WHEN 'A' THEN 'Aye' WHEN 'R' THEN ' Nay ' ELSE 'abstained' END AS raw_vote FROM (
        SELECT l_orderkey AS agenda_item_vote_id, l_suppkey AS member_id, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_suppkey
        ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS rn FROM lineitem) d WHERE rn = 1""",
    "agenda_item_votes": """SELECT o_orderkey AS id, o_orderkey AS meeting_id, replace(lower(n_name), ' ', '_') AS body,
        CASE WHEN o_orderkey % 11 = 0 THEN 'withdrawn' WHEN o_orderkey % 7 = 0 THEN 'Deny the request' WHEN o_orderkey % 5 = 0 THEN 'approve as presented' WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Continue' END AS motion_result,
        concat('C-', CAST(o_orderkey % 90 + 10 AS STRING), '-26-', CAST(o_orderkey % 900 + 100 AS STRING), '-X-0', CAST(o_orderkey % 3 AS STRING)) AS c_number,
        CASE WHEN o_orderkey % 4 = 0 THEN 'Ayes: all' ELSE 'Voice vote' END AS vote_text
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "meeting_members": """SELECT l_suppkey AS member_id, l_orderkey AS meeting_id, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS present FROM lineitem GROUP BY l_suppkey, l_orderkey""",
    "agenda_items": """SELECT l_orderkey AS meeting_id, CAST(l_linenumber AS STRING) AS agenda_item_number, l_partkey AS part_id, l_suppkey AS sponsor_id, l_quantity AS quantity,
        concat(p_type, ' ', p_name) AS title, concat(p_brand, ' hearing on ', p_type, CASE WHEN l_returnflag = 'R' THEN ' was denied' WHEN l_returnflag = 'A' THEN ' motion to approve carried' ELSE ' received and filed' END) AS item_text
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "permits": """SELECT CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) ELSE concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS permit_number,
        md5(concat(CAST(l_orderkey AS STRING), '|', CAST(l_partkey AS STRING))) AS row_hash, CAST(CAST(floor(l_quantity) AS INT) AS STRING) AS permit_square_feet,
        CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS permit_valuation, substring(CAST(l_shipdate AS STRING), 1, 10) AS permit_issue_date,
        CASE WHEN p_type = 'ECONOMY' THEN 'Commercial' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'Residential' WHEN p_type = 'PROMO' THEN 'Trade' ELSE 'Other' END AS normalized_category,
        CASE WHEN p_size < 15 THEN 'New Construction' WHEN p_size < 35 THEN 'Alteration' ELSE 'Addition' END AS work_type,
        l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "supporting_documents": """SELECT doc_id AS id, doc_id % 500 AS meeting_id, lang AS document_type, concat('https://www.', source, '.example.org/files/', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.pdf' WHEN doc_id % 3 = 1 THEN '.DOCX?v=1' ELSE '/view' END) AS document_url,
        source, text AS text_content FROM documents""",
    "page_views": "SELECT event_id AS id, ts AS viewed_at, user_id AS article_id, event_type FROM events",
    "entities": """SELECT c_custkey AS id, lower(replace(c_name, '#', ' ')) AS normalized_name, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'person' WHEN c_custkey % 3 = 1 THEN 'firm' ELSE 'agency' END AS entity_type FROM customer""",
    "entity_mentions": """SELECT o_orderkey AS id, o_custkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'agenda_item' ELSE 'supporting_document' END AS source_type, o_orderkey AS source_id,
        substring(CAST(o_orderdate AS STRING), 1, 10) AS mention_date FROM orders""",
    "entity_relationships": """SELECT DISTINCT l_suppkey AS source_entity_id, o_custkey AS target_entity_id, CASE WHEN l_returnflag = 'A' THEN 'REPRESENTS' WHEN l_returnflag = 'R' THEN 'HAS_APPLICANT' ELSE 'MEMBER_OF' END AS relationship_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


class Tables:
    """Base tables and civic views of one directory, as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._made = spark, path, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                needed = [x for x in [*BASE, *VIEWS] if x != name and re.search(rf"\b(?:FROM|JOIN)\s+{x}\b", VIEWS[name])]
                text = VIEWS[name]
                for x in needed:
                    text = re.sub(rf"\b(FROM|JOIN)\s+{x}\b", rf"\1 {{{x}}}", text)
                self._made[name] = self._spark.sql(text, **{x: getattr(self, x) for x in needed})
            elif name in BASE:
                self._made[name] = self._spark.read.parquet(f"{self._path}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def with_prefix(sql: str) -> str:
    """``sql`` with the views it names as common table expressions before its own."""
    used: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in used:
                    used.append(name)

    add(sql)
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if not ctes:
        return body
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    return f"WITH {m[1] or ''}{ctes}, {body[m.end():]}" if m else f"WITH {ctes} {body}"
