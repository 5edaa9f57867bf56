"""Every registered civic query against its SQL, and the operators on small frames."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicspark.functions import text as T
from civicspark.operators import merge as M
from civicspark.operators import permits as P
from civicspark.operators import resolve as R
from civicspark.operators import search as S
from civicspark.operators import votes as V
from civicspark.plans import registry
from civicspark.plans.projection import BASE
from civicspark.streaming import views

registry.load()
PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in BASE:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{PATH}/{name}.parquet'")
    return db


def canonical(frame: pd.DataFrame):
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool":
            return str(bool(v))
        return f"{float(v):.5f}" if not isinstance(v, str) and hasattr(v, "__float__") else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, PATH).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def one(spark, expression, *values):
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in frame.select(expression).collect()]


def test_vote_values(spark):
    assert one(spark, T.normalize_vote("x"), "Aye", " NAY", None, "Abstained", "Recused", "present") == ["yes", "no", "", "abstain", "recused", "present"]
    assert one(spark, T.normalize_motion_result("x"), None, "", "Deny it", "approve", "Filed away") == ["approved", "approved", "denied", "approved", "Filed away"]


def test_vote_semantics(spark):
    rows = [(1, 1, "yes"), (1, 2, "no"), (1, 3, "yes"), (2, 1, "yes"), (2, 2, "no"), (3, 1, "abstain"), (4, 1, "no"), (4, 2, "no")]
    votes = spark.createDataFrame(rows, "agenda_item_vote_id long, member_id long, vote string")
    tally = {r.agenda_item_vote_id: (r.is_split, r.majority) for r in V.tallies(votes).collect()}
    assert tally == {1: (True, "yes"), 2: (True, "tie"), 3: (False, None), 4: (False, "no")}
    items, flags = V.vote_attributes(votes)
    assert {r.agenda_item_vote_id: (r.unanimous, r.majority_position) for r in items.collect()} == {1: (False, "yes"), 2: (False, "tie"), 3: (None, "unknown"), 4: (True, "no")}
    assert {(r.agenda_item_vote_id, r.member_id) for r in flags.where("is_dissent").collect()} == {(1, 2)}
    assert {r.member_id for r in V.swing_votes(votes).collect()} == {1, 3}
    roster = spark.createDataFrame([(9, 1), (9, 2), (9, 5)], "meeting_id long, member_id long")
    about = spark.createDataFrame([(1, 9, "approved", "Ayes: 2"), (3, 9, "approved", "Nay: 0"), (4, 9, "withdrawn", "Ayes: 2")], "id long, meeting_id long, motion_result string, vote_text string")
    absent, abstained = V.infer_missing(votes, about, roster)
    assert [r.member_id for r in absent.collect()] == [5] and [(r.agenda_item_vote_id, r.member_id) for r in abstained.collect()] == [(3, 2)]


def test_states_and_errors(spark):
    texts = ["Item was continued to May", "Motion to approve carried", "received and filed; approved", "held in trust", "Held for staff", "approved as amended", "", None, "denied access", "request is withdrawable"]
    assert one(spark, T.lifecycle("x"), *texts) == ["continued", "approved", "informational", "unknown", "held", "approved_as_amended", "unknown", "unknown", "unknown", "unknown"]
    assert one(spark, T.error_category("x"), "HTTP 503", "KeyError: x", "body not found", "odd", None) == ["TRANSIENT", "CODE", "DATA", "UNKNOWN", "UNKNOWN"]


def test_names_dates_and_links(spark):
    assert one(spark, T.slug("x"), " North  Side! ") == ["north-side"]
    assert one(spark, T.is_canceled("x"), "Meeting CANCELLED", "cancel culture", None, "canceling") == [True, True, False, False]
    assert one(spark, T.file_extension("x"), "http://a/b.PDF?x=1", "http://a/b.exe", "http://a/b") == ["pdf", "", ""]
    assert one(spark, P.arcgis_date(F.col("x")), "/Date(1711929600000)/", "1711929600000", "2024-04-01T00:00", "n/a", None) == ["2024-04-01", "2024-04-01", "2024-04-01", None, None]
    assert one(spark, P.number(F.col("x")), "$1,500.5", "", "abc", None) == [1500.5, None, None, None]
    parts = spark.createDataFrame([("C-86-26-102-X-00",), ("C-86-26-102",)], "x string").select(T.c_number_parts("x").alias("p")).collect()
    assert [tuple(r.p) for r in parts] == [("C-86-26-102-X", "00"), ("C-86-26-102", None)]


def test_permits(spark):
    rows = [("1", "h1", "10", "5", "2024-01-02", "A", "New"), ("1", "h1", "10", "5", "2024-01-01", "A", "New"), (None, "h2", None, "", "2024-01-03", "B", "New"), ("1", "h1", "20", "bad", "2024-01-01", "A", "Old")]
    permits = spark.createDataFrame(rows, "permit_number string, row_hash string, permit_square_feet string, permit_valuation string, permit_issue_date string, normalized_category string, work_type string")
    found = {r.normalized_category: (r.permits, r.square_feet, r.valuation) for r in P.category_totals(permits, ["A", "C"]).collect()}
    assert found == {"A": (2, 30, 5), "C": (0, 0, 0)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k long, v string, h string")
    new = spark.createDataFrame([(2, "c", "q"), (2, "d", "r"), (3, "e", "s"), (None, "m", "t")], "k long, v string, h string")
    found = {r.k: (r.v, r.h) for r in M.upsert(old, new, ["k"], [F.desc("v")], keep=["h"]).collect()}
    assert found == {1: ("a", "x"), 2: ("d", "y"), 3: ("e", "s"), None: ("m", "z")}
    assert M.upsert(old, new.limit(0), ["k"], [F.desc("v")]).count() == 3
    assert {r.k for r in M.insert_missing(old, new.where("k is not null"), ["k"]).collect()} == {3}
    assert {r.v for r in M.replace_groups(old, new, ["k"]).collect()} >= {"a", "c", "d"}


def test_search_parts(spark):
    docs = spark.createDataFrame([(1, "Red brick house", ""), (2, "brick red", "red"), (3, None, "")], "id long, a string, b string")
    index = S.build_index(docs, "id", {"a": "A", "b": "B"})
    ids = lambda q: sorted(r.id for r in S.search(index, q).collect())
    assert ids("red brick") == [1, 2] and ids('"red brick"') == [1] and ids("red -house") == [2] and ids("bri*") == [1, 2] and ids("") == []


def test_resolution(spark):
    names = spark.createDataFrame([(1, "Smith John"), (2, "john smith"), (3, "Acme Holdings"), (4, "Acme Holdings Inc"), (5, None)], "id long, name string")
    assert {(r.id, r.other) for r in R.similar_pairs(names, "id", "name").collect()} == {(1, 2), (3, 4)}


def _similarity(a, b):
    import re

    x, y = ([w for w in re.split("[^a-z0-9]+", n.lower()) if w] for n in (a, b))
    jaccard = len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
    one, two = sorted((a.lower(), b.lower()), key=len)
    contained = 0.85 if one in two and len(one) > 0.25 * len(two) else 0.0
    longest = lambda w: max(w, key=lambda v: (len(v), v))
    block = a.lower()[:6] == b.lower()[:6] or bool(x and y) and (
        x[0] == y[0] or x[-1] == y[-1] or set(x) <= set(y) or set(y) <= set(x) or longest(x) == longest(y) or [w[0] for w in dict.fromkeys(x)] == [w[0] for w in dict.fromkeys(y)]
    )
    return max(jaccard, contained) if block else 0.0


NAMES = [
    "Johnson", "Johnsons", "Vertical Bridge", "Annmarie Beckett, Vertical Bridge/Clear Blue Services", "Clear Blue Services", "Школьная", "Школьная №", "Smith John", "john  smith",
    "Acme Holdings", "Acme Holdings Inc", "Big Acme Holdings Inc", "Johnson Ranch", "The Johnson Ranch", "Ranch", "A", "", "Blue",
]


def test_similar_pairs_brute_force(spark):
    names = spark.createDataFrame(list(enumerate(NAMES)) + [(99, None)], "id long, name string")
    found = {(r.id, r.other) for r in R.similar_pairs(names, "id", "name").collect()}
    assert found == {(i, j) for j, b in enumerate(NAMES) for i, a in enumerate(NAMES[:j]) if round(_similarity(a, b), 4) >= 0.85}
    assert {(0, 1), (2, 3), (5, 6), (7, 8)} <= found


def test_merge_variations_brute_force(spark):
    names = [n for n in NAMES if n] + ["Smith, John", "Blue", "acme holdings", "Lone Name"]
    table = spark.createDataFrame([(i, n, i * 7 % 5) for i, n in enumerate(names)], "id long, name string, mentions long")
    group = list(range(len(names)))
    for j, b in enumerate(names):
        for i, a in enumerate(names[:j]):
            if _similarity(a, b) >= 0.85 and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    want = set()
    for g in set(group):
        ids = [i for i in range(len(names)) if group[i] == g]
        best = max(ids, key=lambda i: (i * 7 % 5, -i))
        want |= {(i, best) for i in ids if i != best}
    assert {(r.victim, r.survivor) for r in R.merge_variations(table, "id", "name", "mentions").collect()} == want


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{PATH}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 5")
    events.write.parquet(str(tmp_path / "in"))
    stream = views.file_stream(spark, str(tmp_path / "in"), events.schema)
    counted = views.trending(stream, "user_id", "ts", "1 day", "1 day")
    query = counted.writeStream.format("memory").queryName("trend").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = views.trending(events, "user_id", "ts", "1 day", "1 day")
    assert sorted(map(tuple, spark.table("trend").collect())) == sorted(map(tuple, want.collect()))
    for _ in range(2):  # a second drain adds nothing
        views.drain(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def _exchanges(frame):
    """Exchanges of a plan, each with what is below it."""
    def walk(node):
        yield node
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))
    return [n for n in walk(frame._jdf.queryExecution().optimizedPlan())]


def test_members_without_votes_shuffle_no_pairs(spark):
    """Pairs of meetings and members are made by the last join: nothing that could shuffle them follows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("v21", "v22", "v23", "j13"):
            kinds = [n.nodeName() for n in _exchanges(registry.QUERIES[name](spark, PATH))]
            top = next(i for i, k in enumerate(kinds) if k == "Join")
            assert not {"Aggregate", "Window", "RepartitionByExpression"} & set(kinds[:top]), name
            top_join = [n for n in _exchanges(registry.QUERIES[name](spark, PATH)) if n.nodeName() == "Join"][0]
            assert top_join.joinType().toString() == "Inner", name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_roster_by_body(spark):
    votes = spark.createDataFrame([(1, 1), (3, 2), (3, 2)], "agenda_item_vote_id long, member_id long")
    items = spark.createDataFrame([(1, 9, 4, "approved", "Ayes: 2"), (3, 9, 4, "approved", "Nay: 0"), (5, 8, None, "approved", "Ayes: 2")], "id long, meeting_id long, body long, motion_result string, vote_text string")
    roster = spark.createDataFrame([(4, 1), (4, 2), (4, 5), (4, 5), (None, 6)], "body long, member_id long")
    absent, abstained = V.infer_missing(votes, items, roster, "body")
    assert [tuple(r) for r in absent.collect()] == [(9, 5)] and {tuple(r) for r in abstained.collect()} == {(9, 3, 1), (9, 1, 2)}


def test_alignment_deals_each_pair_once_over_enough_tasks(spark):
    rows = [(k, m, "yes" if (k + m) % 3 else "no") for k in range(6) for m in (1, 2, 3)]
    votes = spark.createDataFrame(rows, "agenda_item_vote_id long, member_id long, vote string")
    found = V.pairwise_alignment(votes, votes)
    assert found.count() == 6 and {(r.total_comparable_votes, r.same_votes + r.different_votes) for r in found.collect()} == {(6, 6)}
    pairs = spark.createDataFrame([(1, 2, True), (1, 2, False), (1, 3, True)], "a long, b long, same boolean")
    held = V.both_ways(pairs, "a", "b", 9, [F.count("*").alias("n"), F.count_if("same").alias("same")])
    assert {tuple(r) for r in held.collect()} == {(1, 2, 2, 1), (2, 1, 2, 1), (1, 3, 1, 1), (3, 1, 1, 1)} and held.rdd.getNumPartitions() == 9


def test_members_of_a_day_are_told_in_runs(spark):
    from civicspark.plans.projection import Tables
    from civicspark.plans.suites import meetings as suite

    t = Tables(spark, PATH)
    rows = [(k * 7919 % 20_000, k % 5, f"1998-01-0{k % 3 + 1}") for k in range(20_000)]
    t._made["meetings"] = spark.createDataFrame(rows, "meeting_id long, public_body_id int, meeting_date string")
    t._made["body_memberships"] = spark.createDataFrame([(p, p % 5, "1997-01-01", None if p % 2 else "1998-01-02") for p in range(100)], "person_id long, public_body_id int, term_start string, term_end string")
    valid = (F.col("term_start") <= F.col("meeting_date")) & (F.col("term_end").isNull() | (F.col("term_end") >= F.col("meeting_date")))
    plain = t.meetings.join(t.body_memberships, "public_body_id").where(valid).select("meeting_id", "person_id")
    found = suite.j13(t)
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
    told = [r.person_id for r in found.collect()]
    assert sum(a != b for a, b in zip(told, told[1:])) < len(told) / 20


def test_absent_members_are_told_in_runs(spark):
    meetings = spark.createDataFrame([(k * 7919 % 20_000, k % 5, k % 3) for k in range(20_000)] + [(7, 2, 1), (None, 4, 0), (9, None, 0)], "meeting_id long, body int, kind int")
    roster = spark.createDataFrame([(p % 5, p, f"name {p}") for p in range(100)] + [(0, None, "x"), (None, 8, "y")], "body int, member_id long, name string")
    votes = spark.createDataFrame([(k % 20_000, k % 97) for k in range(0, 60_000, 7)] + [(7, None)], "meeting_id long, member_id long")
    plain = meetings.join(roster, "body").join(votes.distinct(), ["meeting_id", "member_id"], "left_anti")
    for chosen in (["meeting_id", "body"], ["meeting_id", "body", "kind"]):
        found = V.without_vote(meetings.select(chosen), roster, votes, "meeting_id", "body")
        want = plain.select(found.columns)
        assert found.count() == want.count() and found.exceptAll(want).count() == 0
    told = [r.member_id for r in V.without_vote(meetings.select("meeting_id", "body"), roster, votes, "meeting_id", "body").collect()]
    assert sum(a != b for a, b in zip(told, told[1:])) < len(told) / 20


def test_members_absent_from_several_items_are_told_in_runs(spark):
    items = spark.createDataFrame([(k, k // 2, k // 2 % 5, "approved", "Ayes: 2") for k in range(20_000)], "id long, meeting_id long, body int, motion_result string, vote_text string")
    roster = spark.createDataFrame([(p % 5, p) for p in range(100)], "body int, member_id long")
    votes = spark.createDataFrame([(k % 20_000, k % 97) for k in range(0, 60_000, 7)], "agenda_item_vote_id long, member_id long")
    absent, _ = V.infer_missing(votes, items, roster, "body")
    voted = votes.join(items, votes.agenda_item_vote_id == items.id).select("meeting_id", "member_id").distinct()
    want = items.select("meeting_id", "body").distinct().join(roster, "body").join(voted, ["meeting_id", "member_id"], "left_anti").select("meeting_id", "member_id")
    assert absent.count() == want.count() and absent.exceptAll(want).count() == 0
    told = [r.member_id for r in absent.collect()]
    assert sum(a != b for a, b in zip(told, told[1:])) < len(told) / 20


def test_members_of_a_day_are_dealt_over_tasks(spark):
    """The days of meetings are few bytes, which the planner would put into a task, but many rows come of them."""
    assert registry.QUERIES["j13"](spark, PATH).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
