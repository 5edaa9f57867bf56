"""Minutes parsers and names on small texts."""

from civicspark.functions import names as N
from civicspark.operators import minutes as X
from pyspark.sql import functions as F

MINUTES = """Members Present: Ann Lee, Bob Ray and Cy Fox
Absent: none
1. Call to order
2. Rezoning Z-101-26
Motion by Lee, seconded by Ray, to approve. The motion carried unanimously, vote of 70.
5. Not next
3) Parcel 123-45-678A
Motion by Fox, second by Lee, to deny. Motion failed. Ayes: 1; Nays: 6
"""


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_minutes(spark):
    docs = spark.createDataFrame([(1, MINUTES), (2, None), (3, "")], "id long, body string")
    assert rows(X.roll_call(docs, "id", "body")) == [(1, "Ann Lee", True), (1, "Bob Ray", True), (1, "Cy Fox", True)]
    assert rows(X.numbered_items(docs, "id", "body")) == [(1, 1, "Call to order"), (1, 2, "Rezoning Z-101-26"), (1, 3, "Parcel 123-45-678A")]
    found = [(r.mover, r.seconder, r.result, r.yes_votes, r.no_votes, r.unanimous) for r in X.motions(docs, "id", "body").orderBy("place").collect()]
    assert found == [("Lee", "Ray", "passed", 7, 0, True), ("Fox", "Lee", "failed", 1, 6, False)]
    assert X.events(docs, "id", "body", {"approve": "approval", "deny": "denial"}).count() == 2


def test_adjacent_events(spark):
    import re

    verbs = {"denied": "denial", "filed": "filing", "carried": "approval"}
    texts = [
        "Z-101 was denied; Z-202 was filed", "Denied, denied and FILED.\nThe motion for CASE 12345 carried", "unfiled", "", "filed" + " x" * 200 + "\n denied PLN1234", "é" * 80 + " carried filed",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, body string")
    case = re.compile(r"Z[-/\s]?\d{3,6}|PLN\d{4,6}|CASE\s*\d{4,9}", re.I)
    want = []
    for i, body in enumerate(texts):
        for k, m in enumerate(re.finditer(r"\b(?:denied|filed|carried)\b", body, re.I)):
            near = case.search(body[max(0, m.start() - 100) : m.end() + 200])
            column = m.start() - body.rfind("\n", 0, m.start()) - 1
            want.append((i, k, m[0].lower(), verbs[m[0].lower()], body[max(0, m.start() - 60) : m.end() + 60], m.start(), near and near[0].replace(" ", "").upper(), 0.9 if column < 15 else 0.7))
    assert sorted(map(str, rows(X.events(docs, "id", "body", verbs)))) == sorted(map(str, want)) and len(want) == 10


def test_names(spark):
    frame = spark.createDataFrame([("Vice Chair  John Q. O'Neil, Member",), ("The Honorable Ann Lee",), ("Acme & Sons, L.L.C.",), (None,)], "x string")
    assert [r[0] for r in frame.select(N.person_key(F.col("x"))).collect()][:2] == ["john q o'neil", "ann lee"]
    assert [r[0] for r in frame.select(N.entity_key(F.col("x"))).collect()][2:] == ["acme and sons", None]
    one = spark.createDataFrame([(MINUTES,)], "x string").select(N.case_numbers(F.col("x")), N.parcel_numbers(F.col("x"))).first()
    assert list(one) == [["Z-101-26"], ["123-45-678A"]]
    dates = spark.createDataFrame([("3/4/2024",), ("March 4, 2024",), ("soon",), (None,)], "x string").select(N.iso_date(F.col("x"))).collect()
    assert [r[0] for r in dates] == ["2024-03-04", "2024-03-04", None, None]


def test_samples(spark):
    frame = spark.range(1000).withColumn("s", F.col("id") % 3)
    sample = X.sample_by_stratum(frame, ["s"], "id", 5)
    assert sample.groupBy("s").count().where("count <> 5").count() == 0 and rows(sample) == rows(X.sample_by_stratum(frame.repartition(7), ["s"], "id", 5))
    folds = {r.fold: r["count"] for r in X.split_80_10_10(frame, "id").groupBy("fold").count().collect()}
    assert sum(folds.values()) == 1000 and 700 < folds["train"] < 900


def test_strata_and_quotas(spark):
    sizes = {None: 7, "a": 1, "b": 10, "c": 505}
    frame = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "id string, s string")
    split = X.split_80_10_10(frame, "id", ["s"], 8)
    found = {(r.s, r.fold): r["count"] for r in split.groupBy("s", "fold").count().collect()}
    want = {(s, f): k for s, n in sizes.items() for f, k in (("train", n * 8 // 10), ("val", n // 10), ("test", n - n * 8 // 10 - n // 10)) if k}
    assert found == want and split.select("id").distinct().count() == 523 and rows(split.select("id", "fold")) == rows(X.split_80_10_10(frame.repartition(5), "id", ["s"], 8).select("id", "fold"))
    assert X.sample_quotas({"a": 1, "b": 10, "c": 505}, 60, 40) == {"a": 1, "b": 10, "c": 40} and X.sample_quotas({"a": 100, "c": 505}, 60, 40, {"c": 0.5}) == {"a": 20, "c": 40}
    frame = frame.withColumn("k", F.length("id"))
    sample = X.sample_by_quota(frame, "s", ["k"], "id", 30, 20)
    assert {r.s: r["count"] for r in sample.groupBy("s").count().collect()} == X.sample_quotas(sizes, 30, 20)
    assert sample.where("s = 'c'").select("k").distinct().count() == 3
