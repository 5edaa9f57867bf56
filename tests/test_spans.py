"""The algebra of spans against brute force."""

import random
import re
import time

from civicspark.operators import spans as S
from pyspark.sql import functions as F


def test_found_spans_equal_a_second_reader(spark):
    rng = random.Random(1)
    parts = ["Ann Lee", "Owner: Bob Ray", "x", ", ", "é ", "for Cy Fox", "\n", "Acme & Sons", "A.", " Big Tree Homes", "Red Oak Hill, L.L.C."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc int, text string")
    for family, pattern in (*S.FAMILIES, ("capitals", "([A-Z]+)")):
        found = rows.select("doc", S.find(F.coalesce("text", F.lit("")), pattern, family).alias("s")).collect()
        for r in found:
            text = "" if r.doc == 999 else texts[r.doc]
            assert [tuple(x) for x in r.s] == [(m.start(1), m.end(1), family, m[1]) for m in re.finditer(pattern, text)]


def test_schedule_and_complement(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        spans = [(a := rng.randrange(40), a + rng.randrange(1, 9), "k", str(n)) for n in range(rng.randrange(7))]
        rows.append((k, spans))
    table = spark.createDataFrame(rows, "id int, s array<struct<start: int, end: int, kind: string, name: string>>")
    found = table.select("id", S.schedule(F.col("s")).alias("taken"), S.complement(F.col("s"), F.lit(50)).alias("gaps")).collect()

    def most(spans):
        if not spans:
            return 0
        first, *rest = spans
        return max(most(rest), 1 + most([x for x in rest if x[0] >= first[1] or x[1] <= first[0]]))

    for r in found:
        spans = rows[r.id][1]
        assert len(r.taken) == most(spans) and all(a.end <= b.start for a, b in zip(r.taken, r.taken[1:]))
        covered = {p for a, b, *_ in spans for p in range(a, b)}
        assert {p for g in r.gaps for p in range(g.start, g.end)} == set(range(50)) - covered
        assert all(g.start < g.end for g in r.gaps)


def test_candidates_count_once(spark):
    text = "Owner: Red Oak. for Red Oak again; told of The Red Oak & Partners Hill by Big Tree, LLC and Big Tree LLC"
    found = {(r.normalized_name, r.family, text[r.start : r.end] == r["name"]) for r in S.candidates(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").collect()}
    assert ("red oak", "field", True) in found and sum(n == "red oak" for n, *_ in found) == 1 and all(ok for *_, ok in found)


def test_negatives_touch_nothing_known(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known = docs.withColumn("known", S.find(F.col("text"), r"([A-Z][a-z]+)(?=,)", "known"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = S.negative_spans(known, "doc_id", "text", "known", 10_000).collect()
    want = set()
    for d, text in texts.items():
        taken = {p for m in re.finditer(r"[A-Z][a-z]+(?=,)", text) for p in range(*m.span())}
        for m in re.finditer(r"(?:[A-Z][a-zA-Z'.\-]+\s+)+[A-Z][a-zA-Z'.\-]+", text):
            if m.end() - m.start() >= 4 and not taken & set(range(*m.span())):
                want.add((d, m[0], *m.span()))
    assert {(r.doc_id, r["name"], r.start, r.end) for r in found} == want and want
    few = S.negative_spans(known, "doc_id", "text", "known", 2)
    assert few.groupBy("doc_id").count().where("count > 2").count() == 0 and few.count() > 0


def test_texts_of_many_spans_take_no_square_of_their_number(spark):
    n = 50_000
    rows = spark.createDataFrame([("Ab " * n,)], "text string").select(F.length("text").alias("n"), S.find(F.col("text"), "([A-Z]+)", "k").alias("s"))
    began = time.time()
    found = rows.select(F.size("s").alias("runs"), F.element_at("s", -1)["start"].alias("last"), F.size(S.complement(F.col("s"), F.col("n"))).alias("gaps")).first()
    assert (found.runs, found["last"], found.gaps) == (n, 3 * (n - 1), n) and time.time() - began < 60


def test_a_phrase_of_very_many_words_takes_no_stack(spark):
    docs = spark.createDataFrame([(1, "Ab " * 100_000 + "cd", None), (2, "an Ab Cd, Ef", None)], "id int, text string, known " + S._SPAN.join(("array<", ">")))
    found = S.negative_spans(docs, "id", "text", "known").select("id", "start", "end").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 299_999), (2, 3, 8)]


def test_texts_of_a_small_file_are_dealt_over_tasks(spark):
    from civicspark.plans.projection import Tables
    from civicspark.plans.suites.spans import _names

    rows = _names(Tables(spark, "/root/testdata/sf0.01"))
    assert rows.groupBy(F.spark_partition_id()).count().count() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
