"""The stored index against a plain search, in generations and with pruning."""

import random
import re

import pytest
from civicspark.operators import search_index as S
from civicspark.operators.search import parse_query

FIELDS = {"title": "A", "body": "B"}
WEIGHT = {"title": 1.0, "body": 0.4}


def documents(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Alpha", "beta", "betamax"]
    text = lambda most: " ".join(rng.choices(words, [3 / (k + 1) for k in range(15)], k=rng.randrange(most))) + rng.choice(["", ".", " é!"])
    return [(k * 3, text(4), text(30), rng.choice("xy")) for k in range(n)] + [(9_000, None, None, "x"), (9_001, "", "Alpha", None)]


def brute(rows, query, k, kind=None):
    parts, out = parse_query(query), []
    for i, title, body, group in rows:
        if kind and group != kind:
            continue
        score, good = 0, True
        for minus, prefix, words in parts:
            found = 0
            for field, text in (("title", title), ("body", body)):
                tokens = [w.lower() for w in re.split("[^A-Za-z0-9]+", text or "") if w]
                for at in range(len(tokens)):
                    hit = tokens[at].startswith(words[0]) if prefix else tokens[at : at + len(words)] == words
                    found += hit * WEIGHT[field]
            good &= (found == 0) if minus else (found > 0)
            score += 0 if minus else found
        if good:
            out.append((-round(score * 1000), i))
    return [(i, round(-s / 1000 / (-s / 1000 + 1), 6)) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("first", [1, 64])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, first):
    monkeypatch.setattr(S, "FIRST_BLOCKS", first)
    monkeypatch.setattr(S, "BLOCK_IDS", 64)
    rows = documents(1, 300)
    docs = spark.createDataFrame(rows, "doc long, title string, body string, kind string")
    index = S.build(docs.where("doc % 2 = 0"), "doc", FIELDS, f"{tmp_path}/i", ("kind",))
    assert S.add(index, docs, "doc", ("kind",)) == 1
    assert S.add(index, docs, "doc", ("kind",)) == 2  # nothing is new
    assert index.documents().count() == len(rows) and index.documents().where("generation = 2").count() == 0
    for query in ("w3", "alpha -beta", '"w0 w1"', "bet* w7", '"w1 w0" -w9 w2', "none", "", "-w1", '-"w0 w0" w0'):
        for k, kind in ((5, None), (1000, "x")):
            found = S.search(index, query, k, None if kind is None else f"kind = '{kind}'").collect()
            want = brute(rows, query, k, kind) if [p for p in parse_query(query) if not p[0]] else []
            assert [(r.id, r["rank"]) for r in found] == want, query


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    index = S.build(spark.createDataFrame(documents(2, 50), "doc long, title string, body string, kind string"), "doc", FIELDS, f"{tmp_path}/i")
    plan = index.postings().where("bucket = 3 and term = 'w1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan


def test_headlines(spark, tmp_path):
    rows = [(1, "Alpha", "one two three four five six seven Beta eight nine ten eleven twelve thirteen fourteen fifteen sixteen alpha"), (2, "beta alpha", "none")]
    docs = spark.createDataFrame(rows, "doc long, title string, body string")
    index = S.build(docs, "doc", FIELDS, f"{tmp_path}/i")
    found = S.headlines(S.search(index, "alpha beta", 9), index, docs, "doc", "body")
    assert {r.id: r.headline for r in found.collect()} == {
        1: "three four five six seven <b>Beta</b> eight nine ten eleven twelve thirteen fourteen fifteen sixteen", 2: None
    }


def test_an_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc long, title string, body string")
    index = S.build(docs, "doc", FIELDS, f"{tmp_path}/i")
    assert S.add(index, spark.createDataFrame([(4, "a b", None)], docs.schema), "doc") == 0
    assert [r.id for r in S.search(index, "a", 3).collect()] == [4]
