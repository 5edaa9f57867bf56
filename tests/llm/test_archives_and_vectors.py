"""WARC round trips, nearest neighbours, components and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from civicspark.llm import inverted_multi_index as im
from civicspark.llm import warc
from civicspark.llm.common import connected_components

PAGES = "page_id long, url string, html string, digest string"


def pages():
    big, tricky = "<p>é</p>" * 200, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60
    rows = [(k, f"http://h/{k}", big, "x") for k in (3, 9, 4)] + [(k, f"http://t/{k}", tricky, "x") for k in (1, 2)]
    rows += [(5, None, None, "x"), (6, "u\r\nInjected: 1", "", "x"), (7, "u", "small", "x"), (8, "u", "small", "x"), (9, "http://h/9", big, "x"), (None, "n", big, "x")]
    return rows


def test_round_trip_resolves_revisits(spark):
    rows = pages()
    found = warc.archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    largest = {}
    for k, _, html, _ in rows:
        largest[html] = max(largest.get(html, -1), -1 if k is None else k)
    want = []
    for k, _, html, _ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and largest[html] != k
        want.append((str(k), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[html] if revisit else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in found) == sorted(want, key=str) or sorted(
        ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in found), key=str
    ) == sorted(want, key=str)


def test_payloads_survive(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(pages(), PAGES), path)
    records = warc.read_warc(spark, path).collect()
    full = {(r.page_id, bytes(r.payload).decode()) for r in records if r.record_type == "response"}
    assert full >= {(9, pages()[0][2]), (2, pages()[3][2]), (5, ""), (7, "small")}
    assert all(not r.payload for r in records if r.record_type == "revisit")
    assert len(records) == len(pages())


def test_parser_reads_members_and_rejects_cuts():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["payload"] for r in warc.parse_warc(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse_warc(record[:-6]))
    assert list(warc.parse_warc(b"")) == []


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def brute(rows, k):
    known = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in known:
        if q % 5 == 0:
            ranked = sorted(((-(v * x).sum(), i) for i, v in known if i != q))
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def vectors(n=300):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=6))]) for k in range(n)]
    rows += [(n + k, rows[7][1]) for k in range(40)]  # copies of one vector
    return rows + [(900, None), (905, [0.0] * 6), (910, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (915, [float("nan")] * 6), (920, [1.0]), (None, rows[0][1]), rows[3]]


@pytest.mark.parametrize("block", [4000, 16])
def test_full_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(im, "BLOCK_ROWS", block)
    monkeypatch.setattr(im, "GROUP_ROWS", 4 * block)
    rows = [(i, v, "s") for i, v in vectors()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = im.nearest(table, table.where("vec_id % 5 = 0"), k=7, share=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([x[:2] for x in rows[:-1]], 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = im.nearest(table, table.where("vec_id % 20 = 0"), k=20).collect()
    best = {q: set(np.argsort(-(x @ x[q]))[:21].tolist()) - {q} for q in range(0, 2000, 20)}
    assert sum(r.vec_id in best[r.query_id] for r in found) / (20 * len(best)) >= 0.9


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(24, 8)))]
    rows += [rows[0]] * 200 + [(0, v.tolist()) for v in rng.normal(size=(9, 8))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = im.nearest(table, table.where("vec_id < 5").dropDuplicates(["vec_id"]), k=20).collect()
    for q in range(5):
        assert sorted(r["rank"] for r in found if r.query_id == q) == list(range(1, 21))


def test_query_ids_with_unusable_vectors_too(spark):
    rows = [(0, [1.0, None]), (0, [1.0, 2.0]), (0, [0.0, 0.0]), (1, [3.0, 1.0]), (2, [float("inf"), 1.0]), (3, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = im.nearest(table, table.where("vec_id in (0, 2)"), k=20).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, 1, 5.0), (0, 3, 1.5)]


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    at, x = im.matrix(pa.array([v for _, v in rows], pa.list_(pa.float64())))
    ids = np.array([rows[i][0] for i in at])
    found = im.nearest(table, table.where("vec_id % 20 = 0"), k=20).collect()
    hits = want = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = np.where(ids == ids[q], -np.inf, x @ x[q])
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits += sum(r.vec_id in best for r in found if r.query_id == ids[q])
        want += len(best)
    assert hits / want >= 0.9


def test_few_or_no_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], shape)
    assert [(r.rank, r.vec_id) for r in im.nearest(few, few.where("vec_id = 0"), share=1.0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert im.nearest(few.limit(0), few.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(300, 200), (200, 400), (5, 5)]
    rng.shuffle(edges)
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 100 for k in range(100, 141)} | {k: 7 for k in range(7, 60)} | {k: 200 for k in (200, 300, 400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline
    from tests.llm.test_dedup import components

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, rows = docs.columns, None
    from civicspark.llm.common import keep

    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = keep(stage(spark, docs, path), name)
        rows = docs.collect()
        if name != "mixing":
            assert docs.columns == columns or sorted(docs.columns) == sorted(columns)
        if name == "near_duplicates":
            want = components(before)
            assert sorted(r.doc_id for r in rows) == sorted(k for k, (_, c) in want.items() if c == k)
    assert rows and all(r.rate >= 0 for r in rows)
    assert len(corpus_pipeline.run(spark, path).columns) == len(docs.columns)
