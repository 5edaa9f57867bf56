"""Readers and sinks on small files."""

from civicspark.sources import files as S


def test_reports_lose_titles_names_and_blank_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Permits of May,,\nType,Number,Issue Date\nBLD,1,5/1/2026\n,,\nR\x00S,2,"5/2, 2026"\n"","",""\nX,3\n')
    rows = S.read_report(spark, str(tmp_path / "r.csv"), ["Type", "Number", "Issue Date"])
    assert sorted(tuple(r) for r in rows.collect()) == [("BLD", "1", "5/1/2026"), ("RS", "2", "5/2, 2026"), ("X", "3", None)]


def test_feature_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features": [{"attributes": {"id": 1, "kind": "a"}, "geometry": {"x": 1.5, "y": 2}},\n {"attributes": {"id": 2}}], "exceededTransferLimit": true}')
    (tmp_path / "b.json").write_text('{"features": []}')
    rows = S.read_feature_pages(spark, str(tmp_path), "id: long, kind: string")
    assert sorted((r.id, r.kind, r.x, r.y) for r in rows.collect()) == [(1, "a", 1.5, 2.0), (2, None, None, None)]
    assert S.page_offsets(5, 2) == [0, 2, 4] and S.page_offsets(0, 2) == [0]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\nnone\n\n{"id": 2}\n')
    assert sorted((r.id, r.t) for r in S.read_json_lines(spark, str(tmp_path), "id long, t string").collect()) == [(1, "a"), (2, None)]


def test_keyed_tables_take_new_rows_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "2026-01-01", None), ("a", "2026-01-01", "x"), ("b", "2026-02-01", "y, z")], "k string, day string, v string")
    assert S.append_new(one, path, ["k", "day"]).count() == 2
    two = spark.createDataFrame([("b", "2026-02-01", "again"), (None, "2026-03-01", "n")], "k string, day string, v string")
    assert S.append_new(two, path, ["k", "day"]).count() == 3
    found = S.append_new(two, path, ["k", "day"])
    assert found.count() == 3
    assert [r.k for r in S.between(found, "day", "2026-02-01", "2026-02-28").collect()] == ["b"]
