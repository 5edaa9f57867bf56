"""Saved pages of map services."""

import json

import pytest
from civicspark.sources import paged as D

SCHEMA = "ID long, NAME string"


def save(folder, pages):
    folder.mkdir(parents=True, exist_ok=True)
    for offset, page in pages.items():
        (folder / f"{offset}.json").write_text(page if isinstance(page, str) else json.dumps(page))
    return str(folder)


def page(*ids, more=False, **extra):
    return {"features": [{"attributes": {"ID": i, "NAME": f"n{i}", **extra}, "geometry": {"x": i / 2, "y": 1.0}} for i in ids], "exceededTransferLimit": more}


def ids(frame):
    return sorted(r.ID for r in frame.collect())


def test_pages_end_where_the_limit_is_not_exceeded(spark, tmp_path):
    path = save(tmp_path / "a", {0: page(1, 2, more=True), 2: page(3, 4, more=True), 4: page(5), 6: page(99)})
    rows = D.read_layer(spark, path, SCHEMA)
    assert ids(rows) == [1, 2, 3, 4, 5] and rows.where("ID = 3").first().geometry.x == 1.5
    assert ids(D.read_layer(spark, path, SCHEMA, 3)) == [1, 2, 3] and ids(D.read_layer(spark, path, SCHEMA, 2)) == [1, 2]
    empty_last = save(tmp_path / "b", {0: page(1, more=True), 1: page(), 2: "no json"})
    assert ids(D.read_layer(spark, empty_last, SCHEMA)) == [1]
    assert ids(D.read_layer(spark, save(tmp_path / "c", {0: page()}), SCHEMA)) == []
    assert ids(D.read_layer(spark, save(tmp_path / "d", {0: {"features": [{"attributes": {"ID": 7}}]}}), SCHEMA)) == [7]


def test_faults_are_told_by_name(spark, tmp_path):
    broken = save(tmp_path / "a", {0: page(1, 2, more=True), 2: '{"features": [', 4: page(5)})
    with pytest.raises(D.BrokenPages, match="broken .*2.json"):
        D.read_layer(spark, broken, SCHEMA)
    refused = save(tmp_path / "b", {0: page(1, more=True), 1: {"error": {"code": 500}}})
    with pytest.raises(D.BrokenPages, match="error .*1.json"):
        D.read_layer(spark, refused, SCHEMA)
    with pytest.raises(D.BrokenPages, match="missing offset 2"):
        D.read_layer(spark, save(tmp_path / "c", {0: page(1, 2, more=True), 4: page(5)}), SCHEMA)
    assert ids(D.read_layer(spark, f"{tmp_path}/c", SCHEMA, 2)) == [1, 2]


def test_layers_are_united(spark, tmp_path):
    one, two = save(tmp_path / "a", {0: page(1)}), save(tmp_path / "b", {0: page(2, KIND="k", more=True), 1: page(3)})
    rows = D.read_layers(spark, {"a": (one, SCHEMA), "b": (two, f"{SCHEMA}, KIND string")})
    assert sorted(((r.layer, r.ID, r.KIND) for r in rows.collect()), key=str) == [("a", 1, None), ("b", 2, "k"), ("b", 3, None)]


def test_round_trip(spark, tmp_path):
    rows = spark.range(25).selectExpr("id AS place", "id * 3 AS ID", "concat('é', id) AS NAME")
    D.write_pages(rows, f"{tmp_path}/p", "place", 10)
    back = D.read_layer(spark, f"{tmp_path}/p", SCHEMA)
    assert sorted((r.offset, r.ID, r.NAME) for r in back.collect()) == sorted((k // 10 * 10, k * 3, f"é{k}") for k in range(25))
