"""Recorded pages as a data source: tokens, broken pages, schemas by API."""

import json

import pytest

from tessella.sources import recorded as Re

A = Re.Api("a", "items", "next", (("name", "$.n"), ("deep", "$.x.y")))
B = Re.Api("b", "results", "cursor", (("name", "$.title"),))


@pytest.fixture
def folder(spark, tmp_path):
    pages = [("a", str(i), json.dumps({"items": [{"n": f"{i}-{j}", "x": {"y": j}} for j in range(3)], "next": str(i + 1) if i < 9 else None})) for i in range(10)]
    pages += [("a", "cut", '{"items": [{"n"'), ("a", "other", '{"rows": []}'), ("a", "list", "[1]"), ("a", "none", '{"items": [], "next": "gone"}'), ("b", "x/y z", '{"results": [{"title": "t"}, {"name": "no title"}, 7]}'), ("c", "0", "{}")]
    at = f"file://{tmp_path}/pages"
    Re.record(spark.createDataFrame(pages, "api string, page string, body string"), at)
    return at


@pytest.mark.parametrize("size", [1, 3, 100])
def test_pages_items_and_errors(spark, folder, size):
    rows = Re.read(spark, folder, [A, B], size)
    assert {(r.page, r.pos, r.name, r.deep) for r in Re.typed(rows, A).collect()} == {(str(i), j, f"{i}-{j}", str(j)) for i in range(10) for j in range(3)}
    assert {(r.page, r.pos, r.name) for r in Re.typed(rows, B).collect()} == {("x/y z", 0, "t"), ("x/y z", 1, None), ("x/y z", 2, None)}
    errors = {(r.api, r.page): r.error for r in Re.errors(rows).collect()}
    assert errors.keys() == {("a", "cut"), ("a", "other"), ("a", "list"), ("a", "gone")}
    assert errors["a", "gone"] == "not recorded" and "JSONDecodeError" in errors["a", "cut"]
    assert rows.rdd.getNumPartitions() == -(-15 // size)


def test_nothing_recorded(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert Re.read(spark, f"file://{tmp_path}/empty", [A]).count() == 0
