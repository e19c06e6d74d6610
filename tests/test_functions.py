import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paging, scoring, text


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, "x string").select(column).collect()]


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("*.java", "A.java", True), ("*.java", "a/A.java", False), ("src/**/A.java", "src/A.java", True), ("src/**/A.java", "src/x/y/A.java", True), ("s?c/*", "src/a", True), ("s?c/*", "src/a/b", False), ("a+b/*", "a+b/c", True)],
)
def test_path_globs(glob, path, fits):
    assert bool(re.match(text.path_glob(glob), path)) is fits


@pytest.mark.parametrize(
    ("glob", "name", "fits"),
    [("org.acme..", "org.acme", True), ("org.acme..", "org.acme.web.x", True), ("org.acme..", "org.acmes", False), ("org.*.web", "org.a.b.web", True), ("org.acme", "orgxacme", False), ("..api", "org.x.api", False), ("org..api", "org.x.api", True), ("org..api", "orgapi", True)],
)
def test_package_globs(glob, name, fits):
    assert bool(re.match(text.package_glob(glob), name)) is fits


def test_names(spark):
    x = F.col("x")
    rows = [("org.acme.A$B$C",), ("A",), ("A$B",)]
    assert values(spark, rows, text.package_name(x)) == ["org.acme", "<default>", "<default>"]
    assert values(spark, rows, text.outer_name(x)) == ["org.acme.A", "A", "A"]
    assert values(spark, [("a.b.c.D",), ("a.b",), ("a",)], text.library_of(x)) == ["a.b", "a", ""]
    assert values(spark, [("public static",), ("nonstatic",), ("",)], text.has_modifier(x, "static")) == [True, False, False]


def test_scores(spark):
    df = spark.createDataFrame([(v,) for v in (0, 3, 8, 15, 20, 1, 5, 12)], "x long")
    got = [r[0] for r in df.select(scoring.scaled(F.col("x"), 0, 3, 8, 15)).collect()]
    assert got == pytest.approx([0, 5, 8, 10, 10, 5 / 3, 6.2, 8 + 8 / 7])
    halves = spark.createDataFrame([(1.005,), (2.345,), (-0.05,)], "x double").select(scoring.half_up(F.col("x"), 1))
    assert [r[0] for r in halves.collect()] == [1.0, 2.3, 0.0]
    assert [r[0] for r in spark.range(5).select(scoring.bus_factor(F.col("id"))).collect()] == [0, 10, 5, 2, 0]


def test_pages_and_cursors():
    assert paging.clamp(None, 30, 100) == 30 and paging.clamp(500, 30, 100) == 100 and paging.clamp(0, 30, 100) == 1
    assert paging.envelope(10, 25, 10, 10) == {"showing": 10, "total": 25, "limit": 10, "offset": 10, "has_more": True, "truncated": True, "next_offset": 20}
    assert paging.envelope(5, 5, 10, 0)["truncated"] is False
    cursor = paging.encode_cursor(index="a", target="T", direction="out", depth=3, offset=40)
    assert paging.decode_cursor(cursor, index="a", target="T", direction="out", depth=3) == 40
    for wrong in ({"index": "b"}, {"depth": 2}):
        with pytest.raises(ValueError):
            paging.decode_cursor(cursor, **wrong)
    with pytest.raises(ValueError):
        paging.decode_cursor("%%%")


def test_byte_budget():
    answer = {"a": ["x" * 900] * 4, "b": {"c": ["y" * 2000] * 3}}
    cut = paging.within_budget(answer, 4096)
    assert cut["budget_truncated"] and len(cut["b"]["c"]) < 3 and len(cut["a"]) >= 3
    assert paging.within_budget({"a": [1]}, 100) == {"a": [1]}
