"""Traversals with a budget against a plain walk, and pages with totals."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paging
from codeloom.operators import graph as g


def plain(pairs, start, most, depth):
    """(node -> depth, followed, truncated, complete)"""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    seen, level, used, cut, d = {start: 0}, [start], 0, False, 0
    while level and (depth is None or d < depth):
        kept = sorted(level)[: most - used]
        cut |= len(kept) < len(level)
        used += len(kept)
        d += 1
        level = sorted({n for k in kept for n in out.get(k, ())} - seen.keys())
        seen |= {n: d for n in level}
    beyond = bool({n for k in level for n in out.get(k, ())} - seen.keys())
    return seen, used, cut, not cut and not beyond


@pytest.mark.parametrize(("most", "depth"), [(1, 3), (5, 4), (12, None), (10_000, 2), (10_000, None)])
def test_bounded_distances(spark, most, depth):
    dice = random.Random(4)
    pairs = [(dice.randrange(60), dice.randrange(60)) for _ in range(110)] * 2
    edges = spark.createDataFrame(pairs, "src long, dst long")
    starts = spark.createDataFrame([(k, k) for k in (0, 7, 31, 99)], "origin long, node long")
    walk = g.bounded_distances(edges, starts, most=most, max_depth=depth)
    found, status = {}, {r.origin: tuple(r)[1:] for r in walk.status.collect()}
    for r in walk.rows.collect():
        found.setdefault(r.origin, {})[r.node] = r.depth
    for o in (0, 7, 31, 99):
        seen, used, cut, complete = plain(pairs, o, most, depth)
        assert found[o] == seen and status[o] == (len(seen), used, cut, complete)
    one = g.bounded_distances(edges, starts.where("origin = 7").select("node"), most=most, max_depth=depth)
    assert {r.node: r.depth for r in one.rows.collect()} == found[7] and tuple(one.status.first()) == status[7]


def test_a_level_that_is_one_hot_group(spark):
    edges = spark.range(5000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(spark.range(5000).select(F.col("id").alias("src"), (F.col("id") + 10_000).alias("dst")))
    walk = g.bounded_distances(edges, spark.createDataFrame([(-1,)], "node long"), most=101, max_depth=2)
    assert tuple(walk.status.first()) == (1 + 5000 + 100, 101, True, False)
    assert {r.node for r in walk.rows.where("depth = 2").collect()} == set(range(10_000, 10_100))


def test_bounded_paths(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "y"), ("b", "d", "x"), ("c", "e", "z"), ("d", "f", "x")], "src string, dst string, label string")
    start = spark.createDataFrame([("a",)], "node string")
    walk = g.bounded_paths(edges, start, max_depth=3, most=2)
    assert sorted((r.node, r.path) for r in walk.rows.collect()) == [("a", "a>"), ("b", "a>b>"), ("c", "a>c>"), ("d", "a>b>d>")]
    assert tuple(walk.status.first()) == (4, 2, True, False)
    assert tuple(g.bounded_paths(edges, start, max_depth=9).status.first()) == (6, 6, False, True)
    assert tuple(g.bounded_paths(edges, start, max_depth=2).status.first()) == (5, 3, False, False)


def test_answers_are_counted_with_their_page(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 5).alias("k"))
    one = paging.answer(df, order=[F.desc("k"), "id"], limit=10, offset=20, traversal="t", status={"truncated": True})
    two = paging.answer(df.orderBy(F.desc("k"), "id"), limit=10, offset=20, traversal="t")
    assert one["results"] == two["results"] and one["total"] == two["total"] == 57 and one["answer_complete"] is False
    on = paging.answer(df, order=[F.desc("k"), "id"], limit=50, cursor=one["next_cursor"], traversal="t")
    assert on["showing"] == 27 and not on["has_more"] and on["next_cursor"] is None
    rows = paging.page_with_total(df, [F.desc("k"), "id"], 10, 50).collect()
    assert len(rows) == 7 and {(r.total, r.has_more) for r in rows} == {(57, False)}
    assert paging.page_with_total(df.where("id < 0"), ["id"], 10).collect() == []
