import random
import zlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import sharding


def check(docs_of, rows, shards=24):
    got = sharding.shard_by_bytes(docs_of(rows, "doc_id long, text string, shard int"), shards=shards).collect()
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)
    sizes = [0] * shards
    for r in got:
        sizes[r.shard] += r["size"]
    return sizes, got


def test_even_bytes_and_whole_groups(docs_of):
    r = random.Random(1)
    texts = ["é" * r.randrange(400) for _ in range(900)]
    rows = [(i, r.choice(texts) + str(r.randrange(400)) if i % 4 else "copy", 0) for i in range(8000)]
    sizes, got = check(docs_of, rows, 6)
    mean = sum(sizes) / 6
    assert max(abs(s - mean) for s in sizes) < 0.01 * mean
    split = {}
    for x in got:
        split.setdefault(x.text_crc32, set()).add(x.shard)
    assert {k for k, s in split.items() if len(s) > 1} <= {zlib.crc32(b"copy")}


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_groups_stay_whole_unless_they_are_large(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    got = sharding.shard_by_bytes(docs).groupBy("text_crc32", "size").agg(F.sum("size").alias("bytes"), F.countDistinct("shard").alias("n")).collect()
    mean = sum(r["bytes"] for r in got) / 24
    assert [r for r in got if r.n > 1 and r["bytes"] <= 0.1 * mean] == []
    sizes = [r["bytes"] for r in sharding.shard_by_bytes(docs).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    longest = max(r["size"] for r in got)
    assert max(abs(x - mean) for x in sizes) <= 0.102 * mean + longest


def test_a_hot_group_is_split(docs_of):
    rows = [(i, "hot text " * 20 if i % 3 else f"text {i}", 0) for i in range(6000)]
    sizes, _ = check(docs_of, rows, 24)
    mean = sum(sizes) / 24
    assert max(abs(s - mean) for s in sizes) < 0.03 * mean


def test_edges(docs_of):
    assert check(docs_of, [])[1] == []
    check(docs_of, [(1, "a", 0)])
    check(docs_of, [(7, "same", 0)] * 50 + [(None, None, 0)] * 3 + [(8, "", 0)], 5)
    check(docs_of, [(i, None, 0) for i in range(100)], 7)


@pytest.mark.parametrize(("shards", "seed"), [(3, 1), (7, 2), (24, 3)])
def test_boundaries_equal_a_plain_sort(docs_of, spark, shards, seed):
    """Against all prefix sums of the sorted keys: within the tolerance, or no prefix is nearer."""
    r = random.Random(seed)
    big = lambda: r.getrandbits(64) - (1 << 63)
    rows = [(big(), big(), big(), r.randrange(1, 500)) for _ in range(300)]
    hot = big(), big()
    rows += [(*hot, big(), 40) for _ in range(500)] + [(hot[0], big(), big(), 40) for _ in range(200)] + [(-(1 << 63), 5, 5, 9), ((1 << 63) - 1, 1, 1, 9)]
    bounds = sharding.splitters(spark.createDataFrame(rows, "k1 long, k2 long, k3 long, size long"), shards)
    rows.sort()
    prefixes, total = [0], 0
    for *_, size in rows:
        total += size
        prefixes.append(total)
    assert len(bounds) == shards - 1 and bounds == sorted(bounds)
    for j, bound in enumerate(bounds, 1):
        below, target = sum(x[3] for x in rows if x[:3] < bound), total * j / shards
        assert abs(below - target) <= max(0.001 * total / shards, min(abs(p - target) for p in prefixes)) + 1e-6


def test_a_third_of_the_rows_all_alike(docs_of):
    rows = [(None, "hot", 0)] * 2000 + [(5, "hot", 0)] * 2000 + [(i, f"text {i}", 0) for i in range(2000)]
    sizes, got = check(docs_of, rows, 24)
    mean = sum(sizes) / 24
    assert max(abs(s - mean) for s in sizes) <= 0.05 * mean
    fine = sharding.shard_by_bytes(docs_of(rows, "doc_id long, text string, shard int").repartition(3), shards=4, slot_rows=50)
    shards = {}
    for x in fine.collect():
        shards.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert fine.groupBy("shard").agg(F.max("slot")).count() == 4


def test_clashing_columns(docs_of):
    rows = [(i, f"t{i}", 1, 2, 3, "x") for i in range(100)]
    got = sharding.shard_by_bytes(docs_of(rows, "doc_id long, text string, k1 int, size int, slot int, salt string"), shards=3).collect()
    assert {x.doc_id for x in got} == set(range(100)) and all(x["size"] == len(f"t{x.doc_id}") + 8 for x in got)
