import random

import pytest

import corpus_pipeline as cp
from codeloom.llm import quality_knn, secret_scan, simhash_dedup

SECRET = 'password = "hunter2hunter2"'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    r = random.Random(1)
    prose = lambda n: " ".join(f"{r.choice(['house', 'river', 'winter', 'Walk'])}{r.choice('abcdefgh')}{r.choice('klmnop')}{r.choice('rstuvw')}" for _ in range(n)) + "."
    rows = [(i, prose(r.randrange(40, 140)), "en", "s", 0) for i in range(120)]
    passage = prose(60)
    rows += [(200 + k, f"{prose(60)} {passage} {prose(30)}", "en", "s", 0) for k in range(3)]
    rows += [(300, rows[3][1], "en", "s", 0), (301, rows[4][1].replace(".", " end."), "en", "s", 0), (302, f"{prose(30)} {SECRET} {prose(30)}", "en", "s", 0)]
    rows += [(400 + k, prose(80).replace(" ", " | "), "en", "s", 0) for k in range(30)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 400)) for i, *_ in rows], "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    return str(path), {i: t for i, t, *_ in rows}, passage, schema


def test_stage_by_stage(spark, folder):
    path, texts, passage, schema = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, path))
        seen.append((name, docs))
        if name != "packed":
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema]
    of = {name: {x.doc_id: x.asDict() for x in d.collect()} for name, d in seen[:-1]}
    assert set(of["quality"]) == {i for i in texts if not 400 <= i < 500}
    shingles = {i: set(simhash_dedup.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in texts.items() if i in of["quality"]}
    drop = {b for b in shingles for a in shingles if a < b and (len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))}
    assert set(of["near_duplicates"]) == set(of["quality"]) - drop and {300, 301, 501} <= drop
    clean = of["repeated_passages"]
    assert set(clean) == set(of["near_duplicates"])
    assert [passage in clean[200 + k]["text"] for k in range(3)] == [True, False, False]
    assert all(clean[i]["text"] == texts[i] for i in clean if i < 200 or i >= 300)
    hidden = of["secrets"]
    assert hidden[302]["text"] == secret_scan.masked(texts[302], secret_scan.scan_text(texts[302])) and "hunter2" not in hidden[302]["text"]
    assert all(hidden[i]["text"] == clean[i]["text"] for i in hidden if i != 302)
    assert {r.doc_id for r in seen[-1][1].collect()} == set(hidden)


def test_run(spark, folder):
    path, texts, *_ = folder
    got = cp.run(spark, path).collect()
    assert got and not {r.doc_id for r in got} & set(range(400, 430))
    assert all(len(r.ids) == r.length for r in got)


def test_ids_that_repeat(spark):
    """An id with several texts keeps each that is no copy; rows that repeat an id and a text are one; rows without an id stay."""
    r = random.Random(4)
    one, two, three = (" ".join(f"w{r.randrange(10_000)}" for _ in range(60)) for _ in range(3))
    rows = [(7, one, "en", "a", 1), (7, two, "en", "b", 1), (8, one + " end", "en", "c", 1), (9, two + " end", "en", "d", 1), (3, three, "en", "z", 1), (3, three, "de", "y", 1), (3, three, None, "x", None), (None, one, "en", "e", 1), (None, one, "en", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id, x.text, x.lang, x.source) for x in cp.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(7, one, "en", "a"), (7, two, "en", "b"), (3, three, None, "x"), (None, one, "en", "e"), (None, one, "en", "e")], key=repr)
    assert cp.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_clashing_columns_and_empty_tables(spark, folder):
    """Extra columns of any name come back as they were; tables without rows and without a column of lengths are no error."""
    path, texts, _, schema = folder
    extra = ["node", "kept", "component_id", "i", "row", "group", "quality_score", "text_is_null", "n", "start", "k", "c", "t", "runs", "spans"]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 40 OR doc_id >= 190")
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in extra])
    for name, stage in cp.STAGES[:-1]:
        plain, full = stage(spark, docs, path), stage(spark, wide, path)
        assert full.columns == wide.columns
        rows = full.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect()), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra), name
    for name, stage in cp.STAGES:
        assert stage(spark, wide.where("doc_id < 0"), path).collect() == [], name
        stage(spark, docs.drop("n_chars"), path).schema  # noqa: B018
