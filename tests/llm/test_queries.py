import hashlib
import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import assert_same, connect  # noqa: E402

from codeloom.llm import queries as q  # noqa: E402

FOLDER = os.environ.get("CODELOOM_SF", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_simhash_dedup": "doc_id fingerprint component_id",
    "op2_quality_knn": "doc_id held_out score predicted",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_embedding_dedup": "vec_id n_links component_id kept",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_histogram_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_row_comes_back(spark, con, name):
    df = q.queries()[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    key = "vec_id" if name.startswith("op7") else "doc_id"
    table = "embeddings" if name.startswith("op7") else "documents"
    assert {r[0] for r in df.select(key).collect()} == {r[0] for r in con.sql(f"SELECT {key} FROM {table}").fetchall()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert_same(q.queries()[name](spark, FOLDER), con, q.oracle_sql()[name])


def test_held_out_rows(spark):
    quality = {r.doc_id: r for r in q.op2_quality_knn(spark, FOLDER).collect()}
    language = {r.doc_id: r for r in q.op8_language_id(spark, FOLDER).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in quality.items())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in language.items())


def test_held_out_accuracy(spark, con):
    truth = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    langs = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    quality = [(r.predicted, truth[r.doc_id]) for r in q.op2_quality_knn(spark, FOLDER).collect() if r.held_out and r.doc_id in truth]
    language = [(r.lang_pred, langs[r.doc_id]) for r in q.op8_language_id(spark, FOLDER).collect() if r.held_out]
    assert sum(a == b for a, b in quality) >= 0.8 * len(quality)
    assert sum(a == b for a, b in language) >= 0.95 * len(language)


def test_digests_of_spans(spark):
    r = q.op5_secret_scan(spark, FOLDER).where("n_assign > 0").first()
    assert r is None or r.base_sha256 == hashlib.sha256(",".join(x for x in r.spans.split(",") if not x.startswith("lexed")).encode()).hexdigest()


# what SQL can state of queries that it can't state as a whole
STATED = {
    "op4_fingerprints": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS x FROM d)
        SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t[1:length(t) - length(t) // 2] || x[1:length(t) // 2]) AS edited_sha256 FROM n""",
    "op5_secret_scan": r"""SELECT doc_id,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM documents""",
    "op9_histogram_sharding": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "op10_byte_bpe": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "op3_best_fit_packing": "SELECT doc_id FROM documents",
    "op1_simhash_dedup": "SELECT doc_id FROM documents",
    "op2_quality_knn": "SELECT doc_id FROM documents",
    "op8_language_id": "SELECT doc_id FROM documents",
}


@pytest.mark.parametrize("name", sorted(STATED))
def test_stated_columns_equal_sql(spark, con, name):
    want = con.sql(STATED[name])
    got = q.queries()[name](spark, FOLDER).select(*want.columns)
    assert_same(got.distinct() if name.startswith("op3") else got, con, STATED[name])


def test_search_within_the_radius_is_whole(spark):
    """Every query row's count, against all pairs of fingerprints."""
    rows = [(r.doc_id, int(r.fingerprint, 16), r.n_near) for r in q.op4_fingerprints(spark, FOLDER).collect()]
    for i, f, n in rows:
        assert n == (sum((f ^ g).bit_count() <= 7 for _, g, _ in rows) - 1 if i % 100 == 0 else None)


def test_shards_hold_near_equal_bytes(spark):
    rows = q.op9_histogram_sharding(spark, FOLDER).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    mean, largest = sum(r["size"] for r in rows) / 24, max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - mean) <= 0.002 * mean + largest for own in shards.values())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
