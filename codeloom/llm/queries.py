"""The registered queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, collocations, embedding_dedup, fill_middle, fingerprint, language_id, packing, quality_knn, secret_scan, sharding, simhash_dedup, substring_dedup, token_counts
from codeloom.llm.common import held_out, stored
from codeloom.runtime import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_knn.fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = quality_knn.score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near is for the query rows, whose id is divisible by 100: how many other documents have a fingerprint within 7 bits."""
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    found = stored(found.withColumn("edited", F.sha2("edited", 256)))
    asked = F.col("doc_id") % 100 == 0
    near = fingerprint.near_counts(found, asked, radius=7, blocks=8, bits=256)
    counted = found.join(near, "fingerprint", "left")
    digits = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return counted.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), *[v.alias(k) for k, v in digits.items()], "near_edited", "near_next", F.when(asked, F.col("n_near") - 1).alias("n_near"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("spans", lambda s: s["kind"] != "lexed"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out("doc_id", 4, 2)))
    return language_id.predict_language(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), restored=True, digests=True)
    return found.withColumnsRenamed({"output": "output_sha256", "restored": "restored_sha256"})


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_REPEATS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE nth > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
r AS (SELECT u.doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY u.j) FILTER (WHERE g.j IS NULL) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.j = u.j GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

_LINKED = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT x, b FROM r JOIN l ON a = y),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT x, min(y) AS least FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept FROM v JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id"""


_FILLED = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t, x, CASE WHEN t = '' THEN [] ELSE list_filter(string_split(regexp_replace(t, '([^\x20\x09-\x0D])([\x20\x09-\x0D])', '\1' || chr(1) || chr(2) || '\2', 'g'), chr(1) || chr(2)), lambda y: y <> '') END AS w FROM d),
h AS (SELECT *, len(w) AS n, list_transform([1, 9, 17, 25], lambda k: CAST(('0x' || substr(x, k, 8)) AS BIGINT)) AS h FROM u),
f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
g AS (SELECT *, list_sum(list_transform(w[1:a], lambda y: length(y))) AS pa, list_sum(list_transform(w[1:b], lambda y: length(y))) AS pb FROM f),
p AS (SELECT *, substr(t, 1, coalesce(pa, 0)::BIGINT) AS pre, substr(t, coalesce(pa, 0)::BIGINT + 1, (coalesce(pb, 0) - coalesce(pa, 0))::BIGINT) AS mid, substr(t, coalesce(pb, 0)::BIGINT + 1) AS suf FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + m - 1] AS w, m, count(*) AS f FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT lang, w, m, f, unnest(range(1, m)) AS k FROM g WHERE m > 1),
s AS (SELECT k.lang, k.w, k.m, k.f AS a, k.k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * k.f) // (l.f + r.f) AS score FROM k JOIN g l ON l.lang = k.lang AND l.w = k.w[1:k.k] JOIN g r ON r.lang = k.lang AND r.w = k.w[k.k + 1:]),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
x AS (SELECT lang, w[i:j] AS w, max(f) AS most FROM (SELECT lang, w, f, m, i, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM g WHERE m > 2)) WHERE j - i + 1 < m GROUP BY ALL),
o AS (SELECT c.lang, array_to_string(c.w, ' ') AS phrase, a, l, r, score FROM c LEFT JOIN x ON x.lang = c.lang AND x.w = c.w WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT t.lang, rank, phrase, a, l, r, n.n AS n, CAST(score AS BIGINT) AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can state: the others hash, learn, tokenize or place rows in ways that SQL
    doesn't have; tests compare those with brute force, exact round trips or held-out labels."""
    return {"op6_substring_dedup": _REPEATS, "op7_embedding_dedup": _LINKED, "op11_fill_middle": _FILLED, "op12_collocations": _PHRASES}
