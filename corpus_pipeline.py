"""A corpus pipeline of five stages, each by an operator of the llm subpackage.

Every stage takes the documents that the one before it kept, written as Parquet and read again.
The stages can't be stated in SQL as a whole (learnt scores, random projections, a tokenizer), so
they are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import packing, quality_knn, secret_scan, simhash_dedup, substring_dedup
from codeloom.llm.common import held_out
from codeloom.runtime import drop_stored, stored, table

QUALITY_LEAST = 0.3
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote doesn't reject; all columns stay, whatever their names."""
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    score = _free(docs, "quality_score")
    return quality_knn.with_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_LEAST).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that with
    the smallest id, of several texts of that id the one with the smallest hash. Of rows that repeat its id and
    text, the least by the other columns stays. Documents without an id have no group and stay. A row's columns go as one, so their names
    are of no matter."""
    groups = stored(simhash_dedup.near_duplicates(docs.select("doc_id", "text")))
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("group").agg(F.min("node").alias("node"), F.min("component_id").alias("i")).select("i", "node")
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").alias("i"), node.alias("node"), F.struct(*docs.columns).alias("row"))
    found = rows.join(first, ["i", "node"], "left_semi")
    repeated = rows.where("i is not null").groupBy("i", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "node")
    if repeated.isEmpty():
        kept = found.select("row.*")
    else:
        repeated = stored(repeated)
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        order = F.struct(*[F.col("row")[c] for c in others], F.col("row")["text"])
        one = found.join(repeated, ["i", "node"], "left_semi").groupBy("i", "node").agg(F.min_by("row", order).alias("row"))
        kept = found.join(repeated, ["i", "node"], "left_anti").select("row.*").unionByName(one.select("row.*"))
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that start earlier in the corpus; white space
    stays, and a document that loses nothing stays as it is."""
    others, gone = [c for c in docs.columns if c != "text"], _free(docs, "text_is_null")
    marked = docs.withColumn(gone, F.col("text").isNull())
    found = substring_dedup.remove_repeats(marked, spacing=True, carry=(*others, gone))
    text = F.when(~F.col("row")[gone], F.col("kept").cast("string"))
    of = {c: F.col("row")[c] for c in others} | {"text": text}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(of["n_chars"])
    return found.select(*[of[c].alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``; what the last returns."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir))
        drop_stored(last)
    return STAGES[-1][1](spark, docs, sf_dir)
