"""Streams of build events and of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The form of a build event.
FIELDS = ("version", "buildTool", "successful", "finishedAt", "captureScope", "failureMessagesBase64", "diagnosticsBase64", "project")
SCHEMA = "version int, buildTool string, successful boolean, finishedAt long, captureScope string, failureMessagesBase64 array<string>, diagnosticsBase64 array<string>, project string"
VERSION, TOOLS, SCOPES = 3, ("maven", "gradle"), ("exception_chain", "task_output")
MOST_FAILURES, MOST_DIAGNOSTICS, SKEW_MS = 50, 200, 5 * 60 * 1000


def checked_events(raw: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Events of JSON texts (value) with a ``problem`` (null if valid): unknown fields, version, tool, sizes, and times more than
    five minutes ahead are refused."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    rows = raw.select("value", F.from_json("value", SCHEMA).alias("e"), F.json_object_keys("value").alias("keys"))
    few = lambda c, n: F.coalesce(F.size(c) <= n, F.lit(True))
    ok64 = lambda c: F.coalesce(F.forall(c, lambda x: F.try_to_binary(x, F.lit("base64")).isNotNull()), F.lit(True))
    problem = (
        F.when(F.col("keys").isNull() | F.col("e").isNull(), "not an object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0, "unknown field")
        .when(~F.col("e.version").eqNullSafe(F.lit(VERSION)), "version")
        .when(~F.coalesce(F.col("e.buildTool").isin(*TOOLS), F.lit(False)), "tool")
        .when(F.col("e.successful").isNull() | F.col("e.finishedAt").isNull(), "missing field")
        .when(~F.coalesce(F.col("e.captureScope").isin(*SCOPES), F.lit(True)), "scope")
        .when(~few(F.col("e.failureMessagesBase64"), MOST_FAILURES) | ~few(F.col("e.diagnosticsBase64"), MOST_DIAGNOSTICS), "too many messages")
        .when(~ok64(F.col("e.failureMessagesBase64")) | ~ok64(F.col("e.diagnosticsBase64")), "base64")
        .when(F.col("e.finishedAt") > now + SKEW_MS, "in the future")
    )
    return rows.select("value", "e.*", problem.alias("problem"))


def decided(events: DataFrame, newest_input_ms: DataFrame | None = None) -> DataFrame:
    """One row for each project: what its latest valid event means: failed, dropped (an input is newer: ``newest_input_ms`` has
    project and at) or refresh."""
    latest = events.where("problem is null").groupBy("project").agg(F.max_by(F.struct("successful", "finishedAt", "buildTool"), "finishedAt").alias("e"))
    rows = latest.select("project", "e.*")
    if newest_input_ms is None:
        rows = rows.withColumn("at", F.lit(None).cast("long"))
    else:
        rows = rows.join(newest_input_ms.select("project", "at"), "project", "left")
    decision = F.when(~F.col("successful"), "failed").when(F.col("at") > F.col("finishedAt"), "dropped").otherwise("refresh")
    return rows.select("project", "finishedAt", "buildTool", decision.alias("decision"))


def consume_events(spark: SparkSession, spool: str, checkpoint: str, act: Callable[[DataFrame, int], None], *, newest_input_ms: DataFrame | None = None) -> StreamingQuery:
    """Watch a folder of event files; each batch's decisions go to ``act(decisions, batch)``. Files that are there are
    taken in one go and the query ends; start it again for more. The checkpoint makes a file count once."""
    raw = spark.readStream.format("text").option("wholetext", "true").load(spool)

    def batch(frame: DataFrame, number: int) -> None:
        act(decided(checked_events(frame), newest_input_ms), number)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(changes: DataFrame, *, gap: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """One row for each burst of changes (project, at, revision): it ends when nothing has come for ``gap``, and has
    the last revision. With a watermark it runs on a stream, and later changes of a closed burst are ignored."""
    rows = changes.withWatermark("at", watermark) if watermark else changes
    by = rows.groupBy("project", F.session_window("at", gap).alias("burst"))
    return by.agg(F.max("revision").alias("revision"), F.count(F.lit(1)).alias("changes")).select("project", F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), "revision", "changes")
