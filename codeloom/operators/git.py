"""Operators over version-control history."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scoring import half_up
from codeloom.plans.snapshot import Snapshot


#: A task of a history's aggregates gets about this many rows.
TASK_ROWS = 250_000


def parts_for(rows: int) -> int:
    """Partitions for a number of rows, so that a task's share doesn't grow with them."""
    return max(1, math.ceil(rows / TASK_ROWS))


def file_rollup(s: Snapshot) -> DataFrame:
    """Per file: commits, first and last date, the last date's author (of several, the greatest), distinct authors."""
    n = parts_for(s.commit_files.count())
    commits = s.commits.select("id", "author", "committed_at").repartition(n, "id")
    rows = s.commit_files.select("commit_id", "class_id", "file_path").repartition(n, "commit_id").join(commits, F.col("commit_id") == F.col("id")).repartition(n, "file_path", "author")
    # a commit has one author, so counts by author add up, and only one distinct count is needed
    authors = rows.groupBy("file_path", "author").agg(F.countDistinct("commit_id").alias("n"), F.max("committed_at").alias("newest"), F.min("committed_at").alias("oldest"), F.min("class_id").alias("class_id"))
    by = authors.repartition(n, "file_path").groupBy("file_path").agg(F.sum("n").alias("commit_count"), F.max(F.struct("newest", "author")).alias("last"), F.min("oldest").alias("first_commit"), F.count("author").alias("distinct_authors"), F.min("class_id").alias("class_id"))
    return by.select("file_path", "class_id", "commit_count", F.col("last.newest").alias("last_modified"), F.col("last.author").alias("last_author"), "first_commit", "distinct_authors")


def hotspots(s: Snapshot, *, since: datetime.date | None = None, include_historical: bool = False, limit: int = 10) -> DataFrame:
    """Files by number of commits (since a day, inclusive), then path. Files of classes that aren't current are left out unless asked for."""
    scope = s if since is None else Snapshot.of(s.spark, {"commits": s.commits.where(F.col("committed_at") >= F.lit(since)), "commit_files": s.commit_files})
    found = file_rollup(scope)
    if not include_historical:
        found = found.join(s.classes.where("lifecycle <> 'current'").select(F.col("id").alias("class_id")), "class_id", "left_anti")
    return found.orderBy(F.desc("commit_count"), "file_path").limit(limit)


def co_changed(s: Snapshot, path: str | None = None, *, limit: int = 10) -> DataFrame:
    """Files that change in the same commits as ``path`` (default: the file with most commits): joint
    rows, and their share of the file's commits. The commit ids are found first, so one file's rows are joined."""
    own = s.commit_files.where(F.col("file_path") == path) if path else s.commit_files.join(F.broadcast(busiest_file(s)), "file_path")
    own = own.select("commit_id", F.col("file_path").alias("target"))
    total = own.groupBy("target").agg(F.countDistinct("commit_id").alias("commits"))
    joint = own.join(s.commit_files, "commit_id").where(F.col("file_path") != F.col("target"))
    counts = joint.groupBy("target", "file_path").agg(F.count(F.lit(1)).alias("co_changes"), F.min("class_id").alias("class_id"))
    share = half_up(F.col("co_changes") / F.col("commits"), 2)
    return counts.join(F.broadcast(total), "target").select("file_path", "class_id", "co_changes", share.alias("ratio")).orderBy(F.desc("co_changes"), "file_path").limit(limit)


def busiest_file(s: Snapshot) -> DataFrame:
    """The path with most rows of history (of several the first)."""
    return s.commit_files.groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(1).select("file_path")


def file_history(s: Snapshot, path: str | None = None, *, limit: int = 10) -> DataFrame:
    """A file's commits, newest first, each once."""
    files = s.commit_files.where(F.col("file_path") == path) if path else s.commit_files.join(F.broadcast(busiest_file(s)), "file_path")
    rows = files.join(s.commits, F.col("commit_id") == F.col("id"))
    return rows.select("hash", "author", "author_email", "committed_at", "message", "change_type").distinct().orderBy(F.desc("committed_at"), "hash", "change_type").limit(limit)


def author_identities(history: DataFrame) -> DataFrame:
    """Commits and e-mail addresses by author over a window of history."""
    return history.groupBy("author").agg(F.countDistinct("hash").alias("commits"), F.countDistinct("author_email").alias("addresses"))


def recent_changes(s: Snapshot, *, commits: int = 10, file_limit: int = 200, offset: int = 0) -> DataFrame:
    """Files of the newest commits, in one page over all of them."""
    newest = s.commits.orderBy(F.desc("committed_at"), F.desc("id")).limit(commits)
    rows = F.broadcast(newest).join(s.commit_files, F.col("id") == F.col("commit_id"))
    return rows.select("hash", "author", "committed_at", "file_path", "change_type").orderBy(F.desc("committed_at"), "file_path", "hash", "change_type").offset(offset).limit(file_limit)


def resolve_entities(s: Snapshot, targets: list[str]) -> DataFrame:
    """Paths by exact path or by base name: current, historical or not found."""
    wanted = s.spark.createDataFrame([(t,) for t in targets], "target string")
    known = s.classes.select(F.col("source_file").alias("path"), "lifecycle").unionByName(s.files.select("path", "lifecycle"))
    # one equality join: each path is known by itself and by its base name
    names = known.select("path", "lifecycle", F.explode(F.array_distinct(F.array("path", F.substring_index("path", "/", -1)))).alias("target"))
    found = wanted.distinct().join(names, "target").groupBy("target").agg(F.count(F.lit(1)).alias("candidates"), F.max((F.col("lifecycle") == "current").cast("int")).alias("current"))
    state = F.when(F.col("current") == 1, "current").when(F.col("current") == 0, "historical").otherwise("not_found")
    return wanted.join(found, "target", "left").select("target", F.coalesce("candidates", F.lit(0)).alias("candidates"), state.alias("resolution"))
