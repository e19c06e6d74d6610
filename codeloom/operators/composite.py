"""Answers that are made of several operators, and decisions over them."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import git, injection, metrics
from codeloom.operators.risk import class_risk, impacted_test_counts, impacted_tests
from codeloom.operators.usage import class_cards, class_usages
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import stored


def change_context(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Per target (id): card, risk, number of users and of uses, and of tests that it may touch."""
    targets = stored(targets.select("id"))
    uses = class_usages(s, targets).groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("user_id").alias("users"), F.sum("occurrences").alias("uses"))
    cards = class_cards(s, targets)
    found = cards.join(class_risk(s, targets).select("id", "score", "level"), "id").join(uses, "id", "left").join(impacted_test_counts(s, targets), "id", "left")
    return found.select(*cards.columns, "score", "level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("users", "uses", "tests")])


def change_plan(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Steps of a change: the targets, each user once for each kind of use, and the tests to run."""
    targets = stored(targets.select("id"))
    primary = class_risk(s, targets).select(F.lit("1-change").alias("step"), "class_name", F.col("level").alias("detail"))
    review = class_usages(s, targets).join(targets.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(F.lit("2-review").alias("step"), "class_name", F.col("usage").alias("detail")).distinct()
    tests = impacted_tests(s, targets).select(F.lit("3-test").alias("step"), "class_name", F.col("confidence").alias("detail"))
    return primary.unionByName(review).unionByName(tests)


def project_overview(s: Snapshot, *, since: datetime.date | None = None, problems: int = 50) -> DataFrame:
    """(section, place, name, value): a project in one answer: counts, the first five hubs of each ranking, injection points by status and the first of those that
    aren't resolved, external libraries, and the files that change most (since a day). ``place`` orders a section; counts have no order."""
    none = F.lit(0)
    points = stored(injection.resolved_points(s))
    open_ = points.where("status <> 'RESOLVED'").join(s.injection_points.select(F.col("id").alias("point_id"), "target_type", "field_name"), "point_id").orderBy("point_id").limit(problems)
    ranked = lambda df, *order: df.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  # of what a limit has cut
    parts = [
        metrics.overview_counts(s).select(F.lit("count").alias("section"), none.alias("place"), F.col("measure").alias("name"), F.col("value").cast("long").alias("value")),
        metrics.hub_rankings(s).select(F.concat(F.lit("hub:"), "ranking"), "place", "class_name", F.col("users").cast("long")),
        metrics.injection_problem_counts(points).select(F.lit("injection"), none, "status", F.col("points").cast("long")),
        open_.select(F.lit("problem"), none, F.concat_ws(" ", "status", "target_type", "field_name"), F.col("point_id").cast("long")),
        ranked(metrics.external_libraries(s), F.desc("classes"), "library").select(F.lit("library"), "place", "library", F.col("classes").cast("long")),
        ranked(git.hotspots(s, since=since), F.desc("commit_count"), "file_path").select(F.lit("hotspot"), "place", "file_path", F.col("commit_count").cast("long")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


# States of a change, gravest first.
VERDICTS = ("blocked", "needs_build", "partial", "ready")


def verification_verdict(*, build_failed: bool, problems: int, structure_stale: bool, unverified: int) -> str:
    """What to say about a change: failures block it, a stale structure needs a build, open evidence is partial."""
    if build_failed or problems:
        return "blocked"
    if structure_stale:
        return "needs_build"
    return "partial" if unverified else "ready"


def session_phase(*, verdict: str | None, planned: bool, open_reviews: int) -> str:
    """Where a change stands."""
    if verdict == "ready" and not open_reviews:
        return "complete"
    if verdict == "blocked":
        return "blocked"
    if not planned:
        return "planned" if verdict is None else "verification_required"
    return "review_required" if open_reviews else "verification_required"


def session_id(root: str, targets: list[str], change: str) -> str:
    """An id of a change session: the first 12 bytes of a hash of what it is about."""
    return hashlib.sha256("\n".join([root, *targets, change]).encode()).hexdigest()[:24]


def build_status(*, head_changed: bool, inputs_newer: bool, pending_event: bool) -> str:
    """Whether an index is up to date."""
    if pending_event:
        return "pending"
    return "stale" if head_changed or inputs_newer else "current"


def tool_matches(name: str, description: str, query: str) -> int:
    """Score of a tool for a query: for each term of three letters or more, 3 if the name has it, else 1 if the description has."""
    score = 0
    for term in query.lower().split():
        if len(term) >= 3:
            score += 3 if term in name.lower() else 1 if term in description.lower() else 0
    return score


def call_report(s: Snapshot) -> DataFrame:
    """Per tool: calls, errors, median and 95th percentile (by nearest rank) and greatest elapsed time."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY elapsed_ms)")
    return s.calls_log.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors"), rank(0.5).alias("median"), rank(0.95).alias("p95"), F.max("elapsed_ms").alias("max"))
