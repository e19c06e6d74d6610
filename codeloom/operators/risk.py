"""Change-risk scores, for all classes or files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scoring import bus_factor, half_up, risk_level, scaled
from codeloom.functions.text import base_name
from codeloom.operators.git import file_rollup, parts_for
from codeloom.operators.graph import Traversal, bounded_distances, distances
from codeloom.operators.metrics import fan_metrics
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import stored

#: A class's co-changed files are counted up to this many.
CO_CHANGES_COUNTED = 100


def co_change_counts(s: Snapshot, files: DataFrame | None = None) -> DataFrame:
    """Per file (or only ``files``, file_path), the number of other files that change with it (at most 100 count). A commit of more than
    100 other files settles that by its size alone; only pairs within smaller ones are enumerated."""
    rows = s.commit_files.select("commit_id", "file_path")
    if files is not None:
        rows = stored(rows.join(stored(rows.join(files, "file_path", "left_semi").select("commit_id").distinct()), "commit_id", "left_semi"))
    dealt = parts_for(rows.count())
    rows = stored(rows.repartition(dealt, "commit_id").distinct())
    by_commit = rows.repartition(dealt, "commit_id")
    sized = stored(by_commit.join(by_commit.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")), "commit_id"))
    large = sized.where(F.col("n") > CO_CHANGES_COUNTED).select("file_path", F.lit(CO_CHANGES_COUNTED).cast("long").alias("co_changed"))
    small = sized.where(F.col("n") <= CO_CHANGES_COUNTED)
    ones = small if files is None else small.join(files, "file_path", "left_semi")
    n, small, ones = ones.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], small.select("commit_id", "file_path"), ones.select("commit_id", "file_path")
    of = parts_for(max(n, rows.count()))
    pairs = ones.repartition(of, "commit_id").join(small.withColumnRenamed("file_path", "other").repartition(of, "commit_id"), "commit_id").where("file_path <> other").select("file_path", "other").repartition(parts_for(n), "file_path", "other").distinct()
    counted = pairs.groupBy("file_path").agg(F.least(F.count(F.lit(1)), F.lit(CO_CHANGES_COUNTED)).alias("co_changed"))
    return counted.unionByName(large).groupBy("file_path").agg(F.max("co_changed").alias("co_changed"))


def class_risk(s: Snapshot, targets: DataFrame | None = None) -> DataFrame:
    """Score (0 to 10), level and what they are made of, of each current class, or only of the targets (id)."""
    files, of = None, s
    if targets is not None:
        # what is stored has a size that Spark knows, so the history of few targets is cut before it is dealt
        targets = stored(targets.select("id").distinct())
        own = targets.select(F.col("id").alias("class_id"))
        files = stored(s.commit_files.join(own, "class_id", "left_semi").select("file_path").distinct())
        rows = stored(s.commit_files.join(files, "file_path", "left_semi"))
        of = Snapshot.of(s.spark, {"commits": s.commits.join(rows.select(F.col("commit_id").alias("id")).distinct(), "id", "left_semi"), "commit_files": rows})
    rollup = file_rollup(of).where("class_id is not null")
    if targets is not None:
        rollup = rollup.join(own, "class_id", "left_semi")
    history = rollup.join(co_change_counts(s, files), "file_path", "left")
    git = history.select(F.col("class_id").alias("id"), F.col("commit_count").alias("churn"), F.col("distinct_authors").alias("authors"), F.coalesce("co_changed", F.lit(0)).alias("co_changed"))
    fans = fan_metrics(s, targets)
    whole = fans.join(git, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("churn", "authors", "co_changed")})
    score = half_up(
        0.30 * scaled(F.col("fan_in"), 0, 3, 8, 15) + 0.10 * scaled(F.col("fan_out"), 0, 3, 5, 8) + 0.25 * scaled(F.col("churn"), 2, 10, 30, 50) + 0.20 * bus_factor(F.col("authors")) + 0.15 * scaled(F.col("co_changed"), 0, 3, 5, 8), 1
    )
    return whole.select("id", "class_name", "fan_in", "fan_out", "churn", "authors", "co_changed", score.alias("score"), risk_level(score).alias("level"))


# Files that configure a build.
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "maven-wrapper.properties", "gradle-wrapper.properties")


def file_criticality(path: Column) -> Column:
    """How much depends on a file by its place and name: the first rule that fits."""
    whole = F.translate(path, "\\", "/")
    name = base_name(whole)
    below = lambda folder: whole.startswith(f"{folder}/") | whole.contains(f"/{folder}/")
    build = name.isin(*BUILD_FILES) | below("buildSrc") | whole.startswith("gradle/libs.versions.") | whole.contains("/gradle/libs.versions.")
    return (
        F.when(below("META-INF/services"), 10).when(build, 9).when(below(".github/workflows"), 8).when(below("src/main/resources"), 7)
        .when(below("src/main"), 5).when(below("src/test"), 3).when(name.endswith(".md") | name.endswith(".adoc"), 1).otherwise(4)
    )


def file_kind(path: Column) -> Column:
    """What a file is, by its place and name: the first rule that fits."""
    whole = F.translate(path, "\\", "/")
    name = base_name(whole)
    below = lambda folder: whole.startswith(f"{folder}/") | whole.contains(f"/{folder}/")
    build = name.isin(*BUILD_FILES) | below("buildSrc") | whole.startswith("gradle/libs.versions.") | whole.contains("/gradle/libs.versions.")
    return (
        F.when(below("META-INF/services"), "service_descriptor").when(build, "build_configuration").when(below(".github/workflows"), "ci_configuration")
        .when(whole.contains("/resources/") | whole.startswith("src/main/resources/"), "resource").when(name.endswith(".java") | name.endswith(".kt"), "source").when(below("src/test"), "test")
        .when(name.endswith(".md") | name.endswith(".adoc"), "documentation").otherwise("file")
    )


def is_test_path(path: Column) -> Column:
    """Below src/test, or named as tests are."""
    whole = F.translate(path, "\\", "/")
    return F.coalesce(whole.startswith("src/test/") | whole.contains("/src/test/") | base_name(whole).rlike(r"(Test|Tests|IT|ITCase|Spec)\.(java|kt)$"), F.lit(False))


def file_risk(s: Snapshot) -> DataFrame:
    """Score of each file of the history or the index: criticality, churn, authors and coupling, or the criticality alone without history."""
    paths = s.commit_files.select("file_path").unionByName(s.files.where("lifecycle <> 'deleted'").select(F.col("path").alias("file_path"))).distinct()
    whole = paths.join(file_rollup(s), "file_path", "left").join(co_change_counts(s), "file_path", "left")
    critical = file_criticality(F.col("file_path"))
    known = half_up(0.50 * critical + 0.20 * scaled(F.col("commit_count"), 2, 10, 30, 50) + 0.15 * bus_factor(F.col("distinct_authors")) + 0.15 * scaled(F.coalesce("co_changed", F.lit(0)), 0, 3, 5, 8), 1)
    score = F.when(F.col("commit_count").isNull(), critical.cast("double")).otherwise(known)
    return whole.select("file_path", critical.alias("criticality"), score.alias("score"), risk_level(score).alias("level"))


def _test_classes(s: Snapshot) -> DataFrame:
    return s.current().where((F.col("source_set") == "test") | is_test_path(F.col("source_file")))


def impacted_tests(s: Snapshot, targets: DataFrame, *, max_depth: int = 3, transitive: bool = True, most: int | None = None) -> DataFrame:
    """The rows of :func:`impacted_tests_traversal`."""
    return impacted_tests_traversal(s, targets, max_depth=max_depth, transitive=transitive, most=most).rows


def impacted_tests_traversal(s: Snapshot, targets: DataFrame, *, max_depth: int = 3, transitive: bool = True, most: int | None = 5000) -> Traversal:
    """Tests that a change of the targets (id) may touch: test classes that reach one, and test classes and test files
    without a current class (id null) that change with one. Score: 100 less 15 for each step after the first, 20 at least, and 5 for each joint
    change, 30 at most; 100 in all. Confidence: high at depth 1, medium if reached or changed together twice. For each target ``most`` classes are
    followed at most; the status has a row for each target (origin)."""
    edges = s.dependencies.select(F.col("to_class_id").alias("src"), F.col("from_class_id").alias("dst"))
    tests = _test_classes(s).select("id", "class_name")
    depth = max_depth if transitive else 1
    if most is None:
        walk = Traversal(distances(edges, targets.select(F.col("id").alias("node")), max_depth=depth), None)
        reach = walk.rows
    else:
        # a target that is a test of another target counts as such
        walk = bounded_distances(edges, targets.select(F.col("id").alias("origin"), F.col("id").alias("node")), most=most, max_depth=depth)
        reach = walk.rows.where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"))
    reach = reach.where("depth > 0")
    static = reach.select(F.col("node").alias("id"), "depth", F.greatest(F.lit(20), 100 - (F.col("depth") - 1) * 15).alias("static")).join(tests, "id", "left_semi")
    joint = _joint_tests(s, targets, tests).groupBy("id", "file").agg(F.count(F.lit(1)).alias("co_changes"))
    found = _merged(static, joint)
    together = F.coalesce("co_changes", F.lit(0))
    score = F.least(F.lit(100), F.coalesce("static", F.lit(0)) + F.least(F.lit(30), 5 * together))
    confidence = F.when(F.coalesce("depth", F.lit(99)) <= 1, "high").when(F.col("static").isNotNull() | (together >= 2), "medium").otherwise("low")
    rows = found.join(tests, "id", "left").select("id", F.coalesce("class_name", "file").alias("class_name"), "depth", together.alias("co_changes"), score.cast("long").alias("score"), confidence.alias("confidence"))
    return Traversal(rows, walk.status)


def _joint_tests(s: Snapshot, targets: DataFrame, tests: DataFrame) -> DataFrame:
    """(target, id, file): test classes (``tests``: id, class_name), or test files without one, each time that they change with a target (id)."""
    own = s.commit_files.join(targets.select(F.col("id").alias("class_id")), "class_id", "left_semi").select("commit_id", F.col("class_id").alias("target"))
    joint = own.join(s.commit_files, "commit_id").where("class_id IS NULL OR class_id <> target").join(tests.withColumnsRenamed({"id": "class_id"}), "class_id", "left")
    joint = joint.where(F.col("class_name").isNotNull() | is_test_path(F.col("file_path")))
    # a class that is no longer current leaves its file
    return joint.select("target", F.when(F.col("class_name").isNotNull(), F.col("class_id")).alias("id"), F.when(F.col("class_name").isNull(), F.col("file_path")).alias("file"))


def impacted_test_counts(s: Snapshot, targets: DataFrame, *, max_depth: int = 3) -> DataFrame:
    """(id, tests): how many tests :func:`impacted_tests` finds for each target (id) by itself."""
    edges = s.dependencies.select(F.col("to_class_id").alias("src"), F.col("from_class_id").alias("dst"))
    tests = _test_classes(s).select("id", "class_name")
    reach = distances(edges, targets.select(F.col("id").alias("origin"), F.col("id").alias("node")), max_depth=max_depth).where("depth > 0")
    static = reach.select(F.col("origin").alias("target"), F.col("node").alias("id"), F.lit(None).cast("string").alias("file")).join(tests.select("id"), "id", "left_semi")
    return static.unionByName(_joint_tests(s, targets, tests)).distinct().groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("tests"))


def _merged(static: DataFrame, joint: DataFrame) -> DataFrame:
    of_class = static.join(joint.where("id is not null").drop("file"), "id", "full").withColumn("file", F.lit(None).cast("string"))
    of_file = joint.where("id is null").select("id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("static"), "co_changes", "file")
    return of_class.unionByName(of_file)


def design_impact(s: Snapshot, candidates: DataFrame, *, depth: int = 3, most: int = 10) -> DataFrame:
    """Candidates (id), ``most`` at most, by what changing them would cost: .6 risk, .25 users, .15 tests; cheapest first."""
    candidates = stored(candidates.select("id").distinct().orderBy("id").limit(most))
    edges = s.dependencies.select(F.col("to_class_id").alias("src"), F.col("from_class_id").alias("dst"))
    reach = distances(edges, candidates.select(F.col("id").alias("origin"), F.col("id").alias("node")), max_depth=depth).where("depth > 0")
    tests = _test_classes(s).select(F.col("id").alias("node"))
    counted = reach.join(tests, "node", "left_semi").groupBy(F.col("origin").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    whole = class_risk(s, candidates).join(candidates.select("id"), "id").join(counted, "id", "left")
    tests_n = F.coalesce("tests", F.lit(0))
    cost = half_up(0.6 * F.col("score") + 0.25 * F.least(F.lit(10.0), F.col("fan_in") / 2.0) + 0.15 * F.least(F.lit(10.0), tests_n / 5.0), 1)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("impact", "class_name"))
    return whole.select("id", "class_name", F.col("score").alias("risk"), "fan_in", tests_n.alias("tests"), cost.alias("impact")).withColumn("place", place)
