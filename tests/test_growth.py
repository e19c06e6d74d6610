"""What must not grow faster than the input: rows that are compared, rounds, what goes through the driver, what a task gets."""

import datetime
import re

from pyspark.sql import functions as F

from codeloom.operators import beans, git, graph, injection, metrics, risk, search
from codeloom.plans.snapshot import Snapshot

POINTS, BEANS = 200, 6


def _injection(spark):
    """Points of one type that ask for one of two qualifiers, and beans of that type, in one module."""
    points = spark.range(POINTS).select("id", F.lit(0).alias("bean_id"), F.lit("T").alias("target_type"), F.when(F.col("id") % 2 == 0, "A").otherwise("@Default").alias("qualifier"), F.lit("f").alias("field_name"), F.lit("m").alias("module"))
    own = spark.range(BEANS).select("id", F.lit("T").alias("bean_type"), F.when(F.col("id") == 3, "A").otherwise("@Default").alias("qualifier"), F.lit(False).alias("is_default"), F.lit(False).alias("is_alternative"), F.lit(None).cast("long").alias("priority"), (F.col("id") == 1).alias("is_primary"), F.lit(None).cast("long").alias("specializes_id"), F.lit("m").alias("module"))
    classes = spark.createDataFrame([("m",)], "module string")
    return Snapshot.of(spark, {"injection_points": points, "beans": own, "classes": classes, "module_edges": spark.createDataFrame([], "module string, visible string, relation string")})


def _compared(spark, monkeypatch, run):
    """The result's rows, and how often a bean was compared with qualifiers."""
    times = spark.sparkContext.accumulator(0)

    def fits(wanted, has):
        times.add(1)
        return set(wanted.split(",")) - {"@Any"} <= set(has.split(","))

    monkeypatch.setattr(injection, "qualifies", lambda: F.udf(fits, "boolean")("wanted", "qualifier"))
    return run().collect(), times.value


def test_beans_are_compared_with_what_is_asked_for_not_with_each_point(spark, monkeypatch):
    for run, status in ((injection.resolved_points, ("RESOLVED", "AMBIGUOUS")), (injection.named_resolution, ("RESOLVED", "RESOLVED")), (injection.in_context, ("RESOLVED", "AMBIGUOUS"))):
        s = _injection(spark)
        rows, times = _compared(spark, monkeypatch, lambda run=run, s=s: run(s))
        assert sorted((r.point_id, r.status) for r in rows) == [(k, status[k % 2]) for k in range(POINTS)]
        assert times <= 4 * BEANS  # two asks, and a plan may evaluate twice


def test_candidates_of_an_ask_are_the_same_for_all_its_points(spark):
    got = injection.candidates(_injection(spark)).collect()
    assert len(got) == POINTS * BEANS
    assert {(r.point_id % 2, r.candidate_id) for r in got if r.disposition != "EXCLUDED"} == {(0, 3)} | {(1, k) for k in range(BEANS) if k != 3}


def test_points_without_a_type_or_qualifier_keep_a_status(spark):
    s = _injection(spark)
    odd = s.injection_points.where("id < 2").withColumn("target_type", F.when(F.col("id") == 0, F.col("target_type")))
    both = Snapshot.of(spark, {"injection_points": odd, "beans": s.beans})
    assert {r.point_id: r.status for r in injection.resolved_points(both).collect()} == {0: "RESOLVED", 1: "UNSATISFIED"}
    assert {r.point_id: r.status for r in injection.named_resolution(both).collect()} == {0: "RESOLVED", 1: "UNSATISFIED"}


def _asks(spark, name, n, asks):
    """(``name``, ask): ids below ``n`` and a null one, dealt to so many asks."""
    ids = spark.range(n).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).toDF("id")
    return ids.select(F.col("id").alias(name), F.struct(F.format_string("T%d", F.coalesce("id", F.lit(0)) % asks).alias("target_type")).alias("ask"))


def test_pairs_are_whole_however_they_are_cut(spark, monkeypatch):
    for name, size in (("BLOCK", 7), ("CHUNK", 5), ("PART_PAIRS", 100)):
        monkeypatch.setattr(injection, name, size)
    points, found = _asks(spark, "point_id", 90, 4), _asks(spark, "candidate_id", 80, 3).withColumn("reason", F.when(F.col("candidate_id") % 2 == 0, "even").otherwise("odd"))
    key = lambda x: (x or 0)
    want = [(p, c, "even" if c is not None and c % 2 == 0 else "odd") for p in [*range(90), None] for c in [*range(80), None] if key(p) % 4 == key(c) % 3]
    assert sorted(map(tuple, injection.spread(points, found).select("point_id", "candidate_id", "reason").collect()), key=repr) == sorted(want, key=repr)


def test_pairs_compress_though_an_ask_has_many_candidates(spark, tmp_path):
    points, found = _asks(spark, "point_id", 100, 1), _asks(spark, "candidate_id", 20_000, 1)
    injection.spread(points, found).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 101 * 20_001
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 101 * 20_001 / 2  # bytes: less than half of one a pair


def test_pairs_are_made_a_block_and_chunk_at_a_time(spark):
    plan = _plan(injection.spread(_asks(spark, "point_id", 9, 1), _asks(spark, "candidate_id", 9, 1)))
    assert re.search(r"Generate explode\(candidate_id.*Generate explode\(point_id.*Coalesce.*SortMergeJoin", plan, re.S)


def test_typed_resolution_selects_once_for_each_ask(spark, monkeypatch):
    sizes, plain = [], beans._selected

    def counted(rows, of, replaced):
        sizes.append(rows.count())
        return plain(rows, of, replaced)

    monkeypatch.setattr(beans, "_selected", counted)
    # the order of the qualifiers, and one that is told twice, make no other ask
    points = spark.range(POINTS).select("id", F.lit("T").alias("target_type"), F.when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("A"), F.lit("A"))).alias("qualifiers"))
    own = spark.range(BEANS).select("id", F.array(F.lit("T")).alias("types"), F.array(F.lit("A"), F.lit("B")).alias("qualifiers"), F.lit(False).alias("is_default"), (F.col("id") == 2).alias("is_alternative"), F.lit(1).cast("long").alias("priority"), F.lit(None).cast("long").alias("specializes_id"))
    assert {(r.bean_id, r.status) for r in beans.typed_resolution(points, own).collect()} == {(2, "RESOLVED")}
    assert beans.typed_candidates(points, own).count() == beans.matching_beans(points, own).count() == POINTS * BEANS
    assert sizes == [BEANS, BEANS]


def _stored_plans(monkeypatch):
    """What a loop stores from now on: the plans."""
    plans, plain = [], graph.stored

    def kept(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *a)

    monkeypatch.setattr(graph, "stored", kept)
    return plans


def test_components_take_few_rounds_on_a_long_chain_of_cycles(spark, monkeypatch):
    plans = _stored_plans(monkeypatch)
    cycles = 16
    pairs = [e for k in range(cycles) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k - 1))]
    got = graph.strong_components(spark.createDataFrame([e for e in pairs if e[1] >= 0], "src long, dst long"), driver_edges=0)
    assert sorted(map(tuple, got.collect())) == [(n, n - n % 2) for n in range(2 * cycles)]
    assert len(plans) < 40


def test_large_levels_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    plans = _stored_plans(monkeypatch)
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(4, 2)], "src long, dst long")
    starts = edges.select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    assert graph.distances(edges, starts).count() == sum(10 - k for k in range(9)) + 3
    assert sorted(map(tuple, graph.strong_components(edges, driver_edges=0).collect())) == [(2, 2), (3, 2), (4, 2)]
    assert not [p for p in plans if "Broadcast" in p]


def _hierarchy(spark, monkeypatch):
    """Two classes that use each other, below a third, and the plans of what is stored from now on."""
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    make = spark.createDataFrame
    classes = make([(1, "a.A", None), (2, "a.B", "a.A"), (3, "a.C", "a.A")], "id long, class_name string, superclass string").withColumns({"kind": F.lit("CLASS"), "lifecycle": F.lit("current"), "origin": F.lit("source")})
    uses = make([(2, 3, "CALLS", 1), (3, 2, "CALLS", 1)], "from_class_id long, to_class_id long, kind string, occurrence_count long")
    faces = make([(3, "a.B")], "class_id long, interface_name string")
    return Snapshot.of(spark, {"classes": classes, "dependencies": uses, "class_interfaces": faces}), _stored_plans(monkeypatch)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_components_are_made_without_broadcasting_classes(spark, monkeypatch):
    s, plans = _hierarchy(spark, monkeypatch)
    got = graph.strong_components(metrics.collapsed_edges(s))
    assert sorted(map(tuple, got.collect())) == [(2, 2), (3, 2)]
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_cycles_are_named_without_broadcasting_classes(spark, monkeypatch):
    s, plans = _hierarchy(spark, monkeypatch)
    got = graph.class_cycles(s)
    assert [tuple(r) for r in got.collect()] == [(2, 2, "a.B")]
    assert not [p for p in [*plans, _plan(got)] if "Broadcast" in p]


def test_cycle_paths_are_named_without_broadcasting_classes(spark, monkeypatch):
    s, plans = _hierarchy(spark, monkeypatch)
    got = graph.class_cycle_paths(s)
    assert sorted((r.place, r.class_name) for r in got.collect()) == [(0, "a.B"), (1, "a.C"), (2, "a.B")]
    assert not [p for p in [*plans, _plan(got)] if "Broadcast" in p]


def test_supertypes_are_found_without_broadcasting_classes(spark, monkeypatch):
    s, plans = _hierarchy(spark, monkeypatch)
    got = graph.ancestors(s)
    assert sorted((r.id, r.ancestor, r.depth) for r in got.collect()) == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 1), (3, 2, 1), (3, 3, 0)]
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_a_position_meets_the_first_declarations_of_other_files_only(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(search, "uses_at", lambda positions, sources: positions)
    monkeypatch.setattr(search, "_first_of_each", lambda rows, *a: sizes.append(rows.count()) or graph._first_of_each(rows, *a))
    classes = spark.range(40).select("id", F.format_string("a.C%02d", "id").alias("class_name"), F.lit("CLASS").alias("kind"), F.format_string("f%d", F.col("id")).alias("source_file"), F.lit(1).cast("long").alias("source_line"), F.lit("current").alias("lifecycle"))
    members = classes.select(F.col("id").alias("class_id"), F.lit("METHOD").alias("kind"), F.lit("run").alias("name"), F.lit("()V").alias("descriptor"), F.lit("").alias("parameter_types"))
    uses = spark.range(30, 40).select(F.format_string("f%d", F.col("id")).alias("path"), F.lit(5).cast("long").alias("line"), F.lit(1).alias("column"), F.lit("run").alias("identifier"), F.lit(None).cast("string").alias("receiver"), F.lit("call").alias("context"), F.lit(0).alias("arguments"))
    got = search.symbols_at(Snapshot.of(spark, {"classes": classes, "class_members": members}), uses, uses, limit=3).collect()
    assert sizes == [40]  # ranked once, not for each of ten positions
    assert {(r.path, r.place, r.name) for r in got} == {(f"f{k}", p, n) for k in range(30, 40) for p, n in ((1, f"a.C{k}#run()V"), (2, "a.C00#run()V"), (3, "a.C01#run()V"))}



def test_history_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(git, "TASK_ROWS", 10)
    commits = spark.range(50).select("id", F.format_string("a%d", F.col("id") % 3).alias("author"), F.lit(datetime.date(2020, 1, 1)).alias("committed_at"))
    files = spark.range(100).select((F.col("id") % 50).alias("commit_id"), (F.col("id") % 4).alias("class_id"), F.format_string("f%d", F.col("id") % 4).alias("file_path"))
    s = Snapshot.of(spark, {"commits": commits, "commit_files": files})
    assert {(r.file_path, r.commit_count, r.distinct_authors) for r in git.file_rollup(s).collect()} == {(f"f{k}", 25, 3) for k in range(4)}
    assert re.search(r"hashpartitioning\(file_path#\d+, author#\d+, 10\), REPARTITION_BY_NUM", git.file_rollup(s)._jdf.queryExecution().executedPlan().toString())
    assert {(r.file_path, r.co_changed) for r in risk.co_change_counts(s).collect()} == {(f"f{k}", 1) for k in range(4)}


def _history(spark, monkeypatch):
    """100 rows of history, two files in each of 50 commits, four classes; ten rows to a task."""
    monkeypatch.setattr(git, "TASK_ROWS", 10)
    make = spark.createDataFrame
    commits = spark.range(50).select("id", F.format_string("a%d", F.col("id") % 3).alias("author"), F.lit(datetime.date(2020, 1, 1)).alias("committed_at"))
    files = spark.range(100).select((F.col("id") % 50).alias("commit_id"), (F.col("id") % 4).alias("class_id"), F.format_string("f%d", F.col("id") % 4).alias("file_path"))
    classes = spark.range(4).select("id", F.format_string("a.C%d", "id").alias("class_name"), F.lit("current").alias("lifecycle"), F.lit("source").alias("origin"))
    return Snapshot.of(spark, {"commits": commits, "commit_files": files, "classes": classes, "dependencies": make([], "from_class_id long, to_class_id long, kind string, occurrence_count long")})


def test_files_of_hotspots_are_dealt_by_rows(spark, monkeypatch):
    s = _history(spark, monkeypatch)
    assert [(r.file_path, r.commit_count) for r in git.hotspots(s, include_historical=True).collect()] == [(f"f{k}", 25) for k in range(4)]
    assert re.search(r"hashpartitioning\(file_path#\d+, 10\), REPARTITION_BY_NUM", _plan(git.hotspots(s, include_historical=True)))


def test_history_of_few_classes_is_cut_before_it_is_dealt(spark, monkeypatch):
    s, told, plain = _history(spark, monkeypatch), [], git.parts_for
    for of in (git, risk):
        monkeypatch.setattr(of, "parts_for", lambda rows: told.append(rows) or plain(rows))
    got = risk.class_risk(s, s.classes.where("id = 0").select("id")).collect()
    assert [(r.id, r.churn, r.authors, r.co_changed) for r in got] == [(0, 25, 3, 1)]
    assert told and max(told) == 50  # of 100 rows those of the file's commits


def test_sizes_of_commits_are_dealt_by_rows(spark, monkeypatch):
    s, plans, plain = _history(spark, monkeypatch), [], risk.stored
    monkeypatch.setattr(risk, "stored", lambda df: plans.append(_plan(df)) or plain(df))
    got = risk.class_risk(s).collect()
    assert sorted((r.id, r.churn, r.authors, r.co_changed) for r in got) == [(k, 25, 3, 1) for k in range(4)]
    assert plans and not [p for p in plans if "ENSURE_REQUIREMENTS" in p]
