"""Operators on a small hand-made index."""

import datetime

import pytest

from codeloom.functions import paging
from codeloom.operators import compare, composite, execution, git, graph, risk, search, unused, usage, workspace
from codeloom.plans.snapshot import Snapshot

D = datetime.datetime


@pytest.fixture(scope="module")
def index(spark):
    classes = [
        (1, "org.acme.OrderService", "CLASS", None, None, "src/main/java/OrderService.java", 3, True, 500, "source", "current", "app", "main", "r1"),
        (2, "org.acme.PaymentService", "INTERFACE", None, None, "src/main/java/PaymentService.java", 1, False, 100, "source", "current", "app", "main", "r1"),
        (3, "org.acme.StripePaymentService", "CLASS", None, "org.acme.PaymentService", "src/main/java/Stripe.java", 1, True, 300, "source", "current", "app", None, "r1"),
        (4, "org.acme.AuditService", "CLASS", None, None, "src/main/java/AuditService.java", 1, True, 200, "source", "current", "lib", "main", "r2"),
        (5, "org.acme.Container", "CLASS", None, None, "src/main/java/Container.java", 1, False, 10, "source", "current", "lib", "main", "r2"),
        (6, "org.acme.Container$Worker", "CLASS", None, None, "src/main/java/Container.java", 9, False, 10, "source", "current", "lib", "main", "r2"),
        (7, "org.acme.OrderTest", "CLASS", None, None, "src/test/java/OrderTest.java", 1, False, 10, "source", "current", "app", "test", "r1"),
        (8, "org.acme.Gone", "CLASS", None, None, "src/main/java/Gone.java", 1, False, 10, "source", "historical", "app", "main", "r1"),
    ]
    schema = "id long, class_name string, kind string, superclass string, interface_name string, source_file string, source_line long, is_bean boolean, source_tokens long, origin string, lifecycle string, module string, source_set string, repository string"
    deps = [(1, 3, "CDI_INJECT", 1), (3, 4, "CONSTRUCTS", 1), (4, 1, "CALLS", 2), (5, 6, "CALLS", 1), (6, 5, "CALLS", 1), (7, 1, "CALLS", 1)]
    commits = [(1, "h1", "Ann", "a@x", D(2026, 8, 26), "one"), (2, "h2", "Bob", "b@x", D(2026, 8, 27), "two"), (3, "h3", "Ann", "a2@x", D(2026, 8, 28), "three")]
    files = [(1, 1, "OrderService.java", "ADD"), (2, 1, "OrderService.java", "MODIFY"), (2, 3, "Stripe.java", "ADD"), (3, 3, "Stripe.java", "MODIFY"), (3, 1, "OrderService.java", "MODIFY"), (1, 8, "Gone.java", "ADD")]
    make = spark.createDataFrame
    return Snapshot.of(
        spark,
        {
            "classes": make(classes, schema), "dependencies": make(deps, "from_class_id long, to_class_id long, kind string, occurrence_count long"),
            "commits": make(commits, "id long, hash string, author string, author_email string, committed_at timestamp, message string"),
            "commit_files": make(files, "commit_id long, class_id long, file_path string, change_type string"),
            "class_occurrences": make([(1, "other", "main", "out/x"), (1, "app", "main", "out/y")], "class_id long, module string, source_set string, output_directory string"),
            "class_annotations": make([], "class_id long, annotation_name string, direct boolean, via_annotation string"),
            "class_members": make([], "class_id long, kind string, name string, descriptor string, parameter_types string, modifiers string, annotations string"),
        },
    )


def test_nested_classes_collapse_out_of_cycles(index):
    edges = graph.collapsed_edges(index)
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 3), (3, 4), (4, 1), (7, 1)}
    assert [(r.component, r.size, r.first_name) for r in graph.class_cycles(index).collect()] == [(1, 3, "org.acme.AuditService")]
    members = graph.strong_components(edges).join(index.classes.selectExpr("id AS node", "class_name AS name"), "node")
    assert graph.cycle_paths(edges, members) == {1: [4, 1, 3, 4]}


@pytest.mark.parametrize("most", [0, 50_000])
def test_components_either_way(spark, most):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8), (9, 1), (5, 9), (10, 11), (11, 12), (12, 10), (12, 13)]
    got = {(r.node, r.component) for r in graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"), driver_edges=most).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (9, 1), (10, 10), (11, 10), (12, 10)}
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long"), driver_edges=most).count() == 0


def test_hotspots_since_a_day(index):
    rows = git.hotspots(index, since=datetime.date(2026, 8, 28)).collect()
    assert [(r.file_path, r.commit_count) for r in rows] == [("OrderService.java", 1), ("Stripe.java", 1)]
    assert [(r.file_path, r.commit_count, r.last_author) for r in git.hotspots(index).collect()] == [("OrderService.java", 3, "Ann"), ("Stripe.java", 2, "Ann")]
    assert "Gone.java" in {r.file_path for r in git.hotspots(index, include_historical=True).collect()}


def test_co_changes_count_rows(index):
    assert [(r.file_path, r.co_changes, r.ratio) for r in git.co_changed(index, "OrderService.java").collect()] == [("Stripe.java", 2, 0.67), ("Gone.java", 1, 0.33)]


def test_modules_by_occurrence(index):
    names = lambda m: [r.id for r in search.search_classes(index, "orderservice", module=m).collect()]
    assert names("other") == [1] and names("app") == [1] and names("lib") == []
    assert [r.id for r in search.search_classes(index, "*Stripe*", module="app").collect()] == [3]


def test_traversals(index):
    assert {(r.depth, r.to_class_id) for r in graph.dependencies_of(index, 1, depth=2).collect()} == {(1, 3), (2, 4)}
    assert [r.id for r in graph.implementations(index, "org.acme.PaymentService").collect()] == [3]
    found = risk.impacted_tests(index, index.classes.where("id = 3").select("id")).collect()
    assert [(r.id, r.depth, r.score, r.confidence) for r in found] == [(7, 2, 85, "medium")]


def test_risk_is_in_range(index):
    rows = risk.class_risk(index).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 10 and r.level in ("LOW", "MEDIUM", "HIGH", "CRITICAL") for r in rows)


def test_unused_classes(index):
    assert {(r.id, r.confidence) for r in unused.unused_classes(index).collect()} == {(7, "medium")}


def test_targets(index):
    assert [(r.id, r.step) for r in search.resolve_target(index, "AuditService").collect()] == [(4, 3)]
    assert [(r.id, r.step) for r in search.resolve_target(index, "org.acme.AuditService").collect()] == [(4, 1)]
    assert search.resolve_target(index, "Gone").collect() == []


def test_candidate_ranking(spark):
    rows = [("g", "a", "CONSTRUCTOR", True, False, "constructor", "match"), ("g", "b", "CLASS", True, False, "constructor", "none"), ("h", "x", "METHOD", False, False, "call", "match"), ("h", "y", "METHOD", False, False, "call", "match")]
    df = spark.createDataFrame(rows, "group string, name string, kind string, same_file boolean, enclosing boolean, context string, arguments string")
    got = {r.name: (r.score, r.place, r.decisive) for r in search.rank_candidates(df).collect()}
    assert got == {"a": (150, 1, True), "b": (60, 2, False), "x": (110, 1, False), "y": (110, 2, False)}


def test_descriptors(spark):
    df = spark.createDataFrame([(["int", "java.lang.String[]"], "void"), ([], "long[][]"), ([None], "int")], "p array<string>, r string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(search.descriptor(F.col("p"), F.col("r"))).collect()] == ["(I[Ljava/lang/String;)V", "()[[J", None]


def test_delta_treats_null_as_equal(spark):
    now = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    want = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "a int, b string")
    parts = {k: {tuple(r) for r in v.collect()} for k, v in compare.delta(now, want).items()}
    assert parts == {"delete": {(2, "x"), (3, "y")}, "insert": {(2, "z"), (4, "y")}, "unchanged": {(1, None)}}
    assert {tuple(r) for r in compare.apply_delta(now, want).collect()} == {(1, None), (2, "z"), (4, "y")}


def test_execution_order(spark):
    edges = spark.createDataFrame([("m", 0, 4), ("m", 4, 8), ("n", 0, 4), ("n", 0, 8), ("n", 4, 8)], "method string, src int, dst int")
    events = spark.createDataFrame([("m", 4, "before", False), ("m", 8, "after", False), ("n", 4, "before", False), ("n", 8, "after", False), ("n", 0, "before", True)], "method string, ordinal int, role string, dynamic boolean")
    assert {tuple(r) for r in execution.execution_order(events, edges).collect()} == {("m", "proven", "straight"), ("n", "proven", "bypass")}


def test_properties(spark):
    rows = [("A", "FIELD", "name", "S"), ("A", "METHOD", "getName", "S"), ("A$Companion", "FIELD", "max", "I"), ("A", "FIELD", "x$delegate", "L"), ("A", "METHOD", "isOpen", "Z"), ("A", "METHOD", "run", "V")]
    got = {tuple(r) for r in workspace.logical_properties(spark.createDataFrame(rows, "owner string, kind string, name string, signature string")).collect()}
    assert got == {("A", "name", "field,getter"), ("A", "max", "field"), ("A", "open", "getter")}


def test_decisions():
    v = composite.verification_verdict
    assert [v(build_failed=True, problems=0, structure_stale=False, unverified=0), v(build_failed=False, problems=0, structure_stale=True, unverified=1), v(build_failed=False, problems=0, structure_stale=False, unverified=2), v(build_failed=False, problems=0, structure_stale=False, unverified=0)] == ["blocked", "needs_build", "partial", "ready"]
    assert composite.session_phase(verdict="ready", planned=True, open_reviews=0) == "complete"
    assert composite.session_id("/r", ["A"], "c") == composite.session_id("/r", ["A"], "c") != composite.session_id("/r", ["B"], "c")
    assert composite.build_status(head_changed=False, inputs_newer=False, pending_event=True) == "pending"
    assert composite.tool_matches("find_cycles", "circular dependencies", "cycles of dependencies") == 4


def test_snapshot_round_trip(index, spark, tmp_path):
    index.write(f"{tmp_path}/g", ["classes", "dependencies"])
    again = Snapshot.read(spark, f"{tmp_path}/g")
    assert again.classes.exceptAll(index.classes).count() == 0 and again.dependencies.count() == 6
    with pytest.raises(AttributeError):
        again._missing  # noqa: B018


def test_readers(index, spark):
    from codeloom.sources import readers

    assert sorted(r.id for r in readers.classes_by_ids(index, [1, 8, 99, 1]).collect()) == [1, 8]
    assert [r.id for r in readers.classes_by_names(index, ["org.acme.Gone"]).collect()] == [8]
    assert [r.id for r in readers.classes_by_short_name(index, "OrderTest").collect()] == [7] and readers.classes_by_short_name(index, "Gone").count() == 0
    assert sorted(r.id for r in readers.classes_by_path(index, "src/main/java/Container.java").collect()) == [5, 6]
    rows = spark.createDataFrame([("a", "c", 2), ("a", "b", 1), ("b", "b", 0)], "module string, visible string, distance int")
    assert [r.visible for r in readers.module_classpath(rows, "a").collect()] == ["b", "c"]
    assert readers.metadata(spark.createDataFrame([("k", "v")], "key string, value string")) == {"k": "v"}


def test_dependencies_through_a_chain(spark):
    edges = [("a", "b", "compile"), ("b", "c", "compile"), ("c", "d", "runtime"), ("x", "d", "compile")]
    s = Snapshot.of(spark, {"module_edges": spark.createDataFrame(edges, "module string, visible string, relation string")})
    got = {tuple(r) for r in search.project_dependencies(s).collect()}
    assert got == {("b", 1, "compile", "direct"), ("c", 2, "compile", "mixed"), ("d", 4, "compile,runtime", "mixed")}


def test_large_commits_settle_co_changes(index, spark):
    files = [(1, f"f{k}") for k in range(101)] + [(2, "f0"), (2, "x"), (3, "x"), (3, "y"), (4, "f1"), (4, "f1")]
    s = Snapshot.of(spark, {"commit_files": spark.createDataFrame(files, "commit_id long, file_path string")})
    got = {r.file_path: r.co_changed for r in risk.co_change_counts(s).collect()}
    assert got == {f"f{k}": 100 for k in range(101)} | {"x": 2, "y": 1}


def test_cycle_paths_equal_a_plain_search(spark):
    import random

    r = random.Random(3)
    edges = {(a, b) for a in range(30) for b in r.sample(range(30), 2) if a != b}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    members = graph.strong_components(frame).selectExpr("node", "component", "concat('n', lpad(node, 3, '0')) AS name")
    home = {x.node: x.component for x in members.collect()}
    got = graph.cycle_paths(frame, members)
    assert set(got) == set(home.values())
    for component, path in got.items():
        start = min(n for n in home if home[n] == component)
        ways = [[start]]
        while not any(len(w) > 1 and w[-1] == start for w in ways):  # all walks, one step longer each time
            ways = [[*w, b] for w in ways for a, b in sorted(edges) if a == w[-1] and home.get(b) == component and b not in w[1:]]
        assert path == min(w for w in ways if w[-1] == start)


def _chords(n, r):
    """A ring of ``n`` nodes with steps back and short steps forward, and its names, in which 5 is the first."""
    edges = {(k, (k + 1) % n) for k in range(n)} | {(k, k - r.randrange(1, 4)) for k in range(3, n, 2)} | {(k, min(n - 1, k + r.choice((25, 31)))) for k in range(0, n - 1, 3)}
    return {(a, b) for a, b in edges if a != b and b != 5} | {(n - 1, 5)}, {k: f"n{(k - 5) * 7 % n:03}" for k in range(n)}


def test_cycles_of_many_classes_have_a_path(spark):
    import random

    edges, names = _chords(130, random.Random(8))
    frame = spark.createDataFrame(sorted(edges) + [(500, 501), (501, 500)], "src long, dst long")
    members = graph.strong_components(frame)
    members = members.join(spark.createDataFrame(list((names | {500: "a", 501: "b"}).items()), "node long, name string"), "node")
    assert members.where("component < 500").count() > 100
    shortest = {5: (5,)}  # for each node the first by name of the shortest ways from 5
    level = [5]
    while 5 not in {b for a in level for b in (y for x, y in edges if x == a)}:
        ways = [(shortest[a] + (b,)) for a in level for x, b in sorted(edges) if x == a and b not in shortest]
        ways.sort(key=lambda w: [names[k] for k in w])
        for w in ways:
            shortest.setdefault(w[-1], w)
        level = list({w[-1] for w in ways})
    want = min((shortest[a] for a in level if (a, 5) in edges), key=lambda w: [names[k] for k in w])
    assert graph.cycle_paths(frame, members) == {0: [*want, 5], 500: [500, 501, 500]}
    assert len(want) > 4
    got = sorted(map(tuple, graph.cycle_path_rows(frame, members, task_edges=2).collect()))  # the larger one by joins
    assert got == [(0, k, n) for k, n in enumerate([*want, 5])] + [(500, 0, 500), (500, 1, 501), (500, 2, 500)]


def test_a_context_has_the_whole_card_and_tests(index, spark):
    targets = spark.createDataFrame([(1,), (4,)], "id long")
    more = {"external_deps": spark.createDataFrame([(1, "lib.A"), (1, "lib.B")], "class_id long, external_type string"), "dependency_lines": index.dependencies.selectExpr("from_class_id", "to_class_id", "kind", "1L AS line"),
            "class_interfaces": index.classes.where("interface_name is not null").selectExpr("id AS class_id", "interface_name")}
    index = Snapshot(spark, lambda name, _, of=index: more[name] if name in more else of[name])
    whole = {r.id: r.asDict() for r in usage.class_cards(index, targets).collect()}
    got = {r.id: r.asDict() for r in composite.change_context(index, targets).collect()}
    assert set(got) == {1, 4} and all(got[k].items() >= whole[k].items() for k in got)
    assert {k: r["tests"] for k, r in got.items()} == {1: 1, 4: 1} and {r.class_name for r in risk.impacted_tests(index, targets).collect()} >= {"org.acme.OrderTest"}


def test_answers_have_totals_and_cursors(spark):
    rows = spark.range(25).selectExpr("id", "concat('row ', id) AS name").orderBy("id")
    first = paging.answer(rows, limit=10, traversal="rows")
    assert [x["id"] for x in first["results"]] == list(range(10)) and first["total"] == 25 and first["has_more"]
    last = paging.answer(rows, limit=20, cursor=first["next_cursor"], traversal="rows")
    assert [x["id"] for x in last["results"]] == list(range(10, 25)) and last["next_cursor"] is None
    with pytest.raises(ValueError, match="another traversal"):
        paging.answer(rows, cursor=first["next_cursor"], traversal="other")
    wide = spark.range(40).selectExpr("id", "repeat('x', 500) AS name").orderBy("id")
    cut = paging.answer(wide, limit=40, budget=5000, traversal="wide")
    assert cut["budget_truncated"] and cut["has_more"] and 0 < cut["showing"] < 40
    assert paging.answer(wide, limit=40, cursor=cut["next_cursor"], traversal="wide")["results"][0]["id"] == cut["showing"]


def test_a_cluster_has_to_name_a_folder(spark, monkeypatch):
    from codeloom import runtime

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"getOrElse": staticmethod(lambda x: x)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_dominators_equal_sets(spark):
    """Against the definition: the greatest sets that hold a node and what all nodes before it have in common."""
    import random

    r = random.Random(12)
    edges = {(m, a, b) for m in range(25) for a, b in [(r.randrange(14), r.randrange(14)) for _ in range(r.choice([1, 6, 20, 40]))]}
    got = {(x.method, x.node, x.dominator) for x in graph.dominators(spark.createDataFrame(sorted(edges), "method long, src long, dst long")).collect()}
    want = set()
    for m in range(25):
        own = {(a, b) for n, a, b in edges if n == m}
        nodes = sorted({x for e in own for x in e})
        before = {n: {a for a, b in own if b == n} for n in nodes}
        sets = {n: {n} if n == nodes[0] or not before[n] else set(nodes) for n in nodes}
        for _ in range(len(nodes) + 1):
            for n in nodes[1:]:
                if before[n]:
                    sets[n] = {n} | set.intersection(*(sets[p] for p in before[n]))
        want |= {(m, n, d) for n in nodes for d in sets[n]}
    assert got == want
