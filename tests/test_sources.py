import glob
import os

import pyspark
import pytest

from codeloom.plans.snapshot import Snapshot
from codeloom.sources import classfile, store, text

JAR = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "slf4j-api-*.jar")))[0]


@pytest.fixture(scope="module")
def parsed(spark):
    return classfile.read_class_files(spark, JAR, "*.jar").cache()


def test_class_files(parsed):
    assert parsed.where("problem is not null").count() == 0
    rows = {r.class_name: r for r in classfile.class_rows(parsed).collect()}
    assert rows["org.slf4j.Logger"].kind == "INTERFACE" and rows["org.slf4j.event.Level"].kind == "ENUM"
    assert "org.slf4j.ILoggerFactory" in rows["org.slf4j.helpers.NOPLoggerFactory"].interfaces
    assert rows["org.slf4j.LoggerFactory"].source_file == "LoggerFactory.java"
    members = {(r.class_name, r.name, r.descriptor): r for r in classfile.member_rows(parsed).collect()}
    get = members["org.slf4j.LoggerFactory", "getLogger", "(Ljava/lang/String;)Lorg/slf4j/Logger;"]
    assert set(get.modifiers) == {"public", "static"} and get.kind == "METHOD"


def test_calls_fields_and_dependencies(parsed):
    calls = {(r.class_name, r.method, r.owner, r.name, r.invocation_kind): r for r in classfile.call_rows(parsed).collect()}
    one = calls["org.slf4j.LoggerFactory", "getLogger", "org.slf4j.ILoggerFactory", "getLogger", "interface"]
    assert one.occurrence_count == 1 and len(one.evidence_lines) == 1 and one.evidence_lines[0] > 0
    assert any(r.access_kind == "write_static" and r.owner == "org.slf4j.LoggerFactory" for r in classfile.access_rows(parsed).collect())
    kinds = {r.kind for r in classfile.dependency_rows(parsed).where("from_class = 'org.slf4j.LoggerFactory'").collect()}
    assert {"CALLS", "CONSTRUCTS"} <= kinds
    used = classfile.programmatic_usages(parsed).collect()
    assert {("org.slf4j.LoggerFactory", "slf4j.provider")} <= {(r.class_name, r.value) for r in used if r.usage == "config_key"} and any(r.usage == "dynamic_config_key" and r.value is None for r in used)


def test_flow_feeds_dominance(parsed):
    from codeloom.operators.graph import dominators

    one = classfile.flow_edges(parsed.where("class_name = 'org.slf4j.helpers.MessageFormatter'"))
    rows = dominators(one).collect()
    assert rows and all(any(r.method == s.method and r.node == s.node and s.dominator == 0 for s in rows) for r in rows[:50])


def test_broken_files(spark):
    files = spark.createDataFrame([("a.class", bytearray(b"\xca\xfe")), ("b.class", bytearray(b"\xca\xfe\xba\xbe\0\0\0\x34\0\x05\x63\x00")), ("c.jar", bytearray(b"no")), ("d.class", None)], "path string, content binary")
    assert {r.path: bool(r.problem) for r in classfile.parsed_classes(files).collect()} == {"a.class": True, "b.class": True, "c.jar": True}


def test_jar_order(spark, parsed):
    both = parsed.unionByName(parsed.selectExpr("replace(path, 'slf4j', 'other') AS path", *[c for c in parsed.columns if c != "path"]))
    name = os.path.basename(JAR)
    kept = classfile.first_by_jar(both, [name.replace("slf4j", "other"), name])
    assert kept.count() == parsed.count() and kept.where("jar NOT LIKE 'other%'").count() == 0


def test_services(spark):
    rows = spark.createDataFrame([("x/META-INF/services/a.B", "# head\np.One # c\n\n p.Two\n"), ("y/a.Processor", "p.X\np.Y")], "path string, text string")
    got = sorted((r.service, r.provider, r.line, r.position, r.ordered) for r in text.service_providers(rows).collect())
    assert got == [("a.B", "p.One", 2, 1, False), ("a.B", "p.Two", 4, 2, False), ("a.Processor", "p.X", 1, 1, True), ("a.Processor", "p.Y", 2, 2, True)]


def test_configuration(spark):
    props = "# c\na.b=1\\\n  two\nc\\ d : x\n! no\ne.f\nlast \\\\\nnext=1"
    yaml = "server:\n  port: 80 # c\n  ssl:\n    key: x\nlist:\n  - a: 1\n---\nother: y\nempty:\n"
    xml = '<persistence>\n<persistence-unit name="pu1" x="1">'
    rows = spark.createDataFrame([("c/a.properties", props), ("c/a.yml", yaml), ("m/persistence.xml", xml), ("n.properties", None)], "path string, text string")
    got = {(r.kind, r.key, r.line) for r in text.configuration_definitions(rows).collect()}
    assert got == {("properties", "a.b", 2), ("properties", "c d", 4), ("properties", "e.f", 6), ("properties", "last", 7), ("properties", "next", 8), ("yaml", "server.port", 2), ("yaml", "server.ssl.key", 4), ("yaml", "list", 5), ("yaml", "other", 8), ("yaml", "empty", 9), ("persistence_unit", "pu1", 2)}
    found = text.placeholders(spark.createDataFrame([(1, "x ${a.b} ${c:d} $e")], "id int, v string"), "v").collect()
    assert [(r.key, r.has_default) for r in found] == [("a.b", False), ("c", True)]


def test_modules_and_class_paths(spark):
    pom = '<project xmlns="http://maven"><artifactId>app</artifactId><dependencies><dependency><artifactId>lib</artifactId></dependency><dependency><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>'
    gradle = "dependencies { implementation project(':core:util')\n testImplementation(project(\":core\")) }"
    rows = spark.createDataFrame([("r/app/pom.xml", pom), ("r/web/build.gradle", gradle), ("r/bad/pom.xml", "<")], "path string, text string")
    assert {tuple(r) for r in text.module_edges(rows).collect()} == {("app", "lib", "compile"), ("app", "t", "test"), ("web", "util", "compile"), ("web", "core", "test")}
    cp = "/h/.m2/repository/org/acme/lib/1.2/lib-1.2.jar:/h/.gradle/caches/modules-2/files-2.1/com.x/y/3/abc/y-3.jar:/z/classes"
    got = {(r.group, r.artifact, r.version) for r in text.classpath_coordinates(spark.createDataFrame([("c", cp)], "path string, text string")).collect()}
    assert got == {("org.acme", "lib", "1.2"), ("com.x", "y", "3")}


def test_git_log(spark):
    log = "\x01h2\x02h\x02Ann\x02a@x\x022026-08-28T10:00:00Z\x02fix: it\n\nM\tsrc/A.java\nR100\tsrc/B.java\tsrc/C.java\n\x01h1\x02h\x02Bob\x02b@x\x022026-08-27T10:00:00Z\x02empty\n"
    commits, files = text.git_log(spark.createDataFrame([("l", log)], "path string, text string"))
    assert [(r.hash, r.author, r.message) for r in commits.collect()] == [("h2", "Ann", "fix: it")]
    assert sorted((r.file_path, r.change_type) for r in files.collect()) == [("src/A.java", "MODIFY"), ("src/C.java", "RENAME")]


def test_diagnostics(spark):
    lines = ["[ERROR] /p/src/A.java:[3,7] cannot find symbol", "w: file:///p/B.kt:5:1 unused", "src/C.java:9: error: bad", "noise"]
    found = text.diagnostics(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.severity, r.file, r.line, r.message) for r in found.collect()] == [("error", "/p/src/A.java", 3, "cannot find symbol"), ("warning", "/p/B.kt", 5, "unused"), ("error", "src/C.java", 9, "bad")]
    assert [r.line for r in text.problems_of(found, paths=["A.java", "src/C.java"], severity="error").collect()] == [3, 9]


def test_inventory_occurrences_and_worktree(spark):
    a = spark.createDataFrame([("x", "source"), ("y", "source")], "path string, origin string")
    b = spark.createDataFrame([("y", "history"), ("z", "history")], "path string, origin string")
    assert sorted((r.path, r.origin) for r in text.file_inventory(a, b).collect()) == [("x", "source"), ("y", "source"), ("z", "history")]
    paths = spark.createDataFrame([("/r/target/classes/org/A.class",), ("/r/build/classes/java/main/org/B.class",), ("/r/readme",)], "path string")
    assert sorted((r.class_name, r.output_directory) for r in text.class_occurrences(paths).collect()) == [("org.A", "/r/target/classes"), ("org.B", "/r/build/classes/java/main")]
    rows, counts = text.worktree_status(spark.createDataFrame([("a", " M"), ("b", "??"), ("c", "UU"), ("d", " D")], "path string, code string"), status="untracked")
    assert [r.path for r in rows.collect()] == ["b"] and {r.status: r.changes for r in counts.collect()} == {"modified": 1, "untracked": 1, "conflicting": 1, "deleted": 1}


def test_generation_store(spark, tmp_path):
    made = store.GenerationStore(spark, f"file://{tmp_path}/idx")
    for k in range(7):
        made.publish(Snapshot.of(spark, {"classes": spark.range(k + 1)}), ["classes"], f"g{k}", "old" if k == 0 else "main")
    assert made.open("main").classes.count() == 7 and made.open("old").classes.count() == 1
    assert made.generations() == ["g0", "g2", "g3", "g4", "g5", "g6"] and not (tmp_path / "idx/g1").exists()
    with pytest.raises(OSError):
        made.publish(Snapshot.of(spark, {"classes": spark.range(1)}), ["classes"], "g6", "main")


def test_resolved_modules(spark):
    pom = lambda own, deps, more="": f"<project xmlns=\"http://maven.apache.org/POM/4.0.0\">{own}<properties><g>org.acme</g><deep>${{g}}</deep><lib>lib</lib>{more}</properties><dependencies>{deps}</dependencies></project>"
    dep = lambda g, a, scope="": f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId>{f'<scope>{scope}</scope>' if scope else ''}</dependency>"
    parent = "<parent><groupId>org.acme</groupId><artifactId>root</artifactId></parent>"
    rows = [
        ("app/pom.xml", pom(f"{parent}<artifactId>app</artifactId>", dep("${project.groupId}", "${lib}") + dep("${deep}", "tests", "test") + dep("org.other", "lib") + dep("${nowhere}", "lib") + dep("org.acme", "app"))),
        ("lib/pom.xml", pom("<groupId>org.acme</groupId><artifactId>lib</artifactId>", "")), ("qa/pom.xml", pom(f"{parent}<artifactId>tests</artifactId>", dep("org.acme", "lib", "runtime"))),
        ("broken/pom.xml", "<project>"), ("none/pom.xml", None), ("loop/pom.xml", pom("<groupId>x</groupId><artifactId>y</artifactId>", dep("${a}", "lib"), "<a>${b}</a><b>${a}</b>")),
        ("g/web/build.gradle", "dependencies { implementation project(':g:core'); testImplementation(project(path: ':util')) ; api project(\":gone\") }"), ("g/core/build.gradle.kts", "dependencies { api(project(\":util\")) }"), ("g/util/build.gradle", None), ("readme", "x"),
    ]
    got = {tuple(r) for r in text.resolved_module_edges(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("app", "lib", "compile"), ("app", "qa", "test"), ("qa", "lib", "runtime"), ("g/web", "g/core", "compile"), ("g/web", "g/util", "test"), ("g/core", "g/util", "compile")}
    assert text.resolved_module_edges(spark.createDataFrame([], "path string, text string")).isEmpty()
