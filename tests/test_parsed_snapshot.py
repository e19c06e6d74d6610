"""Operators on the relations of a real JAR."""

import glob
import os

import pyspark
import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, metrics, search, unused, usage
from codeloom.plans.parsed import snapshot_of
from codeloom.runtime import stored
from codeloom.sources import classfile

JAR = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "slf4j-api-*.jar")))[0]


@pytest.fixture(scope="module")
def index(spark):
    s = snapshot_of(stored(classfile.read_class_files(spark, JAR, "*.jar").where("class_name NOT LIKE 'module-info%'")), module="slf4j-api")
    for name in ("classes", "class_interfaces", "class_members", "dependencies", "dependency_lines", "method_calls", "field_accesses", "class_annotations"):
        s._made[name] = stored(s[name])
    return s


def named(s, df, column):
    return df.join(s.classes.select(F.col("id").alias(column), F.col("class_name").alias(f"{column}_name")), column)


def test_relations(index):
    assert index.classes.groupBy("id").count().where("count > 1").isEmpty()
    row = index.class_members.join(index.classes.where("class_name = 'org.slf4j.helpers.MessageFormatter'").select(F.col("id").alias("class_id")), "class_id").where("name = 'arrayFormat'").first()
    assert row.parameter_types in ("java.lang.String,java.lang.Object[]", "java.lang.String,java.lang.Object[],java.lang.Throwable") and "static" in row.modifiers


def test_several_interfaces_and_hierarchy(index):
    below = {r.class_name for r in graph.implementations(index, "org.slf4j.Logger").collect()}
    assert {"org.slf4j.helpers.NOPLogger", "org.slf4j.helpers.SubstituteLogger", "org.slf4j.helpers.AbstractLogger"} <= below
    rows = {r.name: r for r in graph.type_hierarchy(index, "org.slf4j.helpers.NOPLogger", direction="ancestor").collect()}
    way = rows["org.slf4j.Logger"]
    assert way.path.startswith("org.slf4j.helpers.NOPLogger>") and way.path.count(">") == way.depth + 1 and way.relations.count(">") == way.depth


def test_methods_are_resolved(index):
    rows = named(index, graph.resolved_owners(index), "id").collect()
    status = {(r.id_name, r.name, r.descriptor): r.status for r in rows}
    assert status["org.slf4j.LoggerFactory", "getILoggerFactory", "()Lorg/slf4j/ILoggerFactory;"] == "declared"
    assert {"declared", "ancestor_not_indexed"} <= set(status.values()) <= {"declared", "ancestor_not_indexed", "inherited_class_declaration", "inherited_interface_declaration", "declaration_not_indexed"}
    own = {(r.class_name, r.name, r.descriptor) for r in index.class_members.join(index.classes.withColumnRenamed("id", "class_id").drop("kind"), "class_id").where("kind = 'METHOD'").collect()}
    assert all(((n, m, d) in own) == (st == "declared") for (n, m, d), st in status.items() if m not in ("<init>", "<clinit>"))


def test_unused_members(index):
    verdicts = unused.method_verdicts(index).where("class_name = 'org.slf4j.LoggerFactory'")
    found = {(r.name, r.verdict) for r in verdicts.collect()}
    assert ("performInitialization", "used") in found and ("bind", "used") in found
    fields = {r.verdict for r in unused.field_verdicts(index).collect()}
    assert {"read", "constant"} <= fields and "serializable" in fields
    reasons = {r.reason for r in unused.class_exclusions(index).collect()}
    assert {"inbound", "hierarchy"} <= reasons


def test_usages_and_calls(index):
    target = index.classes.where("class_name = 'org.slf4j.event.Level'").select("id")
    kinds = {r.usage for r in usage.class_usages(index, target).collect()}
    assert kinds and kinds <= {*usage.USAGE_KINDS.values(), "type_reference", "inheritance", "annotation"}
    calls = graph.call_hierarchy(index, "org.slf4j.LoggerFactory", "getLogger", direction="both", max_depth=2).collect()
    assert {r.direction for r in calls} == {"outbound", "inbound"}
    assert search.entry_points(index).count() == 0  # a library without mains, routes or services
    assert metrics.reference_caveats(index).count() >= 0


def test_routes_of_class_files(spark):
    """Resources of the engine's own status pages, annotated in class files."""
    import zipfile

    core = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-core_*.jar")))[0]
    with zipfile.ZipFile(core) as jar:
        files = [(n, bytearray(jar.read(n))) for n in jar.namelist() if n.startswith("org/apache/spark/status/api/v1/ApiRootResource") or n.startswith("org/apache/spark/status/api/v1/OneApplicationResource")]
    s = snapshot_of(stored(classfile.parsed_classes(spark.createDataFrame(files, "path string, content binary"))))
    rows = {(r.class_name.rpartition(".")[2], r.name, r.http_method, r.path) for r in search.framework_endpoints(s).collect()}
    assert ("ApiRootResource", "version", "GET", "/v1/version") in rows
    assert ("ApiRootResource", "applicationList", "SUBRESOURCE", "/v1/applications") in rows
    kinds = {(r.class_name.rpartition(".")[2], r.entry_kind) for r in search.entry_points(s).collect()}
    assert ("ApiRootResource", "rest_resource") in kinds and ("ApiRootResource", "rest_endpoint") in kinds
