"""The relations of a code index from parsed class files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.snapshot import Snapshot
from codeloom.sources import classfile


def _id(name: str) -> Column:
    return F.xxhash64(name)


def _parameters(descriptor: str) -> Column:
    """Type names of a method descriptor's parameters, comma-joined; arrays end in brackets."""
    parts = F.regexp_extract_all(F.regexp_extract(descriptor, r"^\((.*)\)", 1), F.lit(r"(\[*(?:L[^;]+;|[ZBCSIJFD]))"), 1)
    letters = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}

    def name(part: Column) -> Column:
        element = F.regexp_replace(part, r"^\[+", "")
        plain = F.coalesce(*[F.when(element == k, F.lit(v)) for k, v in letters.items()], F.translate(F.regexp_extract(element, "^L(.*);$", 1), "/", "."))
        return F.concat(plain, F.repeat(F.lit("[]"), (F.length(part) - F.length(element)).cast("int")))

    return F.array_join(F.transform(parts, name), ",")


def snapshot_of(parsed: DataFrame, *, module: str | None = None, source_set: str | None = "main", repository: str | None = None) -> Snapshot:
    """A snapshot of the classes in ``parsed`` (see ``classfile.parsed_classes``), of one module and source set. A class's id is a
    hash of its name, so no order over all classes is needed; of several files with a class the first path counts. What class files
    don't tell (history, configuration) is absent; dependencies on classes outside are left out, as they have no id."""
    one = parsed.where("problem is null").groupBy("class_name").agg(F.min_by(F.struct(*[c for c in parsed.columns if c != "class_name"]), "path").alias("c")).select("class_name", "c.*")
    beans = classfile.discovered_beans(one)
    marked = beans.where("kind = 'MANAGED'").select("class_name", F.lit(True).alias("is_bean")).distinct()
    classes = one.join(marked, "class_name", "left").select(
        _id("class_name").alias("id"), "class_name", "kind", "superclass", F.element_at(F.concat("interfaces", F.array(F.lit(None).cast("string"))), 1).alias("interface_name"),
        F.concat_ws("/", F.translate(F.regexp_extract("class_name", r"^(.*)\.[^.]*$", 1), ".", "/"), "source_file").alias("source_file"), F.lit(1).cast("long").alias("source_line"), F.coalesce("is_bean", F.lit(False)).alias("is_bean"),
        F.lit(0).cast("long").alias("source_tokens"), F.lit("source").alias("origin"), F.lit("current").alias("lifecycle"), F.lit(module).cast("string").alias("module"), F.lit(source_set).cast("string").alias("source_set"), F.lit(repository).cast("string").alias("repository"),
    )
    known = one.select(F.col("class_name").alias("target"))
    members = classfile.member_rows(one).select(_id("class_name").alias("class_id"), "kind", "name", "descriptor", F.when(F.col("descriptor").startswith("("), _parameters("descriptor")).otherwise("").alias("parameter_types"), F.array_join("modifiers", " ").alias("modifiers"), F.array_join("annotations", " ").alias("annotations"))
    used = classfile.dependency_rows(one).join(known, F.col("to_class") == F.col("target")).select(_id("from_class").alias("from_class_id"), _id("to_class").alias("to_class_id"), "kind", "occurrence_count", "evidence_lines")
    calls = classfile.call_rows(one).join(known, F.col("owner") == F.col("target"))
    accesses = classfile.access_rows(one).join(known, F.col("owner") == F.col("target"))
    marks = classfile.meta_annotations(one).select(_id("class_name").alias("class_id"), F.col("annotation").alias("annotation_name"), "direct", F.col("via").alias("via_annotation"))
    none = lambda schema: parsed.sparkSession.createDataFrame([], schema)
    return Snapshot.of(
        parsed.sparkSession,
        {
            "classes": classes,
            "class_interfaces": one.select(_id("class_name").alias("class_id"), F.explode("interfaces").alias("interface_name")),
            "class_members": members,
            "class_annotations": marks,
            "class_occurrences": none("class_id long, module string, source_set string, output_directory string"),
            "dependencies": used.drop("evidence_lines"),
            "dependency_lines": used.select("from_class_id", "to_class_id", "kind", F.explode("evidence_lines").alias("line")),
            "method_calls": calls.select(_id("class_name").alias("caller_class_id"), F.col("method").alias("caller_method"), F.col("descriptor").alias("caller_descriptor"), _id("owner").alias("target_class_id"), F.col("name").alias("target_method"), F.col("to").alias("target_descriptor"), "invocation_kind", "occurrence_count"),
            "field_accesses": accesses.select(_id("class_name").alias("accessor_class_id"), F.col("method").alias("accessor_method"), _id("owner").alias("owner_class_id"), F.col("name").alias("field_name"), "access_kind", "occurrence_count"),
            "service_registrations": none("service_type string, class_id long"),
            "annotation_uses": classfile.annotation_values(one).where("kind <> 'ANNOTATION'").select(_id("class_name").alias("class_id"), F.col("member").alias("name"), "descriptor", "position", "annotation", "element", "values"),
            "annotation_elements": classfile.annotation_elements(one),
            "annotation_metas": classfile.annotation_values(one).where("kind = 'ANNOTATION' AND member = ''").select(F.col("class_name").alias("annotation"), F.col("annotation").alias("meta"), "element", "values"),
            "jvm_api": classfile.jvm_api(parsed).withColumn("class_id", _id("class_name")).drop("class_name"),
            "endpoint_marks": classfile.endpoint_marks(one).withColumn("class_id", _id("class_name")).drop("class_name"),
        },
    )
