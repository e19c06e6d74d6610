"""Candidates for unused code, and why the others aren't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paging import page
from codeloom.functions.text import has_modifier, is_main, simple_name
from codeloom.operators.graph import closure_of, interfaces
from codeloom.operators.metrics import field_usage, method_usage
from codeloom.plans.snapshot import Snapshot, is_production

# Interfaces whose fields a runtime writes, and methods that it calls by name.
SERIALIZABLE = ("java.io.Serializable",)
CALLBACKS = ("writeObject", "readObject", "readResolve", "writeReplace", "readObjectNoData", "finalize")


def class_evidence(s: Snapshot) -> DataFrame:
    """Per current class: inbound users, subtypes, direct annotations, whether it has a main method or is registered as a service."""
    users = s.current().where(is_production()).select(F.col("id").alias("from_class_id"))
    inbound = s.dependencies.join(users, "from_class_id", "left_semi").groupBy(F.col("to_class_id").alias("id")).agg(F.countDistinct("from_class_id").alias("inbound"))
    above = s.current().where("superclass is not null").select(F.col("superclass").alias("class_name"))
    parents = above.unionByName(interfaces(s).join(s.current().select("id"), "id", "left_semi").select(F.col("interface_name").alias("class_name"))).groupBy("class_name").agg(F.count(F.lit(1)).alias("subtypes"))
    marks = s.class_annotations.where("direct").groupBy(F.col("class_id").alias("id")).agg(F.count(F.lit(1)).alias("annotations"))
    main = s.class_members.where(is_main()).select(F.col("class_id").alias("id"), F.lit(True).alias("has_main")).distinct()
    registered = (s.service_registrations if s.has("service_registrations") else s.spark.createDataFrame([], "class_id long")).select(F.col("class_id").alias("id"), F.lit(True).alias("provider")).distinct()
    whole = s.current().join(registered, "id", "left").join(inbound, "id", "left").join(parents, "class_name", "left").join(marks, "id", "left").join(main, "id", "left")
    return whole.select("id", "class_name", "kind", "origin", "source_set", "is_bean", "source_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inbound", "subtypes", "annotations")], F.coalesce("has_main", F.lit(False)).alias("has_main"), F.coalesce("provider", F.lit(False)).alias("provider"))


def _reasons(evidence: DataFrame) -> DataFrame:
    tests = {
        "inbound": F.col("inbound") > 0,
        "hierarchy": F.col("subtypes") > 0,
        "bean": F.col("is_bean"),
        "annotated": F.col("annotations") > 0,
        "main": F.col("has_main"),
        "provider": F.col("provider"),
        "descriptor": simple_name(F.col("class_name")).isin("package-info", "module-info"),
    }
    return evidence.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))


def unused_classes(s: Snapshot, *, limit: int | None = 50) -> DataFrame:
    """Current classes without any evidence of use: medium confidence for classes in source, else low."""
    found = _reasons(class_evidence(s)).where(F.size("reasons") == 0)
    sure = F.when((F.col("kind") == "CLASS") & (F.col("origin") == "source"), "medium").otherwise("low")
    return page(found.select("id", "class_name", "source_tokens", sure.alias("confidence")).orderBy(F.when(F.col("confidence") == "medium", 0).otherwise(1), F.desc("source_tokens"), "class_name"), limit)


def class_exclusions(s: Snapshot) -> DataFrame:
    """Classes kept, by reason; a class may count for several."""
    return _reasons(class_evidence(s)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("classes"))


def _handle_owners(s: Snapshot, kind: str) -> DataFrame:
    """Classes that are referred to by handles of members of this kind; such members may be used without a trace."""
    return s.dependencies.where(F.col("kind") == f"{kind}_HANDLE_REFERENCE").groupBy(F.col("to_class_id").alias("class_id")).agg(F.count(F.lit(1)).alias("handles"))


def method_verdicts(s: Snapshot) -> DataFrame:
    """Private methods of current classes with the first reason to keep them, or unused."""
    used = method_usage(s).select(F.col("target_class_id").alias("class_id"), F.col("target_method").alias("name"), F.col("target_descriptor").alias("descriptor"), F.lit(True).alias("used"))
    methods = s.class_members.where((F.col("kind") == "METHOD") & has_modifier(F.col("modifiers"), "private")).join(s.current().select(F.col("id").alias("class_id"), "class_name"), "class_id")
    whole = methods.join(_handle_owners(s, "METHOD"), "class_id", "left").join(used, ["class_id", "name", "descriptor"], "left")
    verdict = (
        F.when(F.col("handles").isNotNull(), "handle_owner").when(F.col("annotations") != "", "annotated").when(has_modifier(F.col("modifiers"), "native"), "native")
        .when(F.col("name").isin(*CALLBACKS), "callback").when(F.col("descriptor").isNull(), "unresolved").when(F.col("used"), "used").otherwise("unused")
    )
    return whole.select("class_id", "class_name", "name", "descriptor", verdict.alias("verdict"))


def field_verdicts(s: Snapshot, *, include_write_only: bool = False) -> DataFrame:
    """Private fields of current classes with the first reason to keep them, write_only, or unused."""
    usage = field_usage(s).select(F.col("owner_class_id").alias("class_id"), F.col("field_name").alias("name"), "reads", "writes")
    serial = closure_of(s, s.spark.createDataFrame([(n,) for n in SERIALIZABLE], "name string")).select(F.col("name").alias("class_name"), F.lit(True).alias("serial"))
    fields = s.class_members.where((F.col("kind") == "FIELD") & has_modifier(F.col("modifiers"), "private")).join(s.current().select(F.col("id").alias("class_id"), "class_name"), "class_id")
    whole = fields.join(_handle_owners(s, "FIELD"), "class_id", "left").join(serial, "class_name", "left").join(usage, ["class_id", "name"], "left")
    constant = has_modifier(F.col("modifiers"), "static") & has_modifier(F.col("modifiers"), "final")
    verdict = (
        F.when(F.col("handles").isNotNull(), "handle_owner").when(F.col("annotations") != "", "annotated").when(constant, "constant").when(F.col("serial"), "serializable")
        .when(F.coalesce("reads", F.lit(0)) > 0, "read").when(F.coalesce("writes", F.lit(0)) > 0, "unused" if include_write_only else "write_only").otherwise("unused")
    )
    return whole.select("class_id", "class_name", "name", verdict.alias("verdict"))


def exclusions(verdicts: DataFrame) -> DataFrame:
    """Members by verdict."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("members"))
