"""Who uses a class or member, and details and contexts made of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import hierarchy_edges, resolved_owners
from codeloom.operators.metrics import fan_metrics
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import by_shuffle


# Kinds of use by kind of dependency.
USAGE_KINDS = {
    "CONSTRUCTS": "constructor_call", "CALLS": "method_call", "CALLBACK_REFERENCE": "callback_reference", "METHOD_HANDLE_REFERENCE": "method_handle_reference",
    "FIELD_HANDLE_REFERENCE": "field_handle_reference", "BOOTSTRAP_REFERENCE": "bootstrap_reference", "FIELD_ACCESS": "field_access", "CDI_INJECT": "injection", "SPRING_INJECT": "injection",
    "SERVICE_PROVIDES": "service_loader", "SERVICE_CONSUMES": "service_loader",
}


def usage_kind(kind: Column) -> Column:
    """A dependency kind as a kind of use; others are type references."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in USAGE_KINDS.items()], F.lit("type_reference"))


def class_usages(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Uses of the targets (id) by current classes: dependencies, inheritance and annotations. Rows of one
    user, kind of use and indexed kind are one, with summed counts and all lines in order."""
    users = by_shuffle(s.current().select(F.col("id").alias("user_id"), "class_name"))
    chosen = targets.select(F.col("id").alias("target_id"))
    lines = s.dependency_lines.select("from_class_id", "to_class_id", "kind", "line")
    deps = s.dependencies.join(chosen, F.col("to_class_id") == F.col("target_id")).select("target_id", F.col("from_class_id").alias("user_id"), usage_kind(F.col("kind")).alias("usage"), "kind", "occurrence_count")
    seen = lines.join(chosen, F.col("to_class_id") == F.col("target_id")).select("target_id", F.col("from_class_id").alias("user_id"), usage_kind(F.col("kind")).alias("usage"), "kind", "line")
    ids = by_shuffle(s.classes.select(F.col("id").alias("user_id"), F.col("class_name").alias("child")))
    names = s.classes.select(F.col("id").alias("target_id"), F.col("class_name").alias("parent")).join(chosen, "target_id")
    up = hierarchy_edges(s).join(names, "parent").join(ids, "child").select("target_id", "user_id", F.lit("inheritance").alias("usage"), F.col("relation").alias("kind"), F.lit(1).cast("long").alias("occurrence_count"))
    marked = s.class_annotations.groupBy("class_id", "annotation_name").agg(F.max("direct").alias("direct")).join(names, F.col("annotation_name") == F.col("parent"))
    marks_of = marked.select("target_id", F.col("class_id").alias("user_id"), F.lit("annotation").alias("usage"), F.when(F.col("direct"), "ANNOTATED_WITH").otherwise("META_ANNOTATED_WITH").alias("kind"), F.lit(1).cast("long").alias("occurrence_count"))
    rows = deps.unionByName(up).unionByName(marks_of).groupBy("target_id", "user_id", "usage", "kind").agg(F.sum("occurrence_count").alias("occurrences"))
    marks = seen.groupBy("target_id", "user_id", "usage", "kind").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))
    return rows.join(marks, ["target_id", "user_id", "usage", "kind"], "left").join(users, "user_id").select("target_id", "user_id", "class_name", "usage", "kind", "occurrences", F.coalesce("lines", F.lit("")).alias("lines"))


def method_usages(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Calls that reach methods declared by the targets (id), through any class that inherits them."""
    owners = resolved_owners(s).where("owner_id is not null").join(targets.select(F.col("id").alias("owner_id")), "owner_id")
    calls = s.method_calls.select("caller_class_id", "caller_method", F.col("target_class_id").alias("id"), F.col("target_method").alias("name"), F.col("target_descriptor").alias("descriptor"), "occurrence_count")
    return calls.join(owners, ["id", "name", "descriptor"]).select("owner_id", "name", "descriptor", F.col("id").alias("named_id"), "caller_class_id", "caller_method", "occurrence_count")


def field_usages(s: Snapshot, targets: DataFrame, *, access: str | None = None) -> DataFrame:
    """Accesses of the targets' (id) fields; ``access`` read or write."""
    rows = s.field_accesses.join(targets.select(F.col("id").alias("owner_class_id")), "owner_class_id")
    return rows.where(F.col("access_kind").startswith(f"{access}_")) if access else rows


def class_cards(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Per target (id): metrics, members by kind, direct annotations, external types."""
    chosen = targets.select("id")
    members = s.class_members.select(F.col("class_id").alias("id"), "kind").join(chosen, "id", "left_semi").groupBy("id").agg(F.count_if(F.col("kind") == "METHOD").alias("methods"), F.count_if(F.col("kind") == "FIELD").alias("fields"), F.count_if(F.col("kind") == "CONSTRUCTOR").alias("constructors"))
    own = lambda df: df.join(chosen.select(F.col("id").alias("class_id")), "class_id", "left_semi")
    marks = own(s.class_annotations.where("direct")).groupBy(F.col("class_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("annotation_name")), ",").alias("annotations"))
    types = own(s.external_deps).groupBy(F.col("class_id").alias("id")).agg(F.countDistinct("external_type").alias("external_types"))
    found = fan_metrics(s, chosen).join(members, "id", "left").join(marks, "id", "left").join(types, "id", "left")
    return found.select("id", "class_name", "fan_in", "fan_out", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("methods", "fields", "constructors", "external_types")], F.coalesce("annotations", F.lit("")).alias("annotations"))


# Terms that tell what a place does with a state.
STATE_TERMS = {
    "persistence": ("persist", "save", "store", "repository", "persistence", "entitymanager", "session", "dao"),
    "dispatch": ("dispatch", "submit", "publish", "send", "enqueue", "worker", "invoke", "execute"),
    "recovery": ("recover", "restore", "resume", "replay", "retry", "timer", "schedule", "timeout"),
    "serialization": ("serialize", "deserialize", "mapper", "codec", "json", "marshal", "unmarshal"),
}


def state_lifecycle(s: Snapshot, targets: DataFrame) -> DataFrame:
    """Where the targets (id) are created, read and written, with roles by terms in the place's class and method."""
    created = s.dependencies.where("kind = 'CONSTRUCTS'").join(targets.select(F.col("id").alias("to_class_id")), "to_class_id").select(F.col("to_class_id").alias("target_id"), F.col("from_class_id").alias("class_id"), F.lit("").alias("method"), F.lit("create").alias("event"), "occurrence_count")
    touched = field_usages(s, targets).select(F.col("owner_class_id").alias("target_id"), F.col("accessor_class_id").alias("class_id"), F.col("accessor_method").alias("method"), F.when(F.col("access_kind").startswith("read"), "read").otherwise("write").alias("event"), "occurrence_count")
    named = created.unionByName(touched).join(s.classes.select(F.col("id").alias("class_id"), "class_name"), "class_id")
    place = F.lower(F.concat_ws(" ", "class_name", "method"))
    roles = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(place, t)), F.lit(role)) for role, terms in STATE_TERMS.items()]))
    return named.groupBy("target_id", "class_id", "class_name", "method", "event").agg(F.sum("occurrence_count").alias("occurrences")).withColumn("roles", F.array_join(roles, ",")).withColumn("confidence", F.when(F.col("event") == "create", "high").when(F.col("roles") != "", "medium").otherwise("low"))
