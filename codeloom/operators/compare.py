"""Two generations of an index: what changed, and what that means for users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import has_modifier
from codeloom.plans.snapshot import Snapshot, is_current
from codeloom.runtime import stored


def delta(current: DataFrame, desired: DataFrame) -> dict[str, DataFrame]:
    """What turns ``current`` into ``desired``: rows to delete and to insert (null equals null; each row once), and those that stay."""
    same = reduce(lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"d.{c}")) for c in desired.columns])
    c, d = current.select(desired.columns).alias("c"), desired.alias("d")
    return {"delete": c.join(d, same, "left_anti"), "insert": desired.subtract(current.select(desired.columns)), "unchanged": c.join(d, same, "left_semi")}


def delta_counts(current: DataFrame, desired: DataFrame) -> DataFrame:
    """(change, rows) of a delta."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("change"), "rows") for name, df in delta(current, desired).items()]
    return reduce(DataFrame.unionByName, parts)


def apply_delta(current: DataFrame, desired: DataFrame) -> DataFrame:
    """The desired rows, from what stays and what is inserted."""
    parts = delta(current, desired)
    return parts["unchanged"].distinct().unionByName(parts["insert"])


def class_fingerprints(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class_name, fingerprint): a hash of a class's facts and its sorted members."""
    own = members.groupBy(F.col("class_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "kind", "name", "descriptor", "modifiers", "annotations"))), ";").alias("members"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = classes.join(own, "id", "left")
    facts = [text(c) for c in ("kind", "superclass", "interface_name", "source_file", "is_bean", "origin", "module", "source_set", "members")]
    return whole.select("class_name", F.sha2(F.concat_ws("\n", *facts), 256).alias("fingerprint"))


def compare_classes(s: Snapshot) -> DataFrame:
    """(class_name, change) of classes added, removed or modified since the baseline."""
    before = class_fingerprints(s.baseline_classes, s.baseline_members).select("class_name", F.col("fingerprint").alias("was"))
    after = class_fingerprints(s.classes, s.class_members)
    both = after.join(before, "class_name", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("fingerprint").isNull(), "removed").when(F.col("was") != F.col("fingerprint"), "modified")
    return both.select("class_name", change.alias("change")).where("change is not null")


def _names(classes: DataFrame) -> DataFrame:
    """(id, class_name) of a generation's current classes. Ids mean something within their generation only."""
    return classes.where(is_current()).select("id", "class_name")


def compare_dependencies(s: Snapshot) -> DataFrame:
    """(dependency, change, was, is_now) of dependencies as ``A -> B [kind]``, each generation's by the names that its own current classes have."""

    def listed(df: DataFrame, classes: DataFrame, column: str) -> DataFrame:
        named = _names(classes)
        rows = df.join(named.select(F.col("id").alias("from_class_id"), F.col("class_name").alias("a")), "from_class_id").join(named.select(F.col("id").alias("to_class_id"), F.col("class_name").alias("b")), "to_class_id")
        return rows.groupBy(F.concat("a", F.lit(" -> "), "b", F.lit(" ["), "kind", F.lit("]")).alias("dependency")).agg(F.sum("occurrence_count").alias(column))

    both = listed(s.dependencies, s.classes, "is_now").join(listed(s.baseline_dependencies, s.baseline_classes, "was"), "dependency", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(F.col("was") != F.col("is_now"), "modified")
    return both.select("dependency", change.alias("change"), "was", "is_now").where("change is not null")


def _bean_names(beans: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class_name, bean): beans as ``class [kind] member``."""
    member = F.coalesce(F.col("member_name"), F.lit("")) if "member_name" in beans.columns else F.lit("")
    return beans.join(_names(classes).withColumnRenamed("id", "class_id"), "class_id").select("id", "class_name", F.concat("class_name", F.lit(" ["), "kind", F.lit("] "), member).alias("bean"))


def compare_beans(s: Snapshot) -> DataFrame:
    """(bean, change) of beans added or removed since the baseline, as ``class [kind] member`` with the class of their own generation."""
    now, was = (_bean_names(b, c).select("bean").distinct() for b, c in ((s.beans, s.classes), (s.baseline_beans, s.baseline_classes)))
    return now.join(was, "bean", "left_anti").withColumn("change", F.lit("added")).unionByName(was.join(now, "bean", "left_anti").withColumn("change", F.lit("removed")))


def injection_values(points: DataFrame, beans: DataFrame, classes: DataFrame) -> DataFrame:
    """(injection, value) of one generation's ``points`` (bean_id, field_name, target_type, qualifier, status[, kind, reason]): each as
    ``class#field [kind:type:qualifiers]`` and how it is resolved; of several alike the greatest."""
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in points.columns else F.lit(other)
    of = points.join(_bean_names(beans, classes).select(F.col("id").alias("bean_id"), "class_name"), "bean_id")
    name = F.concat("class_name", F.lit("#"), text("field_name", ""), F.lit(" ["), text("kind", "FIELD"), F.lit(":"), "target_type", F.lit(":"), text("qualifier", ""), F.lit("]"))
    return of.groupBy(name.alias("injection")).agg(F.max(F.concat("status", F.lit(":"), text("reason", ""))).alias("value"))


def compare_injections(before: DataFrame, after: DataFrame) -> DataFrame:
    """(injection, change, was, is_now) of injection points (injection, value) that were added, removed or are resolved in another way."""
    both = before.select("injection", F.col("value").alias("was")).join(after.select("injection", F.col("value").alias("is_now")), "injection", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(F.col("was") != F.col("is_now"), "resolution_changed")
    return both.select("injection", change.alias("change"), "was", "is_now").where("change is not null")


def _visibility(modifiers: str) -> Column:
    m = F.col(modifiers)
    return F.when(m.isNull(), F.lit(None)).when(has_modifier(m, "public"), 3).when(has_modifier(m, "protected"), 2).when(has_modifier(m, "private"), 0).otherwise(1)


# What a change of a declaration means to those who use it.
ASSESSMENTS = {
    "AMBIGUOUS_OWNER": "unknown", "CLASS_ADDED": "review_required", "CLASS_REMOVED": "potentially_breaking", "CLASS_KIND_CHANGED": "potentially_breaking", "HIERARCHY_CHANGED": "potentially_breaking",
    "CLASS_ANNOTATIONS_CHANGED": "review_required", "ABSTRACT_METHOD_ADDED": "potentially_breaking", "MEMBER_ADDED": "review_required", "MEMBER_REMOVED_OR_DESCRIPTOR_CHANGED": "potentially_breaking",
    "VISIBILITY_NARROWED": "potentially_breaking", "VISIBILITY_WIDENED": "review_required", "STATIC_INSTANCE_CHANGED": "potentially_breaking", "FINAL_ADDED": "potentially_breaking",
    "JVM_API_EVIDENCE_INCOMPLETE": "unknown", "CLASS_VISIBILITY_NARROWED": "potentially_breaking", "CLASS_VISIBILITY_WIDENED": "review_required", "CLASS_FINAL_ADDED": "potentially_breaking",
    "CLASS_ABSTRACT_ADDED": "potentially_breaking", "CLASS_OTHER_MODIFIERS_CHANGED": "review_required", "CLASS_GENERIC_SIGNATURE_CHANGED": "review_required", "GENERIC_SIGNATURE_CHANGED": "review_required",
    "THROWS_CHANGED": "review_required", "CONSTANT_VALUE_CHANGED": "review_required", "ABSTRACT_ADDED": "potentially_breaking", "SOURCE_SIGNATURE_CHANGED": "review_required", "ANNOTATIONS_CHANGED": "review_required", "OTHER_MODIFIERS_CHANGED": "review_required",
}
_KEY = ["class_name", "module", "source_set"]


def _owners(classes: DataFrame, annotations: DataFrame, was: str) -> DataFrame:
    """Production classes by key; of a key that several have, none can be compared."""
    live = classes.where(F.coalesce("source_set", F.lit("main")) == "main").withColumns({c: F.coalesce(c, F.lit("")) for c in _KEY[1:]})
    marks = annotations.groupBy(F.col("class_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("annotation_name")), ",").alias("marks"))
    facts = live.join(marks, "id", "left").select(*_KEY, "id", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("superclass", "interface_name", "marks")])
    return facts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("id", "kind", "superclass", "interface_name", "marks")]).withColumnsRenamed({c: f"{was}{c}" for c in ("n", "id", "kind", "superclass", "interface_name", "marks")})


def api_findings(s: Snapshot) -> DataFrame:
    """(class_name, module, source_set, member, reason, assessment): changes of production classes, and of their public and
    protected members, since the baseline; owners are told apart by name, module and source set."""
    now = _owners(s.classes, s.class_annotations.where("direct"), "")
    owners = now.join(_owners(s.baseline_classes, s.baseline_annotations, "was_"), _KEY, "full")
    clear = owners.where("coalesce(n, 1) = 1 AND coalesce(was_n, 1) = 1")
    kept = clear.where("id IS NOT NULL AND was_id IS NOT NULL")
    found = lambda *rules: F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])))
    one = owners.where("n > 1 OR was_n > 1").select(*_KEY, F.lit("AMBIGUOUS_OWNER").alias("reason"))
    one = one.unionByName(clear.select(*_KEY, found(("CLASS_ADDED", F.col("was_id").isNull()), ("CLASS_REMOVED", F.col("id").isNull())).alias("reason")))
    differs = lambda *names: reduce(lambda a, b: a | b, [F.col(c) != F.col(f"was_{c}") for c in names])
    changed = found(("CLASS_KIND_CHANGED", differs("kind")), ("HIERARCHY_CHANGED", differs("superclass", "interface_name")), ("CLASS_ANNOTATIONS_CHANGED", differs("marks")))
    of_classes = one.unionByName(kept.select(*_KEY, changed.alias("reason"))).select(*_KEY, F.lit("").alias("member"), "reason")

    sides = []
    for members, i, was in ((s.class_members, "id", ""), (s.baseline_members, "was_id", "was_")):
        own = members.select(F.col("class_id").alias(i), F.concat_ws(" ", "kind", "name", "descriptor").alias("member"), (F.col("kind") == "METHOD").alias("method"), "modifiers", "parameter_types", F.concat_ws(" ", F.array_sort(F.split("annotations", " "))).alias("annotations"))
        sides.append(kept.select(*_KEY, i).join(own, i).drop(i).withColumnsRenamed({c: f"{was}{c}" for c in ("method", "modifiers", "parameter_types", "annotations")}))
    both = sides[0].join(sides[1], [*_KEY, "member"], "full")
    level, was_level = _visibility("modifiers"), _visibility("was_modifiers")
    both = both.where((F.coalesce(level, F.lit(0)) >= 2) | (F.coalesce(was_level, F.lit(0)) >= 2))
    has = lambda f, was="": has_modifier(F.col(f"{was}modifiers"), f)
    there = F.col("modifiers").isNotNull() & F.col("was_modifiers").isNotNull()
    abstract = F.col("was_modifiers").isNull() & F.col("method") & has("abstract") & ~has("static")
    other = lambda was: F.array_sort(F.array_except(F.split(f"{was}modifiers", r"\s+"), F.array(*map(F.lit, ("public", "protected", "private", "static", "final", "abstract", "")))))
    rules = found(
        ("ABSTRACT_METHOD_ADDED", abstract), ("MEMBER_ADDED", F.col("was_modifiers").isNull() & ~abstract), ("MEMBER_REMOVED_OR_DESCRIPTOR_CHANGED", F.col("modifiers").isNull()),
        ("VISIBILITY_NARROWED", there & (level < was_level)), ("VISIBILITY_WIDENED", there & (level > was_level)), ("STATIC_INSTANCE_CHANGED", there & (has("static") != has("static", "was_"))),
        ("FINAL_ADDED", there & has("final") & ~has("final", "was_")), ("ABSTRACT_ADDED", there & has("abstract") & ~has("abstract", "was_")), ("SOURCE_SIGNATURE_CHANGED", there & differs("parameter_types")),
        ("ANNOTATIONS_CHANGED", there & differs("annotations")),
        ("OTHER_MODIFIERS_CHANGED", there & ((other("") != other("was_")) | has("final", "was_") & ~has("final") | has("abstract", "was_") & ~has("abstract"))),
    )
    whole = of_classes.unionByName(both.select(*_KEY, "member", rules.alias("reason")))
    return whole.withColumn("assessment", F.coalesce(*[F.when(F.col("reason") == k, F.lit(v)) for k, v in ASSESSMENTS.items()]))


def jvm_api_findings(s: Snapshot) -> DataFrame:
    """(class_name, module, source_set, member, reason, before, after, assessment): changes that class files tell and declarations don't: flags and generic
    signatures of production classes; generic signatures, exceptions and constants of their public and protected members. ``jvm_api`` and
    ``baseline_jvm_api`` (class_id, member, field, value) are compared field by field, by owners as in :func:`api_findings`. A class of which only one
    generation has evidence is incomplete."""
    now, was = _owners(s.classes, s.class_annotations.where("direct"), ""), _owners(s.baseline_classes, s.baseline_annotations, "was_")
    kept = stored(now.join(was, _KEY).where("n = 1 AND was_n = 1").select(*_KEY, "id", "was_id"))
    told = kept.join(s.jvm_api.select(F.col("class_id").alias("id"), "member", "field", F.col("value").alias("after")), "id").drop("id", "was_id")
    before = kept.join(s.baseline_jvm_api.select(F.col("class_id").alias("was_id"), "member", "field", F.col("value").alias("before")), "was_id").drop("id", "was_id")
    sides = told.select(*_KEY, F.lit("after").alias("side")).unionByName(before.select(*_KEY, F.lit("before").alias("side"))).distinct().groupBy(*_KEY).count()
    incomplete = sides.where(F.col("count") == 1).select(*_KEY, F.lit("").alias("member"), F.lit("JVM_API_EVIDENCE_INCOMPLETE").alias("reason"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    both = told.join(before, [*_KEY, "member", "field"]).where("before <> after")
    old, new = (F.filter(F.split(c, " "), lambda f: f != "") for c in ("before", "after"))
    level = lambda flags: F.when(F.array_contains(flags, "public"), 3).when(F.array_contains(flags, "protected"), 2).when(F.array_contains(flags, "private"), 0).otherwise(1)
    has = lambda flags, f: F.array_contains(flags, f)
    other = lambda flags: F.array_sort(F.array_except(flags, F.array(*map(F.lit, ("public", "private", "protected", "final", "abstract")))))
    rules = F.array(
        F.when(level(new) < level(old), "CLASS_VISIBILITY_NARROWED").when(level(new) > level(old), "CLASS_VISIBILITY_WIDENED"), F.when(~has(old, "final") & has(new, "final"), "CLASS_FINAL_ADDED"),
        F.when(~has(old, "abstract") & has(new, "abstract"), "CLASS_ABSTRACT_ADDED"), F.when((other(old) != other(new)) | (has(old, "final") & ~has(new, "final")) | (has(old, "abstract") & ~has(new, "abstract")), "CLASS_OTHER_MODIFIERS_CHANGED"),
    )
    of_flags = both.where("member = '' AND field = 'flags'").select(*_KEY, "member", F.explode(F.array_compact(rules)).alias("reason"), "before", "after")
    of_class = both.where("member = '' AND field = 'signature'").select(*_KEY, "member", F.lit("CLASS_GENERIC_SIGNATURE_CHANGED").alias("reason"), "before", "after")
    shown = lambda members, i: members.where(F.coalesce(_visibility("modifiers"), F.lit(0)) >= 2).select(F.col("class_id").alias(i), F.concat_ws(" ", "kind", "name", "descriptor").alias("member"))
    public = kept.join(shown(s.class_members, "id"), "id").select(*_KEY, "member").unionByName(kept.join(shown(s.baseline_members, "was_id"), "was_id").select(*_KEY, "member")).distinct()
    reason = F.when(F.col("field") == "signature", "GENERIC_SIGNATURE_CHANGED").when(F.col("field") == "exceptions", "THROWS_CHANGED").when(F.col("field") == "constant", "CONSTANT_VALUE_CHANGED")
    of_members = both.where("member <> ''").join(public, [*_KEY, "member"], "left_semi").select(*_KEY, "member", reason.alias("reason"), "before", "after").where("reason is not null")
    whole = incomplete.unionByName(of_flags).unionByName(of_class).unionByName(of_members)
    return whole.withColumn("assessment", F.coalesce(*[F.when(F.col("reason") == k, F.lit(v)) for k, v in ASSESSMENTS.items()]))


def api_verdict(findings: DataFrame) -> DataFrame:
    """The gravest assessment of each class, and how many findings it has."""
    rank = F.when(F.col("assessment") == "potentially_breaking", 2).when(F.col("assessment") == "unknown", 1).otherwise(0)
    return findings.groupBy("class_name").agg(F.max_by("assessment", rank).alias("verdict"), F.count(F.lit(1)).alias("findings"))


def finding_impact(s: Snapshot) -> DataFrame:
    """Baseline users of classes with breaking findings: distinct classes that depend on them."""
    broken = api_findings(s).where("assessment = 'potentially_breaking'").select("class_name").distinct()
    ids = s.baseline_classes.select("class_name", F.col("id").alias("to_class_id")).join(broken, "class_name", "left_semi")
    return ids.join(s.baseline_dependencies, "to_class_id").groupBy("class_name").agg(F.countDistinct("from_class_id").alias("users"), F.sum("occurrence_count").alias("occurrences"))
