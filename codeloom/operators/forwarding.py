"""Methods that a Kotlin compiler makes only to forward a call, recognised from relations, and usages seen through them.

A call is a forwarding one if what declarations, members and descriptors say leaves no other reading: methods that fill in default parameters,
overloads made for Java, facades of files and companions, hidden bridges. Chains of forwarding calls are
closed by doubling: five joins reach chains of 32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import Traversal, _first_of_each
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import stored

# Marks of compiler-made constructors, of default parameters and of overloads for Java.
CONSTRUCTOR_MARK, DEFAULT_MARK = "Lkotlin/jvm/internal/DefaultConstructorMarker;", "Ljava/lang/Object;"
OVERLOADS = ("kotlin.jvm.JvmOverloads", "@JvmOverloads")
#: A chain has at most 2 to this power calls.
DOUBLINGS = 5


def _parameters(descriptor: str) -> Column:
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^(\(.*)\)", 1), F.lit(r"(\[*(?:L[^;]+;|[ZBCSIJFD]))"), 1)


def _result(descriptor: str) -> Column:
    return F.regexp_extract(descriptor, r"\)(.*)$", 1)


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def forwarding_calls(s: Snapshot) -> DataFrame:
    """The calls of ``method_calls`` with ``forwards``: whether the caller does nothing but forward. ``kotlin_semantics`` (class_id, kind, jvm_name,
    descriptor, has_defaults, value_parameters, is_suspend, is_extension) has the declarations that are kept from the source."""
    said = s.kotlin_semantics
    names = s.classes.select("id", "class_name")
    rows = s.method_calls.join(names.withColumnsRenamed({"id": "caller_class_id", "class_name": "from_class"}), "caller_class_id").join(names.withColumnsRenamed({"id": "target_class_id", "class_name": "to_class"}), "target_class_id")
    callable_ = F.col("kind").isin("FUNCTION", "PROPERTY", "CONSTRUCTOR")
    has = lambda kind: F.max(F.col("kind") == kind)
    of = said.groupBy("class_id").agg(has("MULTIFILE_FACADE").alias("facade"), has("MULTIFILE_PART").alias("part"), has("COMPANION_OBJECT").alias("companion"), F.max((F.col("kind") == "CONSTRUCTOR") & F.col("has_defaults")).alias("makes_defaults"))
    rows = rows.join(of.select(F.col("class_id").alias("caller_class_id"), F.col("facade").alias("from_facade")), "caller_class_id").join(of.select(F.col("class_id").alias("target_class_id"), "part", "companion", "makes_defaults"), "target_class_id")
    exact = said.where(callable_).groupBy("class_id", "jvm_name", "descriptor").agg(F.max("has_defaults").alias("has_defaults"), F.max("value_parameters").alias("value_parameters"), F.max("is_suspend").alias("is_suspend"), F.max("is_extension").alias("is_extension"))
    key = lambda side: {"class_id": f"{side}_class_id", "jvm_name": f"{side}_method", "name": f"{side}_method", "descriptor": f"{side}_descriptor"}
    place = lambda side: [f"{side}_class_id", f"{side}_method", f"{side}_descriptor"]
    rows = rows.join(exact.withColumnsRenamed(key("caller")).select(*place("caller"), F.lit(True).alias("from_declared")), place("caller"), "left")
    rows = rows.join(exact.withColumnsRenamed(key("target")).withColumn("declared", F.lit(True)), place("target"), "left")
    by_name = said.where("kind = 'FUNCTION' AND has_defaults").select("class_id", "jvm_name").distinct()
    # a default method of the caller's name, or of the target's, declared where the target is
    rows = rows.join(by_name.select(F.col("class_id").alias("target_class_id"), F.col("jvm_name").alias("caller_method"), F.lit(True).alias("caller_defaults")), ["target_class_id", "caller_method"], "left")
    rows = rows.join(by_name.select(F.col("class_id").alias("target_class_id"), F.col("jvm_name").alias("target_method"), F.lit(True).alias("target_defaults")), ["target_class_id", "target_method"], "left")
    members = s.class_members.where("kind IN ('METHOD', 'CONSTRUCTOR')").groupBy("class_id", "name", "descriptor").agg(F.max(F.arrays_overlap(F.split("annotations", " "), F.array(*map(F.lit, OVERLOADS)))).alias("overload"))
    rows = rows.join(members.withColumnsRenamed(key("caller")).select(*place("caller"), F.lit(True).alias("physical"), F.col("overload").alias("from_overload")), place("caller"), "left")
    rows = rows.join(members.withColumnsRenamed(key("target")).select(*place("target"), F.col("overload").alias("to_overload")), place("target"), "left")
    outgoing = s.method_calls.groupBy(*place("caller")).agg(F.count(F.lit(1)).alias("outgoing"))
    rows = rows.join(outgoing, place("caller")).withColumn("f", _parameters("caller_descriptor")).withColumn("t", _parameters("target_descriptor"))
    return rows.withColumn("forwards", F.coalesce(_forwards(), F.lit(False))).select(*s.method_calls.columns, "forwards")


def _forwards() -> Column:
    fm, tm = F.col("caller_method"), F.col("target_method")
    same = F.col("caller_class_id") == F.col("target_class_id")
    makes = tm == "<init>"
    of_companion = F.col("to_class") == F.concat("from_class", F.lit("$Companion"))
    only = F.col("outgoing") == 1
    once = only & (F.col("occurrence_count") == 1)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    java_default = (tm == F.concat("caller_method", F.lit("$default"))) & (same | of_companion) & _yes("from_overload") & _yes("caller_defaults")
    known = makes | _yes("declared") | (_yes("target_defaults") & _yes("to_overload"))
    java_constructor = makes & same & (fm == "<init>") & (last(F.col("t")) == CONSTRUCTOR_MARK) & _yes("makes_defaults")
    fills = same & ((fm == F.concat("target_method", F.lit("$default"))) | (makes & (fm == "<init>")))
    mark = F.when(makes, CONSTRUCTOR_MARK).otherwise(DEFAULT_MARK)
    receiver = F.when(~makes & (F.try_element_at("f", F.lit(1)) == F.concat(F.lit("L"), F.translate("to_class", ".", "/"), F.lit(";"))) & (F.col("invocation_kind") != "static"), 1).otherwise(0)
    flag = lambda c: F.when(~makes & _yes(c), 1).otherwise(0)
    values = F.when(_yes("declared") & F.col("value_parameters").isNotNull(), F.col("value_parameters")).otherwise(F.size("t") - flag("is_suspend") - flag("is_extension"))
    masks = F.floor((values + 31) / 32).cast("int")
    begins = F.slice("f", receiver + 1, F.size("t")) == F.col("t")
    ends = F.forall(F.slice("f", receiver + F.size("t") + 1, F.greatest(masks, F.lit(0))), lambda x: x == "I")
    allowed = F.when(makes, ~_yes("declared") | _yes("has_defaults")).otherwise(_yes("declared") & _yes("has_defaults"))
    filled = allowed & (last(F.col("f")) == mark) & (_result("caller_descriptor") == _result("target_descriptor")) & (F.size("f") == receiver + F.size("t") + masks + 1) & begins & ends
    alike = same & (F.col("caller_descriptor") != F.col("target_descriptor")) & (_yes("from_overload") | (~_yes("physical") & (F.size("f") == F.size("t"))))
    parts = (_yes("from_facade") & _yes("part") & F.col("to_class").startswith(F.concat("from_class", F.lit("__")))) | (of_companion & _yes("companion"))
    return (
        F.when(_yes("from_declared"), False).when(java_default, only).when(~known, False).when(java_constructor, _yes("from_overload") & once).when(fills, filled).when(fm != tm, False)
        .when(alike, once).when(parts & (F.col("caller_descriptor") == F.col("target_descriptor")), once).otherwise(False)
    )


def _key(side: str) -> Column:
    return F.concat_ws("#", F.col(f"{side}_class_id").cast("string"), f"{side}_method", f"{side}_descriptor")


def forwarding_chains(edges: DataFrame, *, doublings: int = DOUBLINGS) -> DataFrame:
    """(src, dst, steps): where chains of ``edges`` (src, dst) lead, with the fewest steps; chains have at most 2 to the power of ``doublings``
    steps. Each join doubles the length. A chain that comes back to its start isn't one."""
    reach = stored(edges.select("src", "dst").where("src <> dst").distinct().withColumn("steps", F.lit(1)))
    for _ in range(doublings):
        on = reach.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("steps").alias("more"))
        further = reach.join(on, "dst").where("src <> end").select("src", F.col("end").alias("dst"), (F.col("steps") + F.col("more")).alias("steps"))
        new = stored(reach.unionByName(further).groupBy("src", "dst").agg(F.min("steps").alias("steps")))
        if new.count() == reach.count():
            return new
        reach = new
    return reach


def usages_through_forwarders(s: Snapshot, *, most: int = 5000) -> Traversal:
    """(target, caller, through, steps): calls of each method that are no forwarding ones, direct (no ``through``) or by the forwarding method that is called and
    the number of forwarding calls from there; for each target ``most`` at most, those of the fewest steps and the first names. The status has for
    each target how many there are and whether some were left out."""
    calls = stored(forwarding_calls(s).select(_key("caller").alias("src"), _key("target").alias("dst"), "forwards").distinct())
    chains = forwarding_chains(calls.where("forwards"))
    own = calls.where("NOT forwards")
    direct = own.select(F.col("dst").alias("target"), F.col("src").alias("caller"), F.lit("").alias("through"), F.lit(0).alias("steps"))
    seen = own.join(chains.select(F.col("src").alias("dst"), F.col("dst").alias("target"), "steps"), "dst").select("target", F.col("src").alias("caller"), F.col("dst").alias("through"), "steps")
    whole = stored(direct.unionByName(seen).distinct())
    status = whole.groupBy("target").agg(F.count(F.lit(1)).alias("found")).withColumn("truncated", F.col("found") > most)
    return Traversal(_first_of_each(whole, ["target"], ["steps", "caller", "through"], F.lit(most)), status)
