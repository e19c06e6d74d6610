"""Routes from annotations, composed and inherited.

A route annotation may stand on another annotation, whose elements are aliases of its own. What an annotation means is worked out level by
level over all uses at once: a use becomes a row for each annotation on its annotation, with the values that nearer
levels have given to elements further on, until a route annotation is reached. The nearest value wins; of one
level two different ones leave the use without a mapping.

A class without a mapping of its own (or a method, found by name and parameters) has that of its interfaces, if just one of
these has any, else its superclass's; several are a conflict. Where a supertype isn't in the index, nothing is
inherited. Selections spread from the types that have mappings down the hierarchy until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import has_modifier, package_name
from codeloom.operators.graph import OBJECT, distances, interfaces
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import drop_stored, stored

# Route annotations and the verbs that they imply.
SPRING = "org.springframework.web.bind.annotation."
REQUEST = f"{SPRING}RequestMapping"
IMPLIED = {f"{SPRING}GetMapping": "GET", f"{SPRING}PostMapping": "POST", f"{SPRING}PutMapping": "PUT", f"{SPRING}DeleteMapping": "DELETE", f"{SPRING}PatchMapping": "PATCH"}
JAX = ("jakarta.ws.rs.", "javax.ws.rs.")
JAX_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
TOKEN = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"
#: Annotations on annotations are followed so far.
DEEPEST = 32

_TEXTS = "array<string>"
_MAP = f"map<string,{_TEXTS}>"


def _none(kind: str) -> Column:
    return F.expr(f"CAST(map() AS {kind})")


def _over(low: Column, high: Column) -> Column:
    """Entries of both maps, of keys in both those of ``high``."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def _definitions(s: Snapshot) -> DataFrame:
    """(annotation, defaults, locals, foreign, metas): what each annotation of the index says of its elements and of those that it has."""
    rows = s.annotation_elements
    own = F.col("alias_annotation").isNull() | F.col("alias_annotation").isin("java.lang.annotation.Annotation") | (F.col("alias_annotation") == F.col("annotation"))
    rows = rows.withColumn("own", own).withColumn("other", F.when(F.coalesce("alias_element", F.lit("")) != "", F.col("alias_element")))
    named = rows.select("annotation", F.col("element").alias("other"), F.lit(True).alias("known"), F.col("own").alias("other_own"))
    local = rows.where("aliased AND own AND other is not null").join(named, ["annotation", "other"], "left")
    local = local.groupBy("annotation").agg(F.array_sort(F.collect_list(F.struct("element", "other"))).alias("locals"), F.min(F.coalesce("known", F.lit(False)) & F.coalesce("other_own", F.lit(False))).alias("sound"))
    foreign = rows.where("aliased AND NOT own").groupBy("annotation", F.col("alias_annotation").alias("target"), F.coalesce("other", "element").alias("to")).agg(F.array_sort(F.collect_list("element")).alias("elements"))
    foreign = foreign.groupBy("annotation").agg(F.array_sort(F.collect_list(F.struct("target", "to", "elements"))).alias("foreign"))
    defaults = rows.where("default_values is not null").groupBy("annotation").agg(F.map_from_entries(F.collect_list(F.struct("element", "default_values"))).alias("defaults"))
    metas = s.annotation_metas.groupBy("annotation", "meta").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("element", "values")), lambda x: x["element"] != "")).alias("given"))
    metas = metas.where(~F.col("meta").startswith("java.lang.annotation.")).groupBy("annotation").agg(F.array_sort(F.collect_list(F.struct("meta", F.map_entries("given").alias("given")))).alias("metas"))
    names = rows.select("annotation").union(s.annotation_metas.select("annotation")).distinct()
    return names.join(defaults, "annotation", "left").join(local, "annotation", "left").join(foreign, "annotation", "left").join(metas, "annotation", "left")


def route_annotations(s: Snapshot) -> DataFrame:
    """(annotation): the route annotations, and all on which one stands, directly or through others."""
    roots = s.spark.createDataFrame([(r,) for r in (REQUEST, *IMPLIED)], "node string")
    on = s.annotation_metas.select(F.col("meta").alias("src"), F.col("annotation").alias("dst"))
    return distances(on, roots).select(F.col("node").alias("annotation"))


def composed_mappings(s: Snapshot) -> DataFrame:
    """(class_id, name, descriptor, verbs, paths, evidence): what the route annotations mean that classes (no name) and methods have, directly or
    through others; ``evidence`` is the way to the route annotation. Uses whose values contradict each other have no row."""
    marks = s.annotation_uses.where("position is null").join(stored(route_annotations(s)), "annotation", "left_semi")
    uses = marks.groupBy("class_id", "name", "descriptor", "annotation").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("element", "values")), lambda x: x["element"] != "")).alias("given"))
    what = stored(_definitions(s))
    level = uses.withColumn("node", F.col("annotation")).withColumn("way", F.array("annotation")).withColumn("over", _none(f"map<string,{_MAP}>")).drop("annotation")
    roots, found = (REQUEST, *IMPLIED), []
    for _ in range(DEEPEST):
        level = stored(level)
        if level.isEmpty():
            break
        full = level.join(what.withColumnRenamed("annotation", "node"), "node", "left")
        mine = F.coalesce(F.element_at("over", F.col("node")), _none(_MAP))
        values = _over(_over(F.coalesce("defaults", _none(_MAP)), F.col("given")), mine)
        full = full.withColumn("mine", mine).withColumn("values", values)
        found.append(_reached(full.where(F.col("node").isin(*roots))))
        level = _further(full.where(~F.col("node").isin(*roots)))
    whole = found[0] if found else _reached(level.where("false"))
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def _reached(full: DataFrame) -> DataFrame:
    given = _over(F.coalesce(F.element_at("over", F.lit(REQUEST)), _none(_MAP)), F.col("mine"))
    full = full.withColumn("above", given).withColumn("values", _over(F.col("values"), given))
    of = lambda m, k: F.coalesce(F.element_at(m, F.lit(k)), F.array().cast(_TEXTS))
    has = lambda k: F.map_contains_key("above", F.lit(k))
    # path and value mirror each other
    path = F.when(has("value") & ~has("path"), of("above", "value")).otherwise(of("values", "path"))
    value = F.when(has("path") & ~has("value"), of("above", "path")).otherwise(of("values", "value"))
    full = full.withColumn("p", path).withColumn("v", value).where("size(p) = 0 OR size(v) = 0 OR p = v")
    implied = F.coalesce(*[F.when(F.col("node") == k, F.array(F.lit(v))) for k, v in IMPLIED.items()])
    verbs = F.when((F.col("node") == REQUEST) | has("method"), of("values", "method")).otherwise(implied)
    paths = F.when(F.size("p") > 0, F.col("p")).when(F.size("v") > 0, F.col("v")).otherwise(F.array(F.lit("")))
    return full.select("class_id", "name", "descriptor", verbs.alias("verbs"), paths.alias("paths"), F.col("way").alias("evidence"))


def _further(full: DataFrame) -> DataFrame:
    """The next level: a row for each annotation on the one that a row has reached."""
    said = lambda l: F.coalesce(F.element_at("mine", l["element"]), F.element_at("given", l["element"]))
    pairs = F.coalesce("locals", F.array().cast("array<struct<element:string,other:string>>"))
    clash = F.exists(pairs, lambda l: said(l).isNotNull() & F.element_at("given", l["other"]).isNotNull() & (said(l) != F.element_at("given", l["other"])))
    mirrored = F.aggregate(pairs, F.col("values"), lambda acc, l: F.when(said(l).isNull(), acc).otherwise(_over(acc, F.create_map(l["other"], said(l)))))
    full = full.where(F.coalesce("sound", F.lit(True)) & ~F.coalesce(clash, F.lit(False))).withColumn("values", mirrored)
    links = F.coalesce("foreign", F.array().cast("array<struct<target:string,to:string,elements:array<string>>>"))
    some = lambda x: F.filter(F.transform(x["elements"], lambda e: F.element_at("values", e)), lambda v: v.isNotNull())
    full = full.withColumn("sent", F.transform(links, lambda x: F.struct(x["target"].alias("target"), x["to"].alias("to"), some(x).alias("all"), F.array_distinct(F.filter(some(x), lambda v: F.size(v) > 0)).alias("full"))))
    taken = lambda x: F.coalesce(F.map_contains_key(F.element_at("over", x["target"]), x["to"]), F.lit(False))
    full = full.where(~F.exists("sent", lambda x: (F.size(x["full"]) > 1) & ~taken(x)))
    full = full.withColumn("sent", F.filter("sent", lambda x: (F.size(x["all"]) > 0) & ~taken(x)))
    one = lambda x: F.when(F.size(x["full"]) > 0, F.element_at(x["full"], 1)).otherwise(F.array().cast(_TEXTS))
    of = lambda t: F.map_from_entries(F.transform(F.filter("sent", lambda x: x["target"] == t), lambda x: F.struct(x["to"], one(x))))
    targets = F.array_distinct(F.transform("sent", lambda x: x["target"]))
    new = F.map_from_entries(F.transform(targets, lambda t: F.struct(t, _over(of(t), F.coalesce(F.element_at("over", t), _none(_MAP))))))
    wide = full.withColumn("over", _over(F.col("over"), new)).withColumn("meta", F.explode("metas"))
    wide = wide.where(~F.array_contains("way", F.col("meta.meta")))
    return wide.select("class_id", "name", "descriptor", F.map_from_entries("meta.given").alias("given"), F.col("meta.meta").alias("node"), F.concat("way", F.array("meta.meta")).alias("way"), "over")


def _keys(s: Snapshot) -> DataFrame:
    """(class_id, name, descriptor, key, modifiers): methods by name and parameters; one that a bridge calls has the bridge's too, which are
    those of the generic method that it implements."""
    rows = s.class_members.where("kind = 'METHOD' AND name NOT LIKE '<%'")
    key = lambda d: F.concat("name", F.regexp_extract(d, r"^(\(.*\))", 1))
    real = rows.where(~(has_modifier(F.col("modifiers"), "bridge") | has_modifier(F.col("modifiers"), "synthetic")))
    bridges = rows.where(has_modifier(F.col("modifiers"), "bridge")).select("class_id", "name", F.col("descriptor").alias("bridge"))
    calls = s.method_calls.where("caller_class_id = target_class_id AND caller_method = target_method").select(F.col("caller_class_id").alias("class_id"), F.col("caller_method").alias("name"), F.col("caller_descriptor").alias("bridge"), F.col("target_descriptor").alias("descriptor"))
    more = real.join(bridges.join(calls, ["class_id", "name", "bridge"]), ["class_id", "name", "descriptor"])
    return real.select("class_id", "name", "descriptor", key("descriptor").alias("key"), "modifiers").unionByName(more.select("class_id", "name", "descriptor", key("bridge").alias("key"), "modifiers")).distinct()


def _parents(s: Snapshot) -> DataFrame:
    """(id, parent, face): the supertypes of classes by id, null where the index hasn't them; the root of all isn't one."""
    up = s.classes.where("superclass is not null").select("id", F.col("superclass").alias("name"), F.lit(False).alias("face")).unionByName(interfaces(s).select("id", F.col("interface_name").alias("name"), F.lit(True).alias("face")))
    known = s.classes.select(F.col("id").alias("parent"), F.col("class_name").alias("name"))
    return up.where(F.col("name") != OBJECT).join(known, "name", "left").select("id", "parent", "face").distinct()


def _spread(own: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, key, state) of the types below those of ``own`` (id, key, state): their own, else the only one of their interfaces, else the
    superclass's; several of interfaces make a blocked one."""
    links = parents.where("parent is not null")
    nothing = F.struct(F.array().cast("array<struct<verbs:array<string>,paths:array<string>,evidence:array<string>>>").alias("mappings"), F.array().cast(_TEXTS).alias("sources"), F.lit(True).alias("blocked"))
    state = own
    while True:
        met = links.join(state.withColumnRenamed("id", "parent"), "parent").groupBy("id", "key").agg(F.collect_set(F.when(F.col("face"), F.col("state"))).alias("faces"), F.min(F.when(~F.col("face"), F.col("state"))).alias("above"))
        taken = met.join(own.select("id", "key"), ["id", "key"], "left_anti")
        new = own.unionByName(taken.select("id", "key", F.when(F.size("faces") == 1, F.element_at("faces", 1)).when(F.size("faces") > 1, nothing).otherwise(F.col("above")).alias("state")))
        new = stored(new)
        if new.exceptAll(state).isEmpty() and new.count() == state.count():
            return new
        if state is not own:
            drop_stored(state)
        state = new


def declared_routes(s: Snapshot) -> DataFrame:
    """(class_id, class_name, name, descriptor, declaring_id, framework, verbs, bases, paths, evidence, sources): the routes of each class that
    isn't an annotation, one row for each method and framework: its own methods and those that it inherits."""
    marks = s.annotation_uses
    parents = stored(_parents(s))
    keys = stored(_keys(s))
    mapped = stored(composed_mappings(s))
    jax = _jax(s, marks)
    # keys that have any route, and the types that have them
    routes = stored(mapped.where("name <> ''").select("class_id", "name", "descriptor").union(jax["marked"].select("class_id", "name", "descriptor")).union(_unclear(s, mapped).where("name <> ''").select("class_id", "name", "descriptor")).distinct())
    wanted = stored(keys.join(routes, ["class_id", "name", "descriptor"]).select("class_id", "key").distinct())
    down = parents.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    owners = stored(distances(down, wanted.select(F.col("class_id").alias("node")).distinct()).select("node"))
    annotations = s.classes.where("kind = 'ANNOTATION'").select(F.col("id").alias("node"))
    owners = stored(owners.join(annotations, "node", "left_anti"))
    up = stored(distances(down.select(F.col("dst").alias("src"), F.col("src").alias("dst")), owners.select(F.col("node").alias("origin"), "node")).select(F.col("origin").alias("owner"), F.col("node").alias("declaring"), "depth"))
    lost = up.join(parents.where("parent is null").select(F.col("id").alias("declaring")), "declaring", "left_semi").select("owner").distinct()
    effective = stored(_effective(s, keys.join(wanted.select("key").distinct(), "key", "left_semi"), up, lost, down))
    return _spring(s, mapped, effective, keys, parents, lost).unionByName(_of_jax(jax, effective, keys, up, lost, down, s)).join(s.classes.select(F.col("id").alias("class_id"), "class_name"), "class_id").select("class_id", "class_name", "name", "descriptor", "declaring_id", "framework", "verbs", "bases", "paths", "evidence", "sources")


def _unclear(s: Snapshot, mapped: DataFrame) -> DataFrame:
    """(class_id, name, descriptor) with route annotations that have no clear meaning."""
    marks = s.annotation_uses.where("position is null").join(stored(route_annotations(s)), "annotation", "left_semi").select("class_id", "name", "descriptor").distinct()
    return marks.join(mapped.select("class_id", "name", "descriptor"), ["class_id", "name", "descriptor"], "left_anti")


def _effective(s: Snapshot, keys: DataFrame, up: DataFrame, lost: DataFrame, down: DataFrame) -> DataFrame:
    """(owner, declaring, name, descriptor, key, modifiers): the methods that each owner has: of its classes the nearest one, else the only most
    specific one of its interfaces if that has a body; of an owner whose supertypes aren't all known only its own."""
    kinds = s.classes.select(F.col("id").alias("declaring"), F.col("kind").alias("declaring_kind"), package_name(F.col("class_name"), "").alias("declaring_package"))
    home = s.classes.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"), package_name(F.col("class_name"), "").alias("package"))
    rows = up.join(keys.withColumnRenamed("class_id", "declaring"), "declaring").join(kinds, "declaring").join(home, "owner")
    flag = lambda *names: F.arrays_overlap(F.split("modifiers", r"\s+"), F.array(*map(F.lit, names)))
    seen = (F.col("depth") == 0) | (~flag("private", "static") & (flag("public", "protected") | (F.col("package") == F.col("declaring_package"))))
    rows = rows.where(seen).join(lost.withColumn("lost", F.lit(True)), "owner", "left").where("depth = 0 OR lost is null")
    by_class = rows.where("declaring_kind <> 'INTERFACE' OR depth = 0").withColumn("n", F.row_number().over(Window.partitionBy("owner", "key").orderBy("depth", "declaring", "descriptor"))).where("n = 1")
    faces = rows.where("declaring_kind = 'INTERFACE'").join(by_class.select("owner", "key"), ["owner", "key"], "left_anti")
    best = _most_specific(faces, down).where(~has_modifier(F.col("modifiers"), "abstract"))
    out = ["owner", "declaring", "name", "descriptor", "key", "modifiers"]
    return by_class.select(out).unionByName(best.select(out))


def _most_specific(rows: DataFrame, down: DataFrame) -> DataFrame:
    """Of ``rows`` (owner, key, declaring, ...) of interfaces those of owners and keys for which one has all others above it."""
    below = distances(down, rows.select(F.col("declaring").alias("origin"), F.col("declaring").alias("node")).distinct()).where("depth > 0").select(F.col("origin").alias("declaring"), F.col("node").alias("lower"))
    shadowed = rows.join(below, "declaring").join(rows.select("owner", "key", F.col("declaring").alias("lower")).distinct(), ["owner", "key", "lower"], "left_semi").select("owner", "key", "declaring").distinct()
    left = rows.join(shadowed, ["owner", "key", "declaring"], "left_anti")
    one = left.groupBy("owner", "key").agg(F.countDistinct("declaring").alias("n")).where("n = 1").select("owner", "key")
    return left.join(one, ["owner", "key"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("owner", "key").orderBy("descriptor"))).where("n = 1").drop("n")


def _source(kind: str) -> Column:
    return F.concat(F.lit("class:"), "class_name") if kind == "class" else F.concat(F.lit("method:"), "class_name", F.lit("#"), "name", "descriptor")


def _spring(s: Snapshot, mapped: DataFrame, effective: DataFrame, keys: DataFrame, parents: DataFrame, lost: DataFrame) -> DataFrame:
    named = s.classes.select(F.col("id").alias("class_id"), "class_name")
    one = F.struct("verbs", "paths", "evidence")
    whole = mapped.groupBy("class_id", "name", "descriptor").agg(F.array_sort(F.collect_set(one)).alias("mappings")).withColumn("blocked", F.lit(False))
    whole = whole.unionByName(_unclear(s, mapped).withColumn("mappings", F.array().cast(whole.schema["mappings"].dataType)).withColumn("blocked", F.lit(True))).join(named, "class_id")
    source = F.when(F.col("blocked"), F.array().cast(_TEXTS))
    state = lambda kind: F.struct("mappings", source.otherwise(F.array(_source(kind))).alias("sources"), "blocked").alias("state")
    of_class = stored(whole.where("name = ''").select(F.col("class_id").alias("id"), F.lit("").alias("key"), state("class")))
    of_method = stored(whole.where("name <> ''").join(keys.drop("modifiers"), ["class_id", "name", "descriptor"]).select(F.col("class_id").alias("id"), "key", state("method")).dropDuplicates(["id", "key"]))
    above = _spread(of_class, parents).join(of_class.select("id", F.lit(True).alias("own")), "id", "left").join(lost.withColumnsRenamed({"owner": "id"}).withColumn("lost", F.lit(True)), "id", "left")
    # of a class whose supertypes aren't all known, what it inherits isn't known either
    above = above.select(F.col("id").alias("owner"), F.col("state.mappings").alias("class_mappings"), F.col("state.sources").alias("class_sources"), (F.col("state.blocked") | (F.col("own").isNull() & F.col("lost").isNotNull())).alias("class_blocked"))
    unknown = lost.join(of_class.select(F.col("id").alias("owner")), "owner", "left_anti").withColumn("unknown", F.lit(True))
    found = _spread(of_method, parents).join(of_method.select("id", "key", F.lit(True).alias("own")), ["id", "key"], "left").join(lost.withColumnsRenamed({"owner": "id"}).withColumn("lost", F.lit(True)), "id", "left").where("own is not null OR lost is null")
    # a method may be known by several keys
    more = keys.withColumnRenamed("class_id", "declaring").select("declaring", "name", "descriptor", F.col("key").alias("by"))
    met = effective.drop("key", "modifiers").distinct().join(more, ["declaring", "name", "descriptor"]).join(found.select(F.col("id").alias("declaring"), F.col("key").alias("by"), "state"), ["declaring", "by"])
    met = met.groupBy("owner", "declaring", "name", "descriptor").agg(F.collect_set("state").alias("states")).where(F.size("states") == 1).withColumn("state", F.element_at("states", 1))
    rows = met.join(above, "owner", "left").join(unknown, "owner", "left").where("NOT state.blocked AND size(state.mappings) = 1 AND NOT coalesce(class_blocked, false) AND unknown is null AND coalesce(size(class_mappings), 0) <= 1")
    m, c = F.element_at("state.mappings", 1), F.try_element_at("class_mappings", F.lit(1))
    verbs = F.array_sort(F.array_union(m["verbs"], F.coalesce(c["verbs"], F.array().cast(_TEXTS))))
    return rows.select(
        F.col("owner").alias("class_id"), "name", "descriptor", F.col("declaring").alias("declaring_id"), F.lit("spring").alias("framework"), F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("ANY"))).alias("verbs"),
        F.coalesce(c["paths"], F.array(F.lit(""))).alias("bases"), m["paths"].alias("paths"), m["evidence"].alias("evidence"), F.array_distinct(F.concat(F.coalesce("class_sources", F.array().cast(_TEXTS)), "state.sources")).alias("sources"),
    )


def _jax(s: Snapshot, marks: DataFrame) -> dict[str, DataFrame]:
    """``marked``: methods with annotations of JAX-RS, on them or on a parameter; ``said``: their verbs, paths and evidence; ``bases``: of classes."""
    http = F.col("meta").isin(*(f"{p}HttpMethod" for p in JAX))
    custom = s.annotation_metas.where(http).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("element") == "value", F.element_at("values", 1))).alias("verb"), F.max(F.when(F.col("element") == "value", F.size("values"))).alias("size"))
    custom = stored(custom.select("annotation", F.when((F.col("n") == 1) & (F.col("size") == 1) & F.col("verb").rlike(TOKEN), F.col("verb")).alias("custom"), F.lit(True).alias("designates")))
    own = F.col("annotation").startswith(JAX[0]) | F.col("annotation").startswith(JAX[1])
    rows = marks.where("name <> ''").join(custom, "annotation", "left").where(own | F.col("designates"))
    short = F.regexp_extract("annotation", r"^(?:jakarta|javax)\.ws\.rs\.(\w+)$", 1)
    verb = F.when(short.isin(*JAX_VERBS), short).otherwise(F.col("custom"))
    path = (short == "Path") & (F.col("element") == "value")
    said = rows.where("position is null").groupBy("class_id", "name", "descriptor").agg(
        F.array_sort(F.collect_set(verb)).alias("verbs"), F.array_distinct(F.flatten(F.collect_list(F.when(path, F.col("values"))))).alias("paths"), F.array_sort(F.collect_set(F.when(verb.isNotNull() | (short == "Path"), F.col("annotation")))).alias("evidence")
    )
    bases = marks.where("name = '' AND element = 'value'").where(F.col("annotation").isin(*(f"{p}Path" for p in JAX))).groupBy("class_id").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("bases"))
    return {"marked": stored(rows.select("class_id", "name", "descriptor").distinct()), "said": stored(said.where("size(evidence) > 0")), "bases": bases}


def _of_jax(jax: dict[str, DataFrame], effective: DataFrame, keys: DataFrame, up: DataFrame, lost: DataFrame, down: DataFrame, s: Snapshot) -> DataFrame:
    """Routes of public methods: as the method itself says, else the nearest class that says anything, else the only most specific interface."""
    methods = effective.where(has_modifier(F.col("modifiers"), "public"))
    marked = stored(keys.join(jax["marked"], ["class_id", "name", "descriptor"]).select(F.col("class_id").alias("source"), F.col("name").alias("source_name"), F.col("descriptor").alias("source_descriptor"), "key"))
    # a method's own annotations count, whatever key it is found by
    more = keys.withColumnRenamed("class_id", "declaring").select("declaring", "name", "descriptor", F.col("key").alias("by"))
    named = methods.select("owner", "declaring", "name", "descriptor").distinct().join(more, ["declaring", "name", "descriptor"])
    own = named.join(jax["marked"].withColumnRenamed("class_id", "declaring"), ["declaring", "name", "descriptor"], "left_semi")
    direct = own.select("owner", "declaring", "name", "descriptor", F.col("declaring").alias("source"), F.col("name").alias("source_name"), F.col("descriptor").alias("source_descriptor")).distinct()
    rest = named.join(own.select("owner", "declaring", "name", "descriptor").distinct(), ["owner", "declaring", "name", "descriptor"], "left_anti").join(lost, "owner", "left_anti")
    kinds = s.classes.select(F.col("id").alias("source"), F.col("kind").alias("source_kind"))
    met = rest.join(up.select("owner", F.col("declaring").alias("source"), "depth"), "owner").join(marked.withColumnRenamed("key", "by"), ["source", "by"]).join(kinds, "source")
    place = Window.partitionBy("owner", "declaring", "name", "descriptor").orderBy("depth", "source", "source_descriptor")
    by_class = met.where("source_kind <> 'INTERFACE'").withColumn("n", F.row_number().over(place)).where("n = 1")
    faces = met.where("source_kind = 'INTERFACE'").join(by_class.select("owner", "declaring", "name", "descriptor"), ["owner", "declaring", "name", "descriptor"], "left_anti")
    faces = faces.withColumnsRenamed({"declaring": "home", "descriptor": "own_descriptor", "source": "declaring"}).withColumn("key", F.concat_ws("#", "home", "name", "own_descriptor")).withColumn("descriptor", F.col("source_descriptor"))
    best = _most_specific(faces.dropDuplicates(["owner", "key", "declaring", "descriptor"]), down)
    out = ["owner", "declaring", "name", "descriptor", "source", "source_name", "source_descriptor"]
    chosen = direct.select(out).unionByName(by_class.select(out)).unionByName(best.select("owner", F.col("home").alias("declaring"), "name", F.col("own_descriptor").alias("descriptor"), F.col("declaring").alias("source"), "source_name", "source_descriptor"))
    said = jax["said"].withColumnsRenamed({"class_id": "source", "name": "source_name", "descriptor": "source_descriptor"})
    names = s.classes.select(F.col("id").alias("source"), F.col("class_name").alias("source_class"))
    homes = s.classes.select(F.col("id").alias("owner"), F.col("class_name").alias("owner_class"))
    rows = chosen.join(said, ["source", "source_name", "source_descriptor"]).join(jax["bases"].withColumnRenamed("class_id", "owner"), "owner", "left").join(names, "source").join(homes, "owner")
    method = F.array(F.concat(F.lit("method:"), "source_class", F.lit("#"), "source_name", "source_descriptor"))
    return rows.select(
        F.col("owner").alias("class_id"), "name", "descriptor", F.col("declaring").alias("declaring_id"), F.lit("jax-rs").alias("framework"), F.when(F.size("verbs") > 0, F.col("verbs")).otherwise(F.array(F.lit("SUBRESOURCE"))).alias("verbs"),
        F.coalesce("bases", F.array(F.lit(""))).alias("bases"), F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit(""))).alias("paths"), "evidence",
        F.when(F.col("bases").isNull(), method).otherwise(F.concat(F.array(F.concat(F.lit("class:"), "owner_class")), method)).alias("sources"),
    )
