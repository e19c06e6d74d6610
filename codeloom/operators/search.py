"""Searches and listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codeloom.functions.paging import page
from codeloom.functions.source import use_at
from codeloom.functions.text import base_name, contains_pattern, has_modifier, is_main, library_of, outer_name, package_glob, package_name, path_glob, property_pattern, simple_name
from codeloom.operators.endpoints import declared_routes
from codeloom.operators.graph import _first_of_each, closure_of, distances
from codeloom.operators.metrics import edges_between_current
from codeloom.operators.risk import file_kind
from codeloom.plans.snapshot import Snapshot, is_production
from codeloom.runtime import ship, stored


def in_module(s: Snapshot, classes: DataFrame, module: str | None, source_set: str | None = None) -> DataFrame:
    """Classes of which any occurrence is in the module (and source set); the class's own module counts only without occurrences."""
    if module is None and source_set is None:
        return classes
    fits = F.lit(True)
    for name, value in (("module", module), ("source_set", source_set)):
        if value is not None:
            fits = fits & (F.col(name) == value)
    of = s.class_occurrences.select(F.col("class_id").alias("id"), "module", "source_set")
    return classes.join(of.where(fits).select("id"), "id", "left_semi").unionByName(classes.where(fits).join(of.select("id"), "id", "left_anti"))


def search_classes(s: Snapshot, pattern: str, *, module: str | None = None, source_set: str | None = None, limit: int | None = 30, offset: int = 0) -> DataFrame:
    """Current classes by name, case-insensitively: a substring, or a pattern with ``*``."""
    found = in_module(s, s.current().where(F.col("class_name").ilike(contains_pattern(pattern))), module, source_set)
    found = found.select("id", "class_name", "kind", "source_file", "module").orderBy("class_name")
    return page(found, limit, offset)


def declared_members(s: Snapshot, members: DataFrame | None = None, wanted: Column | None = None, *, alone: bool = True) -> DataFrame:
    """Members (all, or those given) with their Kotlin declarations, null without one: functions by JVM name and descriptor, properties by JVM name and
    their descriptor if they have one. The disjunction is a union of two equality joins and, with ``alone``, what neither finds. ``wanted`` is a
    condition on ``semantic_kind`` and ``semantic_name``."""
    members = s.class_members if members is None else members
    decl = s.kotlin_declarations.select("class_id", F.col("kind").alias("semantic_kind"), F.col("name").alias("semantic_name"), F.col("jvm_name").alias("name"), "descriptor")
    decl = decl if wanted is None else decl.where(wanted)
    exact = members.join(decl.where("semantic_kind = 'FUNCTION' OR descriptor <> ''"), ["class_id", "name", "descriptor"]).select(*members.columns, "semantic_kind", "semantic_name")
    loose = members.join(decl.where("semantic_kind = 'PROPERTY' AND descriptor = ''").drop("descriptor"), ["class_id", "name"]).select(*members.columns, "semantic_kind", "semantic_name")
    found = exact.unionByName(loose)
    if not alone:
        return found
    rest = members.join(found.select("class_id", "kind", "name", "descriptor"), ["class_id", "kind", "name", "descriptor"], "left_anti").select(*members.columns)
    none = F.lit(None).cast("string")
    return found.unionByName(rest.withColumn("semantic_kind", none).withColumn("semantic_name", none))


def search_symbols(s: Snapshot, pattern: str, *, kind: str | None = None, language: str | None = None, limit: int | None = 50) -> DataFrame:
    """Current classes by simple name and their members by name, signature or Kotlin name; neither bridges nor synthetic members.
    ``kind`` is a class's or member's kind, ``language`` (java or kotlin) that of the source file."""
    like = contains_pattern(pattern)
    source = s.current().select(F.col("id").alias("class_id"), "class_name", F.col("kind").alias("class_kind"), F.when(F.col("source_file").endswith(".kt"), "kotlin").otherwise("java").alias("language"))
    none = F.lit("")
    types = source.select("class_name", F.col("class_kind").alias("symbol_kind"), simple_name(F.col("class_name")).alias("symbol_name"), none.alias("signature"), none.alias("semantic_name"), "language").where(F.col("symbol_name").ilike(like))
    # what may match by itself is filtered before it is joined with its declaration, as are declarations before they are joined with members
    shown = s.class_members.where(~(F.col("modifiers").contains("synthetic") | F.col("modifiers").contains("bridge")))
    alike = F.coalesce(F.col("name").ilike(like) | F.concat("name", "descriptor").ilike(like), F.lit(False))
    if s.has("kotlin_declarations"):
        of_name = declared_members(s, shown.where(alike))
        of_declaration = declared_members(s, shown.where(~alike), F.col("semantic_name").ilike(like), alone=False)
        own = of_name.unionByName(of_declaration)
    else:
        own = shown.where(alike).withColumn("semantic_name", F.lit(None).cast("string"))
    members = own.select("class_id", F.col("kind").alias("symbol_kind"), F.col("name").alias("symbol_name"), F.concat("name", "descriptor").alias("signature"), F.coalesce("semantic_name", none).alias("semantic_name")).join(source, "class_id").select(types.columns)
    found = types.unionByName(members)
    for name, value in (("symbol_kind", kind), ("language", language)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return page(found.orderBy("symbol_name", "class_name", "signature", "semantic_name"), limit)


def search_properties(s: Snapshot, pattern: str) -> DataFrame:
    """Fields of current classes by a pattern for ``class.name`` in which only ``*`` is special."""
    fields = s.class_members.where(F.col("kind") == "FIELD").join(s.current().select(F.col("id").alias("class_id"), "class_name"), "class_id")
    return fields.where(F.concat_ws(".", "class_name", "name").rlike(property_pattern(pattern))).select("class_id", "class_name", "name")


def search_files(s: Snapshot, pattern: str, *, extension: str | None = None, directory: str | None = None, kind: str | None = None, include_deleted: bool = False, limit: int | None = 50) -> DataFrame:
    """Files (of a kind, see ``risk.file_kind``) by glob or, without a wildcard, by substring; ranked: exact path, exact base name, path
    prefix, base-name prefix, glob, substring; then by path. A glob without ``/`` is for base names."""
    path, low, name = F.col("path"), F.lower("path"), F.lower(base_name(F.col("path")))
    want, wild = pattern.lower(), any(c in pattern for c in "*?")
    match = (path if "/" in pattern else base_name(path)).rlike(path_glob(pattern)) if wild else low.contains(want)
    rank = F.when(low == want, 0).when(name == want, 1).when(low.startswith(want), 2).when(name.startswith(want), 3).otherwise(4 if wild else 5)
    found = s.files if include_deleted else s.files.where("lifecycle <> 'deleted'")
    if directory:
        found = found.where(path.startswith(directory.rstrip("/") + "/"))
    if extension:
        found = found.where(path.endswith("." + extension.lstrip(".")))
    if kind:
        found = found.where(file_kind(path) == kind)
    return page(found.where(match).select("path", "lifecycle", rank.alias("rank")).orderBy("rank", "path"), limit)


def project_tree(s: Snapshot, path: str = "", *, depth: int = 2, limit: int | None = 100) -> DataFrame:
    """Folders and files below a folder (or all) down to a depth from there: path, whether it is a file, files below."""
    top = path.strip("/")
    above = len(top.split("/")) if top else 0
    parts = F.split("path", "/")
    levels = F.explode(F.sequence(F.lit(above + 1), F.least(F.size(parts), F.lit(above + depth))))
    files = s.files.where("lifecycle <> 'deleted'")
    rows = (files.where(F.col("path").startswith(f"{top}/")) if top else files).select("path", levels.alias("level"))
    prefix = F.array_join(F.slice(F.split("path", "/"), 1, F.col("level")), "/")
    return page(rows.select(prefix.alias("entry"), "level", (prefix == F.col("path")).alias("file")).groupBy("entry").agg(F.min("level").alias("level"), F.max("file").alias("is_file"), F.count(F.lit(1)).alias("files")).orderBy("entry"), limit)


def search_external(s: Snapshot, pattern: str, *, mode: str = "contains", kind: str | None = None, class_name: str | None = None, library: str | None = None, limit: int | None = 50) -> DataFrame:
    """External types whose qualified or simple name is equal to, starts with or contains a text; stars are dropped. Of those
    that are used in a way (``kind``), by classes with a part of a name, or that are in a library (the first two parts of a name)."""
    want = pattern.replace("*", "").lower()
    test = {"exact": lambda c: c == want, "prefix": lambda c: c.startswith(want), "contains": lambda c: c.contains(want)}[mode]
    used = s.external_deps
    if kind is not None:
        used = used.where(F.col("usage_kind") == kind)
    if library is not None:
        used = used.where(library_of(F.col("external_type")) == library)
    if class_name is not None:
        used = used.join(s.current().where(F.lower("class_name").contains(class_name.lower())).select(F.col("id").alias("class_id")), "class_id", "left_semi")
    names = used.select("external_type").distinct()
    return page(names.where(test(F.lower("external_type")) | test(F.lower(simple_name(F.col("external_type"))))).orderBy("external_type"), limit)


def external_details(s: Snapshot, name: str) -> DataFrame:
    """(external_type, status, usage_kind, classes): uses by kind of the external type of a qualified name, or without one of the types of
    that simple name; several of those are ambiguous."""
    rows = s.external_deps.where((F.col("external_type") == name) | (simple_name(F.col("external_type")) == name))
    found = rows.withColumn("whole", (F.col("external_type") == name).cast("int"))
    best = found.agg(F.max("whole").alias("whole"), F.countDistinct("external_type").alias("types"))
    kept = found.join(best.select("whole", F.when((F.col("whole") == 1) | (F.col("types") == 1), "resolved").otherwise("ambiguous").alias("status")), "whole")
    return kept.groupBy("external_type", "status", "usage_kind").agg(F.countDistinct("class_id").alias("classes"))


def list_beans(s: Snapshot, *, scope: str | None = None, kind: str | None = None, profile: str | None = None, qualifier: str | None = None, module: str | None = None, limit: int | None = 50) -> DataFrame:
    """Beans with their classes; every filter that is given has to hold (the qualifier as a part)."""
    found = s.beans
    for name, value in (("scope", scope), ("kind", kind), ("profile", profile), ("module", module)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if qualifier is not None:
        found = found.where(F.col("qualifier").contains(qualifier))
    named = s.classes.select(F.col("id").alias("class_id"), "class_name", "origin")
    return page(found.join(named, "class_id").select("id", "class_name", "origin", "kind", "scope", "qualifier").orderBy("class_name", "origin", "kind", "id"), limit)


def project_dependencies(s: Snapshot, *, query: str | None = None, scope: str | None = None, directness: str | None = None) -> DataFrame:
    """Visible modules: who sees them and whether directly, through any number of others or both; by a part of the name, a scope
    among theirs, and directness (direct, transitive or mixed)."""
    direct = s.module_edges.select(F.col("visible").alias("artifact"), F.col("module"), F.lit("direct").alias("how"), "relation")
    starts = s.module_edges.select(F.col("module").alias("origin"), F.col("visible").alias("node"))
    reach = distances(s.module_edges.select(F.col("module").alias("src"), F.col("visible").alias("dst")), starts)
    onward = reach.alias("a").join(s.module_edges.alias("b"), F.col("a.node") == F.col("b.module")).select(F.col("b.visible").alias("artifact"), F.col("a.origin").alias("module"), F.lit("transitive").alias("how"), F.col("b.relation"))
    by = direct.unionByName(onward).groupBy("artifact").agg(F.countDistinct("module").alias("consumers"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("scopes"), F.array_sort(F.collect_set("how")).alias("hows"))
    found = by.select("artifact", "consumers", "scopes", F.when(F.size("hows") > 1, "mixed").otherwise(F.col("hows")[0]).alias("directness"))
    if query:
        found = found.where(F.lower("artifact").contains(query.lower()))
    if scope:
        found = found.where(F.array_contains(F.split("scopes", ","), scope))
    return found.where(F.col("directness") == directness) if directness else found


# Route annotations, and the verbs that they stand for.
JAX, SPRING = ("jakarta.ws.rs.", "javax.ws.rs."), "org.springframework.web.bind.annotation."
JAX_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
SPRING_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
REST_CLASSES = (*(f"{p}Path" for p in JAX), "org.springframework.stereotype.Controller", f"{SPRING}RestController", f"{SPRING}RequestMapping")
REST_METHODS = (*(f"{p}{v}" for p in JAX for v in ("Path", *JAX_VERBS)), f"{SPRING}RequestMapping", *(f"{SPRING}{m}" for m in SPRING_VERBS))


def _parts(column: str) -> Column:
    return F.filter(F.split(column, "\n"), lambda x: x != "")


def _endpoint_filters(found: DataFrame, s: Snapshot, http_method: str | None, path_prefix: str | None, framework: str | None, module: str | None, source_set: str | None) -> DataFrame:
    if http_method:
        found = found.where((F.col("http_method") == http_method) | (F.col("http_method") == "ANY"))
    if path_prefix:
        found = found.where(F.col("path").startswith("/" + path_prefix.strip("/")))
    if framework:
        found = found.where(F.col("framework") == framework)
    homes = s.current().select(F.col("id").alias("class_id"), "module", F.coalesce("source_set", F.lit("main")).alias("source_set"))
    for column, value in (("module", module), ("source_set", source_set)):
        if value is not None:
            found = found.join(homes.where(F.col(column) == value).select("class_id"), "class_id", "left_semi")
    return found


def _joined_path() -> Column:
    whole = F.regexp_replace(F.concat_ws("/", F.lit(""), "base", "path"), "/+", "/")
    return F.when(F.length(whole) > 1, F.regexp_replace(whole, "/$", "")).otherwise(whole)


def declared_endpoints(s: Snapshot, *, http_method: str | None = None, path_prefix: str | None = None, framework: str | None = None, module: str | None = None, source_set: str | None = None) -> DataFrame:
    """(class_id, class_name, name, descriptor, framework, http_method, path) of current classes: one row for each verb and path of the routes that
    they declare, compose from annotations of annotations, or inherit."""
    rows = declared_routes(s).join(s.current().select(F.col("id").alias("class_id")), "class_id", "left_semi")
    wide = rows.withColumn("http_method", F.explode("verbs")).withColumn("base", F.explode("bases")).withColumn("path", F.explode("paths"))
    found = wide.select("class_id", "class_name", "name", "descriptor", "framework", "http_method", _joined_path().alias("path")).distinct()
    return _endpoint_filters(found, s, http_method, path_prefix, framework, module, source_set)


def framework_endpoints(s: Snapshot, *, http_method: str | None = None, path_prefix: str | None = None, framework: str | None = None, module: str | None = None, source_set: str | None = None) -> DataFrame:
    """Routes of current classes: class paths with method paths, one row for each verb and path. ``endpoint_marks``
    has the values of route annotations, joined by line ends: of a class where the name is empty, else of a method. Spring's verbs without
    one are ANY, a JAX-RS path without a verb is a SUBRESOURCE. Slashes between parts are one."""
    name = F.col("annotation")
    spring = name.startswith(SPRING)
    marks = s.endpoint_marks.withColumn("framework", F.when(spring, "spring").when(name.startswith(JAX[0]) | name.startswith(JAX[1]), "jax-rs")).where("framework is not null")
    short = F.substring_index("annotation", ".", -1)
    implied = F.when(spring, F.coalesce(*[F.when(short == m, F.array(F.lit(v))) for m, v in SPRING_VERBS.items()])).otherwise(F.when(short.isin(*JAX_VERBS), F.array(short)))
    marks = marks.withColumn("v", F.coalesce(implied, _parts("verbs"))).withColumn("p", _parts("paths"))
    of = lambda rows: [F.array_distinct(F.flatten(F.collect_list(c))).alias(n) for c, n in rows]
    own = marks.where("name <> ''").groupBy("class_id", "name", "descriptor", "framework").agg(*of((("v", "verbs"), ("p", "paths"))))
    above = marks.where("name = ''").groupBy("class_id", "framework").agg(*of((("v", "class_verbs"), ("p", "bases"))))
    rows = own.join(above, ["class_id", "framework"], "left").join(s.current().select(F.col("id").alias("class_id"), "class_name"), "class_id")
    empty = F.array(F.lit(""))
    some = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(empty)
    verbs = F.array_distinct(F.concat("verbs", F.coalesce("class_verbs", F.array().cast("array<string>"))))
    none = F.when(F.col("framework") == "spring", "ANY").otherwise("SUBRESOURCE")
    wide = rows.select("class_id", "class_name", "name", "descriptor", "framework", F.when(F.size(verbs) > 0, verbs).otherwise(F.array(none)).alias("verbs"), some("bases").alias("bases"), some("paths").alias("paths"))
    wide = wide.withColumn("http_method", F.explode("verbs")).withColumn("base", F.explode("bases")).withColumn("path", F.explode("paths"))
    found = wide.select("class_id", "class_name", "name", "descriptor", "framework", "http_method", _joined_path().alias("path")).distinct()
    return _endpoint_filters(found, s, http_method, path_prefix, framework, module, source_set)


# Annotations that make a class or a method an entry point, by kind.
CLASS_RULES = {"rest_resource": REST_CLASSES}
METHOD_RULES = {
    "rest_endpoint": REST_METHODS,
    "observer": ("jakarta.enterprise.event.Observes", "jakarta.enterprise.event.ObservesAsync", "javax.enterprise.event.Observes", "javax.enterprise.event.ObservesAsync"),
    "scheduled": (
        "io.quarkus.scheduler.Scheduled", "io.quarkus.scheduler.Scheduled.ConcurrentExecution", "org.springframework.scheduling.annotation.Scheduled", "jakarta.ejb.Schedule", "jakarta.ejb.Schedules",
        "javax.ejb.Schedule", "javax.ejb.Schedules", "io.micronaut.scheduling.annotation.Scheduled",
    ),
    "message_consumer": (
        "org.eclipse.microprofile.reactive.messaging.Incoming", "org.springframework.kafka.annotation.KafkaListener", "org.springframework.jms.annotation.JmsListener",
        "org.springframework.amqp.rabbit.annotation.RabbitListener", "org.springframework.pulsar.annotation.PulsarListener", "io.quarkus.vertx.ConsumeEvent",
    ),
}
PROCESSORS = ("javax.annotation.processing.Processor", "javax.annotation.processing.AbstractProcessor")


def entry_points(s: Snapshot, *, include_generated: bool = False, include_tests: bool = False, class_rules: dict[str, tuple[str, ...]] = CLASS_RULES, method_rules: dict[str, tuple[str, ...]] = METHOD_RULES) -> DataFrame:
    """Entry points of current classes, each once for each kind: program mains, annotated classes and methods, annotation
    processors by their supertypes, and registered services. Direct evidence is high, an annotation of an annotation medium."""
    classes = s.current()
    if not include_generated:
        classes = classes.where("origin <> 'generated'")
    if not include_tests:
        classes = classes.where(is_production())
    owners = classes.select(F.col("id").alias("class_id"), "class_name")
    rules = lambda r: F.broadcast(s.spark.createDataFrame([(k, a) for k, names in r.items() for a in names], "entry_kind string, annotation string"))
    members = s.class_members.where("kind = 'METHOD'").join(owners, "class_id")
    columns = ["class_id", "class_name", "name", "descriptor", "entry_kind", "confidence"]
    marked = members.withColumn("annotation", F.explode(F.split("annotations", " "))).join(rules(method_rules), "annotation").withColumn("confidence", F.lit("high")).select(columns).distinct()
    main = members.where(is_main()).withColumn("entry_kind", F.lit("main")).withColumn("confidence", F.lit("high")).select(columns)
    whole = lambda df: df.withColumn("name", F.lit("<type>")).withColumn("descriptor", F.lit("")).select(columns)
    resources = s.class_annotations.join(rules(class_rules), F.col("annotation_name") == F.col("annotation")).groupBy("class_id", "entry_kind").agg(F.max("direct").alias("direct"))
    resources = whole(resources.join(owners, "class_id").withColumn("confidence", F.when(F.col("direct"), "high").otherwise("medium")))
    processors = closure_of(s, s.spark.createDataFrame([(p,) for p in PROCESSORS], "name string")).withColumnRenamed("name", "class_name")
    services = s.service_registrations.select("class_id", F.when(F.col("service_type").endswith("annotation.processing.Processor"), "annotation_processor").otherwise("service_provider").alias("entry_kind"))
    typed = owners.join(processors, "class_name", "left_semi").withColumn("entry_kind", F.lit("annotation_processor")).select("class_id", "class_name", "entry_kind")
    typed = whole(typed.unionByName(services.join(owners, "class_id").select("class_id", "class_name", "entry_kind")).distinct().withColumn("confidence", F.lit("high")))
    return marked.unionByName(main).unionByName(resources).unionByName(typed)


def architecture_violations(s: Snapshot, source: str, forbidden: list[str], *, limit: int | None = 100) -> DataFrame:
    """Dependencies of production code in packages that match ``source`` on packages that match one of
    ``forbidden``, named by the first that does; most occurrences first."""
    edges = edges_between_current(s, "class_name", "origin", "source_set").where(is_production("from_") & is_production("to_") & (F.col("from_origin") != "generated") & (F.col("to_origin") != "generated"))
    rule = F.coalesce(*[F.when(package_name(F.col("to_class_name"), "").rlike(package_glob(p)), F.lit(p)) for p in forbidden])
    hits = edges.where(package_name(F.col("from_class_name"), "").rlike(package_glob(source))).withColumn("rule", rule).where("rule is not null")
    return page(hits.select(F.col("from_class_name").alias("source"), F.col("to_class_name").alias("target"), "kind", "occurrence_count", "rule").orderBy(F.desc("occurrence_count"), "source", "target", "kind"), limit)


def class_by_path(s: Snapshot, path: str) -> DataFrame:
    """The first current class by name whose source, or whose indexed file if it has one, is at a path."""
    of = s.current().join(s.class_files.withColumnRenamed("class_id", "id"), "id", "left")
    whole = of.join(s.files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left")
    return whole.where((F.col("source_file") == path) | (F.col("file_path") == path)).select("id", "class_name", "file_path").orderBy("class_name").limit(1)


def di_problems(s: Snapshot, *, limit: int | None = None) -> DataFrame:
    """Problems of dependency-injection specifications that the index has, in order; a class's id may be null."""
    return page(s.di_problems.select("id", "class_id", "class_name", "problem_type", "message").orderBy("id"), limit)


def enclosing_classes(s: Snapshot, path: str, line: int) -> DataFrame:
    """Classes of a file that begin at a line or above it, nearest first. Only history is left out."""
    return s.classes.where((F.col("source_file") == path) & (F.col("source_line") <= line) & (F.col("lifecycle") == "current")).select("id", "class_name", "source_line").orderBy(F.desc("source_line"), "class_name").limit(10)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Declarations that a use may mean, by evidence: same file +20, enclosing class +25, constructor
    context +100 (constructor), +40 (type) or -50 (other), call context +80 (method) or -30, member access
    +70 (field or property), arguments match +30, may use defaults +10, don't match -20, don't apply -150.
    Columns: group, name, kind, same_file, enclosing, context (constructor, call, member or none), arguments
    (match, possible_default, mismatch, not_applicable or none). Adds score, place and decisive: alone at the top."""
    context, kind = F.col("context"), F.col("kind")
    score = (
        F.when(F.col("same_file"), 20).otherwise(0)
        + F.when(F.col("enclosing"), 25).otherwise(0)
        + F.when(context == "constructor", F.when(kind == "CONSTRUCTOR", 100).when(kind.isin("CLASS", "INTERFACE"), 40).otherwise(-50)).otherwise(0)
        + F.when(context == "call", F.when(kind == "METHOD", 80).otherwise(-30)).otherwise(0)
        + F.when((context == "member") & kind.isin("FIELD", "PROPERTY"), 70).otherwise(0)
        + F.when(F.col("arguments") == "match", 30).when(F.col("arguments") == "possible_default", 10).when(F.col("arguments") == "mismatch", -20).when(F.col("arguments") == "not_applicable", -150).otherwise(0)
    )
    scored = candidates.withColumn("score", score)
    order = Window.partitionBy("group").orderBy(F.desc("score"), "name")
    return scored.withColumn("place", F.row_number().over(order)).withColumn("decisive", (F.col("place") == 1) & (F.coalesce(F.lead("score").over(order), F.lit(-10_000)) < F.col("score")))


def symbol_candidates(s: Snapshot, identifier: str, path: str, line: int, *, context: str = "none", limit: int | None = 200) -> DataFrame:
    """Declarations that an identifier at a line of a file may mean, ranked: current classes by simple name and
    their members by name, those of the same file first. The class that begins nearest above the line encloses it."""
    here = (F.col("source_file") == path).alias("same_file")
    near = enclosing_classes(s, path, line).limit(1).select(F.col("id").alias("class_id"), F.lit(True).alias("enclosing"))
    live = s.classes.where("lifecycle = 'current'")
    types = live.where(simple_name(F.col("class_name")) == identifier).select(F.col("id").alias("class_id"), F.col("class_name").alias("name"), "kind", here)
    owners = live.select(F.col("id").alias("class_id"), "class_name", "source_file")
    members = s.class_members.where(F.col("name") == identifier).join(owners, "class_id").select("class_id", F.concat("class_name", F.lit("#"), "name", "descriptor").alias("name"), "kind", here)
    found = types.unionByName(members).orderBy(F.desc("same_file"), "name").limit(limit or 200).join(F.broadcast(near), "class_id", "left")
    return rank_candidates(found.select(F.lit(0).alias("group"), "name", "kind", "same_file", F.coalesce("enclosing", F.lit(False)).alias("enclosing"), F.lit(context).alias("context"), F.lit("none").alias("arguments"))).select("name", "kind", "score", "place", "decisive")


def uses_at(positions: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, line, column, identifier, receiver, context, arguments): what stands at positions (path, line, column) of sources (path, line,
    text, following): the name, what it is said of, how it is used, and with how many arguments. Positions without a name have no row."""
    ship(positions.sparkSession)
    at = positions.select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("int").alias("column")).distinct()
    rows = at.join(sources.select("path", F.col("line").cast("long").alias("line"), "text", "following"), ["path", "line"])
    kind = _parse_datatype_string("path string, line long, column int, identifier string, receiver string, context string, arguments int")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                use = use_at(r["text"] or "", r["column"], r["following"] or "")
                if use:
                    out.append({k: r[k] for k in ("path", "line", "column")} | use)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, kind)


def symbols_at(s: Snapshot, positions: DataFrame, sources: DataFrame, *, limit: int = 200) -> DataFrame:
    """(path, line, column, identifier, context, name, kind, score, place, decisive): the declarations that the name at each position may
    mean, ranked by :func:`rank_candidates`; ``limit`` for each position, of the same file first. The class of the file that begins
    nearest above the line encloses it. A method's or constructor's arguments are compared by number."""
    uses = stored(uses_at(positions, sources)).withColumn("group", F.concat_ws(":", "path", "line", "column"))
    live = s.classes.where("lifecycle = 'current'").select(F.col("id").alias("class_id"), "class_name", F.col("kind").alias("class_kind"), "source_file", "source_line")
    types = live.select(simple_name(F.col("class_name")).alias("identifier"), "class_id", F.col("class_name").alias("name"), F.col("class_kind").alias("kind"), "source_file", F.lit(None).cast("int").alias("parameters"))
    count = F.when(F.col("parameter_types") == "", 0).otherwise(F.size(F.split("parameter_types", ",")))
    own = s.class_members.join(live, "class_id")
    # a constructor is called by its class's name
    called = F.when(F.col("kind") == "CONSTRUCTOR", simple_name(F.col("class_name"))).otherwise(F.col("name"))
    members = own.select(called.alias("identifier"), "class_id", F.concat("class_name", F.lit("#"), "name", "descriptor").alias("name"), "kind", "source_file", F.when(F.col("kind") != "FIELD", count).alias("parameters"))
    wanted = uses.select("identifier").distinct()
    found = types.join(wanted, "identifier", "left_semi").unionByName(members.join(wanted, "identifier", "left_semi"))
    # of other files a position shows only what is among the first of all with its name, so a name's declarations are ranked once
    found = stored(found)
    others = _first_of_each(found, ["identifier"], ["name", "kind", "class_id"], F.lit(limit))
    same = F.coalesce(F.col("source_file") == F.col("path"), F.lit(False)).alias("same_file")
    rows = uses.join(others, "identifier").select("*", same).where("NOT same_file")
    rows = rows.unionByName(uses.join(found, (uses.identifier == found.identifier) & (F.col("source_file") == F.col("path"))).drop(found.identifier).select("*", same))
    near = uses.join(live, (F.col("source_file") == F.col("path")) & (F.col("source_line") <= F.col("line"))).groupBy("group").agg(F.max_by("class_id", F.struct("source_line", F.negative("class_id"))).alias("near"))
    first = Window.partitionBy("group").orderBy(F.desc("same_file"), "name", "kind")
    rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).join(near, "group", "left")
    fits = F.when(F.col("arguments").isNull() | F.col("parameters").isNull(), "none").when(F.col("arguments") == F.col("parameters"), "match").otherwise("mismatch")
    known = rows.select("group", "path", "line", "column", "identifier", F.col("context"), "name", "kind", "same_file", F.coalesce(F.col("near") == F.col("class_id"), F.lit(False)).alias("enclosing"), fits.alias("arguments"))
    return rank_candidates(known).select("path", "line", "column", "identifier", "context", "name", "kind", "score", "place", "decisive")


def descriptor(parameters: Column, returns: Column) -> Column:
    """The JVM descriptor of type names; null if a name is null."""
    letters = {"void": "V", "int": "I", "long": "J", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "float": "F", "double": "D"}

    def one(t: Column) -> Column:
        element = F.regexp_replace(t, r"(\[\])+$", "")
        dims = F.repeat(F.lit("["), ((F.length(t) - F.length(element)) / 2).cast("int"))
        return F.concat(dims, F.coalesce(*[F.when(element == k, F.lit(v)) for k, v in letters.items()], F.concat(F.lit("L"), F.translate(element, ".", "/"), F.lit(";"))))

    return F.when(~F.exists(parameters, lambda p: p.isNull()), F.concat(F.lit("("), F.array_join(F.transform(parameters, one), ""), F.lit(")"), one(returns)))


def resolve_target(s: Snapshot, target: str) -> DataFrame:
    """Classes a target may mean, by the first rule that finds any: full name, source path, short name
    (only for a target without a dot); at most 5."""
    step = F.when(F.col("class_name") == target, 1).when(F.col("source_file") == target, 2)
    if "." not in target:
        step = step.when(simple_name(F.col("class_name")) == target, 3)
    found = s.current().withColumn("step", step).where("step is not null")
    best = Window.partitionBy(F.lit(0)).orderBy("step")
    return found.select("id", "class_name", "step").orderBy("step", "class_name").limit(5).withColumn("best", F.first("step").over(best)).where("step = best").drop("best")


def nested_owner(name: Column) -> Column:
    """A nested class's outermost class, else itself."""
    return outer_name(name)
