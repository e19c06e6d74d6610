"""Traversals, closures and components of the graphs.

Loops run on the driver, one join for each level; what they keep between levels is written to the
shared folder, so plans stay short and a lost executor costs no more than a level.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import has_modifier, package_name
from codeloom.operators.metrics import collapsed_edges
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import by_shuffle, drop_stored, ship, stored

#: Components over fewer edges than this are finished in the driver.
DRIVER_EDGES = 50_000
#: In loops, tables of more rows than this are joined by shuffles: what is broadcast goes through the driver again at each level.
BROADCAST_ROWS = 10_000


# The root of all classes, and its methods.
OBJECT = "java.lang.Object"
OBJECT_METHODS = ("toString", "hashCode", "equals", "getClass", "clone", "finalize", "wait", "notify", "notifyAll")


def _joined(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join in a loop; of many rows, the join is by shuffles."""
    return by_shuffle(df) if rows > BROADCAST_ROWS else df


def distances(edges: DataFrame, starts: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(origin?, node, depth): the least number of edges (src, dst) from a start (node, and origin if
    given); starts have depth 0. Without ``max_depth``, all that can be reached."""
    keys = ["origin", "node"] if "origin" in starts.columns else ["node"]
    links = stored(edges.select("src", "dst").distinct())
    seen = stored(starts.select(*keys, F.lit(0).alias("depth")).dropDuplicates(keys))
    frontier, depth, n = seen, 0, seen.count()
    levels = [(seen, n)]
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(_joined(links, n), frontier.node == links.src).select(*[F.col(k) for k in keys if k != "node"], F.col("dst").alias("node")).distinct()
        for level, size in levels:
            found = found.join(_joined(level.select(*keys), size), keys, "left_anti")
        frontier = stored(found.select(*keys, F.lit(depth).alias("depth")))
        n = frontier.count()
        if not n:
            break
        levels.append((frontier, n))
        if len(levels) > 6:  # few tables are enough to know what was seen
            whole = levels[0][0]
            for level, _ in levels[1:]:
                whole = whole.unionByName(level)
            joined = stored(whole)
            for level, _ in levels:
                drop_stored(level)
            levels = [(joined, sum(size for _, size in levels))]
            frontier = joined.where(F.col("depth") == depth)
    drop_stored(links)
    whole = levels[0][0]
    for level, _ in levels[1:]:
        whole = whole.unionByName(level)
    return whole


@dataclass
class Traversal:
    """Rows of a bounded traversal, and its ``status``, one row for each origin: (origin?, visited long: rows; expanded long: nodes that
    were followed; truncated boolean: the budget left nodes unfollowed; complete boolean: neither the budget nor the depth left any)."""

    rows: DataFrame
    status: DataFrame


def _first_of_each(rows: DataFrame, keys: list[str], order: list[str], room: Column, salts: int = 64) -> DataFrame:
    """The first ``room`` rows (a column, the same for all rows of a key) of each key. First those of each part of a key are taken, so
    that no task gets more than its part and ``salts`` times the room."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)))
    some = parted.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_place") <= room)
    return some.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= room).drop("_part", "_place")


def bounded_distances(edges: DataFrame, starts: DataFrame, *, most: int, max_depth: int | None = None) -> Traversal:
    """As :func:`distances`, but at most ``most`` nodes of each origin are followed (without an origin: in all): nearer ones first, of one depth
    those with the smallest ``node``. What they lead to counts as reached, whether it is followed or not."""
    own = "origin" not in starts.columns
    starts = starts.withColumn("origin", F.lit(0)) if own else starts
    keys = ["origin", "node"]
    links = stored(edges.select("src", "dst").distinct())
    level = stored(starts.select(*keys, F.lit(0).alias("depth")).dropDuplicates(keys))
    seen, marks, depth = level, [level.select("origin", F.lit(0).cast("long").alias("expanded"), F.lit(False).alias("cut"), F.lit(False).alias("beyond")).distinct()], 0
    used = level.select("origin", F.lit(0).cast("long").alias("used")).distinct()
    while max_depth is None or depth < max_depth:
        sized = level.join(used, "origin")
        followed = stored(_first_of_each(sized, ["origin"], ["node"], F.lit(most) - F.col("used")))
        at, kept = level.groupBy("origin").agg(F.count(F.lit(1)).alias("n")), followed.groupBy("origin").agg(F.count(F.lit(1)).alias("k"))
        counted = stored(at.join(kept, "origin", "left").select("origin", F.coalesce("k", F.lit(0)).alias("expanded"), (F.coalesce("k", F.lit(0)) < F.col("n")).alias("cut"), F.lit(False).alias("beyond")))
        marks.append(counted)
        used = stored(used.join(counted.select("origin", "expanded"), "origin", "left").select("origin", (F.col("used") + F.coalesce("expanded", F.lit(0))).alias("used")))
        depth += 1
        found = followed.select(*keys).join(links, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct().join(seen.select(*keys), keys, "left_anti")
        level = stored(found.select(*keys, F.lit(depth).alias("depth")))
        drop_stored(followed)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    else:
        further = level.join(links, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).join(seen.select(*keys), keys, "left_anti")
        marks.append(further.select("origin", F.lit(0).cast("long").alias("expanded"), F.lit(False).alias("cut"), F.lit(True).alias("beyond")).distinct())
    whole = marks[0]
    for m in marks[1:]:
        whole = whole.unionByName(m)
    told = whole.groupBy("origin").agg(F.sum("expanded").alias("expanded"), F.max("cut").alias("truncated"), (~F.max("cut") & ~F.max("beyond")).alias("complete"))
    status = seen.groupBy("origin").agg(F.count(F.lit(1)).alias("visited")).join(told, "origin").select("origin", "visited", "expanded", "truncated", "complete")
    return Traversal(seen.drop("origin"), status.drop("origin")) if own else Traversal(seen, status)


def shortest_paths(edges: DataFrame, starts: DataFrame, *, max_depth: int, most: int | None = None) -> DataFrame:
    """(node, depth, path, labels): of the shortest ways from the starts (node) over ``edges`` (src, dst, label) the first by
    the names on it; names and labels end with ``>`` each. Starts have depth 0. With ``most``, as many nodes are followed at most, as
    :func:`bounded_distances` takes them."""
    return bounded_paths(edges, starts, max_depth=max_depth, most=most).rows


def bounded_paths(edges: DataFrame, starts: DataFrame, *, max_depth: int, most: int | None = None) -> Traversal:
    """:func:`shortest_paths` with their status."""
    spark, left, expanded, cut = edges.sparkSession, most, 0, False
    links = stored(edges.select("src", "dst", "label").distinct())
    level = stored(starts.select("node", F.lit(0).alias("depth"), F.concat(F.col("node").cast("string"), F.lit(">")).alias("path"), F.lit("").alias("labels")).distinct())
    whole, beyond = level, True
    for depth in range(1, max_depth + 1):
        n = level.count()
        if left is not None and n > left:
            level, n, cut = level.orderBy("node").limit(left), left, True
        expanded, left = expanded + n, None if left is None else left - n
        ways = level.join(links, level.node == links.src).select(F.col("dst").alias("node"), F.struct(F.concat("path", F.col("dst").cast("string"), F.lit(">")).alias("path"), F.concat("labels", "label", F.lit(">")).alias("labels")).alias("way"))
        found = ways.join(whole.select("node"), "node", "left_anti").groupBy("node").agg(F.min("way").alias("way"))
        level = stored(found.select("node", F.lit(depth).alias("depth"), "way.path", "way.labels"))
        if level.isEmpty():
            beyond = False
            break
        whole = whole.unionByName(level)
    beyond = beyond and not level.join(links, level.node == links.src).select(F.col("dst").alias("node")).join(whole.select("node"), "node", "left_anti").isEmpty()
    told = spark.range(1).select(F.lit(expanded).cast("long").alias("expanded"), F.lit(cut).alias("truncated"), F.lit(not cut and not beyond).alias("complete"))
    return Traversal(whole, told.select(whole.agg(F.count(F.lit(1))).scalar().alias("visited"), "expanded", "truncated", "complete"))


def busiest_source(edges: DataFrame) -> DataFrame:
    """The node with most distinct outgoing edges, of several the smallest."""
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))


def dependency_edges(s: Snapshot) -> DataFrame:
    return s.dependencies.select(F.col("from_class_id").alias("src"), F.col("to_class_id").alias("dst"), "kind", "occurrence_count")


def dependencies_of(s: Snapshot, target: int | None = None, *, direction: str = "outbound", depth: int = 1) -> DataFrame:
    """Edges found within ``depth`` levels of a class, each once: (direction, depth, from_class_id, to_class_id, kind, occurrence_count)."""
    edges = dependency_edges(s)
    start = busiest_source(edges) if target is None else s.spark.createDataFrame([(target,)], "node long")
    start = stored(start)
    out = []
    for way, src, dst in (("outbound", "src", "dst"), ("inbound", "dst", "src")):
        if direction in (way, "both"):
            turned = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
            reach = distances(turned, start, max_depth=depth - 1)
            hit = edges.join(reach, F.col(src) == F.col("node"))
            out.append(hit.select(F.lit(way).alias("direction"), (F.col("depth") + 1).alias("depth"), F.col("src").alias("from_class_id"), F.col("dst").alias("to_class_id"), "kind", "occurrence_count"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def interfaces(s: Snapshot) -> DataFrame:
    """(id, class_name, kind, interface_name): the interfaces that classes name, one row for each; of an index without that
    relation the one that each class has."""
    if not s.has("class_interfaces"):
        return s.classes.where("interface_name is not null").select("id", "class_name", "kind", "interface_name")
    return s.class_interfaces.withColumnRenamed("class_id", "id").join(by_shuffle(s.classes.select("id", "class_name", "kind")), "id").select("id", "class_name", "kind", "interface_name")


def hierarchy_edges(s: Snapshot) -> DataFrame:
    """(child, parent) names with the relation, of all classes."""
    up = s.classes.where("superclass is not null").select(F.col("class_name").alias("child"), F.col("superclass").alias("parent"), F.lit("EXTENDS").alias("relation"))
    relation = F.when(F.col("kind") == "INTERFACE", "EXTENDS_INTERFACE").otherwise("IMPLEMENTS")
    return up.unionByName(interfaces(s).select(F.col("class_name").alias("child"), F.col("interface_name").alias("parent"), relation.alias("relation")))


def type_hierarchy(s: Snapshot, target: str, *, direction: str = "both", max_depth: int = 5, most: int | None = None) -> DataFrame:
    """Ancestors and descendants of a type by name: direction, depth, name, whether it is indexed, and a shortest way
    there: the types on it and the relations between them, each ended by ``>``. In each direction ``most`` types are followed at most."""
    return type_hierarchy_traversal(s, target, direction=direction, max_depth=max_depth, most=most).rows


def type_hierarchy_traversal(s: Snapshot, target: str, *, direction: str = "both", max_depth: int = 5, most: int | None = None) -> Traversal:
    """:func:`type_hierarchy` with a status of each direction."""
    edges, start = hierarchy_edges(s), s.spark.createDataFrame([(target,)], "node string")
    out, told = [], []
    for way, src, dst in (("ancestor", "child", "parent"), ("descendant", "parent", "child")):
        if direction in (way, "both"):
            found = bounded_paths(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("relation").alias("label")), start, max_depth=max_depth, most=most)
            reach = found.rows.where("depth > 0")
            told.append(found.status.select(F.lit(way).alias("direction"), "*"))
            out.append(reach.select(F.lit(way).alias("direction"), "depth", F.col("node").alias("name"), "path", F.col("labels").alias("relations")))
    whole, status = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in (out, told))
    known = s.current().select(F.col("class_name").alias("name"), F.lit(True).alias("indexed")).distinct()
    return Traversal(whole.join(known, "name", "left").select("direction", "depth", "name", F.coalesce("indexed", F.lit(False)).alias("indexed"), "path", "relations"), status)


def implementations(s: Snapshot, target: str, *, transitive: bool = True) -> DataFrame:
    """Current classes below a type, with their distance."""
    edges = hierarchy_edges(s).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    reach = distances(edges, s.spark.createDataFrame([(target,)], "node string"), max_depth=None if transitive else 1).where("depth > 0")
    return s.current().where("kind <> 'INTERFACE'").join(reach, F.col("class_name") == F.col("node")).select("id", "class_name", "depth")


def ancestors(s: Snapshot, of: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, depth): every supertype of every class (or only of those in ``of``, id) by id, itself at 0."""
    ids = s.classes.select("id", "class_name")
    ends = ids.select(F.col("class_name").alias("child"), F.col("id").alias("src")), ids.select(F.col("class_name").alias("parent"), F.col("id").alias("dst"))
    edges = hierarchy_edges(s).join(by_shuffle(ends[0]), "child").join(by_shuffle(ends[1]), "parent")
    starts = ids.select("id") if of is None else of.select("id").distinct().join(ids.select("id"), "id", "left_semi")
    reach = distances(edges, starts.select(F.col("id").alias("origin"), F.col("id").alias("node")))
    return reach.select(F.col("origin").alias("id"), F.col("node").alias("ancestor"), "depth")


def method_overrides(s: Snapshot, of: DataFrame | None = None) -> DataFrame:
    """Every override of an overridable method (or only of those in ``of``, base_id and name) in a class below: base, override and distance. Supertypes are
    looked up only of classes that have a method of such a name and parameters."""
    methods = s.class_members.where("kind = 'METHOD'")
    free = lambda *flags: ~F.arrays_overlap(F.split("modifiers", r"\s+"), F.array(*map(F.lit, flags)))
    named = s.classes.select(F.col("id").alias("class_id"), package_name(F.col("class_name"), "").alias("package"))
    base = methods.where(free("private", "static", "final")).join(named, "class_id").select(F.col("class_id").alias("base_id"), "name", "parameter_types", F.col("package").alias("base_package"), (~(has_modifier(F.col("modifiers"), "public") | has_modifier(F.col("modifiers"), "protected"))).alias("package_private"))
    over = methods.where(free("private", "static")).join(named, "class_id").select(F.col("class_id").alias("id"), "name", "parameter_types", "package", "descriptor", has_modifier(F.col("modifiers"), "abstract").alias("abstract"))
    if of is not None:
        base = stored(base.join(of.select("base_id", "name").distinct(), ["base_id", "name"], "left_semi"))
        over = over.join(base.select("name", "parameter_types").distinct(), ["name", "parameter_types"], "left_semi")
    # from the override up: a class has few ancestors, while a root class may have any number of subtypes
    below = over.join(ancestors(s, over).where("depth > 0").withColumnRenamed("ancestor", "base_id"), "id")
    found = below.join(base, ["base_id", "name", "parameter_types"])
    return found.where("NOT package_private OR package = base_package").select("base_id", "id", "name", "descriptor", "depth", "abstract")


def resolved_owners(s: Snapshot) -> DataFrame:
    """For each called method, the class whose declaration the named class has, and how it is known: the class chain is
    walked first (``declared``, ``inherited_class_declaration``), then the interfaces of all that were walked
    (``inherited_interface_declaration``: the only declaration, neither static nor private, that no interface below
    declares again). Without an owner: ``declaration_not_indexed``, ``interface_declaration_ambiguous``,
    ``ancestor_not_indexed`` (the walk leaves the index first; the root of all classes may be absent, where there are interfaces and
    the method isn't one of its own) or ``invalid_interface_hierarchy``. The superclass of an interface isn't walked."""
    called = s.method_calls.select(F.col("target_class_id").alias("id"), F.col("target_method").alias("name"), F.col("target_descriptor").alias("descriptor")).distinct()
    ids = s.classes.select(F.col("id").alias("node_id"), F.col("class_name").alias("node"), F.col("kind").alias("node_kind"))
    owners = called.select("id").distinct()
    starts = owners.join(s.classes.select("id", "class_name"), "id").select(F.col("id").alias("origin"), F.col("class_name").alias("node"))
    supers = s.classes.where("superclass is not null AND kind <> 'INTERFACE'").select(F.col("class_name").alias("src"), F.col("superclass").alias("dst"))
    chain = stored(distances(supers, starts).join(ids, "node", "left").select(F.col("origin").alias("id"), "node", "depth", "node_id", "node_kind"))
    faces = interfaces(s).select(F.col("class_name").alias("src"), F.col("interface_name").alias("dst"))
    roots = chain.join(faces, F.col("node") == F.col("src")).select(F.col("id").alias("origin"), F.col("dst").alias("node")).distinct()
    met = stored(distances(faces, roots).join(ids, "node", "left").select(F.col("origin").alias("id"), "node", "node_id", "node_kind"))
    own = s.class_members.where("kind IN ('METHOD', 'CONSTRUCTOR')").select(F.col("class_id").alias("node_id"), "name", "descriptor", "modifiers")
    key = ["id", "name", "descriptor"]
    in_chain = called.join(chain.where("node_id is not null").select("id", "node_id", "depth"), "id").join(own.drop("modifiers"), ["node_id", "name", "descriptor"])
    by_class = in_chain.groupBy(*key).agg(F.min(F.struct("depth", "node_id")).alias("c")).select(*key, F.col("c.depth").alias("depth"), F.col("c.node_id").alias("class_owner"))
    free = own.where(~(has_modifier(F.col("modifiers"), "static") | has_modifier(F.col("modifiers"), "private"))).drop("modifiers")
    offered = called.join(met.where("node_id is not null").select("id", "node_id", "node"), "id").join(free, ["node_id", "name", "descriptor"])
    # an interface above one that declares the method too is shadowed
    above = distances(faces, offered.select(F.col("node").alias("origin"), "node").distinct()).where("depth > 0").select(F.col("origin").alias("below"), "node")
    shadowed = offered.select(*key, F.col("node").alias("below")).join(above, "below").select(*key, "node").distinct()
    by_face = offered.join(shadowed, [*key, "node"], "left_anti").groupBy(*key).agg(F.countDistinct("node_id").alias("maximal"), F.min("node_id").alias("face_owner"))
    out = F.col("node_id").isNull()
    ends = chain.groupBy("id").agg(F.max((out & (F.col("node") != OBJECT)).cast("int")).alias("chain_lost"), F.max((out & (F.col("node") == OBJECT)).cast("int")).alias("object_lost"))
    lost = ends.join(met.groupBy("id").agg(F.max(F.col("node_id").isNull().cast("int")).alias("face_lost"), F.max((F.col("node_kind") != "INTERFACE").cast("int")).alias("not_face")), "id", "left")
    whole = called.join(by_class, key, "left").join(by_face, key, "left").join(lost, "id", "left")
    status = (
        F.when(F.col("depth") == 0, "declared").when(F.col("depth") > 0, "inherited_class_declaration").when(F.col("name").isin("<init>", "<clinit>"), "declaration_not_indexed")
        .when(F.coalesce("chain_lost", F.lit(1)) == 1, "ancestor_not_indexed")
        .when((F.col("object_lost") == 1) & (F.col("face_lost").isNull() | F.col("name").isin(*OBJECT_METHODS)), "ancestor_not_indexed").when(F.col("face_lost") == 1, "ancestor_not_indexed").when(F.col("not_face") == 1, "invalid_interface_hierarchy")
        .when(F.col("maximal") == 1, "inherited_interface_declaration").when(F.col("maximal") > 1, "interface_declaration_ambiguous").otherwise("declaration_not_indexed")
    )
    found = whole.withColumn("status", status)
    return found.select(*key, F.when(F.col("depth").isNotNull(), F.col("class_owner")).when(F.col("status") == "inherited_interface_declaration", F.col("face_owner")).alias("owner_id"), "status")


def dispatch_candidates(s: Snapshot, *, most: int = 20) -> DataFrame:
    """For each method called virtually or through an interface: overrides below its class that aren't abstract, their number and the first ones."""
    called = s.method_calls.where(F.col("invocation_kind").isin("virtual", "interface")).select(F.col("target_class_id").alias("base_id"), F.col("target_method").alias("name"), F.col("target_descriptor").alias("descriptor")).distinct()
    found = called.join(method_overrides(s, called).where("NOT abstract"), ["base_id", "name", "descriptor"])
    place = F.row_number().over(Window.partitionBy("base_id", "name", "descriptor").orderBy("id"))
    first = found.withColumn("place", place)
    return first.groupBy("base_id", "name", "descriptor").agg(F.count(F.lit(1)).alias("candidates"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("id")))), ",").alias("first_ids"))


def _method_key(prefix: str) -> Column:
    return F.concat_ws("#", F.col(f"{prefix}_class_id").cast("string"), F.col(f"{prefix}_method"), F.col(f"{prefix}_descriptor"))


def call_edges(s: Snapshot) -> DataFrame:
    return s.method_calls.select(_method_key("caller").alias("src"), _method_key("target").alias("dst"), "caller_class_id", "target_class_id", "invocation_kind", "occurrence_count")


def _call_starts(s: Snapshot, edges: DataFrame, target: str | None, method: str | None, descriptor: str | None) -> DataFrame:
    if target is None:
        return stored(busiest_source(edges))
    own = s.class_members.where("kind IN ('METHOD', 'CONSTRUCTOR')").join(s.classes.where(F.col("class_name") == target).select(F.col("id").alias("class_id")), "class_id")
    for name, value in (("name", method), ("descriptor", descriptor)):
        if value is not None:
            own = own.where(F.col(name) == value)
    return stored(own.select(F.concat_ws("#", F.col("class_id").cast("string"), "name", "descriptor").alias("node")).distinct())


def call_hierarchy(s: Snapshot, target: str | None = None, method: str | None = None, *, descriptor: str | None = None, direction: str = "outbound", max_depth: int = 3, scope: str = "all", most: int | None = None) -> DataFrame:
    """Calls within ``max_depth`` levels of a class's methods of a name (and descriptor), of all its methods without a name, or
    without a target of the method that calls most. ``direction`` is outbound, inbound or both; the scope (all, cross_class or
    cross_package) holds for what is shown, not for what is followed. ``most``: as many calls in a direction, see :func:`call_traversal`."""
    return call_traversal(s, target, method, descriptor=descriptor, direction=direction, max_depth=max_depth, scope=scope, most=most).rows


def call_traversal(s: Snapshot, target: str | None = None, method: str | None = None, *, descriptor: str | None = None, direction: str = "outbound", max_depth: int = 3, scope: str = "all", most: int | None = None) -> Traversal:
    """:func:`call_hierarchy` and for each direction (direction, found long: calls before the scope; truncated). The walk ends with the level in
    which ``most`` calls are found; of that level the first by caller, target and kind stay. It is then ``truncated``, even if there are no more."""
    edges = call_edges(s)
    start = _call_starts(s, edges, target, method, descriptor)
    out, told = [], []
    for way, src, dst in (("outbound", "src", "dst"), ("inbound", "dst", "src")):
        if direction not in (way, "both"):
            continue
        if most is None:
            reach = distances(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")), start, max_depth=max_depth - 1)
            hit, full = edges.join(reach, F.col(src) == F.col("node")), False
        else:
            hit, full = _calls_by_level(edges, start, src, dst, max_depth, most)
        out.append(hit.withColumn("direction", F.lit(way)))
        told.append(hit.agg(F.count(F.lit(1)).alias("found")).select(F.lit(way).alias("direction"), "found", F.lit(full).alias("truncated")))
    hit, status = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in (out, told))
    if scope != "all":
        hit = hit.where("caller_class_id <> target_class_id")
    if scope == "cross_package":
        named = s.classes.select("id", package_name(F.col("class_name")).alias("package"))
        hit = hit.join(named.select(F.col("id").alias("caller_class_id"), F.col("package").alias("p1")), "caller_class_id").join(named.select(F.col("id").alias("target_class_id"), F.col("package").alias("p2")), "target_class_id").where("p1 <> p2")
    return Traversal(hit.select("direction", (F.col("depth") + 1).alias("depth"), "src", "dst", "invocation_kind", "occurrence_count"), status)


def _calls_by_level(edges: DataFrame, start: DataFrame, src: str, dst: str, max_depth: int, most: int) -> tuple[DataFrame, bool]:
    """(calls with the depth of the method from which they were found, whether ``most`` were)."""
    level, seen, hits, left = start.select("node"), start.select("node"), None, most
    for depth in range(max_depth):
        found = edges.join(level, F.col(src) == F.col("node")).withColumn("depth", F.lit(depth))
        # no more than there is room for is kept, so the sort is bounded
        kept = stored(found.orderBy("src", "dst", "invocation_kind").limit(left))
        hits = kept if hits is None else hits.unionByName(kept)
        left -= kept.count()
        if not left:
            return hits, True
        level = stored(kept.select(F.col(dst).alias("node")).distinct().join(seen, "node", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return hits, False


def forwarded_callers(edges: DataFrame, forwarders: DataFrame, *, max_depth: int = 32) -> DataFrame:
    """(target, caller): callers of each method that isn't a forwarder, seen through chains of forwarders.

    ``edges`` (src, dst); ``forwarders`` (node)."""
    flagged = edges.select("src", "dst").distinct().join(forwarders.select(F.col("node").alias("src"), F.lit(True).alias("through")), "src", "left").select("src", "dst", F.coalesce("through", F.lit(False)).alias("through"))
    flagged = stored(flagged)
    hops = distances(flagged.where("through").select(F.col("dst").alias("src"), F.col("src").alias("dst")), flagged.select(F.col("dst").alias("origin"), F.col("dst").alias("node")).distinct(), max_depth=max_depth)
    seen = hops.join(flagged.where("NOT through"), F.col("node") == F.col("dst"))
    return seen.select(F.col("origin").alias("target"), F.col("src").alias("caller")).distinct().join(forwarders.select(F.col("node").alias("target")), "target", "left_anti")


def strong_components(edges: DataFrame, *, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, component): strongly connected components of more than one node; the component is its least node.

    Nodes without edges in or out are trimmed. What is left is finished in the driver if it has few edges, else each node gets the
    greatest node that it reaches, edges between nodes with different ones are cut, and the same is done backwards. A node
    with the same greatest one in both directions is in that one's component; the others go into the next round, where hashes say what is
    greater, so rounds and what is left of the edges become few whatever the order of the nodes."""
    rest = stored(edges.select("src", "dst").where("src <> dst").distinct())
    spark, done, turn = edges.sparkSession, [], 0
    count = rest.count()
    while count:
        for _ in range(2):
            kept = rest.join(_joined(rest.select(F.col("dst").alias("src")).distinct(), count), "src", "left_semi").join(_joined(rest.select(F.col("src").alias("dst")).distinct(), count), "dst", "left_semi")
            rest, count = _replacing(rest, kept.select("src", "dst"))
        if not count:
            break
        if count <= driver_edges:
            pairs = [(r.src, r.dst) for r in rest.collect()]
            done.append(spark.createDataFrame(list(_kosaraju(pairs)), f"node {rest.schema['src'].dataType.simpleString()}, component {rest.schema['src'].dataType.simpleString()}"))
            break
        below = _greatest(rest, "dst", "src", turn)
        rest, count = _replacing(rest, _within(rest, below, count))
        above = _greatest(rest, "src", "dst", turn)
        both = below.withColumnRenamed("label", "below").join(_joined(above, count), "node")
        found = stored(both.where("below = label").select("node", F.col("label.node").alias("root")))
        parts = found.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
        done.append(stored(found.join(_joined(parts, count), "root").select("node", "component")))
        left = _within(rest, above, count)
        for end in ("src", "dst"):
            left = left.join(_joined(found.select(F.col("node").alias(end)), count), end, "left_anti")
        rest, count = _replacing(rest, left.select("src", "dst"))
        for last in (below, above, found):
            drop_stored(last)
        turn += 1
    if not done:
        kind = edges.schema["src"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def _replacing(last: DataFrame, df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` stored in the place of ``last``, and its number of rows."""
    new = stored(df)
    drop_stored(last)
    return new, new.count()


def _within(edges: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Edges between nodes of the same label."""
    ends = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    return edges.join(_joined(ends[0], rows), "src").join(_joined(ends[1], rows), "dst").where("a = b").select("src", "dst")


def _greatest(edges: DataFrame, src: str, dst: str, turn: int) -> DataFrame:
    """(node, label): the greatest label of the node itself and of those from which ``src`` to ``dst`` leads to it. In turn 0 greater nodes are greater,
    later it is told by a hash, another one in each turn. Only labels that changed are handed on."""
    order = F.lit(0).cast("long") if not turn else F.xxhash64("node", F.lit(turn))
    labels = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.struct(order.alias("order"), "node").alias("label"), F.lit(True).alias("changed")))
    n = rows = labels.count()
    while n:
        moved = labels.where("changed").select(F.col("node").alias(src), "label")
        spread = edges.join(_joined(moved, n), src).groupBy(F.col(dst).alias("node")).agg(F.max("label").alias("other"))
        last, labels = labels, stored(labels.join(_joined(spread, rows), "node", "left").select("node", F.greatest("label", "other").alias("label"), F.coalesce(F.col("other") > F.col("label"), F.lit(False)).alias("changed")))
        drop_stored(last)
        n = labels.where("changed").count()
    out = labels.select("node", "label")
    out._stored_path = labels._stored_path
    return out


def _kosaraju(pairs: list[tuple]) -> Iterator[tuple]:
    """(node, least node of its component) for components of several nodes."""
    out: dict = {}
    back: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in sorted(out):
        stack = [(start, iter(out.get(start, ())))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                order.append(stack.pop()[0])
            else:
                seen.add(following)
                stack.append((following, iter(out.get(following, ()))))
    placed: set = set()
    for root in reversed(order):
        if root in placed:
            continue
        members, todo = [], [root]
        placed.add(root)
        while todo:
            node = todo.pop()
            members.append(node)
            for n in back.get(node, ()):
                if n in seen and n not in placed:
                    placed.add(n)
                    todo.append(n)
        if len(members) > 1:
            yield from ((m, min(members)) for m in members)


def class_cycles(s: Snapshot) -> DataFrame:
    """Components of classes that use each other: component (least id), size and the least name."""
    found = strong_components(collapsed_edges(s))
    named = s.classes.select(F.col("id").alias("node"), "class_name")
    return found.join(by_shuffle(named), "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("class_name").alias("first_name"))


def module_cycles(s: Snapshot) -> DataFrame:
    """Members of cycles of directly visible modules."""
    return strong_components(s.module_edges.select(F.col("module").alias("src"), F.col("visible").alias("dst")))


def cycle_path_rows(edges: DataFrame, members: DataFrame, *, most: int | None = None, task_edges: int = DRIVER_EDGES) -> DataFrame:
    """(component, place, node): for each component (``members``: node, component, name), or each of at most ``most`` nodes, a shortest way
    from its first node by name back to it, neighbours in ascending order of names. A component of at most ``task_edges`` edges is one group; in larger ones the
    way is found by joins, one for each level."""
    of = members.select("component", "node", "name")
    if most is not None:
        small = members.groupBy("component").count().where(F.col("count") <= most).select("component")
        of = of.join(by_shuffle(small), "component")
    ends = of.select(F.col("node").alias("src"), F.col("component"), F.col("name").alias("src_name")), of.select(F.col("node").alias("dst"), F.col("component").alias("other"), F.col("name").alias("dst_name"))
    inside = stored(edges.select("src", "dst").distinct().join(by_shuffle(ends[0]), "src").join(by_shuffle(ends[1]), "dst").where("component = other").drop("other"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        name = dict(zip(pdf.src, pdf.src_name, strict=True)) | dict(zip(pdf.dst, pdf.dst_name, strict=True))
        rank = lambda n: (name[n], n)
        out: dict = {}
        for a, b in zip(pdf.src, pdf.dst, strict=True):
            out.setdefault(a, []).append(b)
        start = min(name, key=rank)
        before, todo = {}, deque([start])
        while todo and start not in before:
            node = todo.popleft()
            for n in sorted(out.get(node, ()), key=rank):
                if n not in before:
                    before[n] = node
                    todo.append(n)
        path = [start]
        if start in before:
            path.append(before[start])
            while path[-1] != start:
                path.append(before[path[-1]])
        return pd.DataFrame({"component": pdf.component.iloc[0], "place": range(len(path)), "node": path[::-1]})

    kinds = {c: members.schema[c].dataType.simpleString() for c in ("component", "node")}
    large = stored(inside.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_edges).select("component"))
    if large.isEmpty():
        return inside.groupBy("component").applyInPandas(walk, f"component {kinds['component']}, place int, node {kinds['node']}")
    rest = inside.join(by_shuffle(large), "component", "left_anti").groupBy("component").applyInPandas(walk, f"component {kinds['component']}, place int, node {kinds['node']}")
    return rest.unionByName(_long_cycle_paths(stored(inside.join(by_shuffle(large), "component", "left_semi"))))


def _long_cycle_paths(inside: DataFrame) -> DataFrame:
    """The ways of :func:`cycle_path_rows` in components (``inside``: src, dst, component, src_name, dst_name) that are too large for a task. Nodes get their
    distance from the start; from it backwards, those on a shortest way back are kept level by level, and of these the first by name is taken
    forwards: the way that a search in one task finds, too."""
    first = inside.groupBy("component").agg(F.min(F.struct(F.col("src_name").alias("name"), F.col("src").alias("node"))).alias("first"))
    starts = stored(first.select("component", F.col("first.node").alias("start")))
    away = distances(inside, starts.select(F.col("component").alias("origin"), F.col("start").alias("node")))
    away = stored(away.select(F.col("origin").alias("component"), "node", "depth"))
    # edges from a level to the next one, and those back to the start
    steps = inside.join(by_shuffle(away.select("component", F.col("node").alias("src"), "depth")), ["component", "src"]).join(by_shuffle(away.select("component", F.col("node").alias("dst"), F.col("depth").alias("deeper"))), ["component", "dst"])
    steps = stored(steps.where("deeper = depth + 1 OR deeper = 0").select("component", "src", "dst", "dst_name", "depth", "deeper"))
    ends = stored(steps.where("deeper = 0").groupBy("component").agg(F.min("depth").alias("depth")))
    forward = steps.where("deeper > 0").select("component", "src", "dst", "dst_name", "depth")
    reached = stored(steps.where("deeper = 0").join(ends, ["component", "depth"]).select("component", F.col("src").alias("dst"), F.col("depth").alias("to")).distinct())
    deepest = ends.agg(F.max("depth")).first()[0]
    # ways of different lengths end at different levels: each level has what a deeper one needs, and the ends of shorter ways
    last = {}
    for depth in range(deepest, 0, -1):
        level = reached.where(F.col("to") == depth).drop("to")
        if depth < deepest:
            level = level.unionByName(last[depth + 1].select("component", F.col("src").alias("dst"))).distinct()
        last[depth] = stored(forward.where(F.col("depth") == depth - 1).join(by_shuffle(level), ["component", "dst"]))
    at = starts.select("component", F.col("start").alias("node"))
    path = [at.withColumn("place", F.lit(0)), starts.join(ends, "component").select("component", F.col("start").alias("node"), (F.col("depth") + 1).alias("place"))]
    for depth in range(1, deepest + 1):
        next_ = last[depth].join(by_shuffle(at.select("component", F.col("node").alias("src"))), ["component", "src"]).groupBy("component").agg(F.min(F.struct("dst_name", "dst")).alias("next"))
        at = stored(next_.select("component", F.col("next.dst").alias("node")))
        path.append(at.withColumn("place", F.lit(depth)))
    whole = path[0]
    for p in path[1:]:
        whole = whole.unionByName(p)
    return whole.select("component", "place", "node")


def cycle_paths(edges: DataFrame, members: DataFrame, *, most: int | None = None) -> dict[object, list]:
    """The ways of :func:`cycle_path_rows` by component, for the components of a page."""
    paths: dict = {}
    for r in cycle_path_rows(edges, members, most=most).orderBy("component", "place").collect():
        paths.setdefault(r.component, []).append(r.node)
    return paths


def class_cycle_paths(s: Snapshot, *, most: int | None = None) -> DataFrame:
    """(component, place, class_name): a shortest cycle of each component of classes, or of those of at most ``most``."""
    edges = stored(collapsed_edges(s).select("src", "dst"))
    named = by_shuffle(s.classes.select(F.col("id").alias("node"), F.col("class_name").alias("name")))
    found = cycle_path_rows(edges, strong_components(edges).join(named, "node"), most=most)
    return found.join(named, "node").select("component", "place", F.col("name").alias("class_name"))


def class_cycle_status(s: Snapshot, *, most: int = 100) -> DataFrame:
    """(component, size, has_path): which components :func:`class_cycle_paths` shows if it is asked for those of at most ``most`` classes; it shows all if it isn't."""
    return class_cycles(s).select("component", "size", (F.col("size") <= most).alias("has_path"))


def module_visibility(s: Snapshot) -> DataFrame:
    """(module, visible, distance): modules each module sees through compile edges, itself at 0."""
    modules = s.classes.select(F.col("module").alias("origin"), F.col("module").alias("node")).distinct()
    reach = distances(s.module_edges.where("relation = 'compile'").select(F.col("module").alias("src"), F.col("visible").alias("dst")), modules)
    return reach.select(F.col("origin").alias("module"), F.col("node").alias("visible"), F.col("depth").alias("distance"))


def module_graph(s: Snapshot, module: str | None = None, *, depth: int = 2) -> DataFrame:
    """Visible modules within a distance of one module, both ways; without one, all direct pairs."""
    seen = module_visibility(s)
    if module is None:
        return seen.where("distance = 1").select("distance", F.lit("outbound").alias("direction"), F.col("module").alias("from_module"), F.col("visible").alias("to_module"))
    near = seen.where((F.col("distance") >= 1) & (F.col("distance") <= depth))
    way = F.when(F.col("module") == module, "outbound").otherwise("inbound")
    return near.where((F.col("module") == module) | (F.col("visible") == module)).select("distance", way.alias("direction"), F.col("module").alias("from_module"), F.col("visible").alias("to_module")).distinct()


def inferred_test_visibility(s: Snapshot) -> DataFrame:
    """(module, visible): the first step over test and compile edges, later ones over compile edges only."""
    first = s.module_edges.select(F.col("module").alias("origin"), F.col("visible").alias("node")).distinct()
    reach = distances(s.module_edges.where("relation = 'compile'").select(F.col("module").alias("src"), F.col("visible").alias("dst")), first)
    return reach.select(F.col("origin").alias("module"), F.col("node").alias("visible"))


def closure_of(s: Snapshot, seeds: DataFrame) -> DataFrame:
    """Names of all types at or below the seeds (name)."""
    edges = hierarchy_edges(s).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return distances(edges, seeds.select(F.col("name").alias("node"))).select(F.col("node").alias("name"))


def specialization_chains(s: Snapshot) -> DataFrame:
    """(id, specialized): every bean that a bean replaces, directly or through others."""
    edges = s.beans.where("specializes_id is not null").select(F.col("id").alias("src"), F.col("specializes_id").alias("dst"))
    return distances(edges, edges.select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()).where("depth > 0").select(F.col("origin").alias("id"), F.col("node").alias("specialized"))


def inherited_mappings(s: Snapshot, mappings: DataFrame) -> DataFrame:
    """(id, owner_id, source): each class's mapping: its own, else of its only mapped interface (several are
    ambiguous, without an owner, and hide the superclasses), else of the nearest mapped superclass. ``mappings`` (id)."""
    ids = s.classes.select("id", "class_name")
    mapped = mappings.select("id").distinct()
    own = mapped.select("id", F.col("id").alias("owner_id"), F.lit(0).alias("rank"))
    faces = interfaces(s).select("id", "interface_name").join(ids.select(F.col("class_name").alias("interface_name"), F.col("id").alias("owner_id")), "interface_name").join(mapped.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    by_face = faces.groupBy("id").agg(F.min("owner_id").alias("owner_id"), F.countDistinct("owner_id").alias("n")).select("id", F.when(F.col("n") == 1, F.col("owner_id")).alias("owner_id"), F.lit(1).alias("rank"))
    supers = s.classes.where("superclass is not null").join(ids.select(F.col("class_name").alias("superclass"), F.col("id").alias("dst")), "superclass").select(F.col("id").alias("src"), "dst")
    up = distances(supers, ids.select(F.col("id").alias("origin"), F.col("id").alias("node"))).where("depth > 0")
    above = up.join(mapped.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("origin").alias("id"), F.col("node").alias("owner_id"), (F.col("depth") + 1).alias("rank"))
    best = Window.partitionBy("id").orderBy("rank", "owner_id")
    return own.unionByName(by_face).unionByName(above).withColumn("place", F.row_number().over(best)).where("place = 1").select("id", "owner_id", F.when(F.col("rank") == 0, "own").when(F.col("owner_id").isNull(), "ambiguous").when(F.col("rank") == 1, "interface").otherwise("superclass").alias("source"))


def _immediate(nodes: list, out: dict, before: dict, roots: list) -> dict:
    """Of each node that the roots reach its nearest dominator, None for those that have only themselves: nodes in reverse
    postorder, and the common dominator of what comes before them, until nothing changes."""
    order, seen = [], set(roots)
    for root in roots:
        stack = [(root, iter(out.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                order.append(stack.pop()[0])
            else:
                seen.add(following)
                stack.append((following, iter(out.get(following, ()))))
    order.reverse()
    place = {n: k + 1 for k, n in enumerate(order)}  # 0 is above all roots
    above = {place[r]: 0 for r in roots} | {0: 0}

    def common(x: int, y: int) -> int:
        while x != y:
            while x > y:
                x = above[x]
            while y > x:
                y = above[y]
        return x

    top, changed = set(roots), True
    while changed:
        changed = False
        for n in order:
            if n in top:
                continue
            known = [place[p] for p in before[n] if place.get(p) in above]
            new = known[0]
            for other in known[1:]:
                new = common(new, other)
            if above.get(place[n]) != new:
                above[place[n]], changed = new, True
    return {n: order[above[place[n]] - 1] if above[place[n]] else None for n in order}


def dominators(edges: DataFrame) -> DataFrame:
    """(method, node, dominator): for each method's control-flow edges (method, src, dst). The entry is
    the least node; it and nodes without predecessors are dominated by themselves only; what no such node reaches is dominated
    by all. One method is one group; a node's rows are its way up the tree of nearest dominators."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf.src) | set(pdf.dst))
        out: dict = {}
        before: dict = {n: [] for n in nodes}
        for a, b in sorted(set(zip(pdf.src, pdf.dst, strict=True))):
            out.setdefault(a, []).append(b)
            before[b].append(a)
        nearest = _immediate(nodes, out, before, [n for n in nodes if n == nodes[0] or not before[n]])
        rows = []
        for n in nodes:
            if n not in nearest:
                rows += [(n, d) for d in nodes]
            d = n if n in nearest else None
            while d is not None:
                rows.append((n, d))
                d = nearest[d]
        return pd.DataFrame([(pdf["method"].iloc[0], n, d) for n, d in rows], columns=["method", "node", "dominator"])

    ship(edges.sparkSession)
    kind = edges.schema["method"].dataType.simpleString()
    return edges.select("method", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).groupBy("method").applyInPandas(of, f"method {kind}, node long, dominator long")


def downstream_depths(edges: DataFrame, start: str, *, max_depth: int = 3) -> DataFrame:
    """Repositories that depend on one, with the least number of steps. ``edges`` (consumer, provider)."""
    turned = edges.select(F.col("provider").alias("src"), F.col("consumer").alias("dst")).where("src <> dst")
    return distances(turned, edges.sparkSession.createDataFrame([(start,)], "node string"), max_depth=max_depth).where("depth > 0")
