"""Queries of traversals, closures and components."""

from pyspark.sql import functions as F

from codeloom.catalogue import CUR, filled, register
from codeloom.catalogue.metrics import COLLAPSED
from codeloom.operators import forwarding
from codeloom.operators import graph as g
from codeloom.plans.snapshot import Snapshot

_BUSY = "b AS (SELECT from_class_id AS node FROM dependencies GROUP BY 1 ORDER BY count(DISTINCT to_class_id) DESC, 1 LIMIT 1)"
_HIER = "h AS (SELECT class_name AS child, superclass AS parent FROM classes WHERE superclass IS NOT NULL UNION ALL SELECT class_name, ci.interface_name FROM classes JOIN class_interfaces ci ON ci.class_id = id)"
_ROOT = "org.acme.p0.C1"
_IDS = "hid AS (SELECT c.id AS child, p.id AS parent FROM h JOIN classes c ON c.class_name = h.child JOIN classes p ON p.class_name = h.parent)"
_UP = f"{_HIER}, {_IDS}, up0 AS (SELECT id, id AS ancestor, 0 AS depth FROM classes UNION SELECT up0.id, parent, depth + 1 FROM up0 JOIN hid ON child = ancestor), up AS (SELECT id, ancestor, min(depth) AS depth FROM up0 GROUP BY 1, 2)"
_OVERRIDES = f"""{_UP}, mm AS (SELECT m.*, regexp_replace(split_part(class_name, '$', 1), '\\.[^.]*$', '') AS package FROM class_members m JOIN classes c ON c.id = class_id WHERE m.kind = 'METHOD'),
    ov AS (SELECT b.class_id AS base_id, o.class_id AS id, o.name, o.descriptor, depth, contains(o.modifiers, 'abstract') AS abstract FROM up JOIN mm b ON b.class_id = ancestor JOIN mm o ON o.class_id = up.id AND o.name = b.name AND o.parameter_types = b.parameter_types
    WHERE depth > 0 AND NOT contains(b.modifiers, 'private') AND NOT contains(b.modifiers, 'static') AND NOT contains(b.modifiers, 'final') AND NOT contains(o.modifiers, 'private') AND NOT contains(o.modifiers, 'static')
    AND (contains(b.modifiers, 'public') OR contains(b.modifiers, 'protected') OR b.package = o.package))"""
_CALLS = "c AS (SELECT concat_ws('#', caller_class_id, caller_method, caller_descriptor) AS src, concat_ws('#', target_class_id, target_method, target_descriptor) AS dst, * FROM method_calls), b AS (SELECT src AS node FROM c GROUP BY 1 ORDER BY count(DISTINCT dst) DESC, 1 LIMIT 1)"


def _kotlin(s: Snapshot) -> Snapshot:
    """The relations of calls, members and declarations in Kotlin under the names that the operator knows."""
    return Snapshot.of(s.spark, {"classes": s.classes, "method_calls": s.kotlin_calls, "class_members": s.kotlin_members, "kotlin_semantics": s.kotlin_semantics})


def _walk(edges: str, src: str, dst: str, start: str, depth: int) -> str:
    return f"w0 AS (SELECT node, 0 AS depth FROM {start} UNION SELECT {dst}, depth + 1 FROM w0 JOIN {edges} ON {src} = node WHERE depth < {depth}), w AS (SELECT node, min(depth) AS depth FROM w0 GROUP BY 1)"


for _n in (1, 3):
    register(
        f"dependencies_depth_{_n}",
        lambda s, n=_n: g.dependencies_of(s, depth=n),
        f"""{_BUSY}, {_walk('dependencies', 'from_class_id', 'to_class_id', 'b', _n - 1)}
        SELECT 'outbound' AS direction, CAST(depth + 1 AS INTEGER) AS depth, from_class_id, to_class_id, kind, occurrence_count FROM dependencies JOIN w ON node = from_class_id""",
    )
register(
    "dependencies_inbound",
    lambda s: g.dependencies_of(s, 3, direction="inbound", depth=3),
    f"""b AS (SELECT CAST(3 AS BIGINT) AS node), {_walk('dependencies', 'to_class_id', 'from_class_id', 'b', 2)}
    SELECT 'inbound' AS direction, CAST(depth + 1 AS INTEGER) AS depth, from_class_id, to_class_id, kind, occurrence_count FROM dependencies JOIN w ON node = to_class_id""",
)
def _ways(name: str, src: str, dst: str, depth: int) -> str:
    return f"""{name}0 AS (SELECT node, 0 AS depth, node || '>' AS path, '' AS relations FROM b UNION SELECT {dst}, depth + 1, path || {dst} || '>', relations || relation || '>' FROM {name}0 JOIN hr ON {src} = node WHERE depth < {depth}),
    {name} AS (SELECT node, depth, min(path) AS path, arg_min(relations, path) AS relations FROM {name}0 x WHERE depth = (SELECT min(depth) FROM {name}0 y WHERE y.node = x.node) GROUP BY 1, 2)"""


_RELATED = "hr AS (SELECT class_name AS child, superclass AS parent, 'EXTENDS' AS relation FROM classes WHERE superclass IS NOT NULL UNION ALL SELECT class_name, ci.interface_name, CASE kind WHEN 'INTERFACE' THEN 'EXTENDS_INTERFACE' ELSE 'IMPLEMENTS' END FROM classes JOIN class_interfaces ci ON ci.class_id = id)"
register(
    "type_hierarchy",
    lambda s: g.type_hierarchy(s, _ROOT, max_depth=4),
    f"""{CUR}, {_RELATED}, b AS (SELECT '{_ROOT}' AS node), {_ways('dn', 'parent', 'child', 4)}, {_ways('an', 'child', 'parent', 4)}
    SELECT 'descendant' AS direction, CAST(depth AS INTEGER) AS depth, node AS name, node IN (SELECT class_name FROM cur) AS indexed, path, relations FROM dn WHERE depth > 0 UNION ALL SELECT 'ancestor', depth, node, node IN (SELECT class_name FROM cur), path, relations FROM an WHERE depth > 0""",
)
register(
    "implementations",
    lambda s: g.implementations(s, _ROOT),
    f"{CUR}, {_HIER}, b AS (SELECT '{_ROOT}' AS node), {_walk('h', 'parent', 'child', 'b', 50)} SELECT id, class_name, CAST(depth AS INTEGER) AS depth FROM w JOIN cur ON class_name = node WHERE depth > 0 AND kind <> 'INTERFACE'",
)
register("supertype_closure", g.ancestors, f"{_UP} SELECT id, ancestor, CAST(depth AS INTEGER) AS depth FROM up")
register("method_overrides", g.method_overrides, f"{_OVERRIDES} SELECT base_id, id, name, descriptor, CAST(depth AS INTEGER) AS depth, abstract FROM ov")
RESOLVED = """q AS (SELECT DISTINCT target_class_id AS id, target_method AS name, target_descriptor AS descriptor FROM method_calls), known AS (SELECT class_name AS node, id AS node_id, kind AS node_kind FROM classes),
    ch0 AS (SELECT id, class_name AS node, 0 AS depth FROM classes WHERE id IN (SELECT id FROM q) UNION SELECT ch0.id, c.superclass, depth + 1 FROM ch0 JOIN classes c ON c.class_name = node AND c.superclass IS NOT NULL AND c.kind <> 'INTERFACE'),
    ch AS (SELECT ch0.id, ch0.node, depth, node_id FROM ch0 LEFT JOIN known ON known.node = ch0.node),
    cf AS (SELECT class_name, ci.interface_name FROM classes JOIN class_interfaces ci ON ci.class_id = classes.id),
    fc0 AS (SELECT DISTINCT ch.id, c.interface_name AS node FROM ch JOIN cf c ON c.class_name = node UNION SELECT fc0.id, c.interface_name FROM fc0 JOIN cf c ON c.class_name = node),
    fc AS (SELECT fc0.id, fc0.node, node_id, node_kind FROM fc0 LEFT JOIN known ON known.node = fc0.node),
    dm AS (SELECT class_id, name, descriptor, contains(modifiers, 'static') OR contains(modifiers, 'private') AS bound FROM class_members WHERE kind IN ('METHOD', 'CONSTRUCTOR')),
    byc AS (SELECT q.id, q.name, q.descriptor, min(depth) AS depth, arg_min(node_id, depth) AS owner FROM q JOIN ch ON ch.id = q.id JOIN dm ON dm.class_id = node_id AND dm.name = q.name AND dm.descriptor = q.descriptor GROUP BY 1, 2, 3),
    off AS (SELECT q.id, q.name, q.descriptor, node, node_id FROM q JOIN fc ON fc.id = q.id JOIN dm ON dm.class_id = node_id AND dm.name = q.name AND dm.descriptor = q.descriptor AND NOT bound),
    sup AS (SELECT class_name AS below, interface_name AS node FROM cf UNION SELECT sup.below, c.interface_name FROM sup JOIN cf c ON c.class_name = sup.node),
    mx AS (SELECT id, name, descriptor, count(DISTINCT node_id) AS n, min(node_id) AS owner FROM off a WHERE NOT EXISTS (SELECT 1 FROM off b JOIN sup ON sup.below = b.node AND sup.node = a.node WHERE b.id = a.id AND b.name = a.name AND b.descriptor = a.descriptor) GROUP BY 1, 2, 3),
    rz AS (SELECT q.*, CASE WHEN byc.depth = 0 THEN 'declared' WHEN byc.depth > 0 THEN 'inherited_class_declaration' WHEN NOT EXISTS (SELECT 1 FROM classes c WHERE c.id = q.id) OR EXISTS (SELECT 1 FROM ch WHERE ch.id = q.id AND node_id IS NULL) OR EXISTS (SELECT 1 FROM fc WHERE fc.id = q.id AND node_id IS NULL) THEN 'ancestor_not_indexed'
    WHEN EXISTS (SELECT 1 FROM fc WHERE fc.id = q.id AND node_kind <> 'INTERFACE') THEN 'invalid_interface_hierarchy' WHEN mx.n = 1 THEN 'inherited_interface_declaration' WHEN mx.n > 1 THEN 'interface_declaration_ambiguous' ELSE 'declaration_not_indexed' END AS status, byc.owner AS class_owner, mx.owner AS face_owner
    FROM q LEFT JOIN byc ON byc.id = q.id AND byc.name = q.name AND byc.descriptor = q.descriptor LEFT JOIN mx ON mx.id = q.id AND mx.name = q.name AND mx.descriptor = q.descriptor),
    ro AS (SELECT id, name, descriptor, CASE WHEN status IN ('declared', 'inherited_class_declaration') THEN class_owner WHEN status = 'inherited_interface_declaration' THEN face_owner END AS owner_id, status FROM rz)"""
register("resolved_owners", lambda s: filled(g.resolved_owners(s), "owner_id"), f"{RESOLVED} SELECT id, name, descriptor, coalesce(owner_id, -1) AS owner_id, status FROM ro")
register(
    "dispatch_candidates",
    g.dispatch_candidates,
    f"""{_OVERRIDES}, q AS (SELECT DISTINCT target_class_id AS base_id, target_method AS name, target_descriptor AS descriptor FROM method_calls WHERE invocation_kind IN ('virtual', 'interface')),
    p AS (SELECT q.base_id, q.name, q.descriptor, ov.id, row_number() OVER (PARTITION BY q.base_id, q.name, q.descriptor ORDER BY ov.id) AS place FROM q JOIN ov ON ov.base_id = q.base_id AND ov.name = q.name AND ov.descriptor = q.descriptor AND NOT abstract)
    SELECT base_id, name, descriptor, count(*) AS candidates, string_agg(id, ',' ORDER BY id) FILTER (WHERE place <= 20) AS first_ids FROM p GROUP BY 1, 2, 3""",
)
for _way, _src, _dst in (("outbound", "src", "dst"), ("inbound", "dst", "src")):
    register(
        f"call_hierarchy_{_way}",
        lambda s, way=_way: g.call_hierarchy(s, direction=way, max_depth=3, scope="cross_class"),
        f"""{_CALLS}, {_walk('c', _src, _dst, 'b', 2)} SELECT '{_way}' AS direction, CAST(depth + 1 AS INTEGER) AS depth, src, dst, invocation_kind, occurrence_count FROM c JOIN w ON node = {_src} WHERE caller_class_id <> target_class_id""",
    )
register(
    "call_hierarchy_cross_package",
    lambda s: g.call_hierarchy(s, max_depth=5, scope="cross_package"),
    f"""{_CALLS}, k AS (SELECT id, regexp_replace(split_part(class_name, '$', 1), '\\.[^.]*$', '') AS package FROM classes), {_walk('c', 'src', 'dst', 'b', 4)}
    SELECT 'outbound' AS direction, CAST(depth + 1 AS INTEGER) AS depth, src, dst, invocation_kind, occurrence_count FROM c JOIN w ON node = src JOIN k p ON p.id = caller_class_id JOIN k q ON q.id = target_class_id WHERE p.package <> q.package""",
)
register(
    "call_hierarchy_of_method",
    lambda s: g.call_hierarchy(s, "org.acme.p0.C4", "run", direction="both", max_depth=2),
    f"""{_CALLS.partition(', b AS')[0]}, b AS (SELECT DISTINCT concat_ws('#', class_id, name, descriptor) AS node FROM class_members m JOIN classes k ON k.id = class_id WHERE class_name = 'org.acme.p0.C4' AND name = 'run'),
    o0 AS (SELECT node, 0 AS depth FROM b UNION SELECT dst, depth + 1 FROM o0 JOIN c ON src = node WHERE depth < 1), i0 AS (SELECT node, 0 AS depth FROM b UNION SELECT src, depth + 1 FROM i0 JOIN c ON dst = node WHERE depth < 1),
    z AS (SELECT 'outbound' AS direction, node, min(depth) AS depth FROM o0 GROUP BY 2 UNION ALL SELECT 'inbound', node, min(depth) FROM i0 GROUP BY 2)
    SELECT direction, CAST(depth + 1 AS INTEGER) AS depth, src, dst, invocation_kind, occurrence_count FROM z JOIN c ON node = CASE direction WHEN 'outbound' THEN src ELSE dst END""",
)
register("class_cycle_paths", g.class_cycle_paths)
register(
    "forwarded_callers",
    lambda s: g.forwarded_callers(g.dependency_edges(s).select("src", "dst"), s.classes.where("id % 10 IN (3, 4)").select(F.col("id").alias("node"))),
    """e AS (SELECT DISTINCT from_class_id AS src, to_class_id AS dst FROM dependencies), w AS (SELECT dst AS target, dst AS node FROM e UNION SELECT w.target, e.src FROM w JOIN e ON e.dst = w.node WHERE e.src % 10 IN (3, 4))
    SELECT DISTINCT target, src AS caller FROM w JOIN e ON e.dst = w.node WHERE src % 10 NOT IN (3, 4) AND target % 10 NOT IN (3, 4)""",
)
_TYPES = "regexp_extract_all(regexp_extract({d}, '^(\\(.*)\\)', 1), '\\[*(?:L[^;]+;|[ZBCSIJFD])')"
_DECLARED = "kind IN ('FUNCTION', 'PROPERTY', 'CONSTRUCTOR')"
_FORWARDS = f"""fc AS (SELECT k.*, a.class_name AS from_class, b.class_name AS to_class, {_TYPES.format(d='caller_descriptor')} AS f, {_TYPES.format(d='target_descriptor')} AS t, count(*) OVER (PARTITION BY caller_class_id, caller_method, caller_descriptor) AS outgoing,
    EXISTS (SELECT 1 FROM kotlin_semantics d WHERE d.class_id = caller_class_id AND {_DECLARED} AND jvm_name = caller_method AND descriptor = caller_descriptor) AS fd, EXISTS (SELECT 1 FROM kotlin_semantics d WHERE d.class_id = target_class_id AND {_DECLARED} AND jvm_name = target_method AND descriptor = target_descriptor) AS td,
    (SELECT max(has_defaults) FROM kotlin_semantics d WHERE d.class_id = target_class_id AND {_DECLARED} AND jvm_name = target_method AND descriptor = target_descriptor) AS dd, (SELECT max(value_parameters) FROM kotlin_semantics d WHERE d.class_id = target_class_id AND {_DECLARED} AND jvm_name = target_method AND descriptor = target_descriptor) AS vp,
    EXISTS (SELECT 1 FROM kotlin_semantics d WHERE d.class_id = target_class_id AND kind = 'FUNCTION' AND has_defaults AND jvm_name = caller_method) AS cdef, EXISTS (SELECT 1 FROM kotlin_semantics d WHERE d.class_id = target_class_id AND kind = 'FUNCTION' AND has_defaults AND jvm_name = target_method) AS tdef,
    EXISTS (SELECT 1 FROM kotlin_semantics d WHERE d.class_id = target_class_id AND kind = 'CONSTRUCTOR' AND has_defaults) AS mdef, EXISTS (SELECT 1 FROM kotlin_members m WHERE m.class_id = caller_class_id AND name = caller_method AND descriptor = caller_descriptor) AS phys,
    EXISTS (SELECT 1 FROM kotlin_members m WHERE m.class_id = caller_class_id AND name = caller_method AND descriptor = caller_descriptor AND contains(annotations, 'JvmOverloads')) AS fo, EXISTS (SELECT 1 FROM kotlin_members m WHERE m.class_id = target_class_id AND name = target_method AND descriptor = target_descriptor AND contains(annotations, 'JvmOverloads')) AS tov
    FROM kotlin_calls k JOIN classes a ON a.id = caller_class_id JOIN classes b ON b.id = target_class_id),
    fw AS (SELECT *, caller_class_id = target_class_id AS same, target_method = '<init>' AS mk FROM fc), fx AS (SELECT *, coalesce(CASE WHEN fd THEN false WHEN target_method = caller_method || '$default' AND same AND fo AND cdef THEN outgoing = 1 WHEN NOT (mk OR td OR (tdef AND tov)) THEN false
    WHEN mk AND same AND caller_method = '<init>' AND t[-1] = 'Lkotlin/jvm/internal/DefaultConstructorMarker;' AND mdef THEN fo AND outgoing = 1 AND occurrence_count = 1
    WHEN same AND (caller_method = target_method || '$default' OR (mk AND caller_method = '<init>')) THEN CASE WHEN mk THEN NOT td OR dd ELSE td AND dd END AND f[-1] = CASE WHEN mk THEN 'Lkotlin/jvm/internal/DefaultConstructorMarker;' ELSE 'Ljava/lang/Object;' END
    AND regexp_extract(caller_descriptor, '[)].*$') = regexp_extract(target_descriptor, '[)].*$') AND len(f) = len(t) + (coalesce(vp, len(t)) + 31) // 32 + 1 AND f[1:len(t)] = t AND len(list_filter(f[len(t) + 1:len(f) - 1], lambda x: x <> 'I')) = 0
    WHEN caller_method <> target_method THEN false WHEN same AND caller_descriptor <> target_descriptor AND (fo OR (NOT phys AND len(f) = len(t))) THEN outgoing = 1 AND occurrence_count = 1 ELSE false END, false) AS forwards FROM fw)"""
register("forwarding_calls", lambda s: forwarding.forwarding_calls(_kotlin(s)), f"{_FORWARDS} SELECT caller_class_id, caller_method, caller_descriptor, target_class_id, target_method, target_descriptor, invocation_kind, occurrence_count, forwards FROM fx")
_THROUGH = f"""{_FORWARDS}, fe AS (SELECT DISTINCT concat_ws('#', caller_class_id, caller_method, caller_descriptor) AS src, concat_ws('#', target_class_id, target_method, target_descriptor) AS dst, forwards FROM fx),
    fr0 AS (SELECT src, dst, 1 AS steps FROM fe WHERE forwards AND src <> dst UNION SELECT fr0.src, fe.dst, steps + 1 FROM fr0 JOIN fe ON fe.src = fr0.dst AND fe.forwards WHERE steps < 32 AND fe.dst <> fr0.src AND fe.src <> fe.dst), fr AS (SELECT src, dst, min(steps) AS steps FROM fr0 GROUP BY 1, 2),
    ut AS (SELECT dst AS target, src AS caller, '' AS through, 0 AS steps FROM fe WHERE NOT forwards UNION SELECT fr.dst, fe.src, fe.dst, fr.steps FROM fe JOIN fr ON fr.src = fe.dst WHERE NOT forwards)"""
for _name, _most in (("capped", 1), ("uncapped", 5000)):
    register(f"usages_through_forwarders_{_name}", lambda s, most=_most: forwarding.usages_through_forwarders(_kotlin(s), most=most).rows, f"{_THROUGH} SELECT target, caller, through, CAST(steps AS INTEGER) AS steps FROM ut QUALIFY row_number() OVER (PARTITION BY target ORDER BY steps, caller, through) <= {_most}")
    register(f"usages_through_forwarders_{_name}_status", lambda s, most=_most: forwarding.usages_through_forwarders(_kotlin(s), most=most).status, f"{_THROUGH} SELECT target, count(*) AS found, count(*) > {_most} AS truncated FROM ut GROUP BY 1")
_REACH = "r AS (SELECT src, dst FROM collapsed UNION SELECT r.src, c.dst FROM r JOIN collapsed c ON c.src = r.dst), scc AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"
register("strong_components", lambda s: g.strong_components(g.collapsed_edges(s)), f"{COLLAPSED}, {_REACH} SELECT node, component FROM scc")
register("strong_components_distributed", lambda s: g.strong_components(g.collapsed_edges(s), driver_edges=0), f"{COLLAPSED}, {_REACH} SELECT node, component FROM scc")
register("class_cycles", g.class_cycles, f"{COLLAPSED}, {_REACH} SELECT component, count(*) AS size, min(class_name) AS first_name FROM scc JOIN classes ON id = node GROUP BY 1")
for _most in (3, 100):
    register(f"class_cycle_status_{_most}", lambda s, most=_most: g.class_cycle_status(s, most=most), f"{COLLAPSED}, {_REACH} SELECT component, count(*) AS size, count(*) <= {_most} AS has_path FROM scc GROUP BY 1")
register("module_cycles", g.module_cycles, "r AS (SELECT module AS src, visible AS dst FROM module_edges UNION SELECT r.src, visible FROM r JOIN module_edges ON module = r.dst) SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src")
_VIS = "v0 AS (SELECT DISTINCT module, module AS visible, 0 AS distance FROM classes UNION SELECT v0.module, e.visible, distance + 1 FROM v0 JOIN module_edges e ON e.module = v0.visible AND relation = 'compile' WHERE distance < 25), v AS (SELECT module, visible, min(distance) AS distance FROM v0 GROUP BY 1, 2)"
register("module_visibility", g.module_visibility, f"{_VIS} SELECT module, visible, CAST(distance AS INTEGER) AS distance FROM v")
register("module_graph", lambda s: g.module_graph(s, "Brand#4", depth=3), f"{_VIS} SELECT CAST(distance AS INTEGER) AS distance, CASE WHEN module = 'Brand#4' THEN 'outbound' ELSE 'inbound' END AS direction, module AS from_module, visible AS to_module FROM v WHERE distance BETWEEN 1 AND 3 AND 'Brand#4' IN (module, visible)")
register("module_graph_direct", g.module_graph, f"{_VIS} SELECT CAST(1 AS INTEGER) AS distance, 'outbound' AS direction, module AS from_module, visible AS to_module FROM v WHERE distance = 1")
register("inferred_test_visibility", g.inferred_test_visibility, "t AS (SELECT module, visible FROM module_edges UNION SELECT t.module, e.visible FROM t JOIN module_edges e ON e.module = t.visible AND e.relation = 'compile') SELECT * FROM t")
register("subtype_closure", lambda s: g.closure_of(s, s.classes.where("id IN (2, 9)").select(F.col("class_name").alias("name"))), f"{_HIER}, t AS (SELECT class_name AS name FROM classes WHERE id IN (2, 9) UNION SELECT child FROM t JOIN h ON parent = name) SELECT name FROM t")
register("specialization_chains", g.specialization_chains, "t AS (SELECT id, specializes_id AS specialized FROM beans WHERE specializes_id IS NOT NULL UNION SELECT t.id, b.specializes_id FROM t JOIN beans b ON b.id = specialized WHERE b.specializes_id IS NOT NULL) SELECT * FROM t")
register(
    "inherited_mappings",
    lambda s: filled(g.inherited_mappings(s, s.class_members.where("annotations = 'jakarta.ws.rs.GET'").select(F.col("class_id").alias("id"))), "owner_id"),
    """m AS (SELECT DISTINCT class_id AS id FROM class_members WHERE annotations = 'jakarta.ws.rs.GET'), f AS (SELECT c.id, CASE WHEN count(DISTINCT p.id) = 1 THEN min(p.id) ELSE -1 END AS owner_id FROM class_interfaces ci JOIN classes c ON c.id = ci.class_id JOIN classes p ON p.class_name = ci.interface_name WHERE p.id IN (SELECT id FROM m) GROUP BY 1),
    u AS (SELECT c.id, p.id AS a, 1 AS depth FROM classes c JOIN classes p ON p.class_name = c.superclass UNION SELECT u.id, p.id, depth + 1 FROM u JOIN classes c ON c.id = u.a JOIN classes p ON p.class_name = c.superclass),
    x AS (SELECT id, id AS owner_id, 0 AS rank FROM m UNION ALL SELECT id, owner_id, 1 FROM f UNION ALL SELECT id, a, depth + 1 FROM u WHERE a IN (SELECT id FROM m))
    SELECT id, owner_id, CASE WHEN rank = 0 THEN 'own' WHEN owner_id = -1 THEN 'ambiguous' WHEN rank = 1 THEN 'interface' ELSE 'superclass' END AS source FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, owner_id) = 1""",
)
_CFG = "SELECT DISTINCT user_id % 40 AS method, event_id % 9 AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 9 AS dst FROM {events}"
register(
    "dominators",
    lambda s: g.dominators(s.spark.sql(f"SELECT DISTINCT method, src, dst FROM ({_CFG.format(events='{log}')}) WHERE dst IS NOT NULL AND src <> dst", log=s.calls_log.selectExpr("id AS event_id", "user_id", "at AS ts")).select("method", "src", "dst")),
    f"""e AS (SELECT DISTINCT method, src, dst FROM ({_CFG.format(events='events')}) WHERE dst IS NOT NULL AND src <> dst), n AS (SELECT method, src AS node FROM e UNION SELECT method, dst FROM e), entry AS (SELECT method, min(node) AS first FROM n GROUP BY 1),
    roots AS (SELECT n.method, n.node FROM n JOIN entry ON entry.method = n.method WHERE n.node = first OR NOT EXISTS (SELECT 1 FROM e WHERE e.method = n.method AND e.dst = n.node)),
    w AS (SELECT n.method, n.node AS without, roots.node FROM n JOIN roots ON roots.method = n.method WHERE n.node <> roots.node UNION SELECT w.method, w.without, dst FROM w JOIN e ON e.method = w.method AND e.src = w.node WHERE dst <> w.without)
    SELECT n.method, n.node, d.node AS dominator FROM n JOIN n d ON d.method = n.method JOIN entry ON entry.method = n.method WHERE n.node = d.node
    OR (n.node <> first AND EXISTS (SELECT 1 FROM e WHERE e.method = n.method AND e.dst = n.node) AND NOT EXISTS (SELECT 1 FROM w WHERE w.method = n.method AND w.without = d.node AND w.node = n.node))""",
)
