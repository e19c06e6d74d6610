"""Queries across repositories, of composite answers and of execution order."""

from pyspark.sql import functions as F

from codeloom.catalogue import CUR, ORACLES, QUERIES, register
from codeloom.catalogue.history import SINCE
from codeloom.catalogue.rules import _IMPACTED, _INJ, _LEVEL, _RISK, _TESTS, _USES
from codeloom.operators import composite, execution, workspace
from codeloom.plans.projection import oracle, snapshot
from codeloom.streaming.events import debounced

_T = lambda s: s.classes.where("id IN (0, 3, 17, 40)").select("id")
register("repositories", workspace.repositories, f"{CUR} SELECT repository, count(DISTINCT module) AS modules, count(*) AS classes, count(*) FILTER (WHERE is_bean) AS beans, CAST(sum(source_tokens) AS BIGINT) AS tokens FROM cur GROUP BY 1")
_CROSS = "x AS (SELECT a.repository AS consumer, b.repository AS provider, from_class_id, occurrence_count FROM dependencies JOIN cur a ON a.id = from_class_id JOIN cur b ON b.id = to_class_id WHERE a.repository <> b.repository)"
register("workspace_dependencies", workspace.cross_dependencies, f"{CUR}, {_CROSS} SELECT consumer, provider, count(DISTINCT from_class_id) AS classes, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM x GROUP BY 1, 2")
_PROV = "pr AS (SELECT a.* FROM module_artifacts a WHERE EXISTS (SELECT 1 FROM cur WHERE cur.module = a.coordinate AND cur.repository = a.repository))"
_DECL = "d AS (SELECT DISTINCT c.repository AS consumer, e.visible AS coordinate, e.version FROM module_edges e JOIN cur c ON c.module = e.module)"


def _declared(s):
    of = s.current().select("module", F.col("repository").alias("consumer")).distinct()
    return s.module_edges.join(of, "module").select("consumer", F.col("visible").alias("coordinate"), "version").distinct()


register(
    "coordinate_matches",
    lambda s: workspace.coordinate_matches(_declared(s), workspace.providers(s)),
    f"""{CUR}, {_PROV}, {_DECL}, m AS (SELECT consumer, d.coordinate, d.version AS declared_version, repository, d.version IS NOT DISTINCT FROM pr.version AS same FROM d JOIN pr ON pr.coordinate = d.coordinate WHERE consumer <> repository),
    b AS (SELECT * FROM m WHERE same OR NOT EXISTS (SELECT 1 FROM m o WHERE o.consumer = m.consumer AND o.coordinate = m.coordinate AND o.declared_version = m.declared_version AND o.same))
    SELECT consumer, coordinate, declared_version, min(repository) AS provider, count(DISTINCT repository) AS candidates, bool_or(same) AS version_matched FROM b GROUP BY 1, 2, 3""",
)
register(
    "dependency_routes",
    lambda s: workspace.dependency_routes(s, _declared(s).select("consumer", "coordinate").distinct()),
    f"""{CUR}, {_PROV}, {_DECL}, {_CROSS}, w AS (SELECT DISTINCT consumer, coordinate FROM d), k AS (SELECT w.*, repository, EXISTS (SELECT 1 FROM x WHERE x.consumer = w.consumer AND x.provider = repository) AS seen FROM w JOIN pr ON pr.coordinate = w.coordinate WHERE consumer <> repository),
    b AS (SELECT consumer, coordinate, bool_or(seen) AS direct, count(DISTINCT repository) FILTER (WHERE seen) AS n1, count(DISTINCT repository) AS n2, min(repository) FILTER (WHERE seen) AS p1, min(repository) AS p2 FROM k GROUP BY 1, 2),
    r AS (SELECT w.consumer, w.coordinate, direct, CASE WHEN direct THEN n1 ELSE n2 END AS n, CASE WHEN direct THEN p1 ELSE p2 END AS p FROM w LEFT JOIN b ON b.consumer = w.consumer AND b.coordinate = w.coordinate)
    SELECT consumer, coordinate, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN p END AS provider, CASE WHEN n = 1 AND direct THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
)
register("provider_status", workspace.provider_status, f"{CUR}, {_PROV}, g AS (SELECT e.visible, count(DISTINCT repository) AS n FROM (SELECT DISTINCT visible FROM module_edges) e LEFT JOIN pr ON coordinate = visible GROUP BY 1) SELECT CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'mapped' ELSE 'ambiguous' END AS status, count(*) AS artifacts FROM g GROUP BY 1")
register(
    "resolve_workspace_entity",
    lambda s: workspace.resolve_across(s, ["C15", "org.acme.p0.C1", "Nothing"]),
    f"""{CUR}, t AS (SELECT unnest(['C15', 'org.acme.p0.C1', 'Nothing']) AS target), m AS (SELECT target, class_name, repository FROM t LEFT JOIN cur ON class_name = target OR regexp_extract(class_name, '[^.]*$') = target)
    SELECT target, count(class_name) AS matches, CASE count(class_name) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(class_name) = 1 THEN min(repository) END AS repository FROM m GROUP BY 1""",
)
register(
    "workspace_usages",
    lambda s: workspace.usages_across(s, s.classes.select("id")),
    f"{CUR} SELECT to_class_id AS target_id, a.repository AS consumer, d.kind, count(DISTINCT from_class_id) AS classes, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM dependencies d JOIN cur a ON a.id = from_class_id JOIN cur b ON b.id = to_class_id WHERE a.repository <> b.repository GROUP BY 1, 2, 3",
)
register(
    "workspace_change_risk",
    lambda s: workspace.risk_across(s, max_depth=2),
    f"""{_RISK}, {_CROSS}, r1 AS (SELECT DISTINCT provider AS origin, consumer AS node FROM x), r2 AS (SELECT DISTINCT r1.origin, x.consumer AS node FROM r1 JOIN x ON x.provider = r1.node WHERE x.consumer <> r1.origin AND NOT EXISTS (SELECT 1 FROM r1 o WHERE o.origin = r1.origin AND o.node = x.consumer)),
    n AS (SELECT c.id, c.repository, (SELECT count(*) FROM r1 WHERE origin = c.repository) AS direct, (SELECT count(*) FROM r2 WHERE origin = c.repository) AS transitive FROM cur c),
    w2 AS (SELECT risk.id, class_name, repository, risk.score AS local, direct, transitive, floor(least(10.0, risk.score + 0.5 * direct + 0.2 * transitive) * 10 + 0.5) / 10 AS score FROM risk JOIN n ON n.id = risk.id)
    SELECT *, CASE WHEN score >= 8 THEN 'CRITICAL' WHEN score >= 6 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM w2""",
)
register(
    "provider_fallback",
    lambda s: workspace.provider_fallback(s, "PROMO", s.classes.select("class_name")),
    f"""{CUR}, m AS (SELECT DISTINCT class_name FROM classes WHERE class_name NOT IN (SELECT class_name FROM cur WHERE repository = 'PROMO')), g AS (SELECT class_name, count(DISTINCT repository) AS n, min(repository) AS r FROM cur WHERE class_name IN (SELECT class_name FROM m) GROUP BY 1)
    SELECT class_name, CASE WHEN n = 1 THEN 'routed' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN r END AS repository FROM g""",
)
register("consumer_evidence", workspace.consumer_evidence, "SELECT 0 AS rank, 'bean:' || bean_type AS evidence, class_id, 1 AS occurrences FROM beans UNION ALL SELECT 1, 'type:' || external_type, class_id, 1 FROM external_deps ORDER BY 1, 2, 3 LIMIT 100")
register("routed_dependencies", workspace.routed_dependencies, f"{CUR}, {_PROV} SELECT from_class_id, to_class_id, d.kind, a.repository AS from_repository, b.repository AS to_repository, b.module AS coordinate, (SELECT count(DISTINCT repository) FROM pr WHERE coordinate = b.module) AS providers FROM dependencies d JOIN cur a ON a.id = from_class_id JOIN cur b ON b.id = to_class_id WHERE a.repository <> b.repository")
register(
    "logical_properties",
    lambda s: workspace.logical_properties(s.class_members.select(F.concat(F.lit("K"), F.col("class_id"), F.when(F.col("class_id") % 4 == 0, "$Companion").otherwise("")).alias("owner"), "kind", F.when(F.col("kind") == "METHOD", F.when(F.col("name") == "run", "setState").otherwise("getState")).otherwise(F.col("name")).alias("name"))),
    """n AS (SELECT 'K' || class_id AS owner, CASE WHEN kind = 'FIELD' THEN 'field' WHEN name = 'run' THEN 'setter' ELSE 'getter' END AS b FROM class_members WHERE kind <> 'CONSTRUCTOR') SELECT owner, 'state' AS property, string_agg(DISTINCT b, ',' ORDER BY b) AS bindings FROM n GROUP BY 1""",
)
register(
    "change_context",
    lambda s: composite.change_context(s, _T(s)),
    f"""{_RISK}, {_TESTS}, i AS (SELECT id, superclass AS parent FROM cur UNION ALL SELECT id, ci.interface_name FROM cur JOIN class_interfaces ci ON ci.class_id = id), u AS (SELECT to_class_id AS id, from_class_id AS u, occurrence_count AS n FROM e WHERE to_class_id IN (0, 3, 17, 40) UNION ALL SELECT t.id, i.id, 1 FROM i JOIN classes t ON t.class_name = i.parent WHERE t.id IN (0, 3, 17, 40)
    UNION ALL SELECT t.id, c.id, 1 FROM (SELECT DISTINCT class_id, annotation_name FROM class_annotations) a JOIN cur c ON c.id = a.class_id JOIN classes t ON t.class_name = annotation_name WHERE t.id IN (0, 3, 17, 40)),
    g AS (SELECT id, count(DISTINCT u) AS users, CAST(sum(n) AS BIGINT) AS uses FROM u GROUP BY 1),
    c0 AS (SELECT x AS origin, x AS node, 0 AS depth FROM (SELECT unnest([CAST(0 AS BIGINT), 3, 17, 40]) AS x) UNION SELECT origin, from_class_id, depth + 1 FROM c0 JOIN dependencies ON to_class_id = node WHERE depth < 3),
    jt AS (SELECT a.class_id AS id, t.id AS test, CASE WHEN t.id IS NULL THEN b.file_path END AS file FROM (SELECT commit_id, class_id FROM commit_files WHERE class_id IN (0, 3, 17, 40)) a JOIN commit_files b ON a.commit_id = b.commit_id AND (b.class_id IS NULL OR a.class_id <> b.class_id)
    LEFT JOIN tests t ON t.id = b.class_id WHERE t.id IS NOT NULL OR regexp_matches(b.file_path, '(^|/)src/test/|(Test|Tests|IT|ITCase|Spec)\\.(java|kt)$')),
    tn AS (SELECT id, count(*) AS tests FROM (SELECT origin AS id, node AS test, NULL AS file FROM c0 WHERE node <> origin AND node IN (SELECT id FROM tests) UNION SELECT id, test, file FROM jt) GROUP BY 1)
    SELECT r.id, class_name, fan_in, fan_out, (SELECT count(*) FROM class_members m WHERE m.class_id = r.id AND kind = 'METHOD') AS methods, (SELECT count(*) FROM class_members m WHERE m.class_id = r.id AND kind = 'FIELD') AS fields, (SELECT count(*) FROM class_members m WHERE m.class_id = r.id AND kind = 'CONSTRUCTOR') AS constructors, (SELECT count(DISTINCT external_type) FROM external_deps x WHERE x.class_id = r.id) AS external_types,
    coalesce((SELECT string_agg(DISTINCT annotation_name, ',' ORDER BY annotation_name) FROM class_annotations a WHERE a.class_id = r.id AND direct), '') AS annotations, score,
    CASE WHEN score >= 8 THEN 'CRITICAL' WHEN score >= 6 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level, coalesce(users, 0) AS users, coalesce(uses, 0) AS uses, coalesce(tests, 0) AS tests FROM risk r LEFT JOIN g ON g.id = r.id LEFT JOIN tn ON tn.id = r.id WHERE r.id IN (0, 3, 17, 40)""",
)
_PLAN = f"""{_RISK}, {_IMPACTED.removeprefix(f'{CUR}, ')}, {_USES}"""
register(
    "change_plan",
    lambda s: composite.change_plan(s, _T(s)),
    f"""{_PLAN} SELECT '1-change' AS step, class_name, {_LEVEL} AS detail FROM risk WHERE id IN (0, 3, 17, 40) UNION ALL SELECT DISTINCT '2-review', class_name, usage FROM cu WHERE user_id NOT IN (0, 3, 17, 40) UNION ALL SELECT '3-test', class_name, confidence FROM im""",
)
_OPEN = f"""{_INJ} SELECT rs.status || ' ' || ip.target_type || ' ' || ip.field_name AS name, rs.point_id FROM rs JOIN injection_points ip ON ip.id = rs.point_id WHERE rs.status <> 'RESOLVED' ORDER BY rs.point_id LIMIT 50"""
QUERIES["project_overview"] = lambda spark, sf_dir: composite.project_overview(snapshot(spark, sf_dir), since=SINCE)
ORACLES["project_overview"] = f"""SELECT 'count' AS section, 0 AS place, measure AS name, CAST(value AS BIGINT) AS value FROM ({ORACLES['overview_counts']}) UNION ALL SELECT 'hub:' || ranking, CAST(place AS INTEGER), class_name, CAST(users AS BIGINT) FROM ({ORACLES['hub_rankings']})
    UNION ALL SELECT 'injection', 0, status, CAST(points AS BIGINT) FROM ({ORACLES['injection_problems']}) UNION ALL SELECT 'problem', 0, p.name, p.point_id FROM ({oracle(_OPEN)}) p
    UNION ALL SELECT 'library', CAST(row_number() OVER (ORDER BY classes DESC, library) AS INTEGER), library, CAST(classes AS BIGINT) FROM ({ORACLES['external_libraries']}) UNION ALL SELECT 'hotspot', CAST(row_number() OVER (ORDER BY commit_count DESC, file_path) AS INTEGER), file_path, CAST(commit_count AS BIGINT) FROM ({ORACLES['hotspots_since']})"""
register(
    "call_report",
    composite.call_report,
    "SELECT tool, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors, quantile_disc(elapsed_ms, 0.5) AS median, quantile_disc(elapsed_ms, 0.95) AS p95, max(elapsed_ms) AS max FROM calls_log GROUP BY 1",
)
_EV = "SELECT user_id % 40 AS method, event_id % 9 AS ordinal, CASE event_type WHEN 'signup' THEN 'before' WHEN 'purchase' THEN 'after' ELSE 'none' END AS role, event_type = 'error' AS dynamic FROM {t}"
_CFG = "SELECT DISTINCT user_id % 40 AS method, event_id % 9 AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 9 AS dst FROM {t}"


def _execution(s):
    log = s.calls_log.selectExpr("id AS event_id", "user_id", "at AS ts", "tool AS event_type")
    events, edges = s.spark.sql(_EV.format(t="{log}"), log=log), s.spark.sql(f"SELECT DISTINCT method, src, dst FROM ({_CFG.format(t='{log}')}) WHERE dst IS NOT NULL AND dst > src", log=log)
    return execution.execution_order(events, edges)


register(
    "execution_order",
    _execution,
    f"""v AS (SELECT * FROM ({_EV.format(t='events')}) WHERE NOT dynamic), e AS (SELECT DISTINCT method, src, dst FROM ({_CFG.format(t='events')}) WHERE dst IS NOT NULL AND dst > src),
    n AS (SELECT method, src AS node FROM e UNION SELECT method, dst FROM e), entry AS (SELECT method, min(node) AS first FROM n GROUP BY 1),
    roots AS (SELECT n.method, n.node FROM n JOIN entry ON entry.method = n.method WHERE n.node = first OR NOT EXISTS (SELECT 1 FROM e WHERE e.method = n.method AND e.dst = n.node)),
    w AS (SELECT n.method, n.node AS without, roots.node FROM n JOIN roots ON roots.method = n.method WHERE n.node <> roots.node UNION SELECT w.method, w.without, dst FROM w JOIN e ON e.method = w.method AND e.src = w.node WHERE dst <> w.without),
    dom AS (SELECT n.method, n.node, d.node AS dominator FROM n JOIN n d ON d.method = n.method JOIN entry ON entry.method = n.method WHERE n.node = d.node OR (n.node <> first AND EXISTS (SELECT 1 FROM e WHERE e.method = n.method AND e.dst = n.node) AND NOT EXISTS (SELECT 1 FROM w WHERE w.method = n.method AND w.without = d.node AND w.node = n.node))),
    s AS (SELECT method, max(ordinal) FILTER (WHERE role = 'before') AS lb, min(ordinal) FILTER (WHERE role = 'before') AS fb, min(ordinal) FILTER (WHERE role = 'after') AS fa, max(ordinal) FILTER (WHERE role = 'after') AS la FROM v GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'before') > 0 AND count(*) FILTER (WHERE role = 'after') > 0),
    g AS (SELECT method, bool_and(EXISTS (SELECT 1 FROM dom JOIN v b ON b.method = dom.method AND b.role = 'before' AND b.ordinal = dom.dominator WHERE dom.method = a.method AND dom.node = a.ordinal)) AS guarded FROM v a WHERE role = 'after' GROUP BY 1),
    br AS (SELECT method, max(c) AS c FROM (SELECT method, src, count(DISTINCT dst) AS c FROM e GROUP BY 1, 2) GROUP BY 1), o AS (SELECT s.method, CASE WHEN lb < fa THEN 'proven' WHEN la < fb THEN 'reversed' ELSE 'mixed' END AS ord, guarded, coalesce(c, 0) AS c FROM s JOIN g ON g.method = s.method LEFT JOIN br ON br.method = s.method)
    SELECT method, ord AS "order", CASE WHEN ord = 'proven' AND c <= 1 THEN 'straight' WHEN guarded THEN 'proven' ELSE 'bypass' END AS runtime FROM o""",
)


_CALLED = """SELECT user_id % 40 AS method, event_id % 9 AS ordinal, CASE event_type WHEN 'signup' THEN 'before' WHEN 'purchase' THEN 'after' ELSE 'none' END AS role, event_type = 'error' AS dynamic,
    CASE WHEN user_id % 4 < 2 THEN 'org.acme.Plain' WHEN event_id % 5 = 0 THEN 'java.util.concurrent.CompletableFuture' WHEN event_id % 5 = 1 THEN 'org.acme.kafka.Bus' ELSE 'org.acme.Store' END AS owner,
    CASE event_id % 7 WHEN 0 THEN 'thenApply' WHEN 1 THEN 'supplyAsync' WHEN 2 THEN 'send' WHEN 3 THEN 'subscribe' WHEN 4 THEN 'submit' ELSE 'run' END AS name FROM {t}"""


def _called(s):
    log = s.calls_log.selectExpr("id AS event_id", "user_id", "at AS ts", "tool AS event_type")
    edges = s.spark.sql(f"SELECT DISTINCT method, src, dst FROM ({_CFG.format(t='{log}')}) WHERE dst IS NOT NULL AND dst > src AND (method % 3 > 0 OR dst = src + 1)", log=log)
    return s.spark.sql(_CALLED.format(t="{log}"), log=log), edges, edges.select("method").distinct().withColumn("handlers", (F.col("method") % 5 == 0).cast("long"))


_ASYNC = f"""v AS (SELECT *, CASE WHEN owner LIKE '%java.util.concurrent%' OR owner LIKE '%kafka%' THEN CASE WHEN contains(name, 'then') THEN 'completion_callback' WHEN name = 'subscribe' THEN 'subscription' WHEN name = 'send' THEN 'publication' WHEN contains(name, 'Async') OR name = 'submit' THEN 'scheduling' END END AS phase
    FROM ({_CALLED.format(t='events')}) WHERE NOT dynamic), e AS (SELECT DISTINCT method, src, dst FROM ({_CFG.format(t='events')}) WHERE dst IS NOT NULL AND dst > src AND (method % 3 > 0 OR dst = src + 1)),
    n AS (SELECT method, src AS node FROM e UNION SELECT method, dst FROM e), entry AS (SELECT method, min(node) AS first FROM n GROUP BY 1),
    roots AS (SELECT n.method, n.node FROM n JOIN entry ON entry.method = n.method WHERE n.node = first OR NOT EXISTS (SELECT 1 FROM e WHERE e.method = n.method AND e.dst = n.node)),
    w AS (SELECT n.method, n.node AS without, roots.node FROM n JOIN roots ON roots.method = n.method WHERE n.node <> roots.node UNION SELECT w.method, w.without, dst FROM w JOIN e ON e.method = w.method AND e.src = w.node WHERE dst <> w.without),
    dom AS (SELECT n.method, n.node, d.node AS dominator FROM n JOIN n d ON d.method = n.method JOIN entry ON entry.method = n.method WHERE n.node = d.node OR (n.node <> first AND EXISTS (SELECT 1 FROM e WHERE e.method = n.method AND e.dst = n.node) AND NOT EXISTS (SELECT 1 FROM w WHERE w.method = n.method AND w.without = d.node AND w.node = n.node)))"""
register(
    "execution_analysis",
    lambda s: execution.execution_analysis(*_called(s)),
    f"""{_ASYNC}, g AS (SELECT method, bool_and(EXISTS (SELECT 1 FROM dom JOIN v b ON b.method = dom.method AND b.role = 'before' AND b.ordinal = dom.dominator WHERE dom.method = a.method AND dom.node = a.ordinal)) AS guarded FROM v a WHERE role = 'after' GROUP BY 1),
    br AS (SELECT method, max(c) AS c FROM (SELECT method, src, count(DISTINCT dst) AS c FROM e GROUP BY 1, 2) GROUP BY 1), p AS (SELECT method, string_agg(phase || '=' || n, ',' ORDER BY phase) AS phases FROM (SELECT method, phase, count(*) AS n FROM v WHERE phase IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT method, count(*) FILTER (WHERE role = 'before') AS b, count(*) FILTER (WHERE role = 'after') AS a, max(ordinal) FILTER (WHERE role = 'before') AS lb, min(ordinal) FILTER (WHERE role = 'after') AS fa, bool_or(phase IS NOT NULL) AS u FROM v GROUP BY 1),
    x AS (SELECT m.*, coalesce(guarded, false) AS guarded, coalesce(c, 1) <= 1 AND NOT (c IS NOT NULL AND m.method % 5 = 0) AS straight, coalesce(phases, '') AS phases FROM m LEFT JOIN g ON g.method = m.method LEFT JOIN br ON br.method = m.method LEFT JOIN p ON p.method = m.method)
    SELECT method, b AS before_events, a AS after_events, CASE WHEN b = 0 OR a = 0 THEN 'unknown' WHEN lb < fa THEN 'proven' ELSE 'disproven' END AS instruction_order, CASE WHEN b = 0 OR a = 0 THEN 'unknown' WHEN guarded AND u THEN 'invocation_order_proven_completion_unknown'
    WHEN guarded AND NOT straight THEN 'proven_on_all_cfg_paths' WHEN lb < fa AND straight THEN CASE WHEN u THEN 'invocation_order_proven_completion_unknown' ELSE 'proven_on_normal_completion' END ELSE 'likely' END AS runtime_order, u AS completion_unknown, phases FROM x""",
)
register(
    "execution_phase_orders",
    lambda s: execution.phase_orders(*_called(s)[:2]),
    f"""{_ASYNC}, q AS (SELECT *, coalesce(phase, '') AS ph FROM v), k AS (SELECT method, ph FROM q GROUP BY 1, 2 HAVING count(*) FILTER (WHERE role = 'before') > 0 AND count(*) FILTER (WHERE role = 'after') > 0)
    SELECT k.method, k.ph AS phase, CASE WHEN bool_and(EXISTS (SELECT 1 FROM dom JOIN q b ON b.method = dom.method AND b.ph = a.ph AND b.role = 'before' AND b.ordinal = dom.dominator WHERE dom.method = a.method AND dom.node = a.ordinal)) THEN 'proven' ELSE 'likely' END AS status
    FROM k JOIN q a ON a.method = k.method AND a.ph = k.ph AND a.role = 'after' GROUP BY 1, 2""",
)
register(
    "debounced_changes",
    lambda s: debounced(s.calls_log.select(F.col("tool").alias("project"), "at", F.col("id").alias("revision")), gap="4 minutes"),
    """c AS (SELECT tool, "at", id, CASE WHEN "at" - lag("at") OVER (PARTITION BY tool ORDER BY "at") < INTERVAL 4 MINUTE THEN 0 ELSE 1 END AS new FROM calls_log), g AS (SELECT *, sum(new) OVER (PARTITION BY tool ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS burst FROM c)
    SELECT tool AS project, min("at") AS began, max("at") + INTERVAL 4 MINUTE AS ended, max(id) AS revision, count(*) AS changes FROM g GROUP BY tool, burst""",
)
