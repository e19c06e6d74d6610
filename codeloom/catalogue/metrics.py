"""Queries of aggregates over the dependency, call and field graphs."""

from codeloom.catalogue import CUR, filled, register
from codeloom.operators import metrics as m

_EDGES = "e AS (SELECT d.*, f.class_name AS f_name, t.class_name AS t_name FROM dependencies d JOIN cur f ON f.id = from_class_id JOIN cur t ON t.id = to_class_id)"
_PKG = "CASE WHEN contains(split_part({c}, '$', 1), '.') THEN regexp_replace(split_part({c}, '$', 1), '\\.[^.]*$', '') ELSE '<default>' END"
_PKG_F, _PKG_T = _PKG.format(c="f_name"), _PKG.format(c="t_name")
_HUBS = f"""{CUR}, hubs AS (SELECT t.id, t.class_name, count(DISTINCT f.id) AS total, count(DISTINCT CASE WHEN f.origin = 'source' THEN f.id END) AS source,
    count(DISTINCT CASE WHEN f.origin = 'generated' THEN f.id END) AS generated, count(DISTINCT CASE WHEN f.source_set IS NULL OR f.source_set <> 'test' THEN f.id END) AS production,
    count(DISTINCT CASE WHEN f.source_set = 'test' THEN f.id END) AS test FROM dependencies JOIN cur f ON f.id = from_class_id JOIN cur t ON t.id = to_class_id GROUP BY 1, 2)"""

register(
    "fan_metrics",
    m.fan_metrics,
    f"""{CUR}, {_EDGES} SELECT id, class_name, (SELECT count(DISTINCT from_class_id) FROM e WHERE to_class_id = c.id) AS fan_in, (SELECT count(DISTINCT to_class_id) FROM e WHERE from_class_id = c.id) AS fan_out,
    CAST(coalesce((SELECT sum(occurrence_count) FROM e WHERE to_class_id = c.id), 0) AS BIGINT) AS in_occurrences, CAST(coalesce((SELECT sum(occurrence_count) FROM e WHERE from_class_id = c.id), 0) AS BIGINT) AS out_occurrences FROM cur c""",
)
register("dependency_breakdown", m.dependency_breakdown, f"{CUR} SELECT to_class_id, origin, count(DISTINCT from_class_id) AS classes, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM dependencies JOIN cur ON id = from_class_id GROUP BY 1, 2")
register("architecture_hubs", lambda s: m.architecture_hubs(s, limit=50), f"{_HUBS} SELECT * FROM hubs ORDER BY total DESC, id LIMIT 50")
register(
    "hub_rankings",
    m.hub_rankings,
    f"""{_HUBS}, u AS (SELECT 'total' AS ranking, id, class_name, total AS users FROM hubs UNION ALL SELECT 'source', id, class_name, source FROM hubs UNION ALL SELECT 'generated', id, class_name, generated FROM hubs
    UNION ALL SELECT 'production', id, class_name, production FROM hubs UNION ALL SELECT 'test', id, class_name, test FROM hubs)
    SELECT ranking, CAST(row_number() OVER (PARTITION BY ranking ORDER BY users DESC, id) AS INTEGER) AS place, id, class_name, users FROM u WHERE users > 0 QUALIFY place <= 5""",
)
register("method_usage", m.method_usage, f"{CUR} SELECT target_class_id, target_method, target_descriptor, count(DISTINCT caller_class_id) AS callers, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM method_calls WHERE caller_class_id IN (SELECT id FROM cur) GROUP BY 1, 2, 3")
register(
    "field_usage",
    m.field_usage,
    f"""{CUR} SELECT owner_class_id, field_name, count(DISTINCT accessor_class_id) FILTER (WHERE access_kind LIKE 'read%') AS readers, count(DISTINCT accessor_class_id) FILTER (WHERE access_kind LIKE 'write%') AS writers,
    CAST(coalesce(sum(occurrence_count) FILTER (WHERE access_kind LIKE 'read%'), 0) AS BIGINT) AS reads, CAST(coalesce(sum(occurrence_count) FILTER (WHERE access_kind LIKE 'write%'), 0) AS BIGINT) AS writes
    FROM field_accesses JOIN cur ON id = accessor_class_id GROUP BY 1, 2""",
)
register(
    "overview_counts",
    m.overview_counts,
    f"""{CUR} SELECT 'classes' AS measure, count(*) AS value FROM cur UNION ALL SELECT 'source_tokens', CAST(sum(source_tokens) AS BIGINT) FROM cur UNION ALL SELECT 'beans', count(*) FROM beans
    UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'scope:' || scope, count(*) FROM beans GROUP BY 1 UNION ALL SELECT 'kind:' || kind, count(*) FROM beans GROUP BY 1""",
)
register(
    "external_libraries",
    m.external_libraries,
    """l AS (SELECT class_id, CASE WHEN len(string_split(external_type, '.')) >= 3 THEN split_part(external_type, '.', 1) || '.' || split_part(external_type, '.', 2) WHEN contains(external_type, '.') THEN split_part(external_type, '.', 1) ELSE '' END AS library FROM external_deps)
    SELECT * FROM (SELECT library, count(DISTINCT class_id) AS classes FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) WHERE library <> ''""",
)
register("external_types_by_class", m.external_of_class, "SELECT class_id, usage_kind, string_agg(DISTINCT external_type, ',' ORDER BY external_type) AS types FROM external_deps GROUP BY 1, 2")
register("classes_using_library", lambda s: m.classes_using_library(s, "org.economy", limit=100), f"{CUR} SELECT id, class_name, count(*) AS uses FROM cur JOIN external_deps ON class_id = id WHERE external_type LIKE 'org.economy.%' GROUP BY 1, 2 ORDER BY class_name LIMIT 100")
register("annotation_origin_counts", lambda s: m.annotation_origin_counts(s, "org.acme.Service"), f"{CUR} SELECT origin, count(*) AS classes FROM cur c WHERE EXISTS (SELECT 1 FROM class_annotations a WHERE a.class_id = c.id AND annotation_name = 'org.acme.Service') GROUP BY 1")
register("resolve_annotation", lambda s: m.resolve_annotation(s, "Service"), "SELECT DISTINCT annotation_name, annotation_name = 'Service' AS exact FROM class_annotations WHERE annotation_name = 'Service' OR annotation_name LIKE '%.Service'")
register(
    "annotated_classes",
    lambda s: m.annotated_classes(s, "Service"),
    f"""{CUR} SELECT id, class_name, annotation_name, CASE WHEN bool_or(direct) THEN 'direct' ELSE 'meta' END AS match, CASE WHEN bool_or(direct) THEN NULL ELSE min(via_annotation) END AS via
    FROM cur JOIN class_annotations ON class_id = id WHERE annotation_name LIKE '%.Service' GROUP BY 1, 2, 3""",
)
register(
    "annotated_symbols",
    lambda s: m.annotated_symbols(s, "io.quarkus.scheduler.Scheduled"),
    "SELECT class_id, kind AS target, name || descriptor AS member FROM class_members WHERE annotations = 'io.quarkus.scheduler.Scheduled' UNION ALL SELECT DISTINCT class_id, 'TYPE', NULL FROM class_annotations WHERE annotation_name = 'io.quarkus.scheduler.Scheduled'",
)
register(
    "package_graph",
    m.package_graph,
    f"""{CUR}, {_EDGES}, p AS (SELECT {_PKG_F} AS from_package, {_PKG_T} AS to_package, * FROM e), k AS (SELECT from_package, to_package, kind, sum(occurrence_count) AS n FROM p GROUP BY 1, 2, 3)
    SELECT from_package, to_package, count(*) AS dependencies, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, count(DISTINCT (from_class_id, to_class_id)) AS class_pairs,
    (SELECT string_agg(k.kind || '=' || CAST(k.n AS BIGINT), ',' ORDER BY k.kind) FROM k WHERE k.from_package = p.from_package AND k.to_package = p.to_package) AS kinds
    FROM p WHERE from_package <> to_package GROUP BY 1, 2""",
)
register(
    "package_summary",
    m.package_summary,
    f"""{CUR} SELECT {_PKG.format(c='class_name')} AS package, count(*) AS classes, count(*) FILTER (WHERE origin = 'generated') AS generated, count(*) FILTER (WHERE source_set = 'test') AS tests,
    count(DISTINCT module) AS modules, CAST(sum(source_tokens) AS BIGINT) AS tokens FROM cur GROUP BY 1""",
)
COLLAPSED = f"""{CUR}, place AS (SELECT c.id, coalesce(o.id, c.id) AS node FROM cur c LEFT JOIN cur o ON o.class_name = split_part(c.class_name, '$', 1)),
    collapsed AS (SELECT a.node AS src, b.node AS dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM dependencies JOIN place a ON a.id = from_class_id JOIN place b ON b.id = to_class_id WHERE a.node <> b.node GROUP BY 1, 2)"""
register("nested_collapse", m.collapsed_edges, f"{COLLAPSED} SELECT * FROM collapsed")
register(
    "module_summaries",
    m.module_summaries,
    f"""{CUR} SELECT module, count(*) AS classes, count(*) FILTER (WHERE origin = 'source') AS source, count(*) FILTER (WHERE origin = 'generated') AS generated, count(*) FILTER (WHERE source_set = 'test') AS tests,
    count(*) FILTER (WHERE is_bean) AS beans, CAST(sum(source_tokens) AS BIGINT) AS tokens FROM cur GROUP BY 1""",
)
register("ambiguous_occurrences", m.ambiguous_occurrences, "SELECT class_id, count(DISTINCT output_directory) AS outputs, count(DISTINCT module) AS modules FROM class_occurrences GROUP BY 1 HAVING count(DISTINCT output_directory) > 1 OR count(DISTINCT module) > 1")
register("coverage_scopes", m.coverage_scopes, f"{CUR} SELECT coalesce(module, '') AS module, coalesce(source_set, '') AS source_set, count(*) AS classes FROM cur GROUP BY 1, 2")
register(
    "reference_caveats",
    m.reference_caveats,
    """h AS (SELECT to_class_id AS id, count(*) AS n FROM dependencies WHERE kind IN ('METHOD_HANDLE_REFERENCE', 'FIELD_HANDLE_REFERENCE') GROUP BY 1), c AS (SELECT id, count(*) AS n FROM (SELECT caller_class_id AS id FROM method_calls WHERE invocation_kind = 'dynamic'
    UNION ALL SELECT target_class_id FROM method_calls WHERE invocation_kind = 'dynamic' AND target_class_id <> caller_class_id) GROUP BY 1)
    SELECT coalesce(h.id, c.id) AS id, coalesce(h.n, 0) AS handles, coalesce(c.n, 0) AS calls FROM h FULL JOIN c ON h.id = c.id""",
)
register("sole_anchors", m.sole_anchors, f"{CUR} SELECT module, min(source_file) AS path, count(DISTINCT source_file) = 1 AS sole FROM cur WHERE module IS NOT NULL GROUP BY 1")
register(
    "member_usage_of_consumers",
    m.member_usage_of_consumers,
    f"""{CUR} SELECT module, coalesce(source_set, 'main') AS source_set, target_class_id, target_method, target_descriptor, count(*) AS groups, CAST(sum(occurrence_count) AS BIGINT) AS occurrences
    FROM method_calls JOIN cur ON id = caller_class_id GROUP BY 1, 2, 3, 4, 5""",
)
register("external_bean_artifacts", m.external_bean_artifacts, "SELECT artifact, count(*) AS beans FROM external_beans WHERE artifact IS NOT NULL GROUP BY 1")
register("required_configuration", m.required_configuration, "SELECT key, class_name AS bean, member FROM external_bean_settings x JOIN external_beans b ON b.id = bean_id WHERE key IS NOT NULL AND required")
register("external_bean_summary", m.external_bean_summary, "SELECT (SELECT count(*) FROM external_beans) AS beans, count(DISTINCT class_name) AS beans_with_configuration, count(*) FILTER (WHERE required) AS required, count(*) FILTER (WHERE NOT required) AS defaulted FROM external_bean_settings JOIN external_beans b ON b.id = bean_id WHERE key IS NOT NULL")
_PLACES = """an AS (SELECT 'org.acme.Core' AS a, 0 AS d UNION SELECT m.annotation, 1 FROM an JOIN annotation_metas m ON m.meta = an.a), pl AS (SELECT u.class_id, u.name, u.descriptor, u.position, min(d) AS d, min(annotation) FILTER (WHERE d = 1) AS via FROM (SELECT DISTINCT class_id, name, descriptor, position, annotation FROM annotation_uses) u JOIN an ON an.a = u.annotation GROUP BY 1, 2, 3, 4)
    SELECT pl.class_id, class_name, CASE WHEN pl.position IS NOT NULL THEN 'PARAMETER' WHEN pl.name = '' THEN 'CLASS' ELSE m.kind END AS kind, pl.name, pl.descriptor, coalesce(pl.position, -1) AS position, CASE WHEN d = 0 THEN 'direct' ELSE 'meta' END AS match, CASE WHEN d = 1 THEN via END AS via
    FROM pl JOIN cur ON cur.id = pl.class_id LEFT JOIN (SELECT DISTINCT class_id, name, descriptor, kind FROM class_members) m ON m.class_id = pl.class_id AND m.name = pl.name AND m.descriptor = pl.descriptor"""
register("annotated_places", lambda s: filled(m.annotated_places(s, "org.acme.Core"), "position"), f"{CUR}, {_PLACES}")
register("annotated_places_direct", lambda s: filled(m.annotated_places(s, "org.acme.Core", meta=False), "position"), f"{CUR}, {_PLACES} WHERE d = 0")
