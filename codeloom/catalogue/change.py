"""Queries that compare two generations."""

from pyspark.sql import functions as F

from codeloom.catalogue import filled, register
from codeloom.catalogue.rules import _INJ
from codeloom.operators import compare, injection

_FP = """{n} AS (SELECT class_name, coalesce(kind, '') || '|' || coalesce(superclass, '') || '|' || coalesce(interface_name, '') || '|' || coalesce(source_file, '') || '|' || is_bean || '|' || origin || '|' || module || '|' || coalesce(source_set, '') || '|' ||
    coalesce((SELECT string_agg(kind || name || descriptor || modifiers || '#' || annotations, ';' ORDER BY kind, name, descriptor) FROM {m} m WHERE m.class_id = c.id), '') AS fp FROM {t} c)"""
register(
    "compare_classes",
    compare.compare_classes,
    f"""{_FP.format(n='a', m='class_members', t='classes')}, {_FP.format(n='b', m='baseline_members', t='baseline_classes')}
    SELECT coalesce(a.class_name, b.class_name) AS class_name, CASE WHEN b.fp IS NULL THEN 'added' WHEN a.fp IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.class_name = b.class_name WHERE a.fp IS DISTINCT FROM b.fp""",
)
_DEP = "{n} AS (SELECT x.class_name || ' -> ' || y.class_name || ' [' || d.kind || ']' AS dependency, CAST(sum(occurrence_count) AS BIGINT) AS n FROM {t} d JOIN {c} x ON x.id = from_class_id JOIN {c} y ON y.id = to_class_id WHERE x.lifecycle = 'current' AND x.origin <> 'orphan_output' AND y.lifecycle = 'current' AND y.origin <> 'orphan_output' GROUP BY 1)"
register(
    "compare_dependencies",
    lambda s: filled(compare.compare_dependencies(s), "was", "is_now"),
    f"""{_DEP.format(n='a', t='dependencies', c='classes')}, {_DEP.format(n='b', t='baseline_dependencies', c='baseline_classes')}
    SELECT coalesce(a.dependency, b.dependency) AS dependency, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'modified' END AS change, coalesce(b.n, -1) AS was, coalesce(a.n, -1) AS is_now FROM a FULL JOIN b ON a.dependency = b.dependency WHERE a.n IS DISTINCT FROM b.n""",
)
register(
    "delta_counts",
    lambda s: compare.delta_counts(s.baseline_dependencies, s.dependencies),
    """SELECT 'delete' AS change, count(*) AS rows FROM (SELECT * FROM baseline_dependencies EXCEPT SELECT * FROM dependencies) UNION ALL SELECT 'insert', count(*) FROM (SELECT * FROM dependencies EXCEPT SELECT * FROM baseline_dependencies)
    UNION ALL SELECT 'unchanged', count(*) FROM (SELECT * FROM dependencies INTERSECT SELECT * FROM baseline_dependencies)""",
)
register("delta_applied", lambda s: compare.apply_delta(s.baseline_dependencies, s.dependencies), "SELECT * FROM dependencies")
_VISIBLE = "CASE WHEN contains({m}, 'public') THEN 3 WHEN contains({m}, 'protected') THEN 2 WHEN contains({m}, 'private') THEN 0 WHEN {m} IS NULL THEN NULL ELSE 1 END"
_OWN = """{n} AS (SELECT class_name, coalesce(module, '') AS module, coalesce(source_set, '') AS source_set, count(*) AS n, min(id) AS id, min(kind) AS kind, min(coalesce(superclass, '')) AS superclass, min(coalesce(interface_name, '')) AS interface_name,
    min(coalesce((SELECT string_agg(DISTINCT annotation_name, ',' ORDER BY annotation_name) FROM {a} x WHERE x.class_id = c.id), '')) AS marks FROM {t} c WHERE coalesce(source_set, 'main') = 'main' GROUP BY 1, 2, 3)"""
_OTHER = "list_sort(list_filter(string_split({m}, ' '), lambda x: x NOT IN ('', 'public', 'protected', 'private', 'static', 'final', 'abstract')))"
_API = f"""{_OWN.format(n='a', a="(SELECT * FROM class_annotations WHERE direct)", t='classes')}, {_OWN.format(n='b', a='baseline_annotations', t='baseline_classes')},
    o AS (SELECT coalesce(a.class_name, b.class_name) AS class_name, coalesce(a.module, b.module) AS module, coalesce(a.source_set, b.source_set) AS source_set, a.id, b.id AS was_id, a.kind, b.kind AS was_kind, a.superclass || '|' || a.interface_name AS up, b.superclass || '|' || b.interface_name AS was_up, a.marks, b.marks AS was_marks,
    coalesce(a.n, 1) > 1 OR coalesce(b.n, 1) > 1 AS twice FROM a FULL JOIN b ON a.class_name = b.class_name AND a.module = b.module AND a.source_set = b.source_set), k AS (SELECT * FROM o WHERE NOT twice AND id IS NOT NULL AND was_id IS NOT NULL),
    n AS (SELECT class_name, module, source_set, m.kind || ' ' || name || ' ' || descriptor AS member, m.kind AS sort, modifiers, parameter_types, annotations FROM class_members m JOIN k ON k.id = class_id),
    w AS (SELECT class_name, module, source_set, m.kind || ' ' || name || ' ' || descriptor AS member, modifiers, parameter_types, annotations FROM baseline_members m JOIN k ON k.was_id = class_id),
    p AS (SELECT coalesce(n.class_name, w.class_name) AS class_name, coalesce(n.module, w.module) AS module, coalesce(n.source_set, w.source_set) AS source_set, coalesce(n.member, w.member) AS member, sort, n.modifiers AS m, w.modifiers AS wm, n.parameter_types AS pt, w.parameter_types AS wpt, n.annotations AS an, w.annotations AS wan,
    {_VISIBLE.format(m='n.modifiers')} AS v, {_VISIBLE.format(m='w.modifiers')} AS wv FROM n FULL JOIN w ON n.class_name = w.class_name AND n.module = w.module AND n.source_set = w.source_set AND n.member = w.member),
    q AS (SELECT * FROM p WHERE coalesce(v, 0) >= 2 OR coalesce(wv, 0) >= 2), c AS (SELECT * FROM q WHERE m IS NOT NULL AND wm IS NOT NULL),
    api AS (SELECT class_name, module, source_set, '' AS member, 'AMBIGUOUS_OWNER' AS reason, 'unknown' AS assessment FROM o WHERE twice UNION ALL SELECT class_name, module, source_set, '', 'CLASS_ADDED', 'review_required' FROM o WHERE NOT twice AND was_id IS NULL
    UNION ALL SELECT class_name, module, source_set, '', 'CLASS_REMOVED', 'potentially_breaking' FROM o WHERE NOT twice AND id IS NULL UNION ALL SELECT class_name, module, source_set, '', 'CLASS_KIND_CHANGED', 'potentially_breaking' FROM k WHERE kind <> was_kind
    UNION ALL SELECT class_name, module, source_set, '', 'HIERARCHY_CHANGED', 'potentially_breaking' FROM k WHERE up <> was_up UNION ALL SELECT class_name, module, source_set, '', 'CLASS_ANNOTATIONS_CHANGED', 'review_required' FROM k WHERE marks <> was_marks
    UNION ALL SELECT class_name, module, source_set, member, CASE WHEN sort = 'METHOD' AND contains(m, 'abstract') AND NOT contains(m, 'static') THEN 'ABSTRACT_METHOD_ADDED' ELSE 'MEMBER_ADDED' END, CASE WHEN sort = 'METHOD' AND contains(m, 'abstract') AND NOT contains(m, 'static') THEN 'potentially_breaking' ELSE 'review_required' END FROM q WHERE wm IS NULL
    UNION ALL SELECT class_name, module, source_set, member, 'MEMBER_REMOVED_OR_DESCRIPTOR_CHANGED', 'potentially_breaking' FROM q WHERE m IS NULL UNION ALL SELECT class_name, module, source_set, member, 'VISIBILITY_NARROWED', 'potentially_breaking' FROM c WHERE v < wv
    UNION ALL SELECT class_name, module, source_set, member, 'VISIBILITY_WIDENED', 'review_required' FROM c WHERE v > wv UNION ALL SELECT class_name, module, source_set, member, 'STATIC_INSTANCE_CHANGED', 'potentially_breaking' FROM c WHERE contains(m, 'static') <> contains(wm, 'static')
    UNION ALL SELECT class_name, module, source_set, member, 'FINAL_ADDED', 'potentially_breaking' FROM c WHERE contains(m, 'final') AND NOT contains(wm, 'final') UNION ALL SELECT class_name, module, source_set, member, 'ABSTRACT_ADDED', 'potentially_breaking' FROM c WHERE contains(m, 'abstract') AND NOT contains(wm, 'abstract')
    UNION ALL SELECT class_name, module, source_set, member, 'SOURCE_SIGNATURE_CHANGED', 'review_required' FROM c WHERE pt <> wpt UNION ALL SELECT class_name, module, source_set, member, 'ANNOTATIONS_CHANGED', 'review_required' FROM c WHERE an <> wan
    UNION ALL SELECT class_name, module, source_set, member, 'OTHER_MODIFIERS_CHANGED', 'review_required' FROM c WHERE {_OTHER.format(m='m')} <> {_OTHER.format(m='wm')} OR (contains(wm, 'final') AND NOT contains(m, 'final')) OR (contains(wm, 'abstract') AND NOT contains(m, 'abstract')))"""
register("api_findings", compare.api_findings, f"{_API} SELECT * FROM api")
register("api_verdicts", lambda s: compare.api_verdict(compare.api_findings(s)), f"{_API} SELECT class_name, CASE WHEN bool_or(assessment = 'potentially_breaking') THEN 'potentially_breaking' WHEN bool_or(assessment = 'unknown') THEN 'unknown' ELSE 'review_required' END AS verdict, count(*) AS findings FROM api GROUP BY 1")
register(
    "api_finding_impact",
    compare.finding_impact,
    f"{_API} SELECT class_name, count(DISTINCT from_class_id) AS users, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM baseline_dependencies JOIN baseline_classes c ON c.id = to_class_id WHERE class_name IN (SELECT class_name FROM api WHERE assessment = 'potentially_breaking') GROUP BY 1",
)
_LEVEL = "CASE WHEN contains({f}, 'public') THEN 3 WHEN contains({f}, 'protected') THEN 2 WHEN contains({f}, 'private') THEN 0 ELSE 1 END"
_REST = "list_sort(list_filter(string_split({f}, ' '), lambda x: x NOT IN ('', 'public', 'protected', 'private', 'final', 'abstract')))"
_JVM = f"""jk AS (SELECT class_name, coalesce(module, '') AS module, coalesce(source_set, '') AS source_set, id FROM classes WHERE coalesce(source_set, 'main') = 'main' QUALIFY count(*) OVER (PARTITION BY class_name, module, source_set) = 1),
    jw AS (SELECT class_name, coalesce(module, '') AS module, coalesce(source_set, '') AS source_set, id FROM baseline_classes WHERE coalesce(source_set, 'main') = 'main' QUALIFY count(*) OVER (PARTITION BY class_name, module, source_set) = 1),
    kp AS (SELECT jk.*, jw.id AS was_id FROM jk JOIN jw USING (class_name, module, source_set)), vis AS (SELECT class_id AS id, kind || ' ' || name || ' ' || descriptor AS member FROM class_members WHERE contains(modifiers, 'public') OR contains(modifiers, 'protected')),
    wvis AS (SELECT class_id AS id, kind || ' ' || name || ' ' || descriptor AS member FROM baseline_members WHERE contains(modifiers, 'public') OR contains(modifiers, 'protected')),
    jb AS (SELECT kp.*, a.member, a.field, b.value AS before, a.value AS after FROM kp JOIN jvm_api a ON a.class_id = kp.id JOIN baseline_jvm_api b ON b.class_id = kp.was_id AND b.member = a.member AND b.field = a.field WHERE a.value <> b.value),
    jf AS (SELECT * FROM jb WHERE field = 'flags'), jr AS (SELECT class_name, module, source_set, '' AS member, 'JVM_API_EVIDENCE_INCOMPLETE' AS reason, NULL AS before, NULL AS after, 'unknown' AS assessment FROM kp WHERE (id IN (SELECT class_id FROM jvm_api)) <> (was_id IN (SELECT class_id FROM baseline_jvm_api))
    UNION ALL SELECT class_name, module, source_set, '', CASE WHEN {_LEVEL.format(f='after')} < {_LEVEL.format(f='before')} THEN 'CLASS_VISIBILITY_NARROWED' ELSE 'CLASS_VISIBILITY_WIDENED' END, before, after, CASE WHEN {_LEVEL.format(f='after')} < {_LEVEL.format(f='before')} THEN 'potentially_breaking' ELSE 'review_required' END FROM jf WHERE {_LEVEL.format(f='after')} <> {_LEVEL.format(f='before')}
    UNION ALL SELECT class_name, module, source_set, '', 'CLASS_FINAL_ADDED', before, after, 'potentially_breaking' FROM jf WHERE contains(after, 'final') AND NOT contains(before, 'final')
    UNION ALL SELECT class_name, module, source_set, '', 'CLASS_ABSTRACT_ADDED', before, after, 'potentially_breaking' FROM jf WHERE contains(after, 'abstract') AND NOT contains(before, 'abstract')
    UNION ALL SELECT class_name, module, source_set, '', 'CLASS_OTHER_MODIFIERS_CHANGED', before, after, 'review_required' FROM jf WHERE {_REST.format(f='before')} <> {_REST.format(f='after')} OR (contains(before, 'final') AND NOT contains(after, 'final')) OR (contains(before, 'abstract') AND NOT contains(after, 'abstract'))
    UNION ALL SELECT class_name, module, source_set, member, CASE WHEN member = '' THEN 'CLASS_GENERIC_SIGNATURE_CHANGED' WHEN field = 'signature' THEN 'GENERIC_SIGNATURE_CHANGED' WHEN field = 'exceptions' THEN 'THROWS_CHANGED' ELSE 'CONSTANT_VALUE_CHANGED' END, before, after, 'review_required' FROM jb
    WHERE field <> 'flags' AND (member = '' OR EXISTS (SELECT 1 FROM vis WHERE vis.id = jb.id AND vis.member = jb.member) OR EXISTS (SELECT 1 FROM wvis WHERE wvis.id = was_id AND wvis.member = jb.member)))"""
register("jvm_api_findings", compare.jvm_api_findings, f"{_JVM} SELECT * FROM jr")
_BEANS = "SELECT b.id, class_name, class_name || ' [' || b.kind || '] ' AS bean FROM {t} b JOIN {c} c ON c.id = b.class_id WHERE lifecycle = 'current' AND origin <> 'orphan_output'"
_SIDES = f"n AS ({_BEANS.format(t='beans', c='classes')}), w AS ({_BEANS.format(t='baseline_beans', c='baseline_classes')})"
register("compare_beans", compare.compare_beans, f"{_SIDES} SELECT bean, 'added' AS change FROM (SELECT bean FROM n EXCEPT SELECT bean FROM w) UNION ALL SELECT bean, 'removed' FROM (SELECT bean FROM w EXCEPT SELECT bean FROM n)")
_POINT = "SELECT class_name || '#' || field_name || ' [FIELD:' || target_type || ':' || qualifier || ']' AS injection, max(status || ':' || reason) AS value FROM {p} p JOIN {b} ON {b}.id = p.bean_id GROUP BY 1"
register(
    "compare_injections",
    lambda s: compare.compare_injections(
        compare.injection_values(s.baseline_injections, s.baseline_beans, s.baseline_classes),
        compare.injection_values(s.injection_points.join(injection.resolved_points(s).select(F.col("point_id").alias("id"), "status"), "id"), s.beans, s.classes),
    ),
    f"""{_INJ}, {_SIDES}, np AS (SELECT ip.*, status, '' AS reason FROM injection_points ip JOIN rs ON rs.point_id = ip.id), a AS ({_POINT.format(p='np', b='n')}), z AS ({_POINT.format(p='baseline_injections', b='w')})
    SELECT coalesce(a.injection, z.injection) AS injection, CASE WHEN z.value IS NULL THEN 'added' WHEN a.value IS NULL THEN 'removed' ELSE 'resolution_changed' END AS change, z.value AS was, a.value AS is_now FROM a FULL JOIN z ON a.injection = z.injection WHERE a.value IS DISTINCT FROM z.value""",
)
