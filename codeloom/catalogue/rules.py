"""Queries of risk, unused code, usages, injection, configuration and resources."""

from pyspark.sql import functions as F

from codeloom.catalogue import CUR, filled, register
from codeloom.catalogue.graphs import RESOLVED
from codeloom.operators import beans, configuration, injection, metrics, risk, unused, usage

_S = "CASE WHEN {x} <= {a} THEN 0.0 WHEN {x} >= {d} THEN 10.0 WHEN {x} <= {b} THEN 5.0 * ({x} - {a}) / ({b} - {a}) WHEN {x} <= {c} THEN 5 + 3.0 * ({x} - {b}) / ({c} - {b}) ELSE 8 + 2.0 * ({x} - {c}) / ({d} - {c}) END"


def _scale(x: str, a: int, b: int, c: int, d: int) -> str:
    return f"({_S.format(x=f'CAST({x} AS DOUBLE)', a=a, b=b, c=c, d=d)})"


_BUS = "(CASE {x} WHEN 1 THEN 10.0 WHEN 2 THEN 5.0 WHEN 3 THEN 2.0 ELSE 0.0 END)"
_LEVEL = "CASE WHEN score >= 8 THEN 'CRITICAL' WHEN score >= 6 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END"
_GIT = """cf AS (SELECT DISTINCT commit_id, file_path FROM commit_files), cc AS (SELECT a.file_path, least(count(DISTINCT b.file_path), 100) AS co FROM cf a JOIN cf b ON a.commit_id = b.commit_id AND a.file_path <> b.file_path GROUP BY 1),
    gf AS (SELECT f.file_path, min(f.class_id) AS class_id, count(DISTINCT commit_id) AS churn, count(DISTINCT author) AS authors FROM commit_files f JOIN commits c ON c.id = commit_id GROUP BY 1)"""
_RISK = f"""{CUR}, e AS (SELECT * FROM dependencies WHERE from_class_id IN (SELECT id FROM cur) AND to_class_id IN (SELECT id FROM cur)), {_GIT},
    fi AS (SELECT to_class_id AS id, count(DISTINCT from_class_id) AS n FROM e GROUP BY 1), fo AS (SELECT from_class_id AS id, count(DISTINCT to_class_id) AS n FROM e GROUP BY 1),
    w AS (SELECT c.id, c.class_name, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out, coalesce(churn, 0) AS churn, coalesce(authors, 0) AS authors, coalesce(co, 0) AS co_changed
    FROM cur c LEFT JOIN fi ON fi.id = c.id LEFT JOIN fo ON fo.id = c.id LEFT JOIN gf ON gf.class_id = c.id LEFT JOIN cc ON cc.file_path = gf.file_path),
    risk AS (SELECT *, floor((0.3 * {_scale('fan_in', 0, 3, 8, 15)} + 0.1 * {_scale('fan_out', 0, 3, 5, 8)} + 0.25 * {_scale('churn', 2, 10, 30, 50)} + 0.2 * {_BUS.format(x='authors')} + 0.15 * {_scale('co_changed', 0, 3, 5, 8)}) * 10 + 0.5) / 10 AS score FROM w)"""
register("class_risk", risk.class_risk, f"{_RISK} SELECT *, {_LEVEL} AS level FROM risk")
_CRIT = """CASE WHEN regexp_matches(p, '(^|/)META-INF/services/') THEN 10 WHEN b IN ('pom.xml', 'build.gradle', 'build.gradle.kts', 'settings.gradle', 'settings.gradle.kts', 'gradle.properties', 'maven-wrapper.properties', 'gradle-wrapper.properties') OR regexp_matches(p, '(^|/)buildSrc/') OR regexp_matches(p, '(^|/)gradle/libs\\.versions\\.') THEN 9
    WHEN regexp_matches(p, '(^|/)\\.github/workflows/') THEN 8 WHEN regexp_matches(p, '(^|/)src/main/resources/') THEN 7 WHEN regexp_matches(p, '(^|/)src/main/') THEN 5 WHEN regexp_matches(p, '(^|/)src/test/') THEN 3 WHEN b LIKE '%.md' OR b LIKE '%.adoc' THEN 1 ELSE 4 END"""
register(
    "file_risk",
    risk.file_risk,
    f"""{_GIT}, af AS (SELECT file_path FROM commit_files UNION SELECT path FROM files WHERE lifecycle <> 'deleted'),
    n AS (SELECT af.file_path, churn, authors, coalesce(co, 0) AS co, af.file_path AS p, regexp_extract(af.file_path, '[^/]*$') AS b FROM af LEFT JOIN gf ON gf.file_path = af.file_path LEFT JOIN cc ON cc.file_path = af.file_path), k AS (SELECT *, {_CRIT} AS criticality FROM n),
    r AS (SELECT file_path, criticality, CASE WHEN churn IS NULL THEN CAST(criticality AS DOUBLE) ELSE floor((0.5 * criticality + 0.2 * {_scale('churn', 2, 10, 30, 50)} + 0.15 * {_BUS.format(x='authors')} + 0.15 * {_scale('co', 0, 3, 5, 8)}) * 10 + 0.5) / 10 END AS score FROM k) SELECT *, {_LEVEL} AS level FROM r""",
)
_NAMES = ("pom.xml", "a/build.gradle.kts", "buildSrc/x.kt", "gradle/libs.versions.toml", "x/.github/workflows/ci.yml", ".github/CODEOWNERS", "m/src/main/resources/META-INF/services/a.B", "src/main/resources/application.yml", "README.md", "docs/a.adoc", "src/test/java/ATest.java", "notes.txt", "sql/a.sql")
_PATHS = "SELECT DISTINCT path FROM (SELECT path FROM {resources} UNION ALL SELECT source_file FROM {classes} UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") AS v(path))"


def _paths(s):
    return s.spark.sql(_PATHS, resources=s.resources, classes=s.classes)


register(
    "file_criticality",
    lambda s: _paths(s).select("path", risk.file_criticality(F.col("path")).alias("criticality")).distinct(),
    f"n AS (SELECT path, path AS p, regexp_extract(path, '[^/]*$') AS b FROM ({_PATHS.format(resources='resources', classes='classes')})) SELECT path, {_CRIT} AS criticality FROM n",
)
register(
    "file_kinds",
    lambda s: _paths(s).select("path", risk.file_kind(F.col("path")).alias("kind")).distinct(),
    f"""SELECT path, CASE WHEN regexp_matches(path, '(^|/)META-INF/services/') THEN 'service_descriptor' WHEN regexp_extract(path, '[^/]*$') IN ('pom.xml', 'build.gradle', 'build.gradle.kts', 'settings.gradle', 'settings.gradle.kts', 'gradle.properties', 'maven-wrapper.properties', 'gradle-wrapper.properties')
    OR regexp_matches(path, '(^|/)buildSrc/|(^|/)gradle/libs\\.versions\\.') THEN 'build_configuration' WHEN regexp_matches(path, '(^|/)\\.github/workflows/') THEN 'ci_configuration' WHEN contains(path, '/resources/') OR starts_with(path, 'src/main/resources/') THEN 'resource'
    WHEN path LIKE '%.java' OR path LIKE '%.kt' THEN 'source' WHEN regexp_matches(path, '(^|/)src/test/') THEN 'test' WHEN path LIKE '%.md' OR path LIKE '%.adoc' THEN 'documentation' ELSE 'file' END AS kind FROM ({_PATHS.format(resources='resources', classes='classes')})""",
)
_TARGETS = lambda s: s.classes.where("id IN (0, 3, 17, 40)").select("id")
_TESTS = "tests AS (SELECT id, class_name FROM cur WHERE source_set = 'test' OR regexp_matches(source_file, '(^|/)src/test/|(Test|Tests|IT|ITCase|Spec)\\.(java|kt)$'))"
_REACH = "w0 AS (SELECT unnest([CAST(0 AS BIGINT), 3, 17, 40]) AS node, 0 AS depth UNION SELECT from_class_id, depth + 1 FROM w0 JOIN dependencies ON to_class_id = node WHERE depth < {d})"
_IMPACTED = f"""{CUR}, {_TESTS}, {_REACH.format(d=3)}, wi AS (SELECT node AS id, min(depth) AS depth FROM w0 GROUP BY 1 HAVING min(depth) > 0),
    j0 AS (SELECT b.class_id, b.file_path, t.id AS test FROM (SELECT commit_id, class_id FROM commit_files WHERE class_id IN (0, 3, 17, 40)) a JOIN commit_files b ON a.commit_id = b.commit_id AND (b.class_id IS NULL OR a.class_id <> b.class_id) LEFT JOIN tests t ON t.id = b.class_id),
    j AS (SELECT test AS id, count(*) AS n FROM j0 WHERE test IS NOT NULL GROUP BY 1), jf AS (SELECT file_path, count(*) AS n FROM j0 WHERE test IS NULL AND regexp_matches(file_path, '(^|/)src/test/|(Test|Tests|IT|ITCase|Spec)\\.(java|kt)$') GROUP BY 1),
    it AS (SELECT t.id, class_name, depth, n FROM tests t LEFT JOIN wi ON wi.id = t.id LEFT JOIN j ON j.id = t.id WHERE depth IS NOT NULL OR n IS NOT NULL UNION ALL SELECT NULL, file_path, NULL, n FROM jf),
    im AS (SELECT coalesce(id, -1) AS id, class_name, CAST(coalesce(depth, -1) AS INTEGER) AS depth, coalesce(n, 0) AS co_changes, CAST(least(100, CASE WHEN depth IS NULL THEN 0 ELSE greatest(20, 100 - (depth - 1) * 15) END + least(30, 5 * coalesce(n, 0))) AS BIGINT) AS score,
    CASE WHEN depth <= 1 THEN 'high' WHEN depth IS NOT NULL OR n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM it)"""
register(
    "impacted_tests",
    lambda s: filled(risk.impacted_tests(s, _TARGETS(s)), "depth", "id"),
    f"{_IMPACTED} SELECT * FROM im",
)
register(
    "design_impact",
    lambda s: risk.design_impact(s, _TARGETS(s)),
    f"""{_RISK}, {_TESTS}, c0 AS (SELECT x AS origin, x AS node, 0 AS depth FROM (SELECT unnest([CAST(0 AS BIGINT), 3, 17, 40]) AS x) UNION SELECT origin, from_class_id, depth + 1 FROM c0 JOIN dependencies ON to_class_id = node WHERE depth < 3),
    t AS (SELECT origin AS id, count(DISTINCT node) AS n FROM c0 WHERE node <> origin AND node IN (SELECT id FROM tests) GROUP BY 1),
    i AS (SELECT r.id, class_name, score AS risk, fan_in, coalesce(n, 0) AS tests, floor((0.6 * score + 0.25 * least(10.0, fan_in / 2.0) + 0.15 * least(10.0, coalesce(n, 0) / 5.0)) * 10 + 0.5) / 10 AS impact FROM risk r LEFT JOIN t ON t.id = r.id WHERE r.id IN (0, 3, 17, 40))
    SELECT *, CAST(row_number() OVER (ORDER BY impact, class_name) AS INTEGER) AS place FROM i""",
)
_EVID = f"""{CUR}, ev AS (SELECT id, class_name, kind, origin, source_set, is_bean, source_tokens,
    (SELECT count(DISTINCT from_class_id) FROM dependencies d JOIN cur u ON u.id = from_class_id WHERE to_class_id = c.id AND coalesce(u.source_set, 'main') <> 'test') AS inbound,
    (SELECT count(*) FROM cur x WHERE x.superclass = c.class_name) + (SELECT count(*) FROM class_interfaces ci JOIN cur x ON x.id = ci.class_id WHERE ci.interface_name = c.class_name) AS subtypes,
    (SELECT count(*) FROM class_annotations a WHERE a.class_id = c.id AND direct) AS annotations,
    EXISTS (SELECT 1 FROM class_members m WHERE m.class_id = c.id AND m.name = 'main' AND m.descriptor = '([Ljava/lang/String;)V' AND modifiers = 'public static') AS has_main, EXISTS (SELECT 1 FROM service_registrations r WHERE r.class_id = c.id) AS provider FROM cur c)"""
register("unused_class_evidence", unused.class_evidence, f"{_EVID} SELECT * FROM ev")
_FREE = "inbound = 0 AND subtypes = 0 AND NOT is_bean AND annotations = 0 AND NOT has_main AND NOT provider"
register("unused_classes", lambda s: unused.unused_classes(s, limit=200), f"{_EVID} SELECT id, class_name, source_tokens, CASE WHEN kind = 'CLASS' AND origin = 'source' THEN 'medium' ELSE 'low' END AS confidence FROM ev WHERE {_FREE} ORDER BY confidence DESC, source_tokens DESC, class_name LIMIT 200")
register(
    "unused_class_exclusions",
    unused.class_exclusions,
    f"""{_EVID} SELECT * FROM (SELECT 'inbound' AS reason, count(*) AS classes FROM ev WHERE inbound > 0 UNION ALL SELECT 'hierarchy', count(*) FROM ev WHERE subtypes > 0 UNION ALL SELECT 'bean', count(*) FROM ev WHERE is_bean
    UNION ALL SELECT 'annotated', count(*) FROM ev WHERE annotations > 0 UNION ALL SELECT 'main', count(*) FROM ev WHERE has_main UNION ALL SELECT 'provider', count(*) FROM ev WHERE provider) WHERE classes > 0""",
)
_HANDLES = "ho AS (SELECT DISTINCT to_class_id AS class_id FROM dependencies WHERE kind = '{0}_HANDLE_REFERENCE')"
_MV = f"""{CUR}, {_HANDLES.format('METHOD')}, mv AS (SELECT m.class_id, class_name, name, descriptor, CASE WHEN m.class_id IN (SELECT class_id FROM ho) THEN 'handle_owner' WHEN annotations <> '' THEN 'annotated' WHEN contains(modifiers, 'native') THEN 'native'
    WHEN EXISTS (SELECT 1 FROM method_calls x WHERE x.target_class_id = m.class_id AND x.target_method = m.name AND x.target_descriptor = m.descriptor AND x.caller_class_id IN (SELECT id FROM cur)) THEN 'used' ELSE 'unused' END AS verdict
    FROM class_members m JOIN cur ON cur.id = m.class_id WHERE m.kind = 'METHOD' AND contains(modifiers, 'private'))"""
register("unused_methods", unused.method_verdicts, f"{_MV} SELECT * FROM mv")
register("unused_method_exclusions", lambda s: unused.exclusions(unused.method_verdicts(s)), f"{_MV} SELECT verdict, count(*) AS members FROM mv GROUP BY 1")
_FV = f"""{CUR}, {_HANDLES.format('FIELD')}, h AS (SELECT class_name AS child, superclass AS parent FROM classes UNION ALL SELECT class_name, ci.interface_name FROM classes JOIN class_interfaces ci ON ci.class_id = id), se AS (SELECT child AS name FROM h WHERE parent = 'java.io.Serializable' UNION SELECT child FROM se JOIN h ON parent = name),
    fa AS (SELECT owner_class_id, field_name, count(*) FILTER (WHERE access_kind LIKE 'read%') AS r, count(*) FILTER (WHERE access_kind LIKE 'write%') AS w FROM field_accesses WHERE accessor_class_id IN (SELECT id FROM cur) GROUP BY 1, 2),
    fv AS (SELECT m.class_id, class_name, name, CASE WHEN m.class_id IN (SELECT class_id FROM ho) THEN 'handle_owner' WHEN annotations <> '' THEN 'annotated' WHEN contains(modifiers, 'static final') THEN 'constant' WHEN class_name IN (SELECT name FROM se) THEN 'serializable'
    WHEN r > 0 THEN 'read' WHEN w > 0 THEN 'write_only' ELSE 'unused' END AS verdict FROM class_members m JOIN cur ON cur.id = m.class_id LEFT JOIN fa ON fa.owner_class_id = m.class_id AND fa.field_name = m.name WHERE m.kind = 'FIELD' AND contains(modifiers, 'private'))"""
register("unused_fields", unused.field_verdicts, f"{_FV} SELECT * FROM fv")
_KIND = "CASE {k} WHEN 'CONSTRUCTS' THEN 'constructor_call' WHEN 'CALLS' THEN 'method_call' WHEN 'METHOD_HANDLE_REFERENCE' THEN 'method_handle_reference' WHEN 'FIELD_HANDLE_REFERENCE' THEN 'field_handle_reference' WHEN 'CDI_INJECT' THEN 'injection' ELSE 'type_reference' END"
_USES = f"""i AS (SELECT c.id, c.kind, c.superclass AS parent, 'EXTENDS' AS relation FROM classes c UNION ALL SELECT id, kind, ci.interface_name, CASE kind WHEN 'INTERFACE' THEN 'EXTENDS_INTERFACE' ELSE 'IMPLEMENTS' END FROM classes JOIN class_interfaces ci ON ci.class_id = id),
    cu AS (SELECT to_class_id AS target_id, from_class_id AS user_id, class_name, {_KIND.format(k='d.kind')} AS usage, d.kind, occurrence_count AS occurrences,
    (SELECT string_agg(line, ',' ORDER BY line) FROM dependency_lines l WHERE l.from_class_id = d.from_class_id AND l.to_class_id = d.to_class_id AND l.kind = d.kind) AS lines
    FROM dependencies d JOIN cur u ON u.id = from_class_id WHERE to_class_id IN (0, 3, 17, 40)
    UNION ALL SELECT t.id, cur.id, cur.class_name, 'inheritance', relation, CAST(count(*) AS BIGINT), '' FROM i JOIN cur ON cur.id = i.id JOIN classes t ON t.class_name = i.parent WHERE t.id IN (0, 3, 17, 40) GROUP BY 1, 2, 3, 4, 5
    UNION ALL SELECT t.id, cur.id, cur.class_name, 'annotation', CASE WHEN bool_or(direct) THEN 'ANNOTATED_WITH' ELSE 'META_ANNOTATED_WITH' END, 1, '' FROM class_annotations a JOIN cur ON cur.id = a.class_id JOIN classes t ON t.class_name = annotation_name WHERE t.id IN (0, 3, 17, 40) GROUP BY 1, 2, 3)"""
register("class_usages", lambda s: usage.class_usages(s, _TARGETS(s)), f"{CUR}, {_USES} SELECT * FROM cu")
register("field_usages", lambda s: usage.field_usages(s, s.classes.select("id"), access="write"), "SELECT * FROM field_accesses WHERE access_kind LIKE 'write%'")
register(
    "method_usages",
    lambda s: usage.method_usages(s, s.classes.select("id")),
    f"""{RESOLVED} SELECT owner_id, x.target_method AS name, x.target_descriptor AS descriptor, x.target_class_id AS named_id, caller_class_id, caller_method, occurrence_count FROM ro JOIN method_calls x ON target_class_id = id AND target_method = name AND target_descriptor = descriptor WHERE owner_id IS NOT NULL""",
)
register(
    "class_cards",
    lambda s: usage.class_cards(s, s.classes.select("id")),
    f"""{CUR}, e AS (SELECT * FROM dependencies WHERE from_class_id IN (SELECT id FROM cur) AND to_class_id IN (SELECT id FROM cur)) SELECT id, class_name, (SELECT count(DISTINCT from_class_id) FROM e WHERE to_class_id = c.id) AS fan_in, (SELECT count(DISTINCT to_class_id) FROM e WHERE from_class_id = c.id) AS fan_out,
    (SELECT count(*) FROM class_members m WHERE m.class_id = c.id AND m.kind = 'METHOD') AS methods, (SELECT count(*) FROM class_members m WHERE m.class_id = c.id AND m.kind = 'FIELD') AS fields, (SELECT count(*) FROM class_members m WHERE m.class_id = c.id AND m.kind = 'CONSTRUCTOR') AS constructors,
    (SELECT count(DISTINCT external_type) FROM external_deps x WHERE x.class_id = c.id) AS external_types, coalesce((SELECT string_agg(DISTINCT annotation_name, ',' ORDER BY annotation_name) FROM class_annotations a WHERE a.class_id = c.id AND direct), '') AS annotations FROM cur c""",
)
register(
    "state_lifecycle",
    lambda s: usage.state_lifecycle(s, s.classes.select("id")),
    """r AS (SELECT to_class_id AS target_id, from_class_id AS class_id, '' AS method, 'create' AS event, occurrence_count FROM dependencies WHERE kind = 'CONSTRUCTS'
    UNION ALL SELECT owner_class_id, accessor_class_id, accessor_method, CASE WHEN access_kind LIKE 'read%' THEN 'read' ELSE 'write' END, occurrence_count FROM field_accesses),
    g AS (SELECT target_id, class_id, class_name, method, event, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM r JOIN classes ON id = class_id GROUP BY ALL),
    x AS (SELECT *, CASE WHEN contains(method, 'Store') THEN 'persistence' WHEN contains(method, 'Worker') THEN 'dispatch' WHEN contains(method, 'Timer') THEN 'recovery' WHEN contains(method, 'Codec') THEN 'serialization' ELSE '' END AS roles FROM g)
    SELECT *, CASE WHEN event = 'create' THEN 'high' WHEN roles <> '' THEN 'medium' ELSE 'low' END AS confidence FROM x""",
)
_FITS = "len(list_filter(string_split({w}, ','), lambda x: x <> '@Any' AND NOT list_contains(string_split({h}, ','), x))) = 0"
_SP = "sp AS (SELECT id, specializes_id AS specialized FROM beans WHERE specializes_id IS NOT NULL UNION SELECT sp.id, b.specializes_id FROM sp JOIN beans b ON b.id = specialized WHERE b.specializes_id IS NOT NULL)"


def _steps(key: str) -> str:
    """Resolution of ``q0`` (keys, candidate_id, fits, is_default, is_alternative, priority), step by step, to ``s6`` with reasons."""
    same = " AND ".join(f"o.{k} = q.{k}" for k in key.split(", "))
    return f"""s1 AS (SELECT *, fits AND EXISTS (SELECT 1 FROM q0 o JOIN sp ON sp.id = o.candidate_id WHERE {same} AND o.fits AND sp.specialized = q.candidate_id) AS replaced FROM q0 q),
    s2 AS (SELECT *, fits AND NOT replaced AS alive, bool_or(fits AND NOT replaced AND NOT is_default) OVER w AS others FROM s1 WINDOW w AS (PARTITION BY {key})),
    s3 AS (SELECT *, alive AND coalesce(priority, 0) = max(CASE WHEN alive THEN coalesce(priority, 0) END) OVER w AS top, max(CASE WHEN alive AND NOT is_default AND is_alternative THEN priority END) OVER w AS best FROM s2 WINDOW w AS (PARTITION BY {key})),
    s4 AS (SELECT *, alive AND NOT is_default AND CASE WHEN best IS NULL THEN NOT is_alternative ELSE is_alternative AND coalesce(priority = best, false) END AS won FROM s3),
    s5 AS (SELECT *, count(*) FILTER (WHERE won) OVER w AS winners, count(*) FILTER (WHERE top) OVER w AS tops FROM s4 WINDOW w AS (PARTITION BY {key})),
    s6 AS (SELECT *, CASE WHEN NOT fits THEN 'QUALIFIER_MISMATCH' WHEN replaced THEN 'SPECIALIZED_BY' WHEN others AND is_default THEN 'DEFAULT_BEAN_SUPPRESSED' WHEN NOT others AND NOT top THEN 'LOWER_PRIORITY_DEFAULT_BEAN'
    WHEN NOT others AND tops = 1 THEN 'DEFAULT_BEAN_FALLBACK_SELECTED' WHEN NOT others THEN 'SAME_PRIORITY_DEFAULT_BEAN' WHEN best IS NOT NULL AND NOT won THEN 'LOWER_PRIORITY_OR_NON_ALTERNATIVE' WHEN best IS NOT NULL AND winners = 1 THEN 'HIGHEST_PRIORITY_ALTERNATIVE'
    WHEN best IS NOT NULL THEN 'SAME_PRIORITY_ALTERNATIVE' WHEN NOT won THEN 'INACTIVE_ALTERNATIVE' WHEN winners = 1 THEN 'UNIQUE_ELIGIBLE_CANDIDATE' ELSE 'MULTIPLE_ELIGIBLE_CANDIDATES' END AS reason FROM s5),
    cand AS (SELECT {key}, candidate_id, CASE WHEN reason IN ('DEFAULT_BEAN_FALLBACK_SELECTED', 'HIGHEST_PRIORITY_ALTERNATIVE', 'UNIQUE_ELIGIBLE_CANDIDATE') THEN 'SELECTED' WHEN reason IN ('SAME_PRIORITY_DEFAULT_BEAN', 'SAME_PRIORITY_ALTERNATIVE', 'MULTIPLE_ELIGIBLE_CANDIDATES') THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS disposition, reason FROM s6)"""


_INJ = f"""{_SP}, q0 AS (SELECT p.id AS point_id, b.id AS candidate_id, {_FITS.format(w='p.qualifier', h='b.qualifier')} AS fits, b.is_default, b.is_alternative, b.priority FROM injection_points p JOIN beans b ON bean_type = target_type), {_steps('point_id')},
    res AS (SELECT p.id AS point_id, max(candidate_id) FILTER (WHERE disposition = 'SELECTED') AS bean_id, count(*) FILTER (WHERE disposition IN ('SELECTED', 'ELIGIBLE')) AS n FROM injection_points p LEFT JOIN cand c ON c.point_id = p.id GROUP BY 1),
    rs AS (SELECT point_id, bean_id, CASE WHEN bean_id IS NOT NULL THEN 'RESOLVED' WHEN n > 0 THEN 'AMBIGUOUS' ELSE 'UNSATISFIED' END AS status FROM res)"""
_TYPED = f"""{_SP}, q0 AS (SELECT p.id AS point_id, b.id AS candidate_id, len(list_filter(p.qualifiers, lambda q: q <> '@Any' AND NOT list_contains(b.qualifiers, q))) = 0 AS fits, b.is_default, b.is_alternative, b.priority FROM typed_points p JOIN typed_beans b ON list_contains(b.types, p.target_type)), {_steps('point_id')}"""
register("typed_bean_matches", lambda s: beans.matching_beans(s.typed_points, s.typed_beans), f"{_TYPED} SELECT point_id, candidate_id FROM q0 WHERE fits")
register("typed_injection_candidates", lambda s: beans.typed_candidates(s.typed_points, s.typed_beans), f"{_TYPED} SELECT * FROM cand WHERE reason <> 'QUALIFIER_MISMATCH'")
register(
    "typed_injection_resolution",
    lambda s: filled(beans.typed_resolution(s.typed_points, s.typed_beans), "bean_id"),
    f"""{_TYPED}, tr AS (SELECT p.id AS point_id, max(candidate_id) FILTER (WHERE disposition = 'SELECTED') AS bean_id, count(*) FILTER (WHERE disposition IN ('SELECTED', 'ELIGIBLE')) AS n FROM typed_points p LEFT JOIN cand c ON c.point_id = p.id GROUP BY 1)
    SELECT point_id, coalesce(bean_id, -1) AS bean_id, CASE WHEN bean_id IS NOT NULL THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNSATISFIED' END AS status FROM tr""",
)
register("injection_candidates", injection.candidates, f"{_INJ} SELECT * FROM cand")
register("injection_resolution", lambda s: filled(injection.resolved_points(s), "bean_id"), f"{_INJ} SELECT point_id, coalesce(bean_id, -1) AS bean_id, status FROM rs")
register("injection_problems", lambda s: metrics.injection_problem_counts(injection.resolved_points(s)), f"{_INJ} SELECT status, count(*) AS points FROM rs GROUP BY 1")
register("injection_points_of_class", lambda s: filled(injection.injection_points_of(s, 21), "resolved_bean_id"), f"{_INJ} SELECT p.id AS point_id, field_name, target_type, p.qualifier, coalesce(rs.bean_id, -1) AS resolved_bean_id, status FROM injection_points p JOIN rs ON rs.point_id = p.id WHERE p.bean_id IN (SELECT id FROM beans WHERE class_id = 21)")
register(
    "named_resolution",
    lambda s: filled(injection.named_resolution(s), "bean_id"),
    f"""q AS (SELECT p.id AS point_id, b.id AS c, is_primary FROM injection_points p JOIN beans b ON bean_type = target_type WHERE p.qualifier = '@Default' OR {_FITS.format(w='p.qualifier', h='b.qualifier')}),
    g AS (SELECT p.id AS point_id, count(c) AS n, min(c) AS lone, count(*) FILTER (WHERE is_primary) AS d, min(c) FILTER (WHERE is_primary) AS prim FROM injection_points p LEFT JOIN q ON q.point_id = p.id GROUP BY 1)
    SELECT point_id, CASE WHEN n = 1 THEN lone WHEN d = 1 THEN prim ELSE -1 END AS bean_id, CASE WHEN n = 0 THEN 'UNSATISFIED' WHEN n = 1 OR d = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM g""",
)
_VIS = "v AS (SELECT DISTINCT module, module AS visible FROM classes UNION SELECT v.module, e.visible FROM v JOIN module_edges e ON e.module = v.visible AND relation = 'compile')"
register(
    "context_resolution",
    injection.in_context,
    f"""{_VIS}, {_SP}, k AS (SELECT p.id AS point_id, v.module AS application, target_type, qualifier FROM injection_points p JOIN v ON v.visible = p.module), bv AS (SELECT beans.*, v.module AS application FROM beans JOIN v ON v.visible = beans.module),
    q0 AS (SELECT k.point_id, k.application, b.id AS candidate_id, {_FITS.format(w='k.qualifier', h='b.qualifier')} AS fits, b.is_default, b.is_alternative, b.priority FROM k JOIN bv b ON b.application = k.application AND bean_type = target_type), {_steps('point_id, application')},
    o2 AS (SELECT k.point_id, k.application, count(*) FILTER (WHERE disposition <> 'EXCLUDED') AS n, max(candidate_id) FILTER (WHERE disposition = 'SELECTED') AS bean FROM k LEFT JOIN cand ON cand.point_id = k.point_id AND cand.application = k.application GROUP BY 1, 2),
    w AS (SELECT point_id, application, CASE WHEN bean IS NOT NULL THEN 'RESOLVED:' || bean WHEN n > 0 THEN 'AMBIGUOUS' ELSE 'UNSATISFIED' END AS outcome FROM o2)
    SELECT point_id, count(*) AS contexts, CASE WHEN count(DISTINCT outcome) = 1 THEN split_part(min(outcome), ':', 1) ELSE 'CONTEXT_REQUIRED' END AS status FROM w GROUP BY 1""",
)
_KEYS = "mk AS (SELECT u.class_id, u.kind, u.key, d.key AS definition FROM configuration_usages u JOIN (SELECT DISTINCT key FROM configuration_definitions) d ON d.key = u.key OR (u.kind = 'prefix' AND d.key LIKE u.key || '.%'))"
register("configuration_matches", configuration.matched_keys, f"{_KEYS} SELECT * FROM mk")
register(
    "configuration_references",
    lambda s: filled(configuration.configuration_references(s, pattern="promo*"), "class_id"),
    f"""{_KEYS} SELECT 'usage' AS record, u.key, u.kind, u.class_id, count(DISTINCT definition) AS definitions, CASE WHEN u.kind = 'dynamic' THEN 'unknown' WHEN count(definition) > 0 THEN 'resolved' ELSE 'unsatisfied' END AS status
    FROM (SELECT DISTINCT class_id, kind, key FROM configuration_usages) u LEFT JOIN mk ON mk.class_id = u.class_id AND mk.kind = u.kind AND mk.key = u.key WHERE u.key ILIKE 'promo%' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT 'definition', key, kind, -1, 1, 'defined' FROM configuration_definitions WHERE key ILIKE 'promo%'""",
)
_RES = """f AS (SELECT DISTINCT regexp_extract(path, '.*/resources/(.*)$', 1) AS resource FROM resources), rr AS (SELECT DISTINCT class_id, kind, resource_path, resource FROM resource_usages JOIN f ON resource = resource_path
    OR (kind = 'bundle' AND (resource = resource_path || '.properties' OR (starts_with(resource, resource_path || '_') AND ends_with(resource, '.properties')))))"""
register("resource_references", configuration.resource_references, f"{_RES} SELECT * FROM rr")
register("unresolved_resources", configuration.unresolved_resources, f"{_RES} SELECT class_id, kind, resource_path FROM resource_usages u WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.class_id = u.class_id AND rr.resource_path = u.resource_path)")
