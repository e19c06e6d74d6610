"""Queries of searches and listings."""

from codeloom.catalogue import CUR, filled, register
from codeloom.operators import artifacts
from codeloom.operators import search as q

_IN = "(EXISTS (SELECT 1 FROM class_occurrences o WHERE o.class_id = c.id AND o.module = 'Brand#3') OR (NOT EXISTS (SELECT 1 FROM class_occurrences o WHERE o.class_id = c.id) AND c.module = 'Brand#3'))"
_PKG = "CASE WHEN contains(split_part({c}, '$', 1), '.') THEN regexp_replace(split_part({c}, '$', 1), '\\.[^.]*$', '') ELSE '' END"

register("search_classes", lambda s: q.search_classes(s, "*P1*.c1*", limit=100), f"{CUR} SELECT id, class_name, kind, source_file, module FROM cur WHERE class_name ILIKE '%P1%.c1%' ORDER BY class_name LIMIT 100")
register("search_classes_substring", lambda s: q.search_classes(s, "$N1", limit=50, offset=5), f"{CUR} SELECT id, class_name, kind, source_file, module FROM cur WHERE class_name ILIKE '%$N1%' ORDER BY class_name LIMIT 50 OFFSET 5")
register("search_classes_in_module", lambda s: q.search_classes(s, "org", module="Brand#3", limit=100), f"{CUR} SELECT id, class_name, kind, source_file, module FROM cur c WHERE class_name ILIKE '%org%' AND {_IN} ORDER BY class_name LIMIT 100")
_SYMBOLS = f"""{CUR}, sy AS (SELECT class_name, kind AS symbol_kind, regexp_extract(class_name, '[^.]*$') AS symbol_name, '' AS signature, '' AS semantic_name, CASE WHEN source_file LIKE '%.kt' THEN 'kotlin' ELSE 'java' END AS language FROM cur UNION ALL
    SELECT class_name, m.kind, m.name, m.name || m.descriptor, coalesce(kd.name, ''), CASE WHEN source_file LIKE '%.kt' THEN 'kotlin' ELSE 'java' END FROM class_members m JOIN cur ON cur.id = m.class_id LEFT JOIN kotlin_declarations kd ON kd.class_id = m.class_id
    AND ((kd.kind = 'FUNCTION' AND kd.jvm_name = m.name AND kd.descriptor = m.descriptor) OR (kd.kind = 'PROPERTY' AND kd.jvm_name = m.name AND (kd.descriptor = '' OR kd.descriptor = m.descriptor))) WHERE m.modifiers NOT LIKE '%bridge%' AND m.modifiers NOT LIKE '%synthetic%')"""
for _name, _pattern in (("search_symbols", "get1"), ("search_symbols_by_kotlin_name", "ondit"), ("search_symbols_by_declaration", "xecute2")):
    register(_name, lambda s, p=_pattern: q.search_symbols(s, p, limit=200), f"{_SYMBOLS} SELECT * FROM sy WHERE symbol_name ILIKE '%{_pattern}%' OR signature ILIKE '%{_pattern}%' OR semantic_name ILIKE '%{_pattern}%' ORDER BY symbol_name, class_name, signature, semantic_name LIMIT 200")
register("class_by_path", lambda s: q.class_by_path(s, "src/main/java/C17.java"), f"{CUR} SELECT c.id, class_name, path AS file_path FROM cur c LEFT JOIN class_files x ON x.class_id = c.id LEFT JOIN files f ON f.id = file_id WHERE source_file = 'src/main/java/C17.java' OR path = 'src/main/java/C17.java' ORDER BY class_name LIMIT 1")
register("di_problems", lambda s: filled(q.di_problems(s), "class_id"), "SELECT id, coalesce(class_id, -1) AS class_id, class_name, problem_type, message FROM di_problems")
register(
    "project_tree_below",
    lambda s: q.project_tree(s, "blog.tionsh.example.net", depth=1, limit=500),
    "SELECT e AS entry, CAST(2 AS INTEGER) AS level, bool_or(e = path) AS is_file, count(*) AS files FROM (SELECT path, 'blog.tionsh.example.net/' || split_part(path, '/', 2) AS e FROM files WHERE lifecycle <> 'deleted' AND starts_with(path, 'blog.tionsh.example.net/')) GROUP BY 1 ORDER BY 1 LIMIT 500",
)
register("search_properties", lambda s: q.search_properties(s, "p1*.C*2.STATE"), f"{CUR} SELECT class_id, class_name, name FROM class_members m JOIN cur ON cur.id = class_id WHERE m.kind = 'FIELD' AND regexp_matches(class_name || '.' || name, 'p1.*\\.C.*2\\.state', 'i')")
register(
    "search_files",
    lambda s: q.search_files(s, "*/fr/**", limit=200),
    "SELECT path, lifecycle, 4 AS rank FROM files WHERE lifecycle <> 'deleted' AND regexp_matches(path, '^[^/]*/fr/.*$') ORDER BY path LIMIT 200",
)
register("search_files_of_kind", lambda s: q.search_files(s, "1", kind="file", limit=200), "SELECT path, lifecycle, CASE WHEN lower(path) = '1' THEN 0 WHEN regexp_extract(path, '[^/]*$') = '1' THEN 1 WHEN starts_with(path, '1') THEN 2 WHEN starts_with(regexp_extract(path, '[^/]*$'), '1') THEN 3 ELSE 5 END AS rank FROM files WHERE lifecycle <> 'deleted' AND contains(path, '1') AND NOT regexp_matches(path, '[.](java|kt|md|adoc)$|/resources/|src/test/|META-INF/services/') ORDER BY rank, path LIMIT 200")
register(
    "search_files_substring",
    lambda s: q.search_files(s, "EN/1", include_deleted=True, limit=200),
    """SELECT path, lifecycle, CASE WHEN lower(path) = 'en/1' THEN 0 WHEN regexp_extract(lower(path), '[^/]*$') = 'en/1' THEN 1 WHEN starts_with(lower(path), 'en/1') THEN 2 WHEN starts_with(regexp_extract(lower(path), '[^/]*$'), 'en/1') THEN 3 ELSE 5 END AS rank
    FROM files WHERE contains(lower(path), 'en/1') ORDER BY rank, path LIMIT 200""",
)
register(
    "project_tree",
    lambda s: q.project_tree(s, depth=2, limit=500),
    """p AS (SELECT path, string_split(path, '/') AS parts FROM files WHERE lifecycle <> 'deleted'), l AS (SELECT path, 1 AS level, parts[1] AS entry FROM p UNION ALL SELECT path, 2, parts[1] || '/' || parts[2] FROM p WHERE len(parts) >= 2)
    SELECT entry, CAST(min(level) AS INTEGER) AS level, bool_or(entry = path) AS is_file, count(*) AS files FROM l GROUP BY entry ORDER BY entry LIMIT 500""",
)
register("search_external_symbols", lambda s: q.search_external(s, "Bolt*", limit=200), "SELECT DISTINCT external_type FROM external_deps WHERE contains(lower(external_type), 'bolt') ORDER BY 1 LIMIT 200")
register("search_external_prefix", lambda s: q.search_external(s, "org.small", mode="prefix", limit=200), "SELECT DISTINCT external_type FROM external_deps WHERE starts_with(lower(external_type), 'org.small') OR starts_with(regexp_extract(lower(external_type), '[^.]*$'), 'org.small') ORDER BY 1 LIMIT 200")
register("search_external_of_library", lambda s: q.search_external(s, "s", kind="FIELD", library="org.small", class_name="p1", limit=200), f"{CUR} SELECT DISTINCT external_type FROM external_deps x JOIN cur ON cur.id = class_id WHERE contains(lower(external_type), 's') AND usage_kind = 'FIELD' AND starts_with(external_type, 'org.small.') AND contains(lower(class_name), 'p1') ORDER BY 1 LIMIT 200")
for _name, _type in (("external_symbol_details", "org.small.blue.bolt"), ("external_symbol_details_by_simple_name", "bolt")):
    register(
        _name,
        lambda s, n=_type: q.external_details(s, n),
        f"""m AS (SELECT *, external_type = '{_type}' AS whole FROM external_deps WHERE external_type = '{_type}' OR regexp_extract(external_type, '[^.]*$') = '{_type}')
        SELECT external_type, CASE WHEN (SELECT bool_or(whole) OR count(DISTINCT external_type) = 1 FROM m) THEN 'resolved' ELSE 'ambiguous' END AS status, usage_kind, count(DISTINCT class_id) AS classes FROM m WHERE whole = (SELECT bool_or(whole) FROM m) GROUP BY 1, 2, 3""",
    )
register("list_beans", lambda s: q.list_beans(s, scope="Dependent", qualifier="Default", limit=100), "SELECT b.id, class_name, origin, b.kind, scope, qualifier FROM beans b JOIN classes c ON c.id = class_id WHERE scope = 'Dependent' AND contains(qualifier, 'Default') ORDER BY 2, 3, 4, 1 LIMIT 100")
register("list_beans_of_profile", lambda s: q.list_beans(s, profile="prod", kind="MANAGED"), "SELECT b.id, class_name, origin, b.kind, scope, qualifier FROM beans b JOIN classes c ON c.id = class_id WHERE profile = 'prod' AND b.kind = 'MANAGED' ORDER BY 2, 3, 4, 1 LIMIT 50")
_ARTIFACTS = """t AS (SELECT module, visible, visible AS node FROM module_edges UNION SELECT t.module, t.visible, e.visible FROM t JOIN module_edges e ON e.module = t.node),
    d AS (SELECT visible AS artifact, module, 'direct' AS how, relation FROM module_edges UNION ALL SELECT e.visible, t.module, 'transitive', e.relation FROM (SELECT DISTINCT module, node FROM t) t JOIN module_edges e ON e.module = t.node),
    pd AS (SELECT artifact, count(DISTINCT module) AS consumers, string_agg(DISTINCT relation, ',' ORDER BY relation) AS scopes, CASE WHEN count(DISTINCT how) > 1 THEN 'mixed' ELSE min(how) END AS directness FROM d GROUP BY 1)"""
register("project_dependencies", q.project_dependencies, f"{_ARTIFACTS} SELECT * FROM pd")
register("project_dependencies_of_scope", lambda s: q.project_dependencies(s, scope="test", directness="mixed"), f"{_ARTIFACTS} SELECT * FROM pd WHERE list_contains(string_split(scopes, ','), 'test') AND directness = 'mixed'")
_ROUTES = f"""{CUR}, em AS (SELECT *, CASE WHEN starts_with(annotation, 'org.springframework') THEN 'spring' ELSE 'jax-rs' END AS framework, CASE WHEN annotation LIKE '%.PostMapping' THEN 'POST' WHEN annotation LIKE '%.GET' THEN 'GET' ELSE verbs END AS vs FROM endpoint_marks),
    mv AS (SELECT class_id, name, descriptor, framework, unnest(string_split(vs, chr(10))) AS verb FROM em WHERE vs <> ''), mp AS (SELECT class_id, name, descriptor, framework, unnest(string_split(paths, chr(10))) AS path FROM em WHERE paths <> ''),
    mt AS (SELECT DISTINCT class_id, class_name, em.name, descriptor, framework FROM em JOIN cur ON cur.id = class_id WHERE em.name <> ''),
    r3 AS (SELECT DISTINCT mt.*, coalesce(mv.verb, CASE mt.framework WHEN 'spring' THEN 'ANY' ELSE 'SUBRESOURCE' END) AS http_method, regexp_replace('/' || coalesce(b.path, '') || '/' || coalesce(p.path, ''), '/+', '/', 'g') AS whole
    FROM mt LEFT JOIN mv ON mv.class_id = mt.class_id AND mv.framework = mt.framework AND ((mv.name = mt.name AND mv.descriptor = mt.descriptor) OR mv.name = '')
    LEFT JOIN mp p ON p.class_id = mt.class_id AND p.framework = mt.framework AND p.name = mt.name AND p.descriptor = mt.descriptor LEFT JOIN mp b ON b.class_id = mt.class_id AND b.framework = mt.framework AND b.name = ''),
    ep AS (SELECT class_id, class_name, name, descriptor, framework, http_method, CASE WHEN length(whole) > 1 THEN regexp_replace(whole, '/$', '') ELSE whole END AS path FROM r3)"""
register("framework_endpoints", q.framework_endpoints, f"{_ROUTES} SELECT * FROM ep")
register("framework_endpoints_of_verb", lambda s: q.framework_endpoints(s, http_method="GET", path_prefix="/m"), f"{_ROUTES} SELECT * FROM ep WHERE http_method IN ('GET', 'ANY') AND starts_with(path, '/m')")
register(
    "framework_endpoints_filtered",
    lambda s: q.framework_endpoints(s, framework="spring", source_set="main", module="Brand#14"),
    f"{_ROUTES} SELECT ep.* FROM ep JOIN classes k ON k.id = ep.class_id WHERE framework = 'spring' AND coalesce(k.source_set, 'main') = 'main' AND k.module = 'Brand#14'",
)
register(
    "entry_points",
    q.entry_points,
    f"""{CUR}, o AS (SELECT id AS class_id, class_name FROM cur WHERE origin <> 'generated' AND coalesce(source_set, 'main') <> 'test'), ms AS (SELECT o.*, name, descriptor, modifiers, ' ' || annotations || ' ' AS marks FROM class_members m JOIN o ON o.class_id = m.class_id WHERE m.kind = 'METHOD'),
    hh AS (SELECT class_name AS child, superclass AS parent FROM classes UNION ALL SELECT class_name, ci.interface_name FROM classes JOIN class_interfaces ci ON ci.class_id = classes.id),
    pr AS (SELECT child AS class_name FROM hh WHERE parent IN ('javax.annotation.processing.AbstractProcessor', 'javax.annotation.processing.Processor') UNION SELECT child FROM pr JOIN hh ON parent = pr.class_name)
    SELECT class_id, class_name, name, descriptor, 'rest_endpoint' AS entry_kind, 'high' AS confidence FROM ms WHERE marks LIKE '% jakarta.ws.rs.GET %' OR marks LIKE '%.PostMapping %' UNION ALL SELECT class_id, class_name, name, descriptor, 'observer', 'high' FROM ms WHERE marks LIKE '%.Observes %'
    UNION ALL SELECT class_id, class_name, name, descriptor, 'scheduled', 'high' FROM ms WHERE marks LIKE '%.Scheduled %' UNION ALL SELECT class_id, class_name, name, descriptor, 'message_consumer', 'high' FROM ms WHERE marks LIKE '%.KafkaListener %'
    UNION ALL SELECT class_id, class_name, name, descriptor, 'main', 'high' FROM ms WHERE name = 'main' AND modifiers = 'public static' AND descriptor = '([Ljava/lang/String;)V'
    UNION ALL SELECT o.class_id, class_name, '<type>', '', 'rest_resource', CASE WHEN bool_or(direct) THEN 'high' ELSE 'medium' END FROM class_annotations a JOIN o ON o.class_id = a.class_id WHERE annotation_name IN ('jakarta.ws.rs.Path', 'org.springframework.web.bind.annotation.RequestMapping') GROUP BY 1, 2
    UNION ALL SELECT class_id, class_name, '<type>', '', kind, 'high' FROM (SELECT class_id, class_name, 'annotation_processor' AS kind FROM o WHERE class_name IN (SELECT class_name FROM pr)
    UNION SELECT o.class_id, class_name, CASE WHEN service_type LIKE '%annotation.processing.Processor' THEN 'annotation_processor' ELSE 'service_provider' END FROM service_registrations r JOIN o ON o.class_id = r.class_id)""",
)
register(
    "architecture_violations",
    lambda s: q.architecture_violations(s, "org.acme.p1*", ["org.acme.p1..", "..acme.p2*", "org..p1*"], limit=200),
    f"""{CUR}, e AS (SELECT f.class_name AS source, t.class_name AS target, d.kind, occurrence_count, {_PKG.format(c='f.class_name')} AS fp, {_PKG.format(c='t.class_name')} AS tp FROM dependencies d JOIN cur f ON f.id = from_class_id JOIN cur t ON t.id = to_class_id
    WHERE coalesce(f.source_set, 'main') <> 'test' AND coalesce(t.source_set, 'main') <> 'test' AND f.origin <> 'generated' AND t.origin <> 'generated'),
    v AS (SELECT source, target, kind, occurrence_count, CASE WHEN tp = 'org.acme.p1' OR tp LIKE 'org.acme.p1.%' THEN 'org.acme.p1..' WHEN regexp_full_match(tp, '(\\..*)?acme\\.p2.*') THEN '..acme.p2*' WHEN regexp_full_match(tp, 'org(\\..*)?p1.*') THEN 'org..p1*' END AS rule FROM e WHERE starts_with(fp, 'org.acme.p1'))
    SELECT * FROM v WHERE rule IS NOT NULL ORDER BY occurrence_count DESC, source, target, kind LIMIT 200""",
)
register("enclosing_classes", lambda s: q.enclosing_classes(s, "src/main/java/C17.java", 20), "SELECT id, class_name, source_line FROM classes WHERE source_file = 'src/main/java/C17.java' AND source_line <= 20 AND lifecycle = 'current' ORDER BY source_line DESC, class_name LIMIT 10")
register("resolve_target", lambda s: q.resolve_target(s, "C15"), f"{CUR} SELECT id, class_name, 3 AS step FROM cur WHERE regexp_extract(class_name, '[^.]*$') = 'C15' ORDER BY class_name LIMIT 5")
_USES = """us AS (SELECT path, line, CAST("column" AS INTEGER) AS "column", CASE k WHEN 1 THEN own WHEN 2 THEN 'state' WHEN 4 THEN getter WHEN 5 THEN 'state' ELSE 'run' END AS identifier, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'other' WHEN 4 THEN 'helper' END AS receiver,
    CASE k WHEN 1 THEN 'constructor' WHEN 2 THEN 'member' WHEN 5 THEN 'none' ELSE 'call' END AS context, CASE k WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 3 END AS arguments FROM source_lines JOIN source_positions USING (path, line))"""
register("uses_at_positions", lambda s: filled(q.uses_at(s.source_positions, s.source_lines), "arguments").fillna(""), f"{_USES} SELECT path, line, \"column\", identifier, coalesce(receiver, '') AS receiver, context, coalesce(arguments, -1) AS arguments FROM us")
register(
    "symbols_at_positions",
    lambda s: q.symbols_at(s, s.source_positions, s.source_lines),
    f"""{_USES}, lv AS (SELECT id, class_name, kind, source_file, source_line FROM classes WHERE lifecycle = 'current'), dc AS (SELECT regexp_extract(class_name, '[^.$]*$') AS identifier, id, class_name AS name, kind, source_file, CAST(NULL AS BIGINT) AS parameters FROM lv
    UNION ALL SELECT CASE m.kind WHEN 'CONSTRUCTOR' THEN regexp_extract(class_name, '[^.$]*$') ELSE name END, id, class_name || '#' || name || descriptor, m.kind, source_file, CASE WHEN m.kind = 'FIELD' THEN NULL WHEN parameter_types = '' THEN 0 ELSE len(string_split(parameter_types, ',')) END FROM class_members m JOIN lv ON lv.id = m.class_id),
    r0 AS (SELECT us.*, dc.id, dc.name, dc.kind, parameters, source_file = path AS same_file FROM us JOIN dc ON dc.identifier = us.identifier QUALIFY row_number() OVER (PARTITION BY path, line, "column" ORDER BY source_file = path DESC, name, kind) <= 200),
    nr AS (SELECT path, line, "column", arg_max(id, (source_line, -id)) AS near FROM us JOIN lv ON source_file = path AND source_line <= line GROUP BY 1, 2, 3),
    sc AS (SELECT r0.path, r0.line, r0."column", identifier, context, name, kind, CAST(CASE WHEN same_file THEN 20 ELSE 0 END + CASE WHEN near = id THEN 25 ELSE 0 END + CASE context WHEN 'constructor' THEN CASE WHEN kind = 'CONSTRUCTOR' THEN 100 WHEN kind IN ('CLASS', 'INTERFACE') THEN 40 ELSE -50 END
    WHEN 'call' THEN CASE WHEN kind = 'METHOD' THEN 80 ELSE -30 END WHEN 'member' THEN CASE WHEN kind = 'FIELD' THEN 70 ELSE 0 END ELSE 0 END + CASE WHEN arguments IS NULL OR parameters IS NULL THEN 0 WHEN arguments = parameters THEN 30 ELSE -20 END AS INTEGER) AS score
    FROM r0 LEFT JOIN nr ON nr.path = r0.path AND nr.line = r0.line AND nr."column" = r0."column")
    SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, row_number() OVER w = 1 AND coalesce(lead(score) OVER w, -10000) < score AS decisive FROM sc WINDOW w AS (PARTITION BY path, line, "column" ORDER BY score DESC, name)""",
)
register(
    "symbol_candidates",
    lambda s: q.symbol_candidates(s, "get2Worker", "src/main/java/C12.java", 30, context="call"),
    """live AS (SELECT * FROM classes WHERE lifecycle = 'current'), near AS (SELECT id FROM live WHERE source_file = 'src/main/java/C12.java' AND source_line <= 30 ORDER BY source_line DESC, class_name LIMIT 1),
    c AS (SELECT id AS class_id, class_name AS name, kind, source_file = 'src/main/java/C12.java' AS same_file FROM live WHERE regexp_extract(class_name, '[^.]*$') = 'get2Worker'
    UNION ALL SELECT m.class_id, class_name || '#' || m.name || descriptor, m.kind, source_file = 'src/main/java/C12.java' FROM class_members m JOIN live ON live.id = m.class_id WHERE m.name = 'get2Worker'),
    f AS (SELECT * FROM c ORDER BY same_file DESC, name LIMIT 200), s AS (SELECT name, kind, CAST(CASE WHEN same_file THEN 20 ELSE 0 END + CASE WHEN class_id IN (SELECT id FROM near) THEN 25 ELSE 0 END + CASE WHEN kind = 'METHOD' THEN 80 ELSE -30 END AS INTEGER) AS score FROM f)
    SELECT name, kind, score, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS place, row_number() OVER (ORDER BY score DESC, name) = 1 AND coalesce(lead(score) OVER (ORDER BY score DESC, name), -10000) < score AS decisive FROM s""",
)
_MAIN, _THIRD = "WHERE source_set = 'main'", "WHERE module = 'Brand#3'"
_named = lambda df: df.withColumnRenamed("grp", "group")
_PATHS = """lk AS (SELECT module FROM class_path_jars UNION SELECT module FROM module_edges EXCEPT SELECT module FROM class_path_jars WHERE source_set = 'test'), fs AS (SELECT e.module, e.visible FROM module_edges e JOIN lk ON lk.module = e.module WHERE relation IN ('compile', 'runtime', 'test', 'provided')
    UNION SELECT fs.module, e.visible FROM fs JOIN module_edges e ON e.module = fs.visible AND e.relation IN ('compile', 'runtime')), sn AS (SELECT module, visible FROM fs UNION SELECT module, module FROM lk),
    ep AS (SELECT *, 'captured' AS evidence FROM class_path_jars UNION ALL SELECT DISTINCT sn.module, 'test', jar, grp, artifact, version, 'inferred' FROM sn JOIN class_path_jars c ON c.module = sn.visible AND source_set = 'main')"""
_VIEW = f"""{_PATHS}, ha AS (SELECT DISTINCT grp, artifact, version, module FROM ep {{where}}), kn AS (SELECT ha.*, EXISTS (SELECT 1 FROM declared_artifacts d WHERE d.module = ha.module AND d.grp = ha.grp AND d.artifact = ha.artifact) AS d, module IN (SELECT module FROM complete_modules) AS c FROM ha),
    av AS (SELECT grp || ':' || artifact || ':' || version AS coordinate, grp, artifact, version, count(*) AS modules, count(*) FILTER (WHERE d) AS direct, count(*) FILTER (WHERE c AND NOT d) AS transitive, count(*) FILTER (WHERE NOT c) AS unknown,
    coalesce((SELECT string_agg(DISTINCT scope, ',' ORDER BY scope) FROM declared_artifacts x WHERE x.grp = kn.grp AND x.artifact = kn.artifact AND x.module IN (SELECT module FROM ha h WHERE h.grp = kn.grp AND h.artifact = kn.artifact AND h.version = kn.version)), '') AS scopes FROM kn GROUP BY grp, artifact, version),
    aw AS (SELECT *, CASE WHEN direct > 0 AND transitive = 0 AND unknown = 0 THEN 'direct' WHEN direct = 0 AND transitive > 0 AND unknown = 0 THEN 'transitive' WHEN direct = 0 AND transitive = 0 THEN 'unknown' ELSE 'mixed' END AS directness FROM av)"""
register("effective_class_paths", lambda s: artifacts.effective_class_paths(_named(s.class_path_jars), s.module_edges).withColumnRenamed("group", "grp"), f"{_PATHS} SELECT * FROM ep")


def _view(s, **by):
    paths = artifacts.effective_class_paths(_named(s.class_path_jars), s.module_edges)
    return artifacts.artifact_view(paths, _named(s.declared_artifacts), s.complete_modules, **by).withColumnRenamed("group", "grp")


register("artifact_view", _view, f"{_VIEW.format(where='')} SELECT * FROM aw")
register("artifact_view_filtered", lambda s: _view(s, source_set="main", group="O", artifact="LIB", scope="compile", directness="mixed"), f"{_VIEW.format(where=_MAIN)} SELECT * FROM aw WHERE contains(grp, 'o') AND contains(',' || scopes || ',', ',compile,') AND directness = 'mixed'")
register("artifact_view_of_module", lambda s: _view(s, module="Brand#3"), f"{_VIEW.format(where=_THIRD)} SELECT * FROM aw")
