"""The relations of a code index, projected from the driver's tables.

Each relation is one SELECT in the SQL that Spark and DuckDB share, so both sides start from the
same rows; operators and their oracle SQL are written separately on top of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import table


def _name(i: str) -> str:
    block = f"({i} - {i} % 10)"
    own = f"CAST({i} AS STRING)"
    return f"concat('org.acme.p', CAST({block} % 230 AS STRING), '.C', CASE WHEN {i} % 10 IN (7, 8) THEN concat(CAST({block} AS STRING), '$N', {own}) ELSE {own} END)"


_PARENT = "CAST(floor(p_partkey / 4) AS BIGINT)"
_GETTER = "concat('get', CAST({id} % 5 AS STRING), CASE {id} % 5 WHEN 1 THEN 'Store' WHEN 2 THEN 'Worker' WHEN 3 THEN 'Timer' WHEN 4 THEN 'Codec' ELSE '' END)"
_METHOD = f"CASE WHEN {{line}} % 2 = 0 THEN 'run' ELSE {_GETTER} END"
_DESC = "CASE WHEN {line} % 2 = 0 THEN '()V' ELSE '(I)Ljava/lang/String;' END"
_TARGET = "(CASE WHEN l_suppkey % 4 = 0 THEN (l_suppkey * 13 + l_partkey) % (l_partkey + 1) ELSE l_partkey - l_partkey % 10 + (l_suppkey * 11 + l_linenumber * 7 + l_partkey) % 10 END)"

#: Relation -> SELECT over driver tables and other relations.
RELATIONS: dict[str, str] = {
    "classes": f"""SELECT p_partkey AS id, {_name('p_partkey')} AS class_name,
        CASE WHEN p_partkey < 7 THEN 'INTERFACE' ELSE 'CLASS' END AS kind,
        CASE WHEN p_partkey % 59 = 58 THEN 'javax.annotation.processing.AbstractProcessor' WHEN {_PARENT} >= 7 THEN {_name(_PARENT)} END AS superclass,
        CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 12 = 6 AND p_partkey > 7 THEN 'java.io.Serializable' WHEN {_PARENT} < 7 THEN {_name(_PARENT)} WHEN p_partkey % 6 = 0 THEN {_name('(p_partkey % 7)')} END AS interface_name,
        concat('src/', CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'main' END, '/java/C', CAST(p_partkey AS STRING), '.java') AS source_file,
        CAST(p_partkey % 40 + 1 AS BIGINT) AS source_line, p_partkey % 3 = 0 AS is_bean, CAST(p_size * 10 AS BIGINT) AS source_tokens,
        CASE WHEN p_partkey % 97 = 96 THEN 'orphan_output' WHEN p_partkey % 11 = 10 THEN 'generated' ELSE 'source' END AS origin,
        CASE WHEN p_partkey % 53 = 52 THEN 'historical' ELSE 'current' END AS lifecycle, p_brand AS module,
        CASE WHEN p_partkey % 13 = 12 THEN NULL WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'main' END AS source_set, p_type AS repository
        FROM part""",
    "class_interfaces": f"""SELECT id AS class_id, interface_name FROM classes WHERE interface_name IS NOT NULL
        UNION ALL SELECT id, {_name('(id * 3 % 7)')} FROM classes WHERE id % 10 = 5 AND id > 7 AND coalesce(interface_name, '') <> {_name('(id * 3 % 7)')}""",
    "dependency_rows": """SELECT l_partkey AS from_class_id, l_partkey - l_partkey % 10 + (l_suppkey * 7 + l_linenumber * 3) % 10 AS to_class_id,
        'CALLS' AS kind, CAST(l_quantity AS BIGINT) AS quantity, l_linenumber AS line FROM lineitem WHERE l_quantity >= 46 AND l_returnflag = 'R'
        UNION ALL SELECT l_partkey, (l_suppkey * 13 + l_linenumber * 5 + l_partkey) % nullif(l_partkey - l_partkey % 10, 0),
        CASE WHEN l_linenumber % 2 = 1 THEN 'CONSTRUCTS' WHEN l_suppkey % 5 = 0 THEN 'METHOD_HANDLE_REFERENCE' WHEN l_suppkey % 5 = 1 THEN 'FIELD_HANDLE_REFERENCE' WHEN l_suppkey % 5 = 2 THEN 'CDI_INJECT' ELSE 'TYPE_USE' END, CAST(l_quantity AS BIGINT), l_linenumber
        FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'A' AND l_partkey >= 10""",
    "dependencies": """SELECT from_class_id, to_class_id, kind, CAST(sum(quantity) AS BIGINT) AS occurrence_count
        FROM dependency_rows WHERE from_class_id <> to_class_id GROUP BY from_class_id, to_class_id, kind""",
    "dependency_lines": "SELECT DISTINCT from_class_id, to_class_id, kind, line FROM dependency_rows WHERE from_class_id <> to_class_id",
    "class_occurrences": """SELECT p_partkey AS class_id, p_brand AS module, 'main' AS source_set, concat('out/', p_brand) AS output_directory FROM part WHERE p_partkey % 3 <> 1
        UNION ALL SELECT p_partkey, 'Brand#3', 'test', 'out/shared' FROM part WHERE p_partkey % 9 = 0""",
    "class_annotations": """SELECT p_partkey AS class_id, CASE WHEN p_partkey % 8 = 0 THEN 'jakarta.inject.Singleton' ELSE 'org.acme.Service' END AS annotation_name,
        p_partkey % 16 < 8 AS direct, CASE WHEN p_partkey % 16 >= 8 THEN concat('org.acme.Stereo', CAST(p_partkey % 3 AS STRING)) END AS via_annotation
        FROM part WHERE p_partkey % 8 IN (0, 3) UNION ALL SELECT p_partkey, 'org.acme.Service', false, 'org.acme.Base' FROM part WHERE p_partkey % 24 = 3
        UNION ALL SELECT p_partkey, 'org.acme.p0.C3', p_partkey % 2 = 0, CASE WHEN p_partkey % 2 = 1 THEN 'org.acme.Base' END FROM part WHERE p_partkey % 33 = 4
        UNION ALL SELECT p_partkey, 'jakarta.ws.rs.Path', true, NULL FROM part WHERE p_partkey % 14 = 0
        UNION ALL SELECT p_partkey, 'org.springframework.web.bind.annotation.RequestMapping', p_partkey % 28 = 3, CASE WHEN p_partkey % 28 <> 3 THEN 'org.acme.Api' END FROM part WHERE p_partkey % 14 = 3""",
    "endpoint_marks": f"""SELECT p_partkey AS class_id, '' AS name, '' AS descriptor, 'jakarta.ws.rs.Path' AS annotation, concat('/m', substr(p_brand, 7)) AS paths, '' AS verbs FROM part WHERE p_partkey % 14 = 0
        UNION ALL SELECT p_partkey, '', '', 'org.springframework.web.bind.annotation.RequestMapping', concat('/m', CAST(p_partkey % 5 AS STRING), chr(10), 'b/'), '' FROM part WHERE p_partkey % 14 = 3
        UNION ALL SELECT p_partkey, {_GETTER.format(id='p_partkey')}, '(I)Ljava/lang/String;', 'jakarta.ws.rs.GET', '', '' FROM part WHERE p_partkey % 7 = 0
        UNION ALL SELECT p_partkey, {_GETTER.format(id='p_partkey')}, '(I)Ljava/lang/String;', 'jakarta.ws.rs.Path', concat('item/', CAST(p_partkey % 3 AS STRING)), '' FROM part WHERE p_partkey % 21 = 0
        UNION ALL SELECT p_partkey, {_GETTER.format(id='p_partkey')}, '(I)Ljava/lang/String;', 'org.springframework.web.bind.annotation.PostMapping', concat('/save', chr(10), 'put'), '' FROM part WHERE p_partkey % 7 = 3
        UNION ALL SELECT p_partkey, 'run', '()V', 'org.springframework.web.bind.annotation.RequestMapping', '/run', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('GET', chr(10), 'PUT') END FROM part WHERE p_partkey % 28 = 3
        UNION ALL SELECT p_partkey, 'run', '()V', 'jakarta.ws.rs.Path', 'sub', '' FROM part WHERE p_partkey % 28 = 14""",
    "module_artifacts": "SELECT DISTINCT p_brand AS coordinate, p_type AS repository, CASE WHEN length(p_type) > 5 THEN '1.0' ELSE '1.1' END AS version FROM part",
    "service_registrations": "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'javax.annotation.processing.Processor' ELSE 'org.acme.spi.Service' END AS service_type, s_suppkey * 7 AS class_id FROM supplier WHERE s_suppkey % 3 = 1",    "class_members": f"""SELECT p_partkey AS class_id, 'METHOD' AS kind, 'run' AS name, '()V' AS descriptor, '' AS parameter_types,
        CASE WHEN p_partkey % 12 = 8 THEN 'public abstract' WHEN p_partkey % 4 = 0 THEN 'public' WHEN p_partkey % 4 = 1 THEN 'private' WHEN p_partkey % 4 = 2 THEN 'protected' ELSE 'private static' END AS modifiers,
        CASE WHEN p_partkey % 9 = 0 THEN 'io.quarkus.scheduler.Scheduled' WHEN p_partkey % 9 = 4 THEN 'org.acme.Marked org.springframework.kafka.annotation.KafkaListener' WHEN p_partkey % 9 = 5 THEN 'jakarta.enterprise.event.Observes' ELSE '' END AS annotations FROM part
        UNION ALL SELECT p_partkey, 'METHOD', 'main', '([Ljava/lang/String;)V', 'java.lang.String[]', CASE WHEN p_partkey % 8 = 3 THEN 'public static' ELSE 'static' END, '' FROM part WHERE p_partkey % 4 = 3
        UNION ALL SELECT p_partkey, 'METHOD', {_GETTER.format(id='p_partkey')}, '(I)Ljava/lang/String;', 'int',
        CASE p_partkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'public final' WHEN 3 THEN 'private native' WHEN 4 THEN '' ELSE 'public static' END,
        CASE WHEN p_partkey % 7 = 0 THEN 'jakarta.ws.rs.GET' WHEN p_partkey % 7 = 3 THEN 'org.springframework.web.bind.annotation.PostMapping' ELSE '' END FROM part
        UNION ALL SELECT p_partkey, 'CONSTRUCTOR', '<init>', '()V', '', 'public', '' FROM part WHERE p_partkey >= 7
        UNION ALL SELECT p_partkey, 'FIELD', 'state', 'I', '', CASE p_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'private static final' WHEN 2 THEN 'public' WHEN 3 THEN 'private' ELSE 'protected' END,
        CASE WHEN p_partkey % 17 = 0 THEN 'jakarta.inject.Inject' ELSE '' END FROM part""",
    "method_calls": f"""SELECT l_partkey AS caller_class_id, {_METHOD.format(line='l_linenumber', id='l_partkey')} AS caller_method, {_DESC.format(line='l_linenumber')} AS caller_descriptor,
        {_TARGET} AS target_class_id, {_METHOD.format(line='l_suppkey', id=_TARGET)} AS target_method, {_DESC.format(line='l_suppkey')} AS target_descriptor,
        CASE WHEN l_linenumber = 7 THEN 'dynamic' WHEN l_linenumber % 4 = 0 THEN 'virtual' WHEN l_linenumber % 4 = 1 THEN 'static' WHEN l_linenumber % 4 = 2 THEN 'interface' ELSE 'special' END AS invocation_kind, CAST(count(*) AS BIGINT) AS occurrence_count
        FROM lineitem WHERE l_returnflag = 'N' AND l_quantity >= 42 GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "field_accesses": f"""SELECT l_partkey AS accessor_class_id, {_METHOD.format(line='l_linenumber', id='l_partkey')} AS accessor_method, {_TARGET} AS owner_class_id, 'state' AS field_name,
        CASE l_linenumber % 4 WHEN 0 THEN 'write_instance' WHEN 1 THEN 'read_instance' WHEN 2 THEN 'write_static' ELSE 'read_static' END AS access_kind, CAST(count(*) AS BIGINT) AS occurrence_count
        FROM lineitem WHERE l_returnflag = 'N' AND l_quantity <= 8 GROUP BY 1, 2, 3, 4, 5""",
    "commits": """SELECT o_orderkey AS id, concat('h', CAST(o_orderkey AS STRING)) AS hash, c_name AS author, concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.org') AS author_email,
        o_orderdate AS committed_at, o_orderpriority AS message FROM orders JOIN customer ON o_custkey = c_custkey""",
    "commit_files": """SELECT l_orderkey AS commit_id, l_partkey AS class_id, concat('src/java/C', CAST(l_partkey AS STRING), '.java') AS file_path,
        CASE WHEN l_linenumber = 1 THEN 'ADD' ELSE 'MODIFY' END AS change_type FROM lineitem""",
    "beans": """SELECT s_suppkey AS id, s_suppkey * 7 AS class_id, CASE WHEN s_suppkey % 5 = 0 THEN 'PRODUCER_METHOD' ELSE 'MANAGED' END AS kind,
        CASE s_suppkey % 3 WHEN 0 THEN 'ApplicationScoped' WHEN 1 THEN 'RequestScoped' ELSE 'Dependent' END AS scope, concat('T', CAST(s_nationkey AS STRING)) AS bean_type,
        CASE WHEN s_suppkey % 9 = 0 THEN 'BUILDING,MACHINERY' WHEN s_suppkey % 3 = 0 THEN 'BUILDING' WHEN s_suppkey % 3 = 1 THEN 'MACHINERY' ELSE '@Default' END AS qualifier, s_suppkey % 4 = 0 AS is_default, s_suppkey % 8 = 2 AS is_primary, s_suppkey % 7 = 0 AS is_alternative,
        CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 5 AS BIGINT) END AS priority, CASE WHEN s_suppkey % 6 = 0 THEN 'prod' WHEN s_suppkey % 6 = 3 THEN 'dev' END AS profile,
        CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 5 END AS specializes_id, concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING)) AS module FROM supplier""",
    "injection_points": """SELECT c_custkey AS id, c_custkey % 50 AS bean_id, concat('T', CAST(c_nationkey AS STRING)) AS target_type,
        CASE WHEN c_custkey % 11 = 0 THEN '@Any' WHEN c_custkey % 11 = 1 THEN 'MACHINERY,BUILDING' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '@Default' END AS qualifier, concat('field', CAST(c_custkey % 4 AS STRING)) AS field_name,
        concat('Brand#', CAST(c_custkey % 25 + 1 AS STRING)) AS module FROM customer""",
    "typed_beans": """SELECT id, split(concat(bean_type, ',I', CAST(id % 5 AS STRING), CASE WHEN id % 3 = 0 THEN ',Root' ELSE '' END), ',') AS types, split(concat(qualifier, CASE WHEN id % 4 = 1 THEN ',Fast' ELSE '' END, CASE WHEN id % 6 = 1 THEN ',Named' ELSE '' END, ',@Any'), ',') AS qualifiers,
        is_default, is_alternative, priority, specializes_id FROM beans""",
    "typed_points": """SELECT id, CASE WHEN id % 4 = 0 THEN target_type WHEN id % 20 = 1 THEN 'Root' ELSE concat('I', CAST(id % 6 AS STRING)) END AS target_type,
        split(CASE id % 7 WHEN 0 THEN 'MACHINERY,Fast' WHEN 1 THEN '@Any' WHEN 2 THEN 'Named,MACHINERY,@Any' WHEN 3 THEN 'Missing' WHEN 4 THEN 'BUILDING' ELSE '@Default' END, ',') AS qualifiers FROM injection_points""",
    "configuration_definitions": """SELECT lower(concat(p_type, '.', replace(p_brand, '#', ''), '.', replace(p_name, ' ', '.'))) AS key, 'properties' AS kind, concat('conf/', lower(p_type), '.properties') AS file, CAST(p_partkey AS BIGINT) AS line, p_brand AS module FROM part""",
    "configuration_usages": """SELECT lower(concat(p_type, '.', replace(p_brand, '#', ''), '.', replace(p_name, ' ', '.'))) AS key, 'value' AS kind, p_partkey AS class_id FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT lower(p_type), 'prefix', p_partkey FROM part WHERE p_partkey % 50 = 1
        UNION ALL SELECT lower(concat(p_type, '.', replace(p_brand, '#', ''))), 'prefix', p_partkey FROM part WHERE p_size % 5 = 0
        UNION ALL SELECT lower(concat(p_type, '.missing')), 'value', p_partkey FROM part WHERE p_partkey % 31 = 0
        UNION ALL SELECT concat('dyn', CAST(p_partkey AS STRING)), 'dynamic', p_partkey FROM part WHERE p_partkey % 67 = 0""",
    "resources": "SELECT page_id AS id, concat('web/src/main/resources/i18n/m', CAST(page_id % 20 AS STRING), CASE WHEN page_id % 3 = 0 THEN '.properties' WHEN page_id % 3 = 1 THEN concat('_l', CAST(page_id % 5 AS STRING), '.properties') ELSE '.xml' END) AS path FROM pages",
    "resource_usages": "SELECT p_partkey AS class_id, CASE WHEN p_partkey % 2 = 0 THEN 'bundle' ELSE 'file' END AS kind, concat('i18n/m', CAST(p_partkey % 23 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '.properties' ELSE '.xml' END) AS resource_path FROM part WHERE p_partkey % 5 = 0",
    "module_edges": """SELECT DISTINCT p_brand AS module, concat('Brand#', CAST(CAST(substr(p_brand, 7) AS BIGINT) * 2 AS STRING)) AS visible, 'compile' AS relation, CASE WHEN length(p_brand) = 7 THEN '1.0' ELSE '2.0' END AS version FROM part WHERE CAST(substr(p_brand, 7) AS BIGINT) * 2 <= 25
        UNION ALL SELECT DISTINCT p_brand, concat('Brand#', CAST(CAST(substr(p_brand, 7) AS BIGINT) + 7 AS STRING)), 'test', '1.1' FROM part WHERE CAST(substr(p_brand, 7) AS BIGINT) % 3 = 0 AND CAST(substr(p_brand, 7) AS BIGINT) + 7 <= 25
        UNION ALL SELECT DISTINCT p_brand, 'Brand#2', 'compile', '1.0' FROM part WHERE p_brand = 'Brand#16'""",
    "source_lines": f"""SELECT source_file AS path, source_line + k AS line, k, id, concat('C', CAST(id AS STRING)) AS own, {_GETTER.format(id='id')} AS getter, CASE k WHEN 1 THEN concat('    C', CAST(id AS STRING), ' a = new C', CAST(id AS STRING), '(f(1, 2), "x,y");') WHEN 2 THEN '    this.state = other.state;'
        WHEN 3 THEN '    run(); // run(1)' WHEN 4 THEN concat('    helper.', {_GETTER.format(id='id')}, '(items[0], g(a, b), ') WHEN 5 THEN '    int y = state + 1;' ELSE '    run(a < b);' END AS text, CASE WHEN k = 4 THEN 'last);' ELSE '' END AS following
        FROM classes CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS ks WHERE id % 100 = 0""",
    "source_positions": """SELECT path, line, CASE k WHEN 1 THEN instr(text, 'new C') + 4 WHEN 2 THEN instr(text, '.state;') + 1 WHEN 4 THEN instr(text, '.get') + 3 WHEN 5 THEN instr(text, 'state') + 5 ELSE 6 END AS column FROM source_lines""",
    "jvm_api": """SELECT id AS class_id, '' AS member, 'flags' AS field, CASE id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'abstract public' WHEN 2 THEN 'final public' ELSE '' END AS value FROM classes WHERE id % 47 <> 5
        UNION ALL SELECT id, '', 'signature', CASE WHEN id % 5 = 0 THEN '<T:Ljava/lang/Object;>Ljava/lang/Object;' ELSE '' END FROM classes WHERE id % 47 <> 5
        UNION ALL SELECT class_id, concat(kind, ' ', name, ' ', descriptor), 'exceptions', CASE WHEN class_id % 6 = 1 THEN 'java.io.IOException' ELSE '' END FROM class_members WHERE class_id % 47 <> 5 AND kind <> 'FIELD'
        UNION ALL SELECT class_id, concat(kind, ' ', name, ' ', descriptor), 'signature', CASE WHEN class_id % 8 = 3 THEN '<T:Ljava/lang/Object;>(TT;)V' ELSE '' END FROM class_members WHERE class_id % 47 <> 5
        UNION ALL SELECT class_id, concat(kind, ' ', name, ' ', descriptor), 'constant', CASE WHEN class_id % 9 = 2 THEN '1' ELSE '' END FROM class_members WHERE class_id % 47 <> 5 AND kind = 'FIELD'""",
    "baseline_jvm_api": """SELECT class_id, member, field, CASE WHEN field = 'flags' AND class_id % 7 = 3 THEN 'public' WHEN field = 'flags' AND class_id % 7 = 4 THEN '' WHEN field = 'flags' AND class_id % 28 = 5 THEN concat(value, ' synthetic') WHEN field = 'signature' AND class_id % 10 = 5 THEN ''
        WHEN field = 'exceptions' AND class_id % 12 = 7 THEN 'java.io.IOException,java.sql.SQLException' WHEN field = 'constant' AND class_id % 18 = 2 THEN '2' ELSE value END AS value FROM jvm_api WHERE class_id % 53 <> 9""",
    "external_deps": """SELECT p_partkey AS class_id, CASE WHEN p_partkey % 19 = 0 THEN 'Plain' WHEN p_partkey % 7 = 0 THEN concat('lib.', lower(p_type)) ELSE concat('org.', lower(p_type), '.', replace(p_name, ' ', '.')) END AS external_type,
        CASE p_partkey % 3 WHEN 0 THEN 'ANNOTATION' WHEN 1 THEN 'FIELD' ELSE 'METHOD' END AS usage_kind FROM part WHERE p_partkey % 2 = 0""",
    "files": "SELECT page_id AS id, substr(split_part(url, '?', 1), 8) AS path, CASE WHEN page_id % 17 = 0 THEN 'deleted' ELSE 'current' END AS lifecycle FROM pages",
    "baseline_classes": """SELECT id, CASE WHEN id % 61 = 30 THEN concat('org.acme.gone.C', CAST(id AS STRING)) ELSE class_name END AS class_name, CASE WHEN id % 41 = 7 THEN 'INTERFACE' ELSE kind END AS kind, CASE WHEN id % 43 = 9 THEN 'org.acme.Old' ELSE superclass END AS superclass, interface_name, source_file, is_bean, origin, lifecycle, module, source_set
        FROM classes WHERE id % 29 <> 4""",
    "baseline_members": """SELECT class_id, kind, name, descriptor, CASE WHEN class_id % 45 = 10 THEN concat('final ', parameter_types) ELSE parameter_types END AS parameter_types,
        CASE WHEN class_id % 23 = 1 THEN 'public' WHEN class_id % 24 = 8 AND name = 'run' THEN 'public' WHEN class_id % 35 = 2 THEN concat(modifiers, ' synchronized') ELSE modifiers END AS modifiers,
        CASE WHEN class_id % 27 = 0 THEN '' ELSE annotations END AS annotations FROM class_members WHERE NOT (name = 'run' AND class_id % 37 IN (2, 8)) AND class_id % 29 <> 4
        UNION ALL SELECT class_id, kind, 'gone', descriptor, parameter_types, modifiers, annotations FROM class_members WHERE name = 'run' AND class_id % 19 = 6 AND class_id % 29 <> 4""",
    "baseline_annotations": "SELECT class_id, annotation_name FROM class_annotations WHERE direct AND class_id % 31 <> 8",
    "baseline_dependencies": "SELECT from_class_id, to_class_id, kind, CAST(sum(quantity) AS BIGINT) AS occurrence_count FROM dependency_rows WHERE from_class_id <> to_class_id AND line <= 6 GROUP BY from_class_id, to_class_id, kind",
    "kotlin_declarations": f"""SELECT p_partkey AS class_id, 'FUNCTION' AS kind, concat('execute', CAST(p_partkey % 4 AS STRING)) AS name, 'run' AS jvm_name, '()V' AS descriptor FROM part WHERE p_partkey % 6 = 2
        UNION ALL SELECT p_partkey, 'PROPERTY', 'condition', 'state', '' FROM part WHERE p_partkey % 6 = 2
        UNION ALL SELECT p_partkey, 'PROPERTY', 'item', {_GETTER.format(id='p_partkey')}, CASE WHEN p_partkey % 4 = 0 THEN '(I)Ljava/lang/String;' ELSE '()V' END FROM part WHERE p_partkey % 6 IN (2, 3)""",
    "kotlin_calls": """SELECT id AS caller_class_id, 'use' AS caller_method, '()V' AS caller_descriptor, id AS target_class_id, CASE id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'f$default' ELSE 'f' END AS target_method,
        CASE id % 3 WHEN 0 THEN '(I)V' WHEN 1 THEN '(IILjava/lang/Object;)V' ELSE '()V' END AS target_descriptor, 'static' AS invocation_kind, CAST(1 AS BIGINT) AS occurrence_count FROM classes
        UNION ALL SELECT id, 'f$default', CASE WHEN id % 7 = 6 THEN '(ILjava/lang/Object;)V' ELSE '(IILjava/lang/Object;)V' END, id, 'f', '(I)V', 'static', 1 FROM classes
        UNION ALL SELECT id, 'f', '()V', id, 'f$default', '(IILjava/lang/Object;)V', 'static', 1 FROM classes WHERE id % 3 = 2
        UNION ALL SELECT id, 'f', '()V', id, 'use', '()V', 'static', 1 FROM classes WHERE id % 15 = 2
        UNION ALL SELECT id, '<init>', '(IILkotlin/jvm/internal/DefaultConstructorMarker;)V', id, '<init>', '(I)V', 'special', 1 FROM classes WHERE id % 4 = 1
        UNION ALL SELECT id, '<init>', '()V', id, '<init>', '(IILkotlin/jvm/internal/DefaultConstructorMarker;)V', 'special', CASE WHEN id % 8 = 1 THEN 1 ELSE 2 END FROM classes WHERE id % 4 = 1
        UNION ALL SELECT id, 'h', '(J)V', id - id % 10, 'f', '(I)V', 'static', 1 FROM classes WHERE id % 10 > 6
        UNION ALL SELECT id, 'f', '(Ljava/lang/Object;)V', id, 'f', '(I)V', 'virtual', 1 FROM classes WHERE id % 5 = 3""",
    "kotlin_semantics": """SELECT id AS class_id, 'FUNCTION' AS kind, 'f' AS jvm_name, '(I)V' AS descriptor, id % 11 <> 10 AS has_defaults, CASE WHEN id % 2 = 0 THEN 1 END AS value_parameters, false AS is_suspend, false AS is_extension FROM classes WHERE id % 13 <> 12
        UNION ALL SELECT id, 'FUNCTION', 'use', '()V', false, 0, false, false FROM classes UNION ALL SELECT id, 'CONSTRUCTOR', '<init>', '(I)V', id % 6 <> 5, 1, false, false FROM classes WHERE id % 4 = 1""",
    "kotlin_members": """SELECT id AS class_id, 'METHOD' AS kind, 'f' AS name, '()V' AS descriptor, CASE WHEN id % 9 < 7 THEN 'kotlin.jvm.JvmOverloads' ELSE '' END AS annotations FROM classes UNION ALL SELECT id, 'METHOD', 'f', '(I)V', '' FROM classes
        UNION ALL SELECT id, 'CONSTRUCTOR', '<init>', '()V', 'x kotlin.jvm.JvmOverloads' FROM classes WHERE id % 4 = 1""",
    "class_files": "SELECT p_partkey AS class_id, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 50 AS BIGINT) END AS file_id FROM part",
    "annotation_metas": """SELECT DISTINCT concat('org.acme.Mark', CAST(p_partkey % 6 AS STRING)) AS annotation, CASE p_partkey % 6 WHEN 0 THEN 'org.acme.Core' WHEN 1 THEN 'org.acme.Mark0' WHEN 2 THEN 'org.acme.Mark1' WHEN 3 THEN 'org.acme.Mark4' ELSE 'org.acme.Mark3' END AS meta, '' AS element FROM part""",
    "annotation_uses": """SELECT id AS class_id, '' AS name, '' AS descriptor, CAST(NULL AS INTEGER) AS position, CASE WHEN id % 7 = 0 THEN 'org.acme.Core' ELSE concat('org.acme.Mark', CAST(id % 6 AS STRING)) END AS annotation, '' AS element FROM classes WHERE id % 3 <> 1
        UNION ALL SELECT class_id, name, descriptor, CAST(NULL AS INTEGER), concat('org.acme.Mark', CAST((class_id + length(name)) % 6 AS STRING)), '' FROM class_members WHERE class_id % 4 = 2
        UNION ALL SELECT class_id, name, descriptor, 0, CASE WHEN class_id % 5 = 1 THEN 'org.acme.Core' ELSE 'org.acme.Mark2' END, '' FROM class_members WHERE parameter_types <> '' AND class_id % 5 < 3
        UNION ALL SELECT class_id, name, descriptor, 0, 'org.acme.Mark1', '' FROM class_members WHERE parameter_types <> '' AND class_id % 10 = 1""",
    "class_path_jars": """SELECT DISTINCT p_brand AS module, CASE WHEN p_partkey % 3 = 0 AND length(p_brand) = 7 THEN 'test' ELSE 'main' END AS source_set, concat('/m2/', lower(p_type), '/lib', CAST(p_size % 7 AS STRING), '-1.', CAST(p_size % 2 AS STRING), '.jar') AS jar,
        concat('org.', lower(p_type)) AS grp, concat('lib', CAST(p_size % 7 AS STRING)) AS artifact, concat('1.', CAST(p_size % 2 AS STRING)) AS version FROM part""",
    "declared_artifacts": """SELECT DISTINCT p_brand AS module, concat('org.', lower(p_type)) AS grp, concat('lib', CAST(p_size % 7 AS STRING)) AS artifact, CASE p_partkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'runtime' ELSE 'compile' END AS scope FROM part WHERE p_size % 7 < 4 OR p_partkey % 2 = 0""",
    "complete_modules": "SELECT DISTINCT p_brand AS module FROM part WHERE length(p_brand) = 8",
    "external_beans": "SELECT s_suppkey AS id, concat('lib.Bean', CAST(s_suppkey AS STRING)) AS class_name, CASE WHEN s_suppkey % 7 > 0 THEN concat('org.lib:a', CAST(s_nationkey AS STRING)) END AS artifact FROM supplier",
    "external_bean_settings": "SELECT c_custkey % 7 AS bean_id, concat('field', CAST(c_custkey % 5 AS STRING)) AS member, CASE WHEN c_custkey % 4 > 0 THEN concat('app.key', CAST(c_nationkey AS STRING)) END AS key, c_custkey % 3 = 0 AS required FROM customer",
    "di_problems": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 90 AS BIGINT) END AS class_id, concat('org.acme.K', CAST(c_custkey % 90 AS STRING)) AS class_name, CASE WHEN c_custkey % 2 = 0 THEN 'UNSATISFIED' ELSE 'INVALID_SCOPE' END AS problem_type, c_mktsegment AS message FROM customer WHERE c_custkey % 6 = 1",
    "baseline_beans": "SELECT id, class_id, kind, CASE WHEN id % 17 = 3 THEN 'Singleton' ELSE scope END AS scope, qualifier FROM beans WHERE id % 13 <> 5",
    "baseline_injections": "SELECT id, bean_id, target_type, qualifier, field_name, CASE WHEN id % 3 > 0 THEN 'UNSATISFIED' ELSE 'AMBIGUOUS' END AS status, '' AS reason FROM injection_points WHERE id % 9 <> 2",
    "calls_log": "SELECT event_id AS id, event_type AS tool, user_id, ts AS at, value AS elapsed_ms, event_type = 'error' AS failed FROM events",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def needs(name: str) -> list[str]:
    """The relations that a relation is built on, in order, itself last."""
    words = set(re.findall(r"\w+", RELATIONS[name]))
    out: list[str] = []
    for other in RELATIONS:
        if other in words and other != name:
            out += [x for x in needs(other) if x not in out]
    return [*out, name]


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The relations over one folder of driver tables, built when they are asked for."""

    def build(name: str, of: Snapshot) -> DataFrame:
        words = set(re.findall(r"\w+", RELATIONS[name]))
        given = {t: table(spark, sf_dir, t) for t in TABLES if t in words} | {r: of[r] for r in RELATIONS if r in words and r != name}
        text = re.sub(rf"\b({'|'.join(given)})\b(?=\s|$)", r"{\1}", RELATIONS[name]) if given else RELATIONS[name]
        return spark.sql(text, **given)

    return Snapshot(spark, build)


def oracle(body: str) -> str:
    """``body`` (a SELECT, or CTEs and a SELECT) with the relations that it names put before it."""
    words = set(re.findall(r"\w+", body))
    used: list[str] = []
    for name in RELATIONS:
        if name in words:
            used += [x for x in needs(name) if x not in used]
    with_ = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in used)
    rest = body.strip()
    joint = ", " if not rest.upper().startswith(("SELECT", "(SELECT")) else " "
    return f"WITH RECURSIVE {with_}{joint}{rest}" if used else (rest if joint == " " else f"WITH RECURSIVE {rest}")
