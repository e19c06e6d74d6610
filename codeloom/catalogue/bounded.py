"""Queries of traversals with a budget, of what they say about themselves, and of pages with totals.

Each is registered with a budget that is hit and with one that isn't.
"""

from pyspark.sql import functions as F

from codeloom.catalogue import CUR, filled, register
from codeloom.catalogue.graphs import _CALLS, _RELATED, _ROOT
from codeloom.catalogue.rules import _IMPACTED, _TARGETS, _TESTS
from codeloom.functions.paging import page_with_total
from codeloom.operators import graph as g
from codeloom.operators import risk

_STARTS = "SELECT x AS origin, x AS node FROM (SELECT unnest([CAST(0 AS BIGINT), 3, 17, 40]) AS x)"


def _levels(name: str, edges: str, src: str, dst: str, starts: str, depth: int, most: int) -> str:
    """Common table expressions of a walk, level by level: ``l`` what is reached, ``e`` what is followed, and ``all``, ``status``."""
    out = [f"{name}_l0 AS ({starts})"]
    for d in range(depth):
        before = " UNION ALL ".join(f"SELECT origin FROM {name}_e{k}" for k in range(d)) or "SELECT origin FROM (SELECT NULL AS origin) WHERE false"
        seen = " UNION ALL ".join(f"SELECT origin, node FROM {name}_l{k}" for k in range(d + 1))
        out.append(f"{name}_e{d} AS (SELECT origin, node FROM (SELECT l.origin, l.node, row_number() OVER (PARTITION BY l.origin ORDER BY l.node) AS place, (SELECT count(*) FROM ({before}) b WHERE b.origin = l.origin) AS used FROM {name}_l{d} l) WHERE place <= {most} - used)")
        out.append(f"{name}_l{d + 1} AS (SELECT DISTINCT f.origin, x.{dst} AS node FROM {name}_e{d} f JOIN {edges} x ON x.{src} = f.node WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.origin = f.origin AND v.node = x.{dst}))")
    every = " UNION ALL ".join(f"SELECT origin, node, CAST({k} AS INTEGER) AS depth FROM {name}_l{k}" for k in range(depth + 1))
    followed = " UNION ALL ".join(f"SELECT origin, CAST({k} AS INTEGER) AS depth FROM {name}_e{k}" for k in range(depth))
    out.append(f"{name}_all AS ({every}), {name}_f AS ({followed})")
    out.append(
        f"""{name}_status AS (SELECT o.origin, (SELECT count(*) FROM {name}_all a WHERE a.origin = o.origin) AS visited, (SELECT count(*) FROM {name}_f f WHERE f.origin = o.origin) AS expanded,
        (SELECT count(*) FROM {name}_all a WHERE a.origin = o.origin AND depth < {depth}) > (SELECT count(*) FROM {name}_f f WHERE f.origin = o.origin) AS truncated,
        NOT EXISTS (SELECT 1 FROM {name}_all a JOIN {edges} x ON x.{src} = a.node WHERE a.origin = o.origin AND NOT EXISTS (SELECT 1 FROM {name}_all b WHERE b.origin = o.origin AND b.node = x.{dst}))
        AND (SELECT count(*) FROM {name}_all a WHERE a.origin = o.origin AND depth < {depth}) = (SELECT count(*) FROM {name}_f f WHERE f.origin = o.origin) AS complete
        FROM (SELECT DISTINCT origin FROM {name}_l0) o)"""
    )
    return ", ".join(out)


_USERS = "us AS (SELECT DISTINCT to_class_id AS src, from_class_id AS dst FROM dependencies)"
_CAPPED = _IMPACTED.replace("wi AS (SELECT node AS id, min(depth) AS depth FROM w0 GROUP BY 1 HAVING min(depth) > 0)", "wi AS (SELECT node AS id, min(depth) AS depth FROM t_all WHERE depth > 0 GROUP BY 1)")
_WALK0 = _IMPACTED[_IMPACTED.index("w0 AS") : _IMPACTED.index(", wi AS")]
for _name, _most in (("capped", 3), ("uncapped", 5000)):
    _ways = _levels("t", "us", "src", "dst", _STARTS, 3, _most)
    register(
        f"impacted_tests_{_name}",
        lambda s, most=_most: filled(risk.impacted_tests_traversal(s, _TARGETS(s), most=most).rows, "depth", "id"),
        f"{_CAPPED.replace(_WALK0, f'{_USERS}, {_ways}')} SELECT * FROM im",
    )
    register(f"impacted_tests_{_name}_status", lambda s, most=_most: risk.impacted_tests_traversal(s, _TARGETS(s), most=most).status, f"{_USERS}, {_ways} SELECT * FROM t_status")

register(
    "impacted_tests_page",
    lambda s: page_with_total(filled(risk.impacted_tests(s, _TARGETS(s)), "depth", "id"), [F.desc("score"), "class_name", "id"], 10, 5),
    f"{_IMPACTED} SELECT *, (SELECT count(*) FROM im) AS total, (SELECT count(*) FROM im) > 15 AS has_more FROM im ORDER BY score DESC, class_name, id LIMIT 10 OFFSET 5",
)


def _call_levels(most: int, depth: int) -> str:
    """Calls level by level from the method that calls most, until ``most`` are found."""
    out = ["k_l0 AS (SELECT node FROM b)"]
    for d in range(depth):
        used = " + ".join(f"(SELECT count(*) FROM k_h{k})" for k in range(d)) or "0"
        seen = " UNION ALL ".join(f"SELECT node FROM k_l{k}" for k in range(d + 1))
        out.append(f"k_h{d} AS (SELECT * FROM (SELECT c.*, row_number() OVER (ORDER BY src, dst, invocation_kind) AS place FROM c WHERE src IN (SELECT node FROM k_l{d})) WHERE place <= {most} - ({used}))")
        out.append(f"k_l{d + 1} AS (SELECT DISTINCT dst AS node FROM k_h{d} WHERE ({used} + (SELECT count(*) FROM k_h{d})) < {most} AND dst NOT IN (SELECT node FROM ({seen})))")
    return ", ".join([*out, "k_all AS (" + " UNION ALL ".join(f"SELECT CAST({d + 1} AS INTEGER) AS depth, src, dst, invocation_kind, occurrence_count FROM k_h{d}" for d in range(depth)) + ")"])


for _name, _most in (("capped", 4), ("uncapped", 5000)):
    register(f"call_hierarchy_{_name}", lambda s, most=_most: g.call_traversal(s, max_depth=3, most=most).rows, f"{_CALLS}, {_call_levels(_most, 3)} SELECT 'outbound' AS direction, * FROM k_all")
    register(
        f"call_hierarchy_{_name}_status",
        lambda s, most=_most: g.call_traversal(s, max_depth=3, most=most).status,
        f"{_CALLS}, {_call_levels(_most, 3)} SELECT 'outbound' AS direction, count(*) AS found, count(*) >= {_most} AS truncated FROM k_all",
    )
    _below = _levels("d", "hr", "parent", "child", f"SELECT 0 AS origin, '{_ROOT}' AS node", 3, _most)
    register(
        f"type_hierarchy_{_name}",
        lambda s, most=_most: g.type_hierarchy_traversal(s, _ROOT, direction="descendant", max_depth=3, most=most).rows.select("direction", "depth", "name", "indexed"),
        f"{CUR}, {_RELATED}, {_below} SELECT 'descendant' AS direction, depth, node AS name, node IN (SELECT class_name FROM cur) AS indexed FROM d_all WHERE depth > 0",
    )
    register(
        f"type_hierarchy_{_name}_status",
        lambda s, most=_most: g.type_hierarchy_traversal(s, _ROOT, direction="descendant", max_depth=3, most=most).status,
        f"{_RELATED}, {_below} SELECT 'descendant' AS direction, visited, expanded, truncated, complete FROM d_status",
    )
