"""Pages, cursors and byte budgets of results."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def clamp(value: int | None, default: int, most: int, least: int = 1) -> int:
    """A parameter within its bounds."""
    return max(least, min(most, default if value is None else value))


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows of an ordered frame from ``offset``; all without a limit."""
    rest = df.offset(offset) if offset else df
    return rest if limit is None else rest.limit(limit)


def page_with_total(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of ``df`` in an order that tells all rows apart, with ``total`` (all rows) and ``has_more`` on each row. The page is taken by a
    bounded sort; the total is a scalar of the same query, and no row is joined."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = page(df.orderBy(*order), limit, offset).withColumn("total", total)
    return rows.withColumn("has_more", F.col("total") > offset + limit)


def envelope(showing: int, total: int, limit: int, offset: int) -> dict:
    """What a page says about itself."""
    more = offset + showing < total
    return {"showing": showing, "total": total, "limit": limit, "offset": offset, "has_more": more, "truncated": offset > 0 or more, "next_offset": offset + showing if more else None}


def answer(df: DataFrame, *, order: list[Column | str] | None = None, status: dict | None = None, limit: int | None = None, default: int = 50, most: int = 500, offset: int = 0, cursor: str | None = None, traversal: str = "", budget: int = 256 * 1024) -> dict:
    """A page of an unlimited frame as an answer: its rows, how many there are in all, whether there are more and the
    cursor to them. With ``order`` rows are counted by the query that takes the page; without it ``df`` is ordered and is counted by itself.
    ``status`` (of a traversal) is told with it, and the answer is complete only if that is. ``cursor`` continues the traversal of that name;
    last rows go where the answer is beyond ``budget`` bytes."""
    start = decode_cursor(cursor, traversal=traversal) if cursor else max(offset, 0)
    size = clamp(limit, default, most)
    if order is None:
        total = df.count()
        rows = page(df, size, start).collect()
    else:
        rows = page_with_total(df, order, size, start).collect()
        total = rows[0]["total"] if rows else df.count()
        rows = [Row(**{k: v for k, v in r.asDict().items() if k not in ("total", "has_more")}) for r in rows]
    whole = within_budget({"results": json.loads(json.dumps([r.asDict(recursive=True) for r in rows], default=str))}, budget)
    about = envelope(len(whole["results"]), total, size, start) | ({"traversal": status, "answer_complete": not status.get("truncated", False)} if status is not None else {})
    return whole | about | {"next_cursor": encode_cursor(traversal=traversal, offset=about["next_offset"]) if about["has_more"] else None}


def encode_cursor(**state: object) -> str:
    """An opaque cursor for a traversal's state."""
    return base64.urlsafe_b64encode(json.dumps({"v": 1, **state}, sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, **expected: object) -> int:
    """The offset in a cursor; it has to belong to the same traversal."""
    try:
        state = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("cursor can't be read") from e
    if state.get("v") != 1 or any(state.get(k) != v for k, v in expected.items()):
        raise ValueError("cursor belongs to another traversal")
    return int(state["offset"])


def within_budget(answer: dict, most: int = 256 * 1024) -> dict:
    """Drop last items, always from the list whose last item is largest, until the JSON fits."""
    most = max(most, 4096)
    size = lambda x: len(json.dumps(x, separators=(",", ":")).encode())
    dropped = False

    def lists(x: object):
        if isinstance(x, dict):
            for v in x.values():
                yield from lists(v)
        elif isinstance(x, list):
            if x:
                yield x
            for v in x:
                yield from lists(v)

    while size(answer) > most and (found := list(lists(answer))):
        max(found, key=lambda v: size(v[-1])).pop()
        dropped = True
    return answer | {"budget_truncated": True} if dropped else answer
