"""Sharding by histogram sort: near-equal bytes in every shard, in DataFrame operations only.

Rows are ordered by the hash of their text, then by the hash of their id, then by a hash of their place
in the input. For each boundary between shards, exact bytes are counted below candidate keys (256 of them between the last two that enclose
the target), until the boundary is within the tolerance or no key is left to tell rows apart. A
boundary that falls inside a group of equal texts goes to the group's nearer end, unless the group is more than a stated share of a shard;
then the ids' hashes split it, and the places where ids repeat or are null too, so a group with a third of all rows does no harm. The driver sees
counts only, at most 256 for each boundary and round. Rows are exchanged once, to number them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stored

_LOW = -(1 << 63)
_DIGIT = 8


_KEYS = ("k1", "k2", "k3")
_LAST = 8 * len(_KEYS) - 1


@dataclass
class _Cut:
    """A boundary: where its keys begin, as far as known; the bytes below; the level of the next digit."""

    target: float
    low: tuple[int, ...] = (0, 0, 0)
    below: int = 0
    level: int = 0
    done: bool = False


def _key(level: int) -> Column:
    return F.col(_KEYS[level // 8])


def _digit(level: int) -> Column:
    return F.shiftrightunsigned(_key(level).bitwiseXOR(F.lit(_LOW)), 64 - _DIGIT * (level % 8 + 1)).bitwiseAND(F.lit(255)).cast("int")


def _within(cut: _Cut) -> Column:
    """Whether a row has the digits that a boundary has settled so far."""
    at, settled = divmod(cut.level, 8)
    own = cut.low[at]
    inside = _key(cut.level).between(own + _LOW, own + (1 << 64 - _DIGIT * settled) - 1 + _LOW)
    for k in range(at):
        inside = (F.col(_KEYS[k]) == cut.low[k] + _LOW) & inside
    return inside


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.001, whole_share: float = 0.0) -> list[tuple[int, ...]]:
    """Lower bounds (k1, k2, k3), signed, of all shards but the first, for ``keyed`` (k1, k2, k3, size long).

    Each boundary has within ``tolerance`` times a shard's share of bytes below it, or as near as rows of equal
    keys allow: those go to the side of the boundary that is nearer the target, and so do rows of one k1 that have no more than
    ``whole_share`` times a shard's bytes. Of no rows: bounds that leave all shards empty.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = [_Cut(total * j / shards) for j in range(1, shards)]
    allowed = tolerance * total / shards
    while todo := [c for c in cuts if not c.done]:
        nodes = {(c.level, c.low): c for c in todo}
        which = F.coalesce(*[F.when(_within(c), F.lit(k)) for k, c in enumerate(nodes.values())])
        of = lambda f: F.coalesce(*[F.when(F.col("n") == k, f(c.level)) for k, c in enumerate(nodes.values())])
        rows = keyed.select(*_KEYS, "size", which.alias("n")).where("n is not null").select("n", of(_digit).alias("d"), of(_key).alias("key"), "size")
        found = rows.groupBy("n", "d").agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("z"))
        bins: dict[int, list] = {}
        for r in found.collect():
            bins.setdefault(r.n, []).append((r.d, r["size"], r.a, r.z))
        place = {key: sorted(bins.get(k, [])) for k, key in enumerate(nodes)}
        for c in todo:
            below = c.below
            for d, size, a, z in place[c.level, c.low]:
                start = _start(c, d)
                if below >= c.target - allowed:
                    c.low, c.below, c.done = start, below, True
                elif below + size > c.target + allowed:
                    if c.level == _LAST:
                        # equal keys: the nearer end
                        c.low, c.done = _start(c, d + 1) if c.target - below > below + size - c.target else start, True
                    else:
                        at = c.level // 8
                        whole = a == z and at < len(_KEYS) - 1
                        if a == z and at == 0 and size <= whole_share * total / shards:
                            nearer = c.target - below > below + size - c.target
                            c.low, c.done = (a - _LOW + nearer, 0, 0), True
                            break
                        c.low, c.below = (*c.low[:at], a - _LOW, *[0] * (len(_KEYS) - at - 1)) if whole else start, below
                        c.level = 8 * (at + 1) if whole else c.level + 1
                else:
                    below += size
                    continue
                break
            else:
                c.low, c.below, c.done = _start(c, 256), below, True
    return sorted(tuple(min(x, (1 << 64) - 1) + _LOW for x in c.low) for c in cuts)


def _start(cut: _Cut, digit: int) -> tuple[int, ...]:
    """The lowest key with this next digit; 256 gives the end of what the settled digits allow."""
    at, settled = divmod(cut.level, 8)
    key = [*cut.low[:at], cut.low[at] + (digit << 64 - _DIGIT * (settled + 1))]
    while len(key) > 1 and key[-1] >= 1 << 64:
        key.pop()
        key[-1] += 1
    return (*key, *[0] * (len(_KEYS) - len(key)))


def _at_or_above(bound: tuple[int, ...]) -> Column:
    out = F.col(_KEYS[-1]) >= bound[-1]
    for k in range(len(_KEYS) - 2, -1, -1):
        out = (F.col(_KEYS[k]) > bound[k]) | ((F.col(_KEYS[k]) == bound[k]) & out)
    return out


def shard_by_bytes(docs: DataFrame, *, shards: int = 24, tolerance: float = 0.001, whole_share: float = 0.1, slot_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size long, text_crc32 long, shard int, slot long) of all rows.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Shards differ in bytes by about twice
    ``tolerance`` at most, or by a row where rows are larger, or by a group of equal texts of up to ``whole_share`` times a shard's
    bytes: such a group stays in one shard, larger ones are split. ``slot`` numbers the rows of a shard from 0 without gaps; a task numbers
    about ``slot_rows`` of them, dealt by their place in the input, so rows that are all alike meet in no single task.
    Null ids and texts are rows like others; repeated rows stay; other columns are ignored. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # written before it is used, so the places stay as they are
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"), F.xxhash64(F.monotonically_increasing_id()).alias("k3"))
    keyed = stored(rows)
    salts = max(1, -(-keyed.count() // (shards * slot_rows)))
    bounds = splitters(keyed, shards, tolerance, whole_share)
    placed = keyed.withColumn("shard", sum([F.when(_at_or_above(b), 1).otherwise(0) for b in bounds], F.lit(0)).cast("int")).withColumn("salt", F.pmod("k3", F.lit(salts)).cast("int"))
    counts = placed.groupBy("shard", "salt").count()
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("k1", "k2", "k3")))
    return ranked.join(starts, ["shard", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
