"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codeloom.llm.common import MIX, arrow_map, batch_of, cached_hashes, salt, slices, splitmix, stored, trimmed
from codeloom.runtime import ship

#: Words longer than this also give their overlapping pieces, for text without spaces.
LONG_WORD, PIECE = 32, 8
_BLOCK = 1 << 13


def _sequence(words: list[bytes]) -> np.ndarray:
    """Hashes of words in order, each long one followed by its pieces, one for each of its bytes but the last few."""
    h = cached_hashes(words)
    long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
    if not long:
        return h
    out, at = [], 0
    for k in long:
        pieces = np.lib.stride_tricks.sliding_window_view(np.frombuffer(words[k], np.uint8), PIECE)
        out += [h[at : k + 1], splitmix(np.ascontiguousarray(pieces).view("<u8").ravel() + MIX)]
        at = k + 1
    return np.concatenate([*out, h[at:]])


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the terms of a text: words and pairs of neighbouring words, ASCII letters
    lower-cased; pieces of long words count as words after them. A term weighs 1 + ln(times), a word half of that."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    h = _sequence(words)
    one, n1 = np.unique(h, return_counts=True)
    two, n2 = np.unique(splitmix(h[:-1] * MIX + h[1:]), return_counts=True)
    return np.concatenate((one, two)), np.concatenate(((1 + np.log(n1)) / 2, 1 + np.log(n2))).astype(np.float32)


def fingerprint(text: bytes, bits: int = 256) -> bytes:
    """The signs of the weighted votes of term hashes; zeros for a text without words."""
    hashes, weights = terms(text)
    total = np.zeros(bits, np.float64)
    for a in range(0, len(hashes), _BLOCK):
        h = hashes[a : a + _BLOCK]
        wide = np.stack([splitmix(h + salt(k)) for k in range(bits // 64)], axis=1)
        ones = np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1)
        total += weights[a : a + _BLOCK] @ ones.astype(np.float32)
    return np.packbits(2 * total > float(weights.sum(dtype=np.float64)) + 1e-6).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of differing bits."""
    return 1.0 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame, *, bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint binary) of each whole text; null counts as empty, an empty text gives zeros.
    Ids of any type and null pass through; repeated rows repeat; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "t"):
            yield {"doc_id": part.column("i"), "fingerprint": [fingerprint(t, bits) for t in part.column("t").to_pylist()]}

    source = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return arrow_map(source, work, f"doc_id {kind}, fingerprint binary")


def _distance(a: str, b: str, size: int) -> Column:
    part = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
    words = [F.bit_count(part(a, k).bitwiseXOR(part(b, k))) for k in range(-(-size // 8))]
    return sum(words[1:], words[0])


def within_radius(prints: DataFrame, queries: DataFrame, *, radius: int = 3, blocks: int | None = None, bits: int | None = None) -> DataFrame:
    """(query, found, distance): every two fingerprints at ``radius`` or fewer differing bits, one row for
    each pair of distinct values; which documents have a value is in the inputs.

    Both inputs have a column ``fingerprint`` (binary, ``bits`` long, by default as long as the first one);
    null is ignored, another length is an error. The bits are
    cut into ``blocks`` (default radius + 2). As at most ``radius`` blocks can differ, some
    ``blocks - radius`` blocks are equal: each choice of them is one permuted table, keyed by those
    blocks. Values are distinct before they are exchanged, so copies cost nothing. Other columns are ignored.
    """
    if bits is None:
        one = prints.where(F.col("fingerprint").isNotNull()).select(F.length("fingerprint")).first()
        bits = 8 * one[0] if one else 64
    blocks = blocks or radius + 2
    size = bits // 8
    if not radius < blocks <= size:
        raise ValueError("blocks must be more than radius, and a byte long at least")
    cuts = [size * k // blocks for k in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        right = F.when(F.length("fingerprint") == size, F.col("fingerprint")).otherwise(F.raise_error(F.lit(f"a fingerprint isn't {bits} bits long")).cast("binary"))
        value = df.where(F.col("fingerprint").isNotNull()).select(right.alias(name)).distinct()
        keys = [F.xxhash64(F.lit(k), *[F.substring(name, cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in c]) for k, c in enumerate(choices)]
        return value.select(name, F.explode(F.array(*keys)).alias("block_key"))

    met = keyed(prints, "found").join(keyed(queries, "query"), "block_key")
    return met.select("query", "found", _distance("query", "found", size).alias("distance")).where(F.col("distance") <= radius).distinct()


def near_counts(prints: DataFrame, asked: Column, *, radius: int = 7, blocks: int | None = 8, bits: int | None = None) -> DataFrame:
    """(fingerprint, n_near long): for each distinct fingerprint of the rows that ``asked`` selects, how many
    rows of ``prints`` have one within ``radius`` bits of it, itself included; found by :func:`within_radius`."""
    values = prints.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    met = within_radius(prints, prints.where(asked), radius=radius, blocks=blocks, bits=bits)
    found = met.join(values.withColumnRenamed("fingerprint", "found"), "found")
    return found.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n_near"))


def _rank(value: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are below a value (null: 0), by a search in two steps."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    below = lambda some: F.coalesce(F.array_size(F.filter(some, lambda s: s < value)), F.lit(0))
    coarse = below(F.array(*[F.lit(s) for s in splits[step - 1 :: step]]))
    return coarse * step + below(F.slice(F.array(*[F.lit(s) for s in splits]), coarse * step + 1, F.lit(step)))


_EDITED = "doc_id long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: The first bytes of a text as a number, which orders texts as their bytes do as far as it goes.
_START = "CAST(conv(hex(rpad(substring(t, 1, 6), 6, X'00')), 16, 10) AS BIGINT)"


@dataclass
class _Ranges:
    """Ranges of rows in ascending order of id (null first) and text. ``splits`` are ids that end a range; ``within`` has, for
    ids with more rows than a range should have, the starts of texts that end ranges within the id. No split has to be a row's."""

    splits: list[int]
    within: dict[int | None, list[int]]

    def __len__(self) -> int:
        return len(self.splits) + sum(map(len, self.within.values())) + 1

    def home(self) -> Column:
        """The number of a row's range, over i and p."""
        out = _rank(F.col("i"), self.splits)
        for i, cuts in self.within.items():
            above = F.col("i").isNotNull() if i is None else F.coalesce(F.col("i") > i, F.lit(False))
            out = out + F.when(above, len(cuts)).when(F.col("i").eqNullSafe(F.lit(i)), _rank(F.col("p"), cuts)).otherwise(0)
        return out.cast("int")


def _ranges(rows: DataFrame, parts: int) -> tuple[_Ranges, int]:
    """About ``parts`` ranges of as many rows each, and how many rows there are; at most ``parts`` numbers come to the driver for each level."""
    share = lambda c, n: F.expr(f"percentile_approx({c}, array({','.join(str(k / n) for k in range(1, n))}), {50 * n})") if n > 1 else F.array().cast("array<bigint>")
    cut, n, nulls = rows.agg(share("i", parts), F.count(F.lit(1)), F.count_if(F.col("i").isNull())).first()
    often = Counter(cut or ())
    crowded = {i: k for i, k in often.items() if k > 1} | ({None: nulls * parts // n} if n and nulls * parts >= 2 * n else {})
    within: dict[int | None, list[int]] = {}
    if crowded:
        some = rows.where(F.col("i").isin([i for i in crowded if i is not None]) | (F.col("i").isNull() if None in crowded else F.lit(False))).select("i", F.expr(_START).alias("p"))
        of = [(F.when(F.col("i").eqNullSafe(F.lit(i)), F.col("p")), k + 1) for i, k in crowded.items()]
        named = some.select(*[c.alias(f"p{j}") for j, (c, _) in enumerate(of)])
        found = named.agg(*[share(f"p{j}", k).alias(f"c{j}") for j, (_, k) in enumerate(of)]).first()
        within = {i: sorted(set(found[f"c{j}"] or ())) for j, i in enumerate(crowded)}
    return _Ranges(sorted(often), within), n


def edited_fingerprints(docs: DataFrame, *, bits: int = 256, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edit: its last half replaced by the next document's start.

    Returns (doc_id, n_chars, edited binary, fingerprint, edited_fingerprint binary, near_edited,
    near_next). The next document has the next smaller id; after the smallest comes the largest.
    Null ids come after all others, rows of one id in the order of their texts, descending. Null text is
    empty. A single document is its own next. Texts are exchanged once, by ranges of ids, and within an id that very many rows
    have (or none) by the starts of texts; the first row of
    each range also goes to the range before it, so no order over all rows is needed in one place. Of rows that repeat an id
    and a text very often all but one, whose next is their like, are worked out once. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    ranges, total = _ranges(rows, parts)
    if not total:
        return spark.createDataFrame([], _EDITED)
    again = None
    if ranges.within:
        # alike rows can't be told apart by any range: one of them stays in order
        same = [F.col("i"), F.xxhash64("t").alias("h")]
        many = rows.select(*same).groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") * parts > total))
        numbered = rows.withColumn("m", F.monotonically_increasing_id())
        alike = stored(numbered.select(*same, "m").groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m")).join(F.broadcast(many.select(F.col("i").alias("j"), F.col("h").alias("g"))), F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g")), "left_semi"))
        first = stored(numbered.join(F.broadcast(alike.select("m", "n")), "m").select("i", "t", "n"))
        keyed = rows.withColumn("h", F.xxhash64("t"))
        gone = F.broadcast(alike.select(F.col("i").alias("j"), F.col("h").alias("g")))
        rows = keyed.join(gone, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g")), "left_anti").select("i", "t").unionByName(first.select("i", "t"))
        again = first
    started = rows.withColumn("p", F.expr(_START) if ranges.within else F.lit(None).cast("long"))
    placed = started.withColumn("b", ranges.home())
    own = placed.select("b", F.lit(0).alias("guest"), "i", "t")
    # the greatest row of each range that has rows follows, in descending order, on the next one that has; that of the highest on the lowest
    tops = placed.select("b", F.struct(F.col("i").isNotNull(), "i", "p").alias("k")).groupBy("b").agg(F.max("k").alias("k")).select("b", "k.i", "k.p").orderBy("b").collect()
    ends = spark.createDataFrame([(r.i, r.p, r.b, following.b) for r, following in zip(tops, [*tops[1:], tops[0]], strict=True)], "j long, q long, o int, to int")
    met = placed.join(F.broadcast(ends), (F.col("b") == F.col("o")) & F.col("i").eqNullSafe(F.col("j")) & F.col("p").eqNullSafe(F.col("q")))
    guests = met.groupBy("to").agg(F.max("t").alias("t"), F.max("i").alias("i")).select(F.col("to").alias("b"), F.lit(1).alias("guest"), "i", "t")
    dealt = own.unionByName(guests).repartitionById(len(ranges), F.col("b"))
    ordered = dealt.sortWithinPartitions("b", "guest", F.desc_nulls_last("i"), F.desc("t"))
    ship(spark)
    arrow = to_arrow_schema(_parse_datatype_string(_EDITED))

    def listed(out: list[tuple]) -> pa.RecordBatch:
        return batch_of({f.name: [r[k] for r in out] for k, f in enumerate(arrow)}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch, "t"):
                out = []
                for i, t, guest in zip(part.column("i").to_pylist(), part.column("t").to_pylist(), part.column("guest").to_pylist(), strict=True):
                    now = (i, t.decode("utf-8", "replace"), fingerprint(t, bits))
                    if last is not None:
                        out.append(_beside(last, now, bits))
                    last = None if guest else now
                yield listed(out)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, n in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), batch.column("n").to_pylist(), strict=True):
                own = (i, t.decode("utf-8", "replace"), fingerprint(t, bits))
                one = batch_of({f.name: [v] for f, v in zip(arrow, _beside(own, own, bits), strict=True)}, arrow)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([n - 1], pa.int64())], names=[*one.schema.names, "copies"])

    whole = ordered.mapInArrow(trimmed(run), _EDITED)
    if again is None:
        return whole
    copies = again.mapInArrow(trimmed(alone), f"{_EDITED}, copies long")
    return whole.unionByName(copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies"))


def _beside(own: tuple, following: tuple, bits: int) -> tuple:
    i, text, print_ = own
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[1][:half]).encode()
    other = fingerprint(edited, bits)
    return i, len(text), edited, print_, other, likeness(print_, other), likeness(print_, following[2])
