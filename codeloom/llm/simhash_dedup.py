"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits (an even number) exactly if some third value
lies within half the radius of both. So each distinct fingerprint emits every value within half
the radius; equal values meet in one shuffle. All that meet in a value are linked with each other,
and at most ``1 + bits`` (radius 2) distinct fingerprints can meet there, so neighbours in order
are enough to join a group: no group's pairs are enumerated. Each such pair is verified by a bit
count, and pairs that meet in several values are deduplicated.

With ``tables`` over 1, independent fingerprints give several chances to meet, and with
``min_similarity`` candidate pairs are then verified by the Jaccard coefficient of whole shingle
sets. There sharing a value doesn't imply a link, so neighbours only make a first round; then all
texts of a value that are in different groups so far are compared, crowded values block by block,
and what meets a large group is compared with the whole of it, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codeloom.llm.common import arrow_map, as_bytes, batch_of, drop_stored, salt, slices, splitmix, stored, trimmed
from codeloom.llm.components import connected_components
from codeloom.runtime import ship

SEED = 42
_BLOCK = 1 << 15
#: Values of more rows than this are compared by fingerprints first, in blocks of about so many rows.
_CROWDED, _ROWS = 64, 2048
#: What meets a group of so many texts is compared with all of them, not only with those that it meets.
_LARGE = 32


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, ASCII letters lower-cased, one space between;
    of the whole sequence if it is shorter; none if there is no word."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def vote(hashes: np.ndarray) -> int:
    """The 64-bit number of the bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = hashes[k : k + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, shingle: int = 3, words64: int = 1, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1, ...): ``words64`` 64-bit fingerprints of each whole text; null counts as empty,
    no words give zero. Without ``repeats`` each different shingle votes once. Any type of id, null included, passes through."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        out: list[list[int]] = [[] for _ in range(words64)]
        for text in batch.column("t").to_pylist():
            h = shingle_hashes(text, shingle)
            h = h if repeats else np.unique(h)
            for k in range(words64):
                out[k].append(_signed(vote(splitmix(h + salt(k)) if k else h)))
        yield {"i": batch.column("i"), **{f"f{k}": x for k, x in enumerate(out)}}

    source = docs.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t"))
    return arrow_map(source, work, f"i {kind}, " + ", ".join(f"f{k} long" for k in range(words64)))


def ball(bits: int, radius: int) -> list[int]:
    """Every mask of ``bits`` bits with at most ``radius`` set, as signed 64-bit numbers."""
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _variants(nodes: DataFrame, value: Column, bits: int, radius: int) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius // 2)])
    return nodes.select("*", F.posexplode(masks).alias("flipped", "mask")).select(*nodes.columns, "flipped", value.bitwiseXOR(F.col("mask")).alias("variant"))


def hamming_links(nodes: DataFrame, *, radius: int = 2) -> DataFrame:
    """``nodes`` (f0 long, distinct). Links (a, b), enough of them to join every two fingerprints
    that differ in at most ``radius`` bits, directly or through others that do."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: both sides emit half of it")
    # few bytes become many rows, so the number of tasks is given
    dealt = nodes.select("f0").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f0")
    met = _variants(dealt, F.col("f0"), 64, radius)
    before = F.lag("f0").over(Window.partitionBy("variant").orderBy("f0"))
    pairs = met.select(before.alias("a"), F.col("f0").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_components(docs: DataFrame, *, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): groups of fingerprints linked at ``radius`` or fewer bits.

    ``component_id`` is the smallest id in the group. Null text counts as empty; all texts without
    words have fingerprint zero and are linked like any other. Rows with a null id get a row and a
    group too (whose id is the smallest that isn't null, or null). Repeated rows come back repeated;
    no rows give no rows. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    nodes = prints.groupBy("f0").agg(F.min("i").alias("least"))
    roots = connected_components(hamming_links(nodes, radius=radius))
    rooted = nodes.join(roots, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(of_root, "root").select("f0", "component_id"))
    return prints.join(classes, "f0").select(F.col("i").alias("doc_id"), F.col("f0").alias("fingerprint"), "component_id")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "t"):
            yield {"i": part.column("i"), "s": [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in part.column("t").to_pylist()]}

    return arrow_map(docs, work, "i long, s binary")


def jaccard(left: bytes, right: bytes) -> float:
    """Of two sets of 32-bit hashes, each sorted without repeats; of two empty ones: 1."""
    a, b = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def _farthest(similarity: float, bits: int) -> int:
    """The most differing bits that texts of this Jaccard coefficient may have: the mean and six standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, tables: int = 20, first: int = 4, batch: int = 4, radius: int = 2, min_similarity: float = 0.8, bucket_entries: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node long, group long, component_id): groups of texts whose shingle sets have a Jaccard coefficient of
    ``min_similarity`` or more, found by ball hashing over ``tables`` 32-bit fingerprints. ``node`` is
    the text's XXH64 (as Spark's ``xxhash64``), ``group`` the least node that a text reaches, and ``component_id`` the smallest
    id of the group, which several groups may have if several texts have that id.

    In the ``first`` tables, neighbours within a value are proposed: a number linear in its rows, that
    joins most of a group of very many near copies. Then all tables, ``batch`` of them at a time,
    propose every two texts within a value that are in different groups so far; what meets a large
    group is compared with all of its members. Proposals are verified by whole shingle sets. The
    variants of a batch are exchanged in buckets of about ``bucket_entries``, of which a task holds one.

    ``id_col`` is an integer; rows with a null id are left out. Equal texts always share a group.
    Texts without words are equal to each other. There is one row for each id and text that differ:
    repeated rows are one, and an id that has several texts has a row for each.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: both sides emit half of it")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("doc_id"), text.alias("text"))
    keyed = stored(rows.groupBy("id", "doc_id").agg(F.lit(1)).select("id", F.col("doc_id").alias("node")))
    prints = stored(fingerprints(rows, shingle=shingle, words64=(tables + 1) // 2, repeats=False).dropDuplicates(["i"]))
    if first:
        tagged = _tagged(prints, None)
        near = _near(tagged, range(min(first, tables)), radius, min_similarity, bucket_entries)
        links = _verified(near, None, None, rows, shingle, min_similarity)
        for table in (tagged, near):
            drop_stored(table)
    else:
        links = prints.select(F.col("i").alias("a"), F.col("i").alias("b")).limit(0)
    roots = connected_components(links)
    large = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= _LARGE)
    groups = stored(roots.join(large, "root", "left").select("node", "root", F.col("members").isNotNull().alias("large")))
    tagged = _tagged(prints, groups)
    met = [_met(tagged, range(k, min(k + batch, tables)), radius, bucket_entries) for k in range(0, tables, batch)]
    pairs, meets = _proposed(met, tagged, min_similarity)
    whole = _verified(pairs, meets, groups, rows, shingle, min_similarity)
    for table in (prints, tagged, pairs, meets, *met):
        drop_stored(table)
    roots = connected_components(links.unionByName(whole))
    for table in (groups, links, whole):
        drop_stored(table)
    rooted = keyed.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select(F.col("id").alias("doc_id"), "node", F.col("root").alias("group"), "component_id")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: Of the byte beside a key: the number of the mask that made it, and whether the node's group is large.
_MASK, _IN_LARGE = 63, 64


def _tagged(prints: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``prints`` with tag and large: 32 bits of the group that the node is in so far, 32 bits of the node itself,
    and whether the group is large. Nodes that share a tag by chance are proposed together, and verified apart."""
    wide = prints.select("*", F.col("i").alias("c"), F.lit(False).alias("large"))
    if groups is not None:
        wide = prints.join(groups.withColumnRenamed("node", "i"), "i", "left").select(*prints.columns, F.coalesce("root", "i").alias("c"), F.coalesce("large", F.lit(False)).alias("large"))
    low = F.lit((1 << 32) - 1)
    return stored(wide.withColumn("tag", F.shiftleft(F.xxhash64("c"), 32).bitwiseOR(F.xxhash64("i").bitwiseAND(low))).drop("c"))


def _batch_variants(tagged: DataFrame, tables: range, radius: int, bucket_entries: int) -> DataFrame:
    """(b int, e binary): the variants of these tables, packed by bucket of their hashes, sorted by bucket in
    each partition. A blob has the byte planes of sorted keys, a byte for each with mask and size of group, and the tags."""
    spark = tagged.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = np.array([m & 0xFFFFFFFF for m in ball(32, radius // 2)], np.uint64)
    if len(masks) > _MASK + 1:
        raise ValueError("a radius of 2 is the most")
    buckets = parts * max(1, -(-tagged.count() * len(masks) * len(tables) // (bucket_entries * parts)))
    each = len(tables) * len(masks)

    def emit(batch: pa.RecordBatch) -> Iterator[dict]:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            keys = []
            for t in tables:
                word = part.column(f"f{t // 2}").to_numpy().view(np.uint64)
                half = (word >> np.uint64(32)) if t % 2 else word & np.uint64(0xFFFFFFFF)
                keys.append(splitmix((half[:, None] ^ masks) | np.uint64(t << 32)))
            key = np.stack(keys, axis=1).reshape(-1)
            mark = np.tile(np.arange(len(masks), dtype=np.uint8), part.num_rows * len(tables))
            mark |= np.repeat(part.column("large").to_numpy(zero_copy_only=False).astype(np.uint8) * np.uint8(_IN_LARGE), each)
            bucket, low = (key >> np.uint64(32)) % np.uint64(buckets), key.astype(np.uint32)
            order = np.argsort((bucket << np.uint64(32)) | low)
            bucket, low, mark, tag = bucket[order].astype(np.int32), low[order], mark[order], part.column("tag").to_numpy()[order // each]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [low[x:y].view(np.uint8).reshape(-1, 4).T.tobytes() + mark[x:y].tobytes() + tag[x:y].tobytes() for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True)]
            yield {"b": bucket[cuts], "e": blobs}

    return arrow_map(tagged, emit, "b int, e binary").repartitionById(parts, F.col("b")).sortWithinPartitions("b")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, keys, masks, tags and largeness of one bucket after the other, ordered by key, then mask and tag."""
    now, held = -1, []

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(e) // 13 for e in held]
        key = np.concatenate([np.ascontiguousarray(np.frombuffer(e, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel() for e, n in zip(held, sizes, strict=True)])
        mark = np.concatenate([np.frombuffer(e, np.uint8, n, 4 * n) for e, n in zip(held, sizes, strict=True)])
        tag = np.concatenate([np.frombuffer(e, "<i8", n, 5 * n) for e, n in zip(held, sizes, strict=True)])
        flip = mark & _MASK
        order = np.lexsort((tag, flip, key))
        return key[order], flip[order], tag[order], (mark & _IN_LARGE)[order] > 0

    for batch in batches:
        for b, e in zip(batch.column("b").to_pylist(), batch.column("e"), strict=True):
            if b != now and held:
                yield now, *whole()
                held = []
            now = b
            held.append(e.as_py())
    if held:
        yield now, *whole()


def _near(tagged: DataFrame, tables: range, radius: int, min_similarity: float, bucket_entries: int) -> DataFrame:
    """(a, b), stored: neighbours within a value whose fingerprints aren't too far apart. Equal
    fingerprints have flipped the same bits and come together."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, _, tag, _ in _buckets(batches):
            k = np.flatnonzero((key[1:] == key[:-1]) & (tag[1:] != tag[:-1]))
            both = _distinct(tag[k], tag[k + 1])
            yield batch_of({"a": both[:, 0], "b": both[:, 1]}, arrow)

    ship(tagged.sparkSession)
    variants = _batch_variants(tagged, tables, radius, bucket_entries)
    return stored(_close(variants.mapInArrow(trimmed(run), "a long, b long").distinct(), tagged, min_similarity))


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)


def _bits(prints: DataFrame) -> list[str]:
    return [c for c in prints.columns if c[0] == "f"]


def _close(pairs: DataFrame, tagged: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b): the nodes of those pairs of tags whose whole fingerprints aren't farther apart than the similarity allows."""
    bits = _bits(tagged)
    side = lambda n: tagged.select(F.col("tag").alias(n), F.col("i").alias(f"{n}_i"), *[F.col(c).alias(f"{n}_{c}") for c in bits])
    apart = [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in bits]
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(sum(apart[1:], apart[0]) <= _farthest(min_similarity, 64 * len(bits)))
    return near.select(F.least("a_i", "b_i").alias("a"), F.greatest("a_i", "b_i").alias("b"))


def _met(tagged: DataFrame, tables: range, radius: int, bucket_entries: int) -> DataFrame:
    """(sort, a, b, flipped), stored: what :func:`_within_values` finds in the values of these tables, by its number; of a crowd the tag, the value and the mask."""
    kind = _parse_datatype_string("sort int, a long, b long, flipped int")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, key, flip, tag, large in _buckets(batches):
            for sort, columns in enumerate(_within_values(key, flip, tag, tag >> 32, large)):
                a, b, f = (columns[0], (np.int64(number) << 32) | columns[2].astype(np.int64), columns[3]) if sort == 2 else (*columns, np.zeros(len(columns[0])))
                yield batch_of({"sort": np.full(len(a), sort, np.int32), "a": a, "b": b, "flipped": f.astype(np.int32)}, arrow)

    ship(tagged.sparkSession)
    return stored(_batch_variants(tagged, tables, radius, bucket_entries).mapInArrow(trimmed(run), kind))


def _proposed(met: list[DataFrame], tagged: DataFrame, min_similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of texts that share a value of some table and are in different groups: pairs (a, b) that are
    close enough, where neither group is large; (a, mark), a node and the mark of a large group that it meets. Both stored."""
    crowds = _union([m.where("sort = 2").select(F.col("a").alias("tag"), F.xxhash64(F.lit(k), "b").alias("variant"), "flipped") for k, m in enumerate(met)])
    both = _union([m.where("sort < 2") for m in met])
    pairs = both.where("sort = 0").select("a", "b").unionByName(_within_crowds(crowds, tagged, _farthest(min_similarity, 64 * len(_bits(tagged))))).distinct()
    pairs = stored(_close(pairs, tagged, min_similarity).where("a <> b"))
    meets = both.where("sort = 1").select(F.col("a").alias("tag"), F.shiftright("b", 32).alias("mark")).distinct().join(tagged.select("tag", "i"), "tag")
    return pairs, stored(meets.select(F.col("i").alias("a"), "mark"))


def _within_values(v: np.ndarray, f: np.ndarray, i: np.ndarray, c: np.ndarray, large: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of rows in runs of a value ``v``, ordered by mask ``f`` within a run:

    - (a, b): each pair of a run that differs in its group ``c``, of groups that aren't large;
    - (node, member): each row, and a member of each large group of its run that it isn't in, once as well;
    - (node, group, value, mask): the rows of longer runs than ``_CROWDED``, without large groups' rows.

    Equal fingerprints share all their variants and are paired in the one that has flipped nothing; others
    meet in two, and are paired in the one where the lesser node has the lesser mask.
    """
    none = np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    mixed = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
    keep = np.repeat(mixed, np.diff(np.append(starts, len(v))))
    v, f, i, c, large = (x[keep] for x in (v, f, i, c, large))
    if not len(v):
        return [(none, none), (none, none), (none, none, none, none)]
    meets = (none, none)
    if large.any():
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        run = np.repeat(np.arange(len(starts)), sizes := np.diff(np.append(starts, len(v))))
        some = np.flatnonzero(large)
        some = some[np.lexsort((f[some], c[some], run[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (run[some][1:] != run[some][:-1]) | (c[some][1:] != c[some][:-1])
        first = np.flatnonzero(new)
        hubs, low, high = some[first], f[some[first]], f[some[np.append(first[1:], len(some)) - 1]]
        each = sizes[run[hubs]]
        at = np.repeat(np.arange(len(hubs)), each)
        hub = hubs[at]
        row = np.arange(len(hub)) - np.repeat(np.cumsum(each) - each, each) + starts[run[hub]]
        # where some member would be paired: as below, but a whole group is lesser or greater
        other = (c[row] < c[hub]) & (f[row] < high[at]) | (c[row] > c[hub]) & (f[row] > low[at]) | (c[row] != c[hub]) & (f[row] == 0) & (low[at] == 0)
        node, member, mark = i[row[other]], i[hub[other]], c[hub[other]]
        _, at = np.unique(np.stack((node, mark.astype(np.int64)), axis=1), axis=0, return_index=True)
        meets = (node[at], member[at])
        v, f, i, c = (x[~large] for x in (v, f, i, c))
    starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else none
    sizes = np.diff(np.append(starts, len(v)))
    crowd = np.repeat(sizes > _CROWDED, sizes)
    crowds = (i[crowd], c[crowd].astype(np.int64), v[crowd], f[crowd])
    v, f, i, c = (x[~crowd] for x in (v, f, i, c))
    a, b = [none], [none]
    for d in range(1, _CROWDED):
        same = v[d:] == v[:-d]
        if not same.any():
            break
        # a run is ordered by mask, so the first of two has the lesser one
        k = np.flatnonzero(same & (c[d:] != c[:-d]) & ((f[d:] != f[:-d]) & (i[:-d] < i[d:]) | (f[d:] == 0)))
        a.append(i[k])
        b.append(i[k + d])
    both = _distinct(np.concatenate(a), np.concatenate(b))
    return [(both[:, 0], both[:, 1]), meets, crowds]


def _within_crowds(rows: DataFrame, tagged: DataFrame, farthest: int) -> DataFrame:
    """(a, b), tags: all pairs of crowded values (``rows``: tag, variant, flipped) that differ in group and by at
    most ``farthest`` bits. Each value is dealt into blocks, and every two blocks are compared on their own."""
    bits = _bits(tagged)
    blocks = rows.groupBy("variant").agg(F.ceil(F.count(F.lit(1)) / _ROWS).cast("int").alias("n"))
    dealt = rows.join(blocks, "variant").withColumn("own", F.pmod(F.xxhash64("tag"), "n").cast("int"))
    both = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).join(tagged.select("tag", *bits), "tag")
    keyed = both.select("variant", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "tag", "flipped", *bits)
    ship(rows.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string("a long, b long"))

    def compare(table: pa.Table) -> pa.Table:
        own, low, high, i, f = (table.column(n).to_numpy() for n in ("own", "low", "high", "tag", "flipped"))
        prints, c = np.column_stack([table.column(n).to_numpy() for n in bits]).view(np.uint64), i >> 32
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        out: list[np.ndarray] = []
        for k in range(0, len(left), 32):
            x = left[k : k + 32, None]
            apart = sum(np.bitwise_count(prints[x, w] ^ prints[right, w]).astype(np.int32) for w in range(len(bits)))
            yes = (apart <= farthest) & (c[x] != c[right]) & ((f[x] != f[right]) | (f[x] == 0))
            if low[0] == high[0]:
                yes &= i[x] < i[right]
            p, q = np.nonzero(yes)
            out.append(np.column_stack((i[left[k + p]], i[right[q]])))
        found = np.sort(np.concatenate(out), axis=1) if out else np.empty((0, 2), np.int64)
        return pa.Table.from_batches([batch_of({"a": found[:, 0], "b": found[:, 1]}, arrow)])

    return keyed.groupBy("variant", "low", "high").applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, meets: DataFrame | None, groups: DataFrame | None, rows: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """(a, b), stored: the pairs whose shingle sets are similar enough, and for each node of ``meets`` and
    large group a member that is similar to it. Each text that is involved is exchanged once, its set once for each pair."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    if meets is not None:
        large = groups.where("large")
        marks = large.select("root", F.shiftright(F.shiftleft(F.xxhash64("root"), 32), 32).alias("mark")).distinct()
        against = stored(meets.join(marks, "mark").select(F.col("a").alias("node"), "root").distinct())
        members = large.join(against.select("root").distinct(), "root", "left_semi").select("node", "root")
        involved = involved.unionByName(against.select(F.col("node").alias("doc_id"))).unionByName(members.select(F.col("node").alias("doc_id")))
    involved = stored(involved.distinct())
    chosen = _perhaps(rows, involved, "doc_id").join(involved, "doc_id", "left_semi")
    sets = stored(_shingle_sets(chosen.select(F.col("doc_id").alias("i"), as_bytes("text").alias("t")), shingle).dropDuplicates(["i"]))
    withs = pairs.join(sets.select(F.col("i").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("i").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "sa"):
            yes = [jaccard(x, y) >= min_similarity for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist(), strict=True)]
            kept = part.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    found = arrow_map(withs, verify, "a long, b long")
    if meets is not None:
        found = found.unionByName(_within_groups(against, members, sets, min_similarity))
    found = stored(found)
    drop_stored(sets)
    drop_stored(involved)
    if meets is not None:
        drop_stored(against)
    return found


def _perhaps(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """Rows whose key (long) may be in ``wanted``: all that are, and few others while there are fewer than ``2 ** bits`` keys.
    A bitmap of that many bits (4 MB, whatever the input) is broadcast, so that rows are dropped before they are exchanged."""
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    maps = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    wide = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "bucket")
    return wide.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0).select(rows.columns)


def _within_groups(against: DataFrame, members: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b): for nodes (``against``: node, root) and the members of a group (``members``: node, root), a
    similar member for each node that has one. Both sides are dealt into blocks, and every two are compared on their own."""
    blocks = lambda df, n: df.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / _ROWS).cast("int").alias(n))
    sizes = blocks(against, "left").join(blocks(members, "right"), "root")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = against.join(sizes, "root").select("root", own("left").alias("x"), every("right").alias("y"), F.lit(True).alias("asks"), "node")
    held = members.join(sizes, "root").select("root", every("left").alias("x"), own("right").alias("y"), F.lit(False).alias("asks"), "node")
    dealt = asked.unionByName(held).join(sets.withColumnRenamed("i", "node"), "node")
    ship(against.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string("a long, b long"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        nodes, held = table.column("node").to_numpy(), [np.frombuffer(s, np.uint32) for s in table.column("s").to_pylist()]
        own, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = [], []
        if len(own) and len(other):
            sizes = np.array([len(held[k]) for k in other])
            ends = np.cumsum(sizes)
            known, flat = np.unique(np.concatenate([held[k] for k in other]), return_inverse=True)
            mark = np.zeros(len(known) + 1, np.int64)
            for k in own.tolist():
                at = np.searchsorted(known, held[k])
                at = at[known[np.minimum(at, len(known) - 1)] == held[k]] if len(known) else at[:0]
                mark[at] = 1
                total = np.concatenate(([0], np.cumsum(mark[flat])))
                mark[at] = 0
                same = total[ends] - total[ends - sizes]
                union = len(held[k]) + sizes - same
                share = np.divide(same, union, out=np.ones(len(union)), where=union > 0)
                yes = np.flatnonzero((share >= min_similarity) & (nodes[other] != nodes[k]))
                if len(yes):
                    a.append(nodes[k])
                    b.append(nodes[other[yes[0]]])
        return pa.Table.from_batches([batch_of({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}, arrow)])

    return dealt.groupBy("root", "x", "y").applyInArrow(compare, "a long, b long")
