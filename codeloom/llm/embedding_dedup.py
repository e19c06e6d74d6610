"""Near-duplicate vectors by lattice hashing in E8, verified by cosine.

Unit vectors are projected at random to pairs of 8-space in several tables, and each projection is
decoded to its nearest E8 lattice points: the cell it is in and the neighbouring cells it is nearest
to. Vectors that share a cell in a table meet there and are compared exactly. A link is counted in
one of the cells where its ends meet (the smallest), and a cell passes on counts and a spanning
forest, not pairs. Cells with very many vectors are cut into blocks, compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from codeloom.llm.common import MIX, arrow_map, batch_of, splitmix, stored
from codeloom.llm.components import connected_components

TABLES, PAIRED, PROBES = 5, 2, 3


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of any sign, or eight halves with an even number of minus signs."""
    out = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    out += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    at = np.abs(off[odd]).argmax(axis=1)
    near[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return near


def nearest_points(x: np.ndarray, probes: int) -> np.ndarray:
    """For each row of 8 numbers, twice its nearest E8 point and that point's neighbours nearest to the row."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    first = np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)
    gain = (x - first) @ ROOTS.T
    some = np.argsort(-gain, axis=1, kind="stable")[:, : probes - 1]
    return np.rint(2 * np.concatenate([first[:, None], first[:, None] + ROOTS[some]], axis=1)).astype(np.int64)


_PROJECTIONS: dict[tuple[int, int], np.ndarray] = {}


def cells(unit: np.ndarray, labels: np.ndarray, threshold: float, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """64-bit cell numbers of unit vectors: a row for each vector, ``tables * probes ** 2`` columns."""
    n, d = unit.shape
    wide = max(d, 8 * PAIRED)
    with np.errstate(over="ignore"):
        out = []
        for t in range(tables):
            if (wide, t) not in _PROJECTIONS:
                q, _ = np.linalg.qr(np.random.default_rng([8, wide, t]).normal(size=(wide, 8 * PAIRED)))
                _PROJECTIONS[wide, t] = q * math.sqrt(wide)
            # the cells are as much larger as the farthest link is longer
            x = unit @ _PROJECTIONS[wide, t][:d] * (0.8 * math.sqrt(0.04 / max(2 * (1 - threshold), 1e-4)))
            mixed = []
            for k in range(PAIRED):
                points = nearest_points(x[:, 8 * k : 8 * k + 8], probes).astype(np.uint64)
                h = np.full(points.shape[:2], k + 1, np.uint64)
                for c in range(8):
                    h = splitmix(h * MIX + points[:, :, c])
                mixed.append(h)
            pair = splitmix(mixed[0][:, :, None] * MIX + mixed[1][:, None, :]).reshape(n, -1)
            out.append(splitmix(pair + splitmix(labels.astype(np.uint64) * MIX + np.uint64(t * 1000 + d))[:, None]))
    return np.concatenate(out, axis=1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows in double precision from binary of doubles of one length."""
    blobs = vectors.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector in a batch."""
    offsets = np.asarray(batch.column("v").offsets)
    sizes = np.diff(offsets)
    values = np.asarray(batch.column("v").values, dtype=np.float64)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, _unit(values[offsets[rows][:, None] + np.arange(d)])


def _links(vectors: np.ndarray, own: np.ndarray, other: np.ndarray, ids: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different ids and equal labels between two sets of rows (or within one) with at least this cosine, each once."""
    found_a, found_b = [], []
    within = own is other
    for a in range(0, len(own), 1024):
        close = vectors[own[a : a + 1024]] @ vectors[other].T >= threshold
        i, j = np.nonzero(close)
        i, j = own[a : a + 1024][i], other[j]
        keep = (ids[i] != ids[j]) & (labels[i] == labels[j]) & ((i < j) if within else True)
        found_a.append(i[keep])
        found_b.append(j[keep])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row number that each row reaches."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        was = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(was, least):
            return least


def _compared(keys: tuple[int, int, int], part: pa.RecordBatch, threshold: float) -> dict:
    bucket, i, j = keys
    ids, copies, labels = (part.column(c).to_numpy() for c in ("cid", "n", "label"))
    vectors = _matrix(part.column("v"))
    block = part.column("block").to_numpy()
    own, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
    # cells tell labels apart by hashes, so the labels themselves are compared
    exact = part.column("exact").dictionary_encode().indices.to_numpy() if "exact" in part.schema.names else labels
    a, b = _links(vectors, own, own if i == j else other, ids, exact, threshold)
    counts = np.zeros(len(ids), np.int64)
    least = np.arange(len(ids))
    if len(a):
        involved = np.unique(np.concatenate((a, b)))
        at = np.searchsorted(involved, np.stack((a, b)))
        found = np.sort(cells(vectors[involved], labels[involved], threshold), axis=1)
        for k in range(0, len(a), 4096):
            x, y = found[at[0][k : k + 4096]], found[at[1][k : k + 4096]]
            shared = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.uint64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
            mine = shared == np.uint64(bucket & (1 << 64) - 1)
            np.add.at(counts, a[k : k + 4096][mine], copies[b[k : k + 4096][mine]])
            np.add.at(counts, b[k : k + 4096][mine], copies[a[k : k + 4096][mine]])
        least = _forest(len(ids), a, b)
    some = np.flatnonzero((counts > 0) | (least != np.arange(len(ids))))
    return {"cid": ids[some], "links": counts[some], "root": ids[least[some]]}


def near_duplicate_vectors(rows: DataFrame, *, threshold: float = 0.98, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean), one row for each input row.

    Rows are linked if their labels are equal and their cosine, in double precision, is at least
    ``threshold``. Null, empty or zero vectors, vectors with null or non-finite numbers, null labels and null
    ids have no links and are their own component; vectors of different lengths aren't linked. Equal
    vectors are one class: copies are counted but never compared. Rows that repeat an id with
    different vectors aren't linked with each other. Other columns are ignored. No rows give no rows.
    """
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = base.where(usable)
    classes = stored(good.groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n")))
    whole_numbers = isinstance(classes.schema["label"].dataType, LongType)
    exact = [] if whole_numbers else [F.col("label").cast("string").alias("exact")]
    numbered = classes.select("cid", "n", "v", (F.col("label").cast("long") if whole_numbers else F.xxhash64("label")).alias("label"), *exact)

    def keyed(batch: pa.RecordBatch) -> Iterator[dict]:
        labels = batch.column("label").to_numpy()
        ids = batch.column("cid").to_numpy()
        for at, unit in _by_width(batch):
            found = cells(unit, labels[at], threshold).astype(np.int64)
            yield {"bucket": found.ravel(), "cid": np.repeat(ids[at], found.shape[1])}

    def united(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, unit in _by_width(batch):
            yield {"cid": batch.column("cid").to_numpy()[at], "n": batch.column("n").to_numpy()[at], "label": batch.column("label").to_numpy()[at], "v": [u.tobytes() for u in unit]} | ({} if whole_numbers else {"exact": batch.column("exact").take(pa.array(at))})

    keys = stored(arrow_map(numbered.select("cid", "v", "label"), keyed, "bucket long, cid long").distinct())
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    shared = keys.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    met = shared.select("bucket", "cid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q")).select("bucket", "cid", "block", F.least("block", "q").alias("i"), F.greatest("block", "q").alias("j"))
    with_vectors = met.join(arrow_map(numbered, united, "cid long, n long, label long, v binary" + ", exact string" * (not whole_numbers)), "cid")
    # the work is in the comparisons, not in the bytes, so the number of tasks is given
    dealt = with_vectors.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        key, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                own = tuple(int(c[a]) for c in columns)
                if key is not None and own != key:
                    out += _finished(key, held, threshold)
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
            if out:
                yield batch_of({c: np.concatenate([o[c] for o in out]) for c in ("cid", "links", "root")}, arrow)
                out = []
        if key is not None and (out := _finished(key, held, threshold)):
            yield batch_of({c: np.concatenate([o[c] for o in out]) for c in ("cid", "links", "root")}, arrow)

    found = stored(dealt.mapInArrow(compare, "cid long, links long, root long").groupBy("cid", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    whole = classes.join(counts, "cid", "left").join(roots, classes.cid == roots.node, "left")
    result = stored(whole.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id")))
    linked = good.join(result, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _finished(key: tuple[int, int, int], held: list[pa.RecordBatch], threshold: float) -> list[dict]:
    """What one cell's block passes on; nothing for a single vector."""
    part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    widths = np.asarray(pc.binary_length(part.column("v")))
    out = []
    for d in np.unique(widths):
        rows = part.filter(pa.array(widths == d)) if len(np.unique(widths)) > 1 else part
        if rows.num_rows > 1:
            out.append(_compared(key, rows, threshold))
    return [o for o in out if len(o["cid"])]
