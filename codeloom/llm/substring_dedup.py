"""Removal of repeated word sequences by difference-cover anchors.

A window is ``window`` consecutive words. With a difference cover D modulo v, any two positions
share a shift below v that takes both into D. So of two equal windows, both hold equal *anchors*
(runs of ``window - v + 1`` words) that start at cover positions. Only anchors are hashed and
exchanged at first (4 of 13 positions); an anchor that occurs once rules out the windows around it.
The others are extended to whole windows, whose hashes are exchanged with their positions; all but
the first place of each are removed.

Exchanges carry packed arrays, one row for each slice of the input and bucket of hashes; what was
found goes back in the same way and becomes one row of ranges for each document. The number of
buckets follows the measured bytes of text; rows are sorted by bucket within a partition, and a task
holds one bucket at a time, however much its partition has. Each slice first
settles what it can by itself and sends one entry for each hash, so a passage that very many
documents share costs one entry a slice, not one for each document. Texts are exchanged once,
by document, and read twice. Documents, hashes and positions never reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import MIX, arrow_map, as_bytes, batch_of, cached_hashes, slices, splitmix, trimmed

# Perfect difference sets, by modulus.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Where rows with a null id are: at the least id, with a negative hash of their text, so before all others.
NULL_ID = -(1 << 63)
#: Bytes of text for each slice of the input.
_SLICE = 12 << 20
#: The most entries of a document in a row, as their number is in 16 bits.
_RUN = 1 << 15
_BASES = (MIX, np.uint64(0xD6E8FEB86659FD93))
_SPACED = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")
_KEY = np.dtype([("k", "<i8"), ("c", "<i8")])


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.back = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", self.base), ("down", self.back)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


def window_hashes(words: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    powers = _POWERS.setdefault(kind, _Powers(_BASES[kind]))
    up, down = powers.upto(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)))
    return splitmix((total[width:] - total[: n - width + 1]) * down[: n - width + 1])


def _pack(bucket: np.ndarray, doc: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Entries, ordered by document, as a blob for each bucket: counts, keys, runs, columns."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, doc, columns = bucket[order], doc[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        new = np.diff(doc[a:b], prepend=-1) != 0
        within = np.arange(b - a) - np.maximum.accumulate(np.where(new, np.arange(b - a), 0))
        runs = np.flatnonzero(within % _RUN == 0)  # a run of more entries is several
        sizes = np.diff(np.append(runs, b - a)).astype(np.uint16)
        yield int(bucket[a]), b"".join((np.array([len(runs), b - a], np.uint32).tobytes(), keys[doc[a:b][runs]].tobytes(), sizes.tobytes(), *(c[a:b].tobytes() for c in columns)))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The keys, one for each entry, and the columns of a blob."""
    docs, entries = np.frombuffer(blob, np.uint32, 2).tolist()
    keys = np.frombuffer(blob, _KEY, docs, 8)
    sizes = np.frombuffer(blob, np.uint16, docs, 8 + _KEY.itemsize * docs)
    out, at = [np.repeat(keys, sizes)], 8 + (_KEY.itemsize + 2) * docs
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, entries, at))
        at += out[-1].nbytes
    return out


def _flags(keys: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Flagged positions as a blob for each bucket of documents."""
    order = np.lexsort((keys["c"], keys["k"]))
    keys, pos = keys[order], pos[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    own = keys[new]
    home = (splitmix(own["k"].astype(np.uint64) * MIX + own["c"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    doc = np.cumsum(new) - 1
    return list(_pack(home[doc], doc, own, pos))


def _rows(packed: list[tuple[int, bytes]], flagged: list[tuple[int, bytes]]) -> dict:
    """Rows of an exchange: entries for the bucket of their hash; settled flags for their documents'."""
    return {"b": [b for b, _ in (*packed, *flagged)], "f": [None] * len(packed) + [f for _, f in flagged], "e": [e for _, e in packed] + [None] * len(flagged)}


_SENT = "b int, f binary, e binary"


def _by_bucket(batches: Iterator[pa.RecordBatch], column: str, *kinds: str) -> Iterator[list[np.ndarray]]:
    """Of rows sorted by bucket, the unpacked entries of one bucket after the other."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column("b").to_pylist(), batch.column(column), strict=True):
            if b != now and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = b
            if blob.is_valid:
                held.append(_unpack(blob.as_py(), *kinds))
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _settle(df: DataFrame, parts: int, buckets: int, settle, before: int, after: int, *kinds: str) -> DataFrame:
    """(k, c, runs): ``settle`` flags some of all the entries that met in a bucket. Flags go to
    their documents' bucket and become one row for each document: merged ranges of the positions
    from ``before`` below a flag to ``after`` above it."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("b", pa.int32()), ("f", pa.binary())])

        def entries() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                passed.append(batch.filter(batch.column("f").is_valid()).select(["b", "f"]))
                yield batch.filter(batch.column("e").is_valid())

        passed: list[pa.RecordBatch] = []
        for columns in _by_bucket(entries(), "e", *kinds):
            while passed:
                yield passed.pop()
            found = _flags(*settle(*columns), buckets)
            yield batch_of({"b": [x for x, _ in found], "f": [y for _, y in found]}, arrow)
        while passed:
            yield passed.pop()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("runs", pa.binary())])
        for keys, pos in _by_bucket(batches, "f", "<u4"):
            order = np.lexsort((pos, keys["c"], keys["k"]))
            keys, pos = keys[order], pos[order].astype(np.int64)
            other = np.ones(len(keys), bool)
            other[1:] = keys[1:] != keys[:-1]
            new = other.copy()
            new[1:] |= pos[1:] - before > pos[:-1] + after
            first = np.flatnonzero(new)
            runs = np.stack((np.maximum(pos[first] - before, 0), pos[np.append(first[1:], len(pos)) - 1] + after), axis=1).astype("<u4")
            docs = np.flatnonzero(other[first])
            ends = np.append(docs[1:], len(first))
            own = keys[first[docs]]
            for a in range(0, len(docs), 4096):
                some = [runs[x:y].tobytes() for x, y in zip(docs[a : a + 4096].tolist(), ends[a : a + 4096].tolist(), strict=True)]
                yield batch_of({"k": own["k"][a : a + 4096], "c": own["c"][a : a + 4096], "runs": some}, arrow)

    flags = df.repartitionById(parts, F.col("b")).sortWithinPartitions("b").mapInArrow(trimmed(met), "b int, f binary")
    return flags.repartitionById(parts, F.col("b")).sortWithinPartitions("b").mapInArrow(trimmed(merged), "k long, c long, runs binary")


def _shared_anchors(keys: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors, those that came from more than one place."""
    order = np.argsort(tags, kind="stable")
    same = np.diff(tags[order].astype(np.int64)) == 0
    some = order[np.append(same, False) | np.insert(same, 0, False)]
    return keys[some], pos[some]


def _later(keys: np.ndarray, high: np.ndarray, low: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal windows, those that start after the first."""
    some = _not_first(keys, high, low, pos)
    return keys[some], pos[some]


def _not_first(keys: np.ndarray, high: np.ndarray, low: np.ndarray, pos: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys["c"], pos, keys["c"] >= 0, keys["k"], low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    later[order] = (keys[order] != keys[first]) | (pos[order] != pos[first])
    return later


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _covered(runs: bytes, n: int) -> np.ndarray:
    """Which of the first ``n`` positions some range covers."""
    edge = np.zeros(n + 1, np.int32)
    bounds = np.minimum(np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64), n)
    np.add.at(edge, bounds[:, 0], 1)
    np.add.at(edge, bounds[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, *, window: int = 20, modulus: int = 13, partitions: int | None = None, spacing: bool = False, carry: tuple[str, ...] = (), bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary, runs array<struct<start,stop>>): each document without the
    words covered by a window whose word sequence starts earlier (smaller id, or the same id and an
    earlier start). Words are split at ASCII white space and compared as they are; ``kept`` has one
    space between words; ``runs`` are the removed ranges of word positions.

    ``id_col`` is an integer. Null text has no words. Null ids come before all others. Of different texts
    of one id (or of none) the earlier start comes first, then the smaller hash of the text. Rows that repeat an id and a text are the
    same place and keep what one of them keeps. Texts under
    ``window`` words stay whole; a document all of whose words repeat keeps its row with an empty text. Other columns are ignored but for those in ``carry``, which come back
    in a struct ``row``. With ``spacing``, ``kept`` keeps the white space before each word that stays,
    and a text that loses nothing comes back as it is. Exchanges have ``partitions`` (default: the session's
    shuffle partitions); a task holds the entries of one bucket, about ``bucket_bytes`` of text.
    """
    if modulus not in COVERS or window <= modulus:
        raise ValueError(f"modulus must be one of {sorted(COVERS)} and below the window")
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = window - modulus + 1
    cover = np.isin(np.arange(modulus), COVERS[modulus])
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = parts * max(1, -(-total // (bucket_bytes * parts)))
    # c tells texts of one id apart, and null ids from the least id
    whole = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.shiftleft(F.hash(whole).cast("long") + F.lit(1 << 31), 31).bitwiseOR(F.xxhash64(whole).bitwiseAND(F.lit((1 << 31) - 1)))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.when(F.col(id_col).isNull(), F.bitwise_not(digest)).otherwise(digest).alias("c"), as_bytes(text_col).alias("t"), *([F.struct(*carry).alias("row")] if carry else []))
    carried = f", row {texts.schema['row'].dataType.simpleString()}" if carry else ""

    def keys_of(part: pa.RecordBatch) -> np.ndarray:
        keys = np.empty(part.num_rows, _KEY)
        keys["k"], keys["c"] = part.column("k").to_numpy(), part.column("c").to_numpy()
        return keys

    def anchors(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "t", _SLICE):
            keys = keys_of(part)
            tags, docs_, pos = [], [], []
            for i, text in enumerate(part.column("t")):
                words = text.as_py().split()
                if len(words) >= window:
                    at = np.flatnonzero(np.resize(cover, len(words) - span + 1))
                    tags.append(window_hashes(cached_hashes(words), span)[at])
                    docs_.append(np.full(len(at), i, np.int64))
                    pos.append(at.astype(np.uint32))
            tag, doc, at = _joined(tags, np.uint64), _joined(docs_, np.int64), _joined(pos, np.uint32)
            _, first, back, count = np.unique(tag, return_index=True, return_inverse=True, return_counts=True)
            here = count[back] > 1
            flagged = _flags(keys[doc[here]], at[here], buckets)
            first.sort()
            tag, doc, at = tag[first], doc[first], at[first]
            bucket = (splitmix(tag >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            yield _rows(list(_pack(bucket, doc, keys, tag.astype(np.uint32), at)), flagged)

    def windows(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "t", _SLICE):
            keys, runs = keys_of(part), part.column("runs").to_pylist()
            high, low, docs_, pos = [], [], [], []
            for i, text in enumerate(part.column("t")):
                if not runs[i] or len(words := text.as_py().split()) < window:
                    continue
                hashes = cached_hashes(words)
                some = np.flatnonzero(_covered(runs[i], len(words) - window + 1))
                if len(some):
                    high.append(window_hashes(hashes, window)[some])
                    low.append(window_hashes(hashes, window, 1)[some].astype(np.uint32))
                    docs_.append(np.full(len(some), i, np.int64))
                    pos.append(some.astype(np.uint32))
            if not high:
                continue
            h, l, doc, at = np.concatenate(high), np.concatenate(low), np.concatenate(docs_), np.concatenate(pos)
            later = _not_first(keys[doc], h, l, at)
            flagged = _flags(keys[doc[later]], at[later], buckets)
            keep = ~later
            h, l, doc, at = h[keep], l[keep], doc[keep], at[keep]
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            yield _rows(list(_pack(bucket, doc, keys, h, l, at)), flagged)

    def kept(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "t"):
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept", "runs")}
            for key, c, text, found in zip(part.column("k").to_pylist(), part.column("c").to_pylist(), part.column("t"), part.column("runs").to_pylist(), strict=True):
                words, runs = text.as_py().split(), []
                n, gone = len(words), 0
                if found:
                    cut = _covered(found, n)
                    turns = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0)).tolist()
                    runs = [{"start": a, "stop": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                    gone = int(cut.sum())
                    if spacing and gone:
                        words = _SPACED.findall(text.as_py())
                    words = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
                whole = b" ".join(words) if not spacing else b"".join(words).lstrip() if gone else text.as_py()
                for name, v in zip(out, (None if c < 0 else key, n, gone, whole, runs), strict=True):
                    out[name].append(v)
            yield out | ({"row": part.column("row")} if carry else {})

    def with_runs(runs: DataFrame) -> DataFrame:
        return texts.join(runs, ["k", "c"], "left").select("k", "c", "t", *(["row"] if carry else []), "runs")

    # an anchor at q is in the windows that start from q - modulus + 1 to q; a window covers its words
    first = _settle(arrow_map(texts, anchors, _SENT), parts, buckets, _shared_anchors, modulus - 1, 1, "<u4", "<u4")
    second = _settle(arrow_map(with_runs(first), windows, _SENT), parts, buckets, _later, 0, window, "<u8", "<u4", "<u4")
    return arrow_map(with_runs(second), kept, "doc_id long, n_words long, n_removed long, kept binary, runs array<struct<start:long,stop:long>>" + carried)
