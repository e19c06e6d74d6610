"""Packing of documents into sequences: bounded-space online best fit.

Documents become token ids and an end mark; longer ones than a sequence are cut. Each piece is placed when it arrives, and its place is known then:
nothing is held back but the free spaces of a fixed number of open bins, in a bitset keyed by free space that
gives the bin with the least space that is enough. If a bin more is needed than may be open, the fullest closes. The order in which pieces arrive is
chosen: Spark sorts them in runs, the longest of a run first, before they are packed. The packing stays online and in bounded
space in that order, but it is not the order of the input; ``run_rows=1`` packs in the order of a hash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, as_bytes, slices
from codeloom.runtime import ship


class BestFit:
    """Bins of one size; ``open_bins`` may be open."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.most = size, open_bins
        self.free = 0  # bit f: some bin has f free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most and length < self.size:
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self.made, self.size
            self.made += 1
        if space > length:
            self.bins[space - length].append(number)
            self.free |= 1 << (space - length)
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte tokens with their ids, and the special tokens with theirs, of a byte-level BPE file in JSON."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    before, merges = whole.get("pre_tokenizer") or {}, whole["model"]["merges"]
    if whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the file has to cut texts by its byte-level pattern, without a normaliser")
    made = [whole["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(made):
        raise ValueError("the file's merges aren't in the order of their ids, so ids can't serve as ranks")
    # the file shows each byte as a character: printable ones as themselves, others from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = whole.get("added_tokens", [])
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special tokens that strip or look around them aren't supported")
    special = {t["content"]: t["id"] for t in added}
    return {bytes(back[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}, special


_ENCODERS: dict[int, object] = {}


def _encoder(pattern: str, ranks: dict[bytes, int], special: dict[str, int]):
    import tiktoken

    key = hash((pattern, len(ranks), zlib.crc32(b"\0".join(sorted(ranks, key=ranks.get))), tuple(special.items())))
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding(f"codeloom-{key}", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[key]


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of pieces of ``size``; the first may be shorter."""
    first = length % size or size
    return [(0, min(first, length)), *((a, size) for a in range(first, length, size))]


def tokenized_pieces(docs: DataFrame, vocabulary_path: str, pattern: str, *, size: int = 2048, end: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as ids, ended by ``end``, in pieces of at most
    ``size``. A special token's string in a text gives that token's id, as the file's own library does by default."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = _encoder(pattern, *known.value)
        for part in slices(batch, "t", 8 << 20):
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(part.column("i").to_pylist(), part.column("t"), strict=True):
                ids = np.array([*encoder.encode(text.as_py().decode("utf-8", "replace"), allowed_special="all"), end], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    own = ids[start : start + length]
                    for c, v in zip(out, (doc, piece, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None), strict=True):
                        out[c].append(v)
            yield out

    source = docs.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t"))
    return arrow_map(source, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, vocabulary_path: str, pattern: str, *, size: int = 2048, end: int = 0, open_bins: int = 4096, run_rows: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, piece int, start, length, ids_crc32, sequence_id, offset long[, ids array<int>]).

    Pieces are dealt by their number in the partition that made them, so no id or text is dealt to one task,
    and packed in each partition by itself, one after the other as they arrive. They arrive in runs, of ``run_rows`` from
    each partition that made them, the longest of a run first; nothing is held back. Null text
    is empty: a piece of the end mark alone. Null ids and repeated rows are packed like others; of pieces as
    long as each other the one that arrives first is placed first; no rows give no rows. Other columns are ignored. Sequence numbers are distinct, not dense. The vocabulary,
    whose size doesn't depend on the input, is broadcast.
    """
    ship(docs.sparkSession)
    pieces = tokenized_pieces(docs, vocabulary_path, pattern, size=size, end=end, with_ids=with_ids, id_col=id_col, text_col=text_col)
    # without a number of partitions, small ones are merged, which packs better
    place = F.monotonically_increasing_id()
    salted = pieces.withColumn("deal", F.xxhash64(place)).withColumn("run", F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / run_rows))
    dealt = salted.repartition("deal").sortWithinPartitions("run", F.desc("length"), "deal").drop("deal", "run")
    kind = dealt.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, home = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = np.array([fit.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            columns = [batch.column(n) for n in names] + [pa.array(places[:, 0] + home), pa.array(places[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids array): whole sequences of packed pieces with ids; a group is one sequence at most."""
    by = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return by.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
