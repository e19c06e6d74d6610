"""Helpers of the corpus operators: Arrow maps, word hashes, bit arithmetic."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from codeloom.runtime import drop_stored, ship, stored

__all__ = ["CACHE_WORDS", "MIX", "arrow_extend", "arrow_map", "as_bytes", "batch_of", "cached_hashes", "drop_stored", "held_out", "salt", "slices", "splitmix", "stored", "trim", "trimmed", "utf8"]

#: A worker's memo of word hashes is emptied at this size, so its memory is bounded.
CACHE_WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)

_HASHES: dict[bytes, int] = {}


def as_bytes(column: str) -> Column:
    """A text column as UTF-8 bytes, null as empty: Python gets bytes as they are, valid or not."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``; at its end the worker, which lives on, gives freed memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``function`` to slices of each partition. It yields dicts of equally long columns."""
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield batch_of(columns, arrow)

    return df.mapInArrow(trimmed(run), kind)


def arrow_extend(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, most: int = 16 << 20, by: str | None = None) -> DataFrame:
    """``df`` with the columns that ``function`` gives for slices of it: new ones after its own, others replaced.
    ``by`` names a text column whose bytes bound a slice."""
    ship(df.sparkSession)
    new = _parse_datatype_string(schema)
    assert isinstance(new, StructType)
    given = {f.name: f for f in to_arrow_schema(new)}
    names = [*df.columns, *(n for n in given if n not in df.columns)]
    whole = StructType([new[n] if n in given else df.schema[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most) if by else (batch,):
                found = function(part)
                columns = [pa.array(found[n], type=given[n].type) if n in given else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(trimmed(run), whole)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of a string column, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the schema's columns."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``most`` bytes in each part; a single row stays whole."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def cached_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word, seed 0."""
    known = _HASHES
    if len(known) > CACHE_WORDS:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        digest = xxhash.xxh64_intdigest
        for word in words:
            if word not in known:
                known[word] = digest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def salt(k: int) -> np.uint64:
    """The k-th of a row of 64-bit numbers, to be added before a mix."""
    return np.uint64(int(MIX) * k & (1 << 64) - 1)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids: false."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))
