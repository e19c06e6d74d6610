"""Byte-level BPE by longest matches and backtracking.

An automaton over the vocabulary (bytes as Latin-1 characters) finds every token that starts at
each place. Encoding goes from left to right with the longest token, goes back to a shorter one
where the rest can't be encoded, and accepts a token only next to one it is compatible with: that
is, if merging the two tokens' bytes by rank gives just these two. A sequence whose neighbours are
all compatible is the one that the merges give, so the result is exact. Compatibility is memoised,
and a place from which encoding failed is not tried again: the time is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, as_bytes, slices

#: Memos are emptied at these sizes.
PAIRS_KEPT, PIECES_KEPT, PIECE_BYTES = 1_000_000, 500_000, 64


class _Pieces(dict):
    """Ids of pieces met so far, worked out when they are first asked for."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.bpe.piece(data), "<u4").tobytes()
        if len(data) <= PIECE_BYTES:
            self[piece] = ids
        return ids


class ByteBpe:
    """A vocabulary: ``ranks`` gives each token's id by its bytes. Every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._pieces = _Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """Ids by the merges themselves, lowest rank first, leftmost of equals. For short data."""
        get, none = self.ranks.get, 1 << 62
        cuts = list(range(len(data) + 1))
        ranks = [get(data[i : i + 2], none) for i in range(len(data) - 1)]  # of a part with the next one
        while ranks:
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            del cuts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(data[cuts[at] : cuts[at + 2]], none)
            if at:
                ranks[at - 1] = get(data[cuts[at - 1] : cuts[at + 1]], none)
        return [self.ranks[data[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]

    def reachable(self, token: int) -> bool:
        """Whether merges make this token from its bytes."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand next to each other."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > PAIRS_KEPT:
                self._fits.clear()
            known = self._fits[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of text; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        starts: list[list[int]] = [[] for _ in data]
        size = self.sizes
        for end, token in self.automaton.iter(data.decode("latin-1")):
            starts[end + 1 - size[token]].append(token)
        n, at, dead = len(data), 0, bytearray(len(data) + 1)
        out: list[int] = []
        tries = [len(starts[0])]  # of the place that is open now and of those before: how many candidates are left
        while at < n:
            left = tries[-1]
            while left:
                left -= 1
                token = starts[at][left]
                stop = at + size[token]
                if not dead[stop] and self.reachable(token) and (not out or self.compatible(out[-1], token)):
                    tries[-1] = left
                    out.append(token)
                    at = stop
                    tries.append(len(starts[at]) if at < n else 0)
                    break
            else:
                dead[at] = 1
                tries.pop()
                at -= size[out.pop()]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, each match of the pattern by itself."""
        if len(self._pieces) > PIECES_KEPT:
            self._pieces.clear()
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids in the form that encode() gives."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a token (base 64) and a rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


_LOADED: dict[str, ByteBpe] = {}


def _loaded(data: bytes, pattern: str) -> ByteBpe:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(read_ranks(data), pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens long, ids_sha256 string, decoded binary) of each whole text.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers; ``decoded`` is made from the
    ids. ``with_ids=False`` leaves the ids out. Null text is empty and has no ids. Ids of any type
    and null pass through; repeated rows repeat; other columns are ignored. The vocabulary, whose
    size doesn't depend on the input, is broadcast.
    """
    with open(ranks_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = _loaded(vocabulary.value, pattern)
        for part in slices(batch, "t"):
            ids = [bpe.encode(t.as_py().decode("utf-8", "replace")) for t in part.column("t")]
            out = {"doc_id": part.column("i"), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded": [bpe.decode(x) for x in ids]}
            yield out | ({"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]} if with_ids else {})

    source = docs.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t"))
    return arrow_map(source, work, f"doc_id {kind}, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded binary")
