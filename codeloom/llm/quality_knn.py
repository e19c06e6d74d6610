"""Quality of texts by votes of labelled neighbours in a latent-semantic space.

Terms are words, the shapes of words (runs of letters, capitals, digits and signs, each run as
one), and marks for a word that repeats one shortly before it. Every term counts, by a hash to a
column of its family, so there is no vocabulary to cut. Weighted by frequency and idf, they are
reduced to a few latent dimensions by the singular vectors of the labelled texts. The labelled vectors, a bounded sample with as many of each
label, are broadcast; each document's cosines with all of them are exact, computed in blocks, and
the nearest vote with their similarity.

What is multiplied is rounded to fixed grids first, so that all sums are exact in double precision: a text's score depends neither on the
block that it is in nor on the order of sums. Neighbours as near as each other count in the order of the labelled vectors.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_extend, arrow_map, as_bytes, cached_hashes, slices, trim, utf8

_SHAPE = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else 0x20 if b == 0x20 or 9 <= b <= 13 else b for b in range(256)
)
#: A word counts as repeated if one of this many words before it is the same.
LAGS = 3
#: Columns of words, of shapes, and of the marks of repetition.
WORDS, SHAPES = 4096, 1024
COLUMNS = WORDS + SHAPES + LAGS
FAMILIES = ("words", "shapes")
_BLOCK = 512


def terms(text: bytes, families: tuple[str, ...] = FAMILIES) -> np.ndarray:
    """Frequencies of the terms among the words of a text, by column; zeros for a text without words."""
    out = np.zeros(COLUMNS, np.float32)
    words = text.split()
    if not words:
        return out
    n = len(words)
    if "words" in families:
        h = cached_hashes(text.lower().split())
        out[:WORDS] = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    if "shapes" in families:
        shape = np.frombuffer(text.translate(_SHAPE), np.uint8)
        first = np.ones(len(shape), bool)
        np.not_equal(shape[1:], shape[:-1], out=first[1:])
        h = cached_hashes(shape[first].tobytes().split())
        out[WORDS : WORDS + SHAPES] = np.bincount((h % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES)
        h = cached_hashes(words)
        out[WORDS + SHAPES :] = [int((h[lag:] == h[:-lag]).sum()) for lag in range(1, LAGS + 1)]
    return out / np.float32(n)


@dataclass
class QualityModel:
    """The latent projection of columns, labelled unit vectors and their labels."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float
    families: tuple[str, ...]

    def __post_init__(self) -> None:
        # frequencies have 20 bits, the projection 19, a sum of COLUMNS products 13 more: 52
        scale = np.abs(self.project).max(initial=0.0) or 1.0
        self.grid = np.round(self.project.astype(np.float64) / scale * 2.0**19)
        self.points = _on_grid(self.vectors.astype(np.float64))

    def embed(self, found: np.ndarray) -> np.ndarray:
        """Unit vectors on a grid."""
        return _on_grid(np.round(np.sqrt(found.astype(np.float64)) * 2.0**20) @ self.grid)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1, higher for label 1; 0.5 without a neighbour (no known term, or no label learnt)."""
        out = np.full(len(texts), 0.5)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        last = len(self.vectors) - np.arange(len(self.vectors), dtype=np.float64)  # the first of equals is the greatest
        for a in range(0, len(texts), _BLOCK):
            near = self.embed(np.stack([terms(t, self.families) for t in texts[a : a + _BLOCK]])) @ self.points.T
            order = np.rint(near * 2.0**20) * (len(self.vectors) + 1) + last  # whole numbers that are all different
            top = np.argpartition(-order, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(order, top, axis=1), axis=1), axis=1)
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0.0) ** self.power
            total = weight.sum(axis=1)
            some = total > 0
            out[a : a + _BLOCK][some] = np.clip((weight * self.labels[top]).sum(axis=1)[some] / total[some], 0.0, 1.0)
        return out


def _on_grid(x: np.ndarray) -> np.ndarray:
    """Unit vectors in multiples of 2 to the power of -22; zeros stay. All sums that are made of them are exact."""
    greatest = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    near = np.round(np.divide(x, greatest, out=np.zeros_like(x), where=greatest > 0) * 2.0**22)
    norms = np.sqrt((near * near).sum(axis=1, keepdims=True))
    return np.round(np.divide(near, norms, out=np.zeros_like(x), where=norms > 0) * 2.0**22) / 2.0**22


def _leading(x: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    wide = min(dimensions + 16, *x.shape)
    basis = np.random.default_rng(7).normal(size=(x.shape[1], wide)).astype(x.dtype)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions]


def _units(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 2000, dimensions: int = 64, neighbours: int = 15, power: float = 4.0, families: tuple[str, ...] = FAMILIES, word_weight: float = 0.25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on about ``sample`` labelled documents of each label (all, where there are fewer), chosen by a
    hash of the id; each is a vector of ``COLUMNS`` numbers at most. So the model's size is bounded.
    ``families`` names the terms; words, whose language and topic say less, weigh ``word_weight``. Null labels and ids teach nothing; of several labels of a document the greatest
    counts. Rows that repeat an id and a text teach once; different texts of an id teach each, up to ``4 * sample``
    rows in all, by a hash. The order of rows makes no difference."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    seen = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    grain = 1 << 30
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(int(grain * min(1.0, sample / n)))) for y, n in seen.items()], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit("quality")), F.lit(grain)) < rate)
    texts = docs.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t")).join(F.broadcast(chosen), "i")

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "t"):
            found = [terms(t, families) for t in part.column("t").to_pylist()]
            at = [np.flatnonzero(f).astype("<u2") for f in found]
            yield {"y": part.column("y"), "i": part.column("i").cast(pa.string()), "at": [k.tobytes() for k in at], "share": [f[k].tobytes() for f, k in zip(found, at, strict=True)]}

    # repeated rows of an id are one, and only rows of many different texts under one id go beyond the sample: those are cut
    rows = arrow_map(texts.select("i", "t", "y"), work, "y int, i string, at binary, share binary").distinct().orderBy(F.xxhash64("i", "at"), "i", "at", "share").limit(4 * sample).collect()
    if not rows:
        return QualityModel(np.zeros((COLUMNS, 1)), np.zeros((0, 1)), np.zeros(0), neighbours, power, families)
    found, y = np.zeros((len(rows), COLUMNS), np.float32), np.array([r.y for r in rows], float)
    for row, r in zip(found, rows, strict=True):
        row[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.share, "<f4")
    df = (found > 0).sum(axis=0)
    idf = np.where(df > 0, 1 + np.log(len(found) / np.maximum(df, 1)), 0).astype(np.float32)
    idf[:WORDS] *= np.float32(word_weight)
    # in place: this is the largest thing that the driver holds, ``4 * sample * COLUMNS`` numbers at most
    np.sqrt(found, out=found)
    found *= idf
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    np.divide(found, norms, out=found, where=norms > 0)
    leading = _leading(found, dimensions)
    # a row's length makes no difference to its unit vector
    model = QualityModel(idf[:, None] * leading, _units(found @ leading), y, neighbours, power, families)
    del found, rows
    trim()
    return model


_MODELS: dict[str, QualityModel] = {}


def with_quality(docs: DataFrame, model: QualityModel, *, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """All rows and columns with the score of each whole text (a column of that name is replaced); null
    and empty texts score 0.5. The model, of bounded size, is broadcast."""
    data = pickle.dumps(model)
    shipped, name = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def work(part: pa.RecordBatch) -> dict:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = pickle.loads(shipped.value)
        return {score_col: _MODELS[name].scores(utf8(part.column(text_col)))}

    return arrow_extend(docs, work, f"{score_col} double", by=text_col)


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double), as :func:`with_quality` says. Null ids and repeated rows pass through; other columns are ignored."""
    scored = with_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", "score")
