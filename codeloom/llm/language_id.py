"""Language identification: words first, backing off to shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by its longest known
character n-grams: those of the greatest length that are known for the language model at all, then
one shorter, and so on. Models are fitted on a bounded, hashed sample of each language's documents,
so their size doesn't depend on the corpus; counting is distributed.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import CACHE_WORDS, arrow_map, as_bytes, slices

UNDETERMINED = "und"
LONGEST = 5
_WORD = re.compile(r"[^\W\d_]+")


_COUNTED = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. Numerals that aren't decimal digits (as in Roman or fraction signs) are no letters."""
    found = _WORD.findall(text.lower())
    return found if not found or "".join(found).isalpha() else ["".join(run) for word in found for is_letter, run in groupby(word, str.isalpha) if is_letter]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between two marks."""
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class LanguageModel:
    """Log frequencies by language. ``counts`` has (lang, kind, item, n): kind 0 is a word, others the length of an n-gram.

    All items are rows of one matrix. The scores of words met so far are kept in a second one, up to a bound;
    a text's unseen words are worked out together.
    """

    def __init__(self, counts: list[tuple[str, int, str, int]] | pa.Table, documents: dict[str, int], alpha: float = 0.5) -> None:
        self.languages = sorted(documents)
        table = pa.table({c: [r[k] for r in counts] for k, c in enumerate(("lang", "kind", "item", "n"))}, schema=_COUNTED) if isinstance(counts, list) else counts
        kinds, langs, n = (table.column(c).to_numpy() for c in ("kind", "lang", "n"))
        lang = np.searchsorted(np.array(self.languages, object), langs) if len(langs) else np.empty(0, np.int64)
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        parts, rows = [np.zeros((1, max(len(self.languages), 1)))], 1  # row 0 is for words without a known n-gram
        for kind in range(LONGEST + 1):
            own = np.flatnonzero(kinds == kind)
            if len(own):
                items = table.column("item").take(pa.array(own)).combine_chunks().dictionary_encode()
                names = items.dictionary.to_pylist()
                self.tables[kind] = dict(zip(names, range(rows, rows + len(names)), strict=True))
                part = np.zeros((len(names), len(self.languages)))
                np.add.at(part, (items.indices.to_numpy(), lang[own]), n[own])
                parts.append(np.log(part + alpha) - np.log(part.sum(axis=0) + alpha * len(names)))
                rows += len(names)
        matrix = np.concatenate(parts)
        self.matrix = (matrix - matrix.mean(axis=1, keepdims=True)).astype(np.float32)
        self._index: dict[str, int] = {}
        self._known = np.zeros((0, self.matrix.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Work out and keep the scores of new words."""
        if len(self._index) + len(words) > len(self._known):
            self._index.clear()
            if len(words) > len(self._known):
                self._known = np.zeros((max(CACHE_WORDS, len(words)), self.matrix.shape[1]), np.float32)
        rows, starts, scale = [], [], []
        whole = self.tables[0]
        for word in words:
            starts.append(len(rows))
            row = whole.get(word)
            if row is not None:
                rows.append(row)
                scale.append(1.0)
                continue
            marked, n = f"<{word}>", min(LONGEST, len(word) + 2)
            while n:
                get = self.tables[n].get
                found = [r for k in range(len(marked) - n + 1) if (r := get(marked[k : k + n])) is not None]
                if found:
                    break
                n -= 1
            rows += found if n else [0]
            scale.append(1.0 / max(n, 1))  # neighbouring n-grams share characters
        first = len(self._index)
        self._known[first : first + len(words)] = np.add.reduceat(self.matrix[rows], starts, axis=0) * np.array(scale, np.float32)[:, None]
        self._index.update(zip(words, range(first, first + len(words)), strict=True))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, share of the softmax over the mean evidence); ``und`` with 0 if there is no letter."""
        words = words_of(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        known = self._index
        if new := {w for w in words if w not in known}:
            if len(known) + len(new) > len(self._known):
                new = set(words)  # the memo is emptied first
            self._learn(list(new))
        score = self._known[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        score -= score.max()
        share = np.exp(score / math.sqrt(len(words)))
        best = int(np.argmax(score))
        return self.languages[best], float(share[best] / share.sum())


def fit(train: DataFrame, *, documents: int = 2000, text_bytes: int = 16 << 20, total_bytes: int = 256 << 20, least_words: int = 2, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on about ``documents`` documents of each language (all, where there are fewer), or about ``text_bytes`` of text where that is
    less, and ``total_bytes`` over all languages, chosen by a hash of the id (of the text, without an id): what comes to the driver has a bound
    in bytes, whatever the corpus, its documents and the number of languages. Rows that repeat
    count each; null texts and languages teach nothing. Items seen fewer than ``least_words`` times are left out, as unseen words then are scored by n-grams."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("size")).collect()
    seen = {r.lang: r.n for r in counts}
    if not seen:
        return LanguageModel([], {})
    grain, most = 1 << 30, min(text_bytes, total_bytes / len(seen))
    rate = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(int(grain * min(1.0, documents / r.n, most / max(r["size"], 1)))))])
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit("language"))).otherwise(F.xxhash64(F.col(id_col), F.lit("language")))
    chosen = rows.where(F.pmod(place, F.lit(grain)) < rate[F.col(lang_col)])

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        found: dict[str, Counter] = {}
        for part in slices(batch, "t"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("t").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.decode("utf-8", "replace")))
        out: Counter = Counter()
        for lang, words in found.items():
            for word, n in words.items():
                out[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        out[lang, size, gram] += n
        yield {"lang": [k[0] for k in out], "kind": [k[1] for k in out], "item": [k[2] for k in out], "n": list(out.values())}

    counted = arrow_map(chosen.select(F.col(lang_col).alias("lang"), as_bytes(text_col).alias("t")), count, "lang string, kind int, item string, n long")
    summed = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).where(F.col("n") >= least_words)
    # its order would change sums by rounding
    return LanguageModel(summed.orderBy("kind", "item", "lang").toArrow().cast(_COUNTED), seen)


_MODELS: dict[str, LanguageModel] = {}


def predict_language(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred string, score double) of each whole text. ``und`` with score 0 if the text is null or
    has no letter (or the model has no language). Null ids and repeated rows pass through; other columns are ignored."""
    spark = docs.sparkSession
    data = pickle.dumps(model)
    shipped, name = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = pickle.loads(shipped.value)
        own = _MODELS[name]
        for part in slices(batch, "t"):
            found = [own.predict(t.as_py().decode("utf-8", "replace")) for t in part.column("t")]
            yield {"doc_id": part.column("i"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    source = docs.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t"))
    return arrow_map(source, work, f"doc_id {kind}, lang_pred string, score double")
