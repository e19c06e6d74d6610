"""Collocations: phrases of two to four words that are frequent and stick together.

Counting is PCY with DHP's pruning. The pass that counts phrases of ``m`` words exactly also counts, in hashed buckets, the occurrences
of phrases of ``m + 1`` words whose both parts of ``m`` words may still be frequent. The buckets that reach the
threshold become a bitmap, which is broadcast with a bitmap of the phrases that proved frequent (Apriori). The next
pass counts exactly only those phrases whose bucket and whose two parts are set in them. A bitmap can only let too much through, never
too little, and what it lets through is counted exactly, so the result is exact; both bitmaps have a fixed greatest size.

Within a slice of text, phrases are numbered without hashing and counted once; what is exchanged is one row for each phrase or
bucket of a task. Cuts look the counts of their parts up by joins whose keys are salted, since a few words begin or end very
many phrases, and the best phrases of a language are taken in two steps, so no task gets a whole language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from codeloom.llm.common import MIX, as_bytes, batch_of, slices, splitmix, stored, trimmed
from codeloom.runtime import ship

#: ASCII capitals to small letters, what ends a piece to a full stop, a tab to a space.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Bits of a bitmap: at least, at most (32 MB).
LEAST_BITS, MOST_BITS = 16, 28
#: Bytes of text in a block; a block's arrays take some ten times as much. Words whose numbers and buckets whose counts a worker holds.
BLOCK, VOCABULARY, BUCKETS_HELD = 4 << 20, 300_000, 4_000_000


def blocks(text: bytes, most: int = BLOCK) -> Iterator[bytes]:
    """Parts of a lowered text, cut at spaces and ends of pieces where it is long; a word is never cut."""
    at = 0
    while len(text) - at > most:
        stop = max(text.rfind(b" ", at, at + most), text.rfind(b".", at, at + most)) + 1
        if not stop:
            ends = [k for k in (text.find(b" ", at + most), text.find(b".", at + most)) if k >= 0]
            if not ends:
                break
            stop = min(ends) + 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def _combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return splitmix(left * MIX + right)


def phrase_hashes(words: np.ndarray, m: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1 to ``m`` words that start at each place where there is room."""
    out = [words]
    for k in range(1, m):
        out.append(_combined(out[-1][:-1], words[k:]))
    return out


class _Bitmap:
    """Which of 2 to the power of ``bits`` buckets are set."""

    def __init__(self, data: bytes, bits: int) -> None:
        self.data, self.shift = np.frombuffer(data, np.uint8), np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(buckets: DataFrame, bits: int) -> bytes:
    """The bitmap of a column ``bucket``. Spark makes its parts; the driver gets as many bytes as it has, whatever the number of rows."""
    after = F.col("bucket") + 1  # Spark counts bits from 1
    parts = buckets.groupBy(F.bitmap_bucket_number(after).alias("p")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(after)).alias("m"))
    out = np.zeros(max(1 << bits, 32768) // 8, np.uint8)
    for p, m in parts.collect():
        out[(p - 1) * 4096 : p * 4096] = np.frombuffer(m, np.uint8)
    return out.tobytes()


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each distinct key is first, its number of times, the number of each key)."""
    _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, count, back


class _Words(dict):
    """Numbers of the words met so far, in order, and their hashes."""

    def __init__(self) -> None:
        self.hashes = np.empty(VOCABULARY, np.uint64)
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        if number == len(self.hashes):
            self.hashes = np.append(self.hashes, np.empty_like(self.hashes))
        self.hashes[number] = xxhash.xxh64_intdigest(word)
        self.names.append(word)
        return number


_WORDS = _Words()


def _word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of words by ``_WORDS``, which is emptied before a block if it has become large; 0 is the end of a piece."""
    global _WORDS
    if len(_WORDS) > VOCABULARY or not _WORDS:
        _WORDS = _Words()
        _WORDS[b"."]
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))


class _Buckets:
    """Counts of buckets, added up before they leave the task; some millions of them at most are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, buckets: np.ndarray) -> None:
        self.parts.append(np.unique(buckets, return_counts=True))
        self.held += len(self.parts[-1][0])

    def rows(self) -> Iterator[dict]:
        if not self.parts:
            return
        bucket, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(bucket)
        bucket, count = bucket[order], count[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        none = pa.nulls(len(first))
        yield {"lang": none, "phrase": none, "bucket": bucket[first].astype(np.int64), "n": np.add.reduceat(count, first)}


def _tallies(words: list[bytes], carried: int, lang: str, m: int, bits: int, sets: tuple[_Bitmap, _Bitmap] | None, longest: int, buckets: _Buckets) -> Iterator[dict]:
    """Columns of the phrases of ``m`` words of a block; what is in the next longer ones' buckets goes to ``buckets``. A phrase counts where its
    last word is not one of the ``carried`` first words. ``sets``: frequent phrases of m - 1 words, and buckets of phrases of m words."""
    ids = _word_ids(words)
    names, shift = _WORDS.names, np.uint64(64 - bits)
    of_lang = np.array([xxhash.xxh64_intdigest(lang.encode())], np.uint64)
    hashes = phrase_hashes(_combined(of_lang, _WORDS.hashes[ids]), m + 1)
    breaks = np.concatenate(([0], np.cumsum(ids == 0, dtype=np.int32)))

    def whole(k: int) -> np.ndarray:
        return breaks[k:] == breaks[: len(breaks) - k]

    if len(words) < m:
        return
    ok = whole(m)
    if sets:
        before = whole(m - 1)
        before[before] = sets[0].has(hashes[m - 2][before])
        ok &= before[:-1] & before[1:]
        ok[ok] = sets[1].has(hashes[m - 1][ok])
    start = max(0, carried - m + 1)
    at = np.flatnonzero(ok[start:]) + start
    if m == 1:
        count = np.bincount(ids[at])
        own = np.flatnonzero(count)
        if len(own):
            bucket = _combined(of_lang, _WORDS.hashes[own]) >> shift
            yield {"lang": [lang] * len(own), "phrase": [names[k] for k in own.tolist()], "bucket": bucket.astype(np.int64), "n": count[own]}
    elif len(at):
        key = ids[at]
        for k in range(1, m):
            # numbers of phrases of k words, then of k + 1: exact, no hash decides
            key = (_numbered(key)[2] if k > 1 else key) << np.int64(32) | ids[at + k]
        first, count, _ = _numbered(key)
        own = at[first].tolist()
        yield {"lang": [lang] * len(own), "phrase": [b" ".join(words[i : i + m]) for i in own], "bucket": (hashes[m - 1][at[first]] >> shift).astype(np.int64), "n": count}
    if m < longest and len(words) > m:
        start = max(0, carried - m)
        both = (ok[:-1] & ok[1:] & whole(m + 1))[start:]
        if both.any():
            buckets.add(hashes[m][start:][both] >> shift)


def _pass(docs: DataFrame, m: int, bits: int, sets: tuple[bytes, bytes] | None, least: int, longest: int) -> DataFrame:
    """(lang, phrase binary, bucket long, n long), stored: phrases of ``m`` words with their own bucket; for the next pass, buckets without
    phrase; in the first pass, for each language the number of all words, with bucket -1."""
    spark = docs.sparkSession
    ship(spark)
    broadcast = spark.sparkContext.broadcast(sets)
    kind = _parse_datatype_string("lang string, phrase binary, bucket long, n long")
    arrow = to_arrow_schema(kind)

    def tallied(part: pa.RecordBatch, bitmaps: tuple[_Bitmap, _Bitmap] | None, buckets: _Buckets) -> Iterator[dict]:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("t"), strict=True):
            texts.setdefault(lang, []).append(text.as_py().translate(_LOWER))
        for lang, own in texts.items():
            carry: list[bytes] = []
            for block in blocks(b".".join(own)):
                words = [*carry, *block.replace(b".", b" . ").split()]
                yield from _tallies(words, len(carry), lang, m, bits, bitmaps, longest, buckets)
                if m == 1 and (n := len(words) - len(carry) - words[len(carry) :].count(b".")):
                    yield {"lang": [lang], "phrase": [None], "bucket": [-1], "n": [n]}
                carry = words[-m:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = tuple(_Bitmap(data, bits) for data in broadcast.value) if broadcast.value else None
        buckets = _Buckets()
        for batch in batches:
            for part in slices(batch, "t", BLOCK):
                for columns in tallied(part, bitmaps, buckets):
                    yield batch_of(columns, arrow)
                if buckets.held > BUCKETS_HELD:
                    yield from (batch_of(c, arrow) for c in buckets.rows())
        yield from (batch_of(c, arrow) for c in buckets.rows())

    rows = docs.mapInArrow(trimmed(run), kind)
    # added up in the task as far as they can be, so they are exchanged as they are; a phrase has a few rows of each task
    counted = rows.repartition("lang", "phrase", "bucket").groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
    return stored(counted.where((F.col("n") >= least) | (F.col("bucket") == -1)))


def frequent_phrases(docs: DataFrame, *, least: int = 30, longest: int = 4, bits: int | None = None, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase string, m int, f long): all phrases of 1 to ``longest`` words that occur ``least`` times or more, exactly counted;
    (lang, n long): all words of each language). Stored tables. ``bits`` of the bitmaps follow the bytes of text, within bounds."""
    if bits is None:
        total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (total // 64).bit_length()))
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("t"))
    source = source.select("lang", as_bytes("t").alias("t"))
    sets, found, totals = None, [], None
    for m in range(1, longest + 1):
        table = _pass(source, m, bits, sets, least, longest)
        if m == 1:
            totals = table.where("bucket = -1").groupBy("lang").agg(F.sum("n").alias("n"))
        phrases = table.where("phrase IS NOT NULL")
        found.append(phrases.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(m).alias("m"), F.col("n").alias("f")))
        if m < longest:
            sets = (_bitmap(phrases.select("bucket"), bits), _bitmap(table.where("phrase IS NULL AND bucket >= 0").select("bucket"), bits))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole, totals


def _whole(x: Column) -> Column:
    """A number that doesn't overflow when it is multiplied."""
    return x.cast("decimal(20,0)")


def _best_cuts(candidates: DataFrame, phrases: DataFrame, longest: int, scale: int, salts: int) -> DataFrame:
    """(lang, phrase, m, a, l, r, score) of each candidate by the cut that scores lowest, of equals that after the fewest words.

    A word may begin or end very many candidates, so candidates are dealt by a salt as well, and the
    counts, of which there are few beside the text, are repeated for each salt."""
    words = F.split("phrase", " ")
    parts = lambda k: [F.struct(F.lit(f"{side}{k}").alias("of"), F.array_join(F.slice(words, F.lit(1 + (side == "r") * k), F.lit(k) if side == "l" else F.col("m") - k), " ").alias("part")) for side in "lr"]
    listed = F.flatten(F.array(*[F.when(F.col("m") > k, F.array(*parts(k))).otherwise(F.array().cast("array<struct<of:string,part:string>>")) for k in range(1, longest)]))
    wanted = candidates.select("lang", "phrase", "m", F.col("f").alias("a"), F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("s"), F.explode(listed).alias("p"))
    wanted = wanted.select("lang", "phrase", "m", "a", "s", F.col("p.of").alias("of"), F.col("p.part").alias("part"))
    known = phrases.where(F.col("m") < longest).select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("s"))
    counted = wanted.join(known, ["lang", "part", "s"])
    sides = [F.max(F.when(F.col("of") == f"{side}{k}", F.col("n_part"))).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"]
    by = counted.groupBy("lang", "phrase", "m", "a").agg(*sides)
    score = lambda k: F.expr(f"(CAST(a AS DECIMAL(20,0)) * CAST({scale} AS DECIMAL(10,0))) div (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))")
    cuts = [F.when(F.col("m") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return by.withColumn("cut", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", "phrase", "m", "a", "cut.l", "cut.r", "cut.score")


def _within_longer(candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, most long): phrases of two words or more within longer candidates, and how often the most frequent of these occurs."""
    words = F.split("phrase", " ")
    inner = [F.when((F.col("m") >= k + i) & (F.col("m") > k), F.array_join(F.slice(words, i + 1, k), " ")) for k in range(2, longest) for i in range(longest - k + 1)]
    subs = candidates.where("m > 2").select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "f")
    return subs.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, scale: int = 2_000_000, share: int = 80, top: int = 2000, salts: int = 16, bits: int | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then number, then bytes.

    Texts have A-Z lowered and are split at ``.,;:!?`` and ends of lines into pieces, pieces at spaces and tabs into words. Candidates are phrases
    of 2 to ``longest`` words within a piece that occur ``a`` >= ``least`` times in their language, overlaps included. Cut after its first
    words a candidate scores floor(scale * a / (l + r)), where l and r are the numbers of its two parts; the lowest cut counts, of equals
    the first. Left out are candidates within a longer one that has ``share`` per cent of their number or more. ``n``: all words of the language.
    Null text is empty; null language is ``und``; bytes that aren't UTF-8 become U+FFFD; repeated rows count each time; other columns are ignored;
    no rows, or no frequent phrase, give no rows. Products are decimals of 30 digits.
    """
    phrases, totals = frequent_phrases(docs, least=least, longest=longest, bits=bits, lang_col=lang_col, text_col=text_col)
    candidates = phrases.where("m > 1")
    scored = _best_cuts(candidates, phrases, longest, scale, salts)
    outer = scored.join(_within_longer(candidates, longest), ["lang", "phrase"], "left")
    kept = outer.where(F.col("most").isNull() | (_whole(F.col("most")) * 100 < _whole(F.col("a")) * share))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first the best of each part of a language, then of these, at most 64 times ``top``, the best
    some = kept.withColumn("s", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "s").orderBy(*order))).where(F.col("rank") <= top).drop("s")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
