"""Token counts of every prefix, by dynamic programming over word-ended BPE.

Merges never pass a word, and a word's last symbol is another symbol than the same byte elsewhere. A
sequence of tokens is the one that the merges give if each token is what the merges make of its own
symbols and each two neighbours are what they make of theirs. So the last token of every prefix of
a word is the one token, among those that end there, which fits the last token of what is before it;
one pass over the word gives the last token and the number of tokens of all its prefixes. Two tables
are kept: of prefixes that go on (``inner``) and of prefixes that end there (``ended``).

A text's table is that of its chunks (parts without white space) added up: it holds the exact number of tokens that the
library would give each prefix of the text, so that truncation and budgets are look-ups. Texts are
normalised and cut into words by the library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, as_bytes, slices

#: Memos are emptied at these sizes; longer chunks and words aren't kept.
CHUNKS_KEPT, WORDS_KEPT, PAIRS_KEPT, CHARS_KEPT = 500_000, 500_000, 1_000_000, 48
# The white space that the normaliser and the pre-tokenizer know. No word and no special token holds any.
_CHUNK = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
# The pre-tokenizer's pattern, which is checked when a file is read, and what it is for lower-case ASCII.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
#: The character that the file has for each byte: printable ones themselves, others from 256 on.
_CHARACTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Memo(dict):
    """Numbers of tokens of strings met so far; long strings aren't kept, and at ``most`` of them it is emptied."""

    def __init__(self, count: Callable[[str], int], most: int) -> None:
        self.count, self.most = count, most

    def __missing__(self, text: str) -> int:
        found = self.count(text)
        if len(text) <= CHARS_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[text] = found
        return found


class WordBpe:
    """A vocabulary file of BPE with word ends, in JSON."""

    def __init__(self, data: bytes) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        whole = json.loads(data)
        model = whole["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("the file has to be of plain BPE with word ends")
        steps = [n["type"] for n in whole["normalizer"]["normalizers"]], whole["pre_tokenizer"]["pretokenizers"][0].get("pattern")
        if steps != (["NFC", "Replace", "Lowercase"], {"Regex": _PATTERN}):
            raise ValueError("the normaliser and pre-tokenizer aren't those that this operator knows")
        added = whole.get("added_tokens", [])
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that strip or look around them aren't supported")
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.normal, self.cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        byte_of = {c: b for b, c in _CHARACTER.items()}
        self.first = [vocab[_CHARACTER[b]] for b in range(256)]
        self.final = [vocab[_CHARACTER[b] + suffix] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        self.symbols: dict[int, list[int]] = {}
        ends: dict[str, list[int]] = {}
        self.sizes: dict[int, int] = {}
        for token, number in vocab.items():
            ended = token.endswith(suffix) and token != suffix
            plain = token[: -len(suffix)] if ended else token
            if not plain or any(c not in byte_of for c in plain):
                continue
            data_ = bytes(byte_of[c] for c in plain)
            self.symbols[number] = [*map(self.first.__getitem__, data_[:-1]), (self.final if ended else self.first)[data_[-1]]]
            self.sizes[number] = len(data_)
            ends.setdefault(data_.decode("latin-1"), [-1, -1])[ended] = number
        # only tokens that the merges make of their own symbols can be in an encoding
        for number in [n for n in self.symbols if self._merged(self.symbols[n]) != [n]]:
            del self.symbols[number]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for key, (inner, ended) in ends.items():
            both = (len(key), inner if inner in self.symbols else -1, ended if ended in self.symbols else -1)
            if both[1:] != (-1, -1):
                self.automaton.add_word(key, both)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        alone = {number: 1 for number in self.symbols}
        self.words = _Memo(lambda w: alone.get(vocab.get(w + suffix)) or self.ended(word_bytes(w), True)[-1], WORDS_KEPT)
        self.chunks = _Memo(self.chunk, CHUNKS_KEPT)

    def _merged(self, symbols: list[int]) -> list[int]:
        """The merges themselves, lowest rank first, leftmost of equals. For short sequences."""
        own, merges = list(symbols), self.merges
        while len(own) > 1:
            found = [merges.get(a << 32 | b) for a, b in zip(own, own[1:], strict=False)]
            best = min((f[0], i) for i, f in enumerate(found) if f) if any(found) else None
            if best is None:
                break
            own[best[1] : best[1] + 2] = [found[best[1]][1]]
        return own

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand next to each other."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > PAIRS_KEPT:
                self._fits.clear()
            known = self._fits[key] = self._merged(self.symbols[left] + self.symbols[right]) == [left, right]
        return known

    def ended(self, word: bytes, only_last: bool = False) -> list[int]:
        """The number of tokens of each prefix of a word, each ended where it ends; the first is of the empty one. With ``only_last``, the
        last number alone is worked out."""
        n = len(word)
        last, inner, ended = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        known, fits = self._fits.get, self.fits
        for at, (size, go_on, stop) in self.automaton.iter(word.decode("latin-1")):
            at += 1
            left = at - size
            before = last[left]
            if left and before < 0:
                continue
            if go_on >= 0 and last[at] < 0 and at < n:
                fit = not left or known(before << 32 | go_on)
                if fit or (fit is None and fits(before, go_on)):
                    last[at], inner[at] = go_on, inner[left] + 1
            if stop >= 0 and not ended[at] and (at == n or not only_last):
                fit = not left or known(before << 32 | stop)
                if fit or (fit is None and fits(before, stop)):
                    ended[at] = inner[left] + 1
        return ended

    def words_of(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the pre-tokenizer shows them: a character for each byte."""
        if text.isascii() and text.isprintable():
            return _ASCII_WORD.findall(text.lower())
        return [w for w, _ in self.cut(self.normal(text))]

    def _plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.words_of(text)))

    def chunk(self, text: str) -> int:
        """The number of tokens of a text without white space, special tokens as the library's default has them."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def chunk_prefixes(self, text: str) -> list[int]:
        """The number of tokens of each prefix of a chunk in NFC, by code points; the first is of the empty one."""
        out, total, at, tail = [0], 0, 0, ""
        for m in self.special.finditer(text) if self.special is not None else ():
            table, tail = self._table(text[at : m.start()])
            out += [total + t for t in table[1:]]
            total += table[-1]
            # a special token that is cut is ordinary text; its first sign goes on a word of signs before it
            before = total - self._plain(tail)
            out += [before + self._plain(tail + m[0][:k]) for k in range(1, len(m[0]))]
            total += 1
            out.append(total)
            at = m.end()
        out += [total + t for t in self._table(text[at:])[0][1:]]
        return out

    def _table(self, text: str) -> tuple[list[int], str]:
        """Counts of each prefix of a text without white space and special tokens; its last word if that is one of signs."""
        normal, out, total, word = self.normal(text), [0], 0, ""
        for shown, (a, b) in self.cut(normal):
            word = normal[a:b]
            if word[0] == "'" and len(word) == 3 and word.isascii() and word[1].isalpha():
                own = [self._plain(word[:k]) for k in (1, 2)] + [self.words[shown]]  # cut, it is two words
            else:
                ends = self.ended(word_bytes(shown))
                own = ends[1:] if len(shown) == len(word) else [ends[k] for k in accumulate(len(c.encode()) for c in word)]
            out += [total + t for t in own]
            total = out[-1]
        if len(normal) != len(text):  # a character may become two when it is lowered
            out = [out[k] for k in accumulate((len(self.normal(c)) for c in text), initial=0)]
        return out, word if word and len(self.cut(word + "<")) == 1 else ""

    def nfc(self, text: str) -> str:
        """The text in NFC, by the library's own tables."""
        from tokenizers.normalizers import NFC

        return text if text.isascii() else NFC().normalize_str(text)

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        return sum(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """The number of tokens of each prefix of the text's NFC, by code points."""
        text = self.nfc(text)
        out, at, total = np.zeros(len(text) + 1, np.int64), 0, 0
        for m in _CHUNK.finditer(text):
            out[at : m.start() + 1] = total
            out[m.start() : m.end() + 1] = np.array(self.chunk_prefixes(m[0])) + total
            at, total = m.end(), int(out[m.end()])
        out[at:] = total
        return out

    def longest(self, text: str, most: int) -> int:
        """The code points of the longest prefix of the text's NFC that has ``most`` tokens or fewer. One chunk's table is made, that in
        which the budget ends."""
        text, total = self.nfc(text), 0
        for m in _CHUNK.finditer(text):
            own = self.chunks[m[0]]
            if total + own > most:
                table = self.chunk_prefixes(m[0])
                return m.start() + max(k for k, t in enumerate(table) if total + t <= most)
            total += own
        return len(text)


def word_bytes(word: str) -> bytes:
    """The bytes of a word as the pre-tokenizer shows it: a character for each byte."""
    return bytes(map(_BYTE.__getitem__, word))


_BYTE = {c: b for b, c in _CHARACTER.items()}
_LOADED: dict[str, WordBpe] = {}


def _loaded(data: bytes) -> WordBpe:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(data)
    return _LOADED[key]


def _over_texts(docs: DataFrame, vocabulary_path: str, work: Callable[[WordBpe, str], dict], schema: str, id_col: str, text_col: str) -> DataFrame:
    """``work`` for each whole text, in slices of a batch; the vocabulary, whose size doesn't depend on the input, is broadcast."""
    with open(vocabulary_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = _loaded(vocabulary.value)
        for part in slices(batch, "t", 4 << 20):
            rows = [work(bpe, t.as_py().decode("utf-8", "replace")) for t in part.column("t")]
            yield {"doc_id": part.column("i"), "n_bytes": part.column("n"), **{k: [r[k] for r in rows] for k in rows[0]}}

    source = docs.select(F.col(id_col).alias("i"), as_bytes(text_col).alias("t")).withColumn("n", F.octet_length("t").cast("long"))
    return arrow_map(source, run, f"doc_id {kind}, n_bytes long, {schema}")


def token_counts(docs: DataFrame, vocabulary_path: str, *, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long) of each whole text, without added tokens; a special
    token's string in a text is that token.

    ``over_limit``: more than ``most`` tokens. ``fitting_chars``: the code points of the longest prefix of the text in NFC that has ``most``
    tokens or fewer; a prefix's number may fall as it grows, so it is the last such prefix. Null text is empty: no bytes,
    no tokens. Bytes that aren't UTF-8 count as U+FFFD, ``n_bytes`` is of what is there. Ids of any type and null pass
    through; repeated rows repeat; other columns are ignored; no rows give no rows. Time and memory are linear in a text.
    """

    def work(bpe: WordBpe, text: str) -> dict:
        n = bpe.count(text)
        return {"n_tokens": n, "over_limit": n > most, "fitting_chars": bpe.longest(text, most) if n > most else len(bpe.nfc(text))}

    return _over_texts(docs, vocabulary_path, work, "n_tokens long, over_limit boolean, fitting_chars long", id_col, text_col)


def prefix_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, counts array<int>): element k is the number of tokens of the first k code points of the text's NFC. Null
    text: the empty prefix alone. Else as :func:`token_counts`."""
    return _over_texts(docs, vocabulary_path, lambda bpe, text: {"counts": bpe.prefixes(text).astype(np.int32)}, "counts array<int>", id_col, text_col)


def truncate_texts(docs: DataFrame, vocabulary_path: str, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, text string, n_tokens long): the longest prefix of each text's NFC with ``most`` tokens or fewer and its number
    of tokens. A text that fits stays as it is. Null text: empty. Else as :func:`token_counts`."""

    def work(bpe: WordBpe, text: str) -> dict:
        if (n := bpe.count(text)) > most:
            text = bpe.nfc(text)[: bpe.longest(text, most)]
            n = bpe.count(text)
        return {"text": text, "n_tokens": n}

    return _over_texts(docs, vocabulary_path, work, "text string, n_tokens long", id_col, text_col)
