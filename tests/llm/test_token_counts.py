"""Counts of prefixes against the library that the vocabulary file belongs to."""

import random
import sys
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = (
    "a b ' 's 'll 'r ve re T É é ́ İ Σ ς 1 ٣ ² ! < | > <|endoftext|> <|endoftext| <|startoftext|> 😀 各 fi ﬁ Å the ing ... aaaa ẛ̣ ǅ ½ _ ª 가 ᆨ 'RE".split()
    + [" ", " ", "\t", "\n", "\x1c", "\x85", "　", "\x00", "\x7f"]
)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, "rb") as file:
        return t.WordBpe(file.read())


def made_up(n, most=14):
    dice = random.Random(11)
    return ["".join(dice.choice(SIGNS) for _ in range(dice.randint(0, most))) for _ in range(n)]


def test_every_prefix_has_the_library_s_number(bpe, library):
    for text in made_up(1500):
        assert bpe.count(text) == library(text), text
        normal = bpe.nfc(text)
        assert bpe.prefixes(text).tolist() == [library(normal[:k]) for k in range(len(normal) + 1)], text


def test_white_space_is_the_library_s():
    tokenizer = Tokenizer.from_file(PATH)
    blank = [c for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))) if not t._CHUNK.fullmatch(c)]
    assert all(tokenizer.normalizer.normalize_str(c) == " " for c in blank)
    assert not [c for c in map(chr, range(0xD800)) if c not in blank and tokenizer.normalizer.normalize_str(c) == " "]


def test_longest_prefix_is_that_of_the_table(bpe):
    for text in made_up(300, 40):
        table = bpe.prefixes(text).tolist()
        for most in (0, 1, 3, 9, 500):
            assert bpe.longest(text, most) == max(k for k, n in enumerate(table) if n <= most)


def test_time_is_linear(bpe, library):
    for text in ("a" * 300_000, "!" * 300_000, "x<|endoftext|>" * 30_000, "'ll" * 100_000, "é" * 100_000, "́" * 100_000, " " * 2_000_000, "é" * 200_000):
        began = time.time()
        table = bpe.prefixes(text)
        assert time.time() - began < 20 and table[-1] == bpe.count(text) == library(text)


def test_operators(docs_of, library):
    data = [(k, x, "y", 3) for k, x in enumerate(made_up(80, 60))] + [(80, None, "y", 3), (None, "null id", "y", 3), (3, "again", "y", 3), (3, "again", "y", 3), (81, "word " * 3000, "y", 3)]
    docs = docs_of(data, "doc_id long, text string, n_tokens string, n int").repartition(3)
    texts = [x[1] or "" for x in data]
    got = t.token_counts(docs, PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len(x.encode()), library(x), library(x) > 2048) for x in texts)
    assert {r.fitting_chars for r in got if r.doc_id == 81} == {2048 * 5}
    cut = t.truncate_texts(docs, PATH, 5).collect()
    assert len(cut) == len(data) and all(r.n_tokens == library(r.text) <= 5 for r in cut)
    assert {r.text for r in cut if r.doc_id == 81} == {"word " * 5}
    tables = t.prefix_counts(docs, PATH).collect()
    assert sorted(r.counts[-1] for r in tables) == sorted(map(library, texts))


def test_empty_table(docs_of):
    assert t.token_counts(docs_of([]), PATH).count() == t.prefix_counts(docs_of([]), PATH).count() == 0


def test_other_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file, pytest.raises((ValueError, KeyError)):
        t.WordBpe(file.read())
