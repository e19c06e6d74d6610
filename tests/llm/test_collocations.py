"""Collocations against a brute-force version."""

import random
import re
from collections import Counter

import pytest

from codeloom.llm import collocations as c


def brute(rows, least=30, top=2000, longest=4):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            own = re.findall("[^ \t]+", piece)
            words[lang] += len(own)
            counts.update((lang, tuple(own[i : i + m])) for m in range(1, longest + 1) for i in range(len(own) - m + 1))
    found = {k: n for k, n in counts.items() if n >= least}
    out = []
    for (lang, w), a in found.items():
        if len(w) < 2:
            continue
        if any(x == lang and len(v) > len(w) and 100 * n >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), n in found.items()):
            continue
        score, k = min((2000000 * a // (found[lang, w[:k]] + found[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, found[lang, w[:k]], found[lang, w[k:]], words[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(own[:top], 1)]
    return ranked


def made_up(n, seed=3):
    dice = random.Random(seed)
    words = ["The", "the", "of", "New", "york", "é", "\x1c", "a.b", "x,", "Y;", "z\nq", "in\tit", "--", "　", "end!", "İI"] + [f"w{k}" for k in range(40)]
    pick = lambda: dice.choices(words, [1 / (k + 1) for k in range(len(words))])[0]
    return [(dice.choice(["en", "fr", None, "und"]), " ".join(pick() for _ in range(dice.randrange(60)))) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("bits", "least"), [(16, 30), (16, 4), (28, 12)])
def test_equals_brute_force(docs_of, bits, least):
    data = made_up(500)
    docs = docs_of([(k, *r) for k, r in enumerate(data)], "doc_id long, lang string, text string")
    got = rows_of(c.collocations(docs, bits=bits, least=least))
    assert got == sorted(brute(data, least)) and len(got) > 50
    assert {r[0] for r in got} == {"en", "fr", "und"}


def test_top_is_cut_by_score_number_and_bytes(docs_of):
    data = made_up(400, 8)
    docs = docs_of([(k, *r, "x", 1) for k, r in enumerate(data)], "doc_id long, lang string, text string, phrase string, m int").repartition(5)
    assert rows_of(c.collocations(docs, top=7, salts=3)) == sorted(brute(data, top=7))


def test_long_texts_are_cut_between_words(docs_of, monkeypatch):
    text = b"one two. three  four five" * 40
    for most in (1, 7, 30, 10_000):
        assert b"".join(c.blocks(text, most)) == text
        assert [w for b in c.blocks(text, most) for w in b.replace(b".", b" . ").split()] == text.replace(b".", b" . ").split()
    assert list(c.blocks(b"x" * 100, 10)) == [b"x" * 100]


def test_carried_words_count_once():
    words = [b"a", b"b", b"c", b".", b"a", b"b", b"c", b"d"]

    def tallied(m, own, carried, into, held):
        for x in c._tallies(own, carried, "en", m, 16, None, 4, held):
            into.update({(m, p): int(n) for p, n in zip(x["phrase"], x["n"], strict=True)})

    whole, parts, held, more = Counter(), Counter(), c._Buckets(), c._Buckets()
    for m in (1, 2, 3):
        tallied(m, words, 0, whole, held)
        tallied(m, words[:4], 0, parts, more)
        tallied(m, words[4 - m :], m, parts, more)
    assert whole == parts and whole[2, b"a b"] == 2 and (2, b"c .") not in whole
    one, two = ([list(map(list, (r["bucket"], r["n"]))) for r in x.rows()] for x in (held, more))
    assert one == two


def test_nulls_repeats_long_and_no_rows(docs_of):
    kind = "doc_id long, lang string, text string"
    data = [(1, None, "New York, new york " * 40), (1, None, "New York, new york " * 40), (None, "en", None), (2, "en", ""), (3, "en", "x" * 2_000_000), (4, "fr", "la vie . " * 600_000)]
    assert rows_of(c.collocations(docs_of(data, kind))) == sorted(brute([r[1:] for r in data]))
    assert c.collocations(docs_of([], kind)).count() == 0
    assert c.collocations(docs_of([(1, "en", "too few words")], kind)).count() == 0
