"""Fill-in-the-middle against a brute-force version of the rules."""

import hashlib
import random
import re

from codeloom.llm import fill_middle as f

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def made_up(n):
    dice = random.Random(5)
    signs = ["a", "é", "😀", " ", "\t", "\n", "\x0b", "\x85", "\x1c", "\x00", "<", ">", "<P", "S>", "<M", "P>", "é", "　"]
    return [(k, "".join(dice.choice(signs) for _ in range(dice.randrange(60)))) for k in range(n)]


def test_equals_brute_force(docs_of):
    data = [*made_up(400), (400, None), (401, ""), (402, " \n"), (None, "a b c d e f"), (403, "x<P>y z"), (7, "same id"), (404, "<S >" * 50)]
    got = [tuple(r) for r in f.fill_in_middle(docs_of(data), restored=True).collect()]
    assert sorted(got, key=repr) == sorted((brute(*r) for r in data), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digests_and_restoring(docs_of):
    data = made_up(100)
    formed = f.fill_in_middle(docs_of(data))
    hashed = {r.doc_id: (r.output, r.restored) for r in f.fill_in_middle(docs_of(data), restored=True, digests=True).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert hashed == {r.doc_id: (sha(r.output), sha(dict(data)[r.doc_id])) for r in formed.collect()}
    assert {r.doc_id: r.text for r in f.restore(formed).collect()} == dict(data)


def test_partitions_repeats_and_clashing_columns(docs_of):
    data = [(k, t, "x", 1) for k, t in made_up(60)] * 2
    docs = docs_of(data, "doc_id long, text string, output string, o int")
    one, two = f.fill_in_middle(docs).collect(), f.fill_in_middle(docs.repartition(5)).collect()
    assert len(one) == 120 and sorted(map(repr, one)) == sorted(map(repr, two))


def test_very_long_text_and_empty_table(docs_of):
    long = [(k, ("w%d <S \n" % k) * 150_000) for k in range(10)]
    got = {r.doc_id: tuple(r)[1:] for r in f.fill_in_middle(docs_of(long), restored=True).collect()}
    assert got == {i: brute(i, t)[1:] for i, t in long} and any(r[1] != "plain" for r in got.values())
    none = f.fill_in_middle(docs_of([]))
    assert none.count() == 0 and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 'k' AS doc_id, CAST(X'61FF2062' AS STRING) AS text")
    row = f.fill_in_middle(docs, share=100, restored=True).first()
    assert row.restored == "a� b" and row.n == 2
