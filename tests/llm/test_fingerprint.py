import random

import pytest

from codeloom.llm import fingerprint as fp


def test_edits_follow_descending_ids(docs_of):
    r = random.Random(2)
    rows = [(i * 7, " ".join(f"wörd{r.randrange(900)}" for _ in range(r.randrange(0, 90)))) for i in range(60)] + [(3, None), (10_000, "tail"), (-5, "")]
    r.shuffle(rows)
    got = {x.doc_id: x for x in fp.edited_fingerprints(docs_of(rows).repartition(4), partitions=5).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        edited = (t[: len(t) - h] + n[:h]).encode()
        assert (got[i].n_chars, bytes(got[i].edited)) == (len(t), edited)
        assert bytes(got[i].fingerprint) == fp.fingerprint(t.encode()) and bytes(got[i].edited_fingerprint) == fp.fingerprint(edited)
        assert got[i].near_next == fp.likeness(fp.fingerprint(t.encode()), fp.fingerprint(n.encode()))


@pytest.mark.parametrize("rows", [[], [(5, "one only here")], [(None, "a b"), (None, "c d")], [(1, "a b c"), (1, "d e f"), (1, "a b c")], [(2, "a"), (None, "b"), (3, "c")]])
def test_edge_rows(docs_of, rows):
    got = [(x.doc_id, bytes(x.edited).decode()) for x in fp.edited_fingerprints(docs_of(rows), partitions=3).collect()]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), [-ord(c) for c in x[1]]))
    want = [(i, t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (i, t), (_, n) in zip(order, order[1:] + order[:1])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_block_tables_find_all(docs_of, spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 6))) for b in base for _ in range(4)] + base[:5]
    prints = spark.createDataFrame([(bytearray(v.to_bytes(8)), 1) for v in values] + [(None, 0)], "fingerprint binary, found int")
    for radius, blocks in ((3, None), (2, 3), (3, 6)):
        got = {(int.from_bytes(x.query), int.from_bytes(x.found), x.distance) for x in fp.within_radius(prints, prints, radius=radius, blocks=blocks).collect()}
        assert got == {(a, b, (a ^ b).bit_count()) for a in values for b in values if (a ^ b).bit_count() <= radius}


def test_fingerprints_of_likes(docs_of):
    rows = [(1, "same text here", 0), (2, "same text here", 0), (None, None, 0), (4, "", 0)]
    got = {x.doc_id: bytes(x.fingerprint) for x in fp.fingerprints(docs_of(rows, "doc_id long, text string, fingerprint int")).collect()}
    assert got[1] == got[2] != got[4] == got[None] == bytes(32)
    words = [f"t{i}" for i in range(400)]
    whole, half = fp.fingerprint(" ".join(words).encode()), fp.fingerprint(" ".join(words[:200] + [f"u{i}" for i in range(200)]).encode())
    assert 0.58 < fp.likeness(whole, half) < 0.78


def brute_fingerprint(text, bits=256):
    """One term after the other, in plain integers: the same hashes, weights and signs."""
    import math

    import xxhash

    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    golden, row = 0x9E3779B97F4A7C15, []
    for w in text.lower().split():
        row.append(xxhash.xxh64_intdigest(w))
        if len(w) > 32:
            row += [mix(int.from_bytes(w[k : k + 8], "little") + golden & full) for k in range(len(w) - 7)]
    terms = {}
    for x in row:
        terms[0, x] = terms.get((0, x), 0) + 1
    for x, y in zip(row, row[1:]):
        z = 1, mix(x * golden + y & full)
        terms[z] = terms.get(z, 0) + 1
    out = bytearray()
    weights = {t: (1 + math.log(n)) / (1 if t[0] else 2) for t, n in terms.items()}
    for k in range(bits // 64):
        votes = [0.0] * 64
        for (_, h), w in weights.items():
            x = mix(h + golden * k & full)
            for b in range(64):
                votes[b] += w if x >> b & 1 else -w
        word = sum(1 << b for b in range(64) if votes[b] > 1e-5)
        out += word.to_bytes(8, "little")
    return bytes(out)


@pytest.mark.parametrize("text", ["", "One two two three", "x" * 33, "word " + "y" * 40 + "z tail", "ünï cödé " * 7, "a b " * 50])
def test_fingerprint_equals_plain_votes(text):
    assert fp.fingerprint(text.encode()) == brute_fingerprint(text.encode())


def test_long_words_lose_no_byte():
    for n in (33, 34, 41, 64, 65):
        word = "abcdefghij" * 10
        assert len({fp.fingerprint((word[: n - 1] + c).encode()) for c in "xyz"}) == 3
    one, other = "漢字仮名" * 60, "あ" + "漢字仮名" * 60  # a shift by three bytes
    assert fp.likeness(fp.fingerprint(one.encode()), fp.fingerprint(other.encode())) > 0.7


def test_very_long_text_and_clashing_columns(docs_of):
    text = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    rows = [(2, text, "n", b"f", 1.0), (1, "second", "m", b"g", 2.0)]
    got = {x.doc_id: x for x in fp.edited_fingerprints(docs_of(rows, "doc_id long, text string, i string, fingerprint binary, near_next double"), partitions=2).collect()}
    half = len(text) // 2
    assert bytes(got[2].edited).decode() == text[: len(text) - half] + "second" and got[1].n_chars == 6 and bytes(got[2].fingerprint) == fp.fingerprint(text.encode())


def test_counts_within_the_radius(spark):
    r = random.Random(9)
    base = [r.getrandbits(256) for _ in range(12)]
    values = [b ^ sum(1 << k for k in r.sample(range(256), r.choice([0, 0, 1, 5, 7, 8, 12]))) for b in base for _ in range(6)]
    prints = spark.createDataFrame([(k, bytearray(v.to_bytes(32))) for k, v in enumerate(values)] + [(9999, None)], "doc_id long, fingerprint binary")
    got = {int.from_bytes(x.fingerprint): x.n_near for x in fp.near_counts(prints, prints.doc_id % 3 == 0).collect()}
    assert got == {v: sum((v ^ w).bit_count() <= 7 for w in values) for k, v in enumerate(values) if k % 3 == 0}
    with pytest.raises(Exception, match="isn't 64 bits long"):
        fp.within_radius(prints, prints, radius=3, bits=64).collect()


def in_order(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), [255 - b for b in x[1].encode()] + [256]))
    return sorted(((i, t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for (i, t), (_, n) in zip(order, order[1:] + order[:1])), key=repr)


@pytest.mark.parametrize("hot", [None, 7, 0, 999])
def test_an_id_with_a_third_of_the_rows(docs_of, hot):
    """Different texts of one id (or none) go to several ranges, in their order."""
    r = random.Random(3)
    text = lambda: " ".join(f"{r.choice('abcdefghij')}{r.randrange(1000)}" for _ in range(r.randrange(1, 6)))
    rows = [(hot, text()) for _ in range(120)] + [(r.randrange(1000), text()) for _ in range(240)] + [(None, "z last of none"), (5, None)]
    r.shuffle(rows)
    docs = docs_of(rows).repartition(3)
    ranges, n = fp._ranges(docs.selectExpr("doc_id AS i", "CAST(coalesce(text, '') AS BINARY) AS t"), 12)
    assert n == len(rows) and hot in ranges.within and len(ranges.within[hot]) >= 2
    got = fp.edited_fingerprints(docs, partitions=12)
    assert sorted(((x.doc_id, bytes(x.edited).decode()) for x in got.collect()), key=repr) == in_order(rows)


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_that_are_all_alike(docs_of, hot):
    rows = [(hot, "the same text in very many rows")] * 200 + [(i, f"text {i}") for i in range(100)] + [(hot, "another text"), (hot, "a third")]
    got = fp.edited_fingerprints(docs_of(rows).repartition(4), partitions=8)
    assert sorted(((x.doc_id, bytes(x.edited).decode()) for x in got.collect()), key=repr) == in_order(rows)
    assert fp.edited_fingerprints(docs_of([(hot, "x y")] * 50), partitions=4).count() == 50


def test_ids_beyond_the_precision_of_doubles(docs_of):
    r = random.Random(8)
    rows = [(r.getrandbits(63) * r.choice([1, -1]), f"text {k} {k * k}") for k in range(300)]
    got = fp.edited_fingerprints(docs_of(rows).repartition(3), partitions=9)
    assert sorted(((x.doc_id, bytes(x.edited).decode()) for x in got.collect()), key=repr) == in_order(rows)
