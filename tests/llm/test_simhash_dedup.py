import random

import numpy as np
import pytest
import xxhash

from codeloom.llm import simhash_dedup as sd


def brute_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(a) for a in range(len(prints))]


def texts(n=120, seed=5):
    r = random.Random(seed)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(40)) for _ in range(r.randrange(1, 300))) for _ in range(n // 4)]
    out = ["", None, "  \t\n", "One", "one", "Two words", "é è ß", "x " * 3000]
    for t in base:
        for _ in range(3):
            w = t.split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    return out


def test_fingerprints_and_groups_equal_brute_force(docs_of):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in sd.simhash_components(docs_of(rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i].fingerprint & (1 << 64) - 1 for i, _ in rows] == prints
    assert [got[i].component_id for i, _ in rows] == brute_groups(prints, 2)


def test_wider_radius(docs_of):
    rows = list(enumerate(texts(40, 7)))
    got = {r.doc_id: r.component_id for r in sd.simhash_components(docs_of(rows), radius=4).collect()}
    assert [got[i] for i, _ in rows] == brute_groups([brute_print(t) for _, t in rows], 4)


def test_edge_rows(docs_of):
    assert sd.simhash_components(docs_of([])).collect() == []
    rows = [(None, "a b c d", 1, 1), (7, "a b c d", 2, 1), (7, "a b c d", 2, 1), (None, "other words of no other", 0, 0)]
    got = sd.simhash_components(docs_of(rows, "doc_id long, text string, fingerprint int, f0 int")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.component_id == 7) == [(False, 7, 7), (False, 7, 7), (True, None, 7)]
    assert len(got) == 4 and [r.component_id for r in got].count(None) == 1


def test_near_duplicates_by_shingle_sets(docs_of):
    r = random.Random(3)
    words = [f"w{r.randrange(500)}" for _ in range(400)]
    near, far = words[:], words[:]
    near[10] = near[300] = "changed"
    far[::12] = ["x"] * len(far[::12])
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (1, " ".join(far)), (2, None), (4, ""), (None, "lost"), (6, "short text")]
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(docs_of(rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 2, 4: 2, 6: 6}
    assert sd.near_duplicates(docs_of([])).collect() == []


@pytest.mark.parametrize(("between", "rows"), [(1, 2048), (60, 2048), (150, 2048), (150, 40)])
def test_near_copies_with_unlike_texts_between(docs_of, monkeypatch, between, rows):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10_000)}" for _ in range(120))
    first, second = text(), text()
    texts = [(0, first), (1, second), *[(2 + k, text()) for k in range(between)], (900, second + " end"), (901, first + " end")]
    # all texts meet in all values, and none are far apart
    monkeypatch.setattr(sd, "fingerprints", lambda d, *, words64, **_: d.selectExpr("doc_id AS i", *[f"0L AS f{k}" for k in range(words64)]))
    monkeypatch.setattr(sd, "_ROWS", rows)
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(docs_of(texts), tables=2, first=1).collect()}
    assert got == {i: {900: 1, 901: 0}.get(i, i) for i, _ in texts}


def test_runs_of_values():
    r = random.Random(2)
    sizes = [r.choice([2, 3, 40, 63, 64, 65, 66, 200]) for _ in range(80)]
    rows = sorted((v, k % 3, 1000 * v + k, k % 5) for v, n in enumerate(sizes) for k in range(n))
    v, f, i, c = (np.array(x) for x in zip(*rows))
    pairs, meets, crowds = sd._within_values(v, f, i, c.astype(np.uint32), np.zeros(len(v), bool))
    want = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and sizes[a[0]] <= 64 and a[2] < b[2] and a[3] != b[3] and (a[1] < b[1] or a[1] == b[1] == 0)}
    assert set(zip(*(x.tolist() for x in pairs))) == want and not len(meets[0])
    assert sorted(zip(*(x.tolist() for x in (crowds[2], crowds[3], crowds[0], crowds[1])))) == [x for x in rows if sizes[x[0]] > 64]


def test_runs_with_large_groups():
    r = random.Random(4)
    rows = sorted((v, k % 4, 100 * v + k, r.randrange(6)) for v in range(40) for k in range(r.randrange(2, 30)))
    v, f, i, c = (np.array(x) for x in zip(*rows))
    pairs, meets, crowds = sd._within_values(v, f, i, c.astype(np.uint32), c < 2)
    group = dict(zip(i.tolist(), c.tolist()))
    want = {(a[2], b[3]) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and b[3] < 2 and ((a[1] - b[1]) * (a[3] - b[3]) > 0 or a[1] == b[1] == 0)}
    assert {(x, group[y]) for x, y in zip(*(m.tolist() for m in meets))} == want
    want = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and min(a[3], b[3]) > 1 and a[2] < b[2] and a[3] != b[3] and (a[1] < b[1] or a[1] == b[1] == 0)}
    assert set(zip(*(x.tolist() for x in pairs))) == want and not len(crowds[0])


def test_what_meets_a_large_group_is_compared_with_all_of_it(docs_of, monkeypatch):
    r = random.Random(5)
    text = lambda n: [f"w{r.randrange(100_000)}" for _ in range(n)]
    base = text(200)
    copies = [" ".join(base[: 200 - k]) for k in range(40)]  # neighbours are alike, the ends are not
    tail = " ".join([*base[: 200 - 39], *text(30)])
    rows = [*enumerate(copies), (100, tail), (101, " ".join(text(120)))]
    monkeypatch.setattr(sd, "_ROWS", 16)
    monkeypatch.setattr(sd, "_LARGE", 4)
    monkeypatch.setattr(sd, "fingerprints", lambda d, *, words64, **_: d.selectExpr("doc_id AS i", *[f"0L AS f{k}" for k in range(words64)]))
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(docs_of(rows), tables=2, first=1).collect()}
    assert got == {i: 101 if i == 101 else 0 for i, _ in rows}


def test_near_duplicates_of_repeated_ids(docs_of):
    r = random.Random(6)
    one, two = (" ".join(f"w{r.randrange(10_000)}" for _ in range(80)) for _ in range(2))
    rows = [(7, one), (7, two), (7, one), (8, two + " end"), (3, "alone")]
    got = sd.near_duplicates(docs_of(rows)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(3, 3), (7, 7), (7, 7), (8, 7)] and len({x.node for x in got}) == 4


@pytest.mark.parametrize("share", [0.805, 0.83, 0.87])
def test_recall_by_band(docs_of, share):
    """Pairs just above the threshold: at least nine of ten are found, by fingerprints that meet by chance."""
    r = random.Random(int(share * 1000))
    rows, n = [], 400
    for k in range(150):
        words = [f"w{r.randrange(1_000_000)}" for _ in range(n)]
        own = round((n - 4) * (1 - share) / (1 + share)) + 0  # shingles that each side has for itself
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: n - own], *(f"x{r.randrange(1_000_000)}" for _ in range(own))]))]
    true = [k for k in range(150) if sd.jaccard(*(np.unique(sd.shingle_hashes(rows[2 * k + j][1].encode(), 5).astype(np.uint32)).tobytes() for j in (0, 1))) >= 0.8]
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(docs_of(rows)).collect()}
    assert len(true) > 100 and sum(got[2 * k + 1] == 2 * k for k in true) >= 0.9 * len(true)
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_near_duplicates_with_lines_repeated_more_or_less(docs_of):
    r = random.Random(11)
    texts = []
    for k in range(12):
        words, line = (" ".join(f"w{r.randrange(10_000)}" for _ in range(n)) for n in (150, 10))
        texts += [(2 * k, f"{words} {line} {line}"), (2 * k + 1, f"{words} {' '.join([line] * (6, 11, 31)[k % 3])}")]
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(docs_of(texts)).collect()}
    assert got == {i: i - i % 2 for i, _ in texts}
