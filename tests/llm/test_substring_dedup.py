import random

import pytest

from codeloom.llm import substring_dedup as sub


def brute(rows, window):
    first, out = {}, []
    texts = sorted(((-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows), key=lambda x: x[0])
    for i, w in texts:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), []).append((i, p))
    low = {k: min(v) for k, v in first.items()}
    for i, w in texts:
        cut = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < (i, p):
                cut[p : p + window] = [True] * window
        out.append((i, len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c)))
    return sorted(out)


def corpus(seed, n=80):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(300)}"
    passages = [[word() for _ in range(r.randrange(15, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            at = r.randrange(len(w) + 1)
            w[at:at] = p[a:] if r.random() < 0.5 else p
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + i, rows[r.randrange(n)][1]) for i in range(10)]
    return rows


@pytest.mark.parametrize(("window", "modulus", "seed"), [(20, 13, 1), (20, 13, 2), (8, 7, 3), (10, 3, 4)])
def test_equals_brute_force(docs_of, window, modulus, seed):
    rows = [*corpus(seed), (5000, None), (5001, ""), (5002, " \t\n"), (5003, "same word " * 60), (None, corpus(seed)[5][1] + " tail"), (5004, "é x " * 30)]
    random.Random(seed).shuffle(rows)
    got = sub.remove_repeats(docs_of(rows).repartition(5), window=window, modulus=modulus, partitions=3).collect()
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == brute(rows, window)
    assert all(sum(x.stop - x.start for x in r.runs) == r.n_removed for r in got)


def test_repeated_rows_and_clashing_columns(docs_of):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(4, text, 1, 2, b"x"), (4, text, 1, 2, b"x"), (9, text, 0, 0, b"y"), (4, "b " + text, 0, 0, b"z")]
    got = sub.remove_repeats(docs_of(rows, "doc_id long, text string, k int, f int, t binary")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(4, 30, 0), (4, 30, 0), (4, 31, 30), (9, 30, 30)]
    assert sub.remove_repeats(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        sub.remove_repeats(docs_of([]), window=13)


def test_spacing_and_carried_columns(docs_of):
    text = "\n ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "x"), (2, "head\n\nof it  " + text + "\ttail ", None), (3, " as  it is ", "z"), (None, None, "n")]
    got = sub.remove_repeats(docs_of(rows, "doc_id long, text string, k string"), spacing=True, carry=("doc_id", "k")).collect()
    assert sorted((r.row.doc_id or 9, bytes(r.kept).decode(), r.row.k) for r in got) == [(1, text, "x"), (2, "head\n\nof it\ttail", None), (3, " as  it is ", "z"), (9, "", "n")]


def test_one_bucket_at_a_time(docs_of):
    """Many buckets in few partitions give what one bucket does; a task never holds more than a bucket."""
    rows = corpus(9, 120)
    whole = sub.remove_repeats(docs_of(rows), partitions=1).collect()
    fine = sub.remove_repeats(docs_of(rows), partitions=2, bucket_bytes=200).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, fine))
    held = [len(c[0]) for c in sub._by_bucket(iter([_sorted_rows(50, 40)]), "e", "<u4")]
    assert held == [40] * 50


def _sorted_rows(buckets, entries):
    import numpy as np
    import pyarrow as pa

    keys = np.zeros(entries, sub._KEY)
    blob = next(sub._pack(np.zeros(entries, np.int64), np.arange(entries), keys, np.arange(entries, dtype="<u4")))[1]
    return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array([blob] * buckets, pa.binary())], names=["b", "e"])


def test_null_ids_come_first_and_stay_apart_from_the_least_id(docs_of):
    text = " ".join(f"a{i}" for i in range(25))
    rows = [(-(1 << 63), text), (None, text), (None, "other " * 3), (7, text)]
    got = sub.remove_repeats(docs_of(rows)).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got} == {(None, 25, 0), (None, 3, 0), (-(1 << 63), 25, 25), (7, 25, 25)}


def test_very_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(sub, "_RUN", 50)  # runs of entries that go on after a cut
    words = " ".join(f"w{i}" for i in range(9000))
    got = sub.remove_repeats(docs_of([(1, words), (2, "head " + words + " tail")]), partitions=1).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got} == {(1, 9000, 0, words.encode()), (2, 9002, 9000, b"head tail")}
