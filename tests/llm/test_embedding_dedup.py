import math
import random

import numpy as np

from codeloom.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) if label is not None and i is not None else None for i, v, label in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a in range(n):
        least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0]) if rows[a][0] is not None else None
    return sorted((rows[a][0], links[a], least[find(a)]) for a in range(n) if rows[a][0] is not None)


def cloud(seed, n, d, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, d))
    rows = []
    for i in range(n):
        c = centres[r.integers(len(centres))]
        rows.append((int(i * 2), [float(np.float32(x)) for x in c + spread * r.normal(size=d) * np.linalg.norm(c) / math.sqrt(d)], int(r.integers(3))))
    return rows


def run(spark, rows, **options):
    got = ed.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options).collect()
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None), got


def test_equals_brute_force(spark):
    rows = cloud(1, 900, 64, 0.12)
    rows += [(3001 + k, rows[5][1], rows[5][2]) for k in range(5)] + [(1, [x * 2 for x in rows[7][1]], rows[7][2])]
    rows += [(4001, None, 1), (4003, [0.0] * 64, 1), (4005, [float("nan")] * 64, 1), (4007, rows[5][1], None), (4009, [1.0, None] * 32, 0), (4011, [], 1), (4013, [1.0, 2.0], 1), (4015, [1.0, 2.01], 1), (4017, [float("inf")] * 64, 2)]
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_hot_cells_are_cut_into_blocks(spark):
    rows = cloud(2, 40, 16, 0.01)[:6]
    r = random.Random(1)
    hot = [(10_000 + k, [x + 0.004 * r.random() for x in rows[0][1]], 0) for k in range(300)]
    got, _ = run(spark, rows + hot, block=64)
    assert got == brute(rows + hot)


def test_edges(spark):
    assert run(spark, [])[1] == []
    _, got = run(spark, [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)])
    assert sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in got) == [(False, 1, 5, True), (False, 1, 5, True), (True, 0, None, True)]


def test_recall_at_the_threshold():
    r = np.random.default_rng(5)
    a = r.normal(size=(5000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = r.normal(size=a.shape)
    n -= (n * a).sum(axis=1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * n
    one = np.zeros(len(a), np.int64)
    x, y = ed.cells(a, one, 0.98), ed.cells(b, one, 0.98)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() >= 0.9995


def test_clashing_columns_and_ties(spark):
    rows = [(1, [1.0, 0.0], 3, 7, 9, "x"), (2, [2.0, 0.0], 3, 7, 9, "y"), (3, [0.0, 1.0], 3, 7, 9, "z"), (4, [1.0, 0.0], 4, 7, 9, "w")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, cid int, n int, v string")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}


def test_labels_themselves_are_compared(spark):
    """Within a cell, too, where labels are told apart by hashes only; labels of other types than whole numbers by their text."""
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.01]])
    rows = np.arange(3)
    assert [x.tolist() for x in ed._links(vectors, rows, rows, np.array([1, 2, 3]), np.array([7, 8, 7]), 0.98)] == [[0], [2]]
    data = [(i, [float(1 + (i % 7 == 0) * 1e-3), float(i % 2)], f"label {i % 3}") for i in range(60)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")).collect())
    assert got == brute(data)
