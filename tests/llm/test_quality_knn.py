import random

import numpy as np

from codeloom.llm import quality_knn as q
from codeloom.llm.common import held_out


def prose(r, n=60):
    return " ".join(r.choice(["The", "of", "their", "house,", "walked", "and", "über", "mañana."]) + ("\n" if r.random() < 0.1 else "") for _ in range(n))


JUNK = [lambda t: t.replace(" ", " | "), lambda t: " ".join(w + "%%%" for w in t.split()), lambda t: " ".join(w.upper() + "!!" for w in t.split()), lambda t: " ".join(w for w in t.split()[::9] for _ in range(9))]


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = prose(r)
        good = r.random() < 0.7
        out.append((i, t if good else r.choice(JUNK)(t), int(good)))
    return out


def test_held_out_accuracy_and_edges(docs_of, spark):
    data = rows(400, 1)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data[:250]] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, t, 0) for i, t, _ in data] + [(900, None, 0), (901, "", 0), (None, "text", 0)], "doc_id long, text string, y int")
    model = q.fit(docs, labels, sample=60)
    assert len(model.vectors) < 200
    got = {r.doc_id: r.score for r in q.score_quality(docs, model).collect()}
    assert got[900] == got[901] == 0.5 and 0 <= got[None] <= 1
    assert sum((got[i] >= 0.3) == bool(y) for i, _, y in data[250:]) >= 147


def test_without_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = docs_of([(1, "a b")])
    assert [r.score for r in q.score_quality(docs, q.fit(docs, none)).collect()] == [0.5]
    assert q.score_quality(docs_of([]), q.fit(docs, none)).collect() == []


def brute_terms(text):
    """Terms counted one by one, by name."""
    import re

    import xxhash

    words = text.split()
    out = [0.0] * q.COLUMNS
    for w in text.lower().split():
        out[xxhash.xxh64_intdigest(w) % q.WORDS] += 1 / len(words)
    kinds = [(rb"[A-Z]+", b"A"), (rb"[a-z\x80-\xff]+", b"a"), (rb"[0-9]+", b"0")]
    for w in words:
        runs = [m.group() for m in re.finditer(rb"[A-Z]+|[a-z\x80-\xff]+|[0-9]+|(.)\1*", w, re.DOTALL)]
        shape = b"".join(next((to for pattern, to in kinds if re.fullmatch(pattern, x)), x[:1]) for x in runs)
        out[q.WORDS + xxhash.xxh64_intdigest(shape) % q.SHAPES] += 1 / len(words)
    for lag in (1, 2, 3):
        out[q.WORDS + q.SHAPES + lag - 1] = sum(a == b for a, b in zip(words, words[lag:])) / max(len(words), 1)
    return out


def test_terms():
    assert not q.terms(b"").any()
    for text in (b"Ab Ab 12!", "Über mañana -- 3.14 a||b".encode(), b"x " * 500, b"One two one two THREE!!"):
        assert np.allclose(q.terms(text), brute_terms(text), atol=1e-6)
    assert not q.terms(b"a B", ("words",))[q.WORDS :].any() and not q.terms(b"a B", ("shapes",))[: q.WORDS].any()


def test_scores_equal_brute_votes(docs_of, spark):
    data = rows(150, 5)
    labels = spark.createDataFrame([(i, y) for i, _, y in data[:100]], "doc_id long, quality int")
    docs = docs_of([(i, t) for i, t, _ in data])
    model = q.fit(docs, labels)
    got = {r.doc_id: r.score for r in q.score_quality(docs, model).collect()}
    for i, t, _ in data:
        v = np.sqrt(np.array(brute_terms(t.encode()))) @ model.project
        v = v / np.linalg.norm(v)
        near = sorted(((float(v @ w) / float(np.linalg.norm(w)), y) for w, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
        votes = [(max(c, 0.0) ** model.power, y) for c, y in near]
        assert abs(got[i] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 2e-3


def test_any_order_repeats_long_texts_and_clashing_columns(docs_of, spark):
    data = rows(120, 6)
    long = (3000, "word shape 12 " * 40_000, "s", 0.25, 1)
    whole = [(i, t, "x", 0.5, 1) for i, t, _ in data] + [long, (5, data[5][1], "x", 0.5, 1), (5, data[5][1], "x", 0.5, 1)]
    labels = spark.createDataFrame([(i, y) for i, _, y in data] * 2 + [(0, 1)], "doc_id long, quality int")
    schema = "doc_id long, text string, t string, score double, i int"
    one = q.fit(docs_of(whole, schema), labels)
    other = q.fit(docs_of(whole[::-1], schema).repartition(3), labels)
    assert np.array_equal(one.project, other.project) and len(one.vectors) == 120
    got = [(r.doc_id, r.score) for r in q.score_quality(docs_of(whole, schema), one).collect()]
    assert len(got) == len(whole) and len({s for i, s in got if i == 5}) == 1 and all(0 <= s <= 1 for _, s in got)
    kept = q.with_quality(docs_of(whole, schema), one).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "t", "score", "i"} and {r.t for r in kept} == {"x", "s"}


def test_accuracy_with_and_without_shapes(spark):
    """Held-out rows of the driver's table: all families, and words alone."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.where(held_out("doc_id", 5, 0)).collect()}
    own = docs.where(held_out("doc_id", 5, 0))
    right = {}
    for families in (("words", "shapes"), ("words",)):
        model = q.fit(docs, labels.where(~held_out("doc_id", 5, 0)), families=families)
        right[families] = sum((r.score >= 0.3) == (truth[r.doc_id] > 0) for r in q.score_quality(own, model).collect() if r.doc_id in truth)
    known = sum(r.doc_id in truth for r in own.select("doc_id").collect())
    print(right, known)
    assert right["words", "shapes"] >= 0.98 * known and right["words",] >= 0.93 * known
