import math
import random
from collections import Counter

import pytest

from codeloom.llm import language_id as li

PARTS = {"en": "th er on an ing tion ed ly", "de": "sch ung ein en ü ß te keit", "fr": "eau é ou que re le tion ment", "es": "ción mente ar os la ñ do ll"}


def corpus(n=160, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        parts = PARTS[lang].split()
        rows.append((i, " ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(30)), lang, None))
    return rows


def test_held_out_accuracy_and_edges(docs_of):
    rows = corpus()
    model = li.fit(docs_of(rows[:120], "doc_id long, text string, lang string, score int"), documents=20)
    rest = [*rows[120:], (900, None, "en", 1), (901, "1234 !!", None, 2), (None, "", "de", 1), (902, "X" * 5000, None, 1)]
    got = {r.doc_id: r for r in li.predict_language(docs_of(rest, "doc_id long, text string, lang string, score int"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows[120:]) >= 38
    assert [got[i].lang_pred for i in (900, 901, None)] == ["und"] * 3 and got[902].lang_pred in PARTS
    assert all(0 <= r.score <= 1 for r in got.values())
    assert li.predict_language(docs_of([]), model).collect() == []


def test_unseen_words_use_the_longest_known_grams():
    model = li.LanguageModel([("a", 0, "wort", 5), ("b", 0, "mot", 5), ("a", 3, "<wo", 4), ("b", 3, "<mo", 4), ("a", 1, "z", 9), ("b", 1, "q", 9)], {"a": 1, "b": 1})
    assert model.predict("wort")[0] == "a" and model.predict("mohn")[0] == "b"
    assert model.predict("q")[0] == "b" and model.predict("zz")[0] == "a"


def test_no_labels(docs_of):
    model = li.fit(docs_of([(1, "a", None)], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in li.predict_language(docs_of([(1, "abc")]), model).collect()] == ["und"]


def brute_predict(train, text, least=2, alpha=0.5):
    """Word for word: log frequencies from plain counts, unseen words by their longest known n-grams."""
    langs = sorted({lang for _, lang in train})
    counts = {lang: [Counter() for _ in range(6)] for lang in langs}
    words_of = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    for t, lang in train:
        for w in words_of(t):
            counts[lang][0][w] += 1
            for n in range(1, 6):
                for k in range(len(w) + 3 - n):
                    counts[lang][n][f"<{w}>"[k : k + n]] += 1
    for lang in langs:
        counts[lang] = [Counter({x: c for x, c in table.items() if c >= least}) for table in counts[lang]]
    known = [set().union(*(counts[lang][n] for lang in langs)) for n in range(6)]

    def evidence(kind, item):
        logs = [math.log(counts[lang][kind][item] + alpha) - math.log(sum(counts[lang][kind].values()) + alpha * len(known[kind])) for lang in langs]
        return [x - sum(logs) / len(logs) for x in logs]

    score, words = [0.0] * len(langs), words_of(text)
    if not words:
        return "und", 0.0
    for w in words:
        if w in known[0]:
            found, scale = [(0, w)], 1.0
        else:
            found, scale = [], 1.0
            for n in range(min(5, len(w) + 2), 0, -1):
                found = [(n, g) for k in range(len(w) + 3 - n) if (g := f"<{w}>"[k : k + n]) in known[n]]
                if found:
                    scale = 1 / n
                    break
        for f in found:
            score = [s + scale * e for s, e in zip(score, evidence(*f))]
    share = [math.exp((s - max(score)) / math.sqrt(len(words))) for s in score]
    best = share.index(max(share))
    return langs[best], share[best] / sum(share)


def test_predictions_equal_plain_counts(docs_of):
    rows = corpus(60, 3)
    model = li.fit(docs_of(rows[:40], "doc_id long, text string, lang string, score int"))
    texts = [t for _, t, *_ in rows[40:]] + ["zzz qqqq xyxy", "", "ciónheit th", "Ⅷ ½ word", "a1b2"]
    for text in texts:
        want, got = brute_predict([(t, lang) for _, t, lang, _ in rows[:40]], text), model.predict(text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-4)


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ", "١٢٣", "___", "\t\n", "12 34!", "①"])
def test_no_letter_is_undetermined(docs_of, text):
    model = li.LanguageModel([("a", 0, "wort", 5), ("b", 1, "m", 5)], {"a": 1, "b": 1})
    assert model.predict(text) == ("und", 0.0) and model.predict("ª")[0] in "ab"


def test_repeats_ties_long_texts_and_clashing_columns(docs_of):
    rows = corpus(40, 5)
    schema = "doc_id long, text string, lang string, i int, t string, lang_pred string"
    wide = [(i, t, lang, 1, "x", "y") for i, t, lang, _ in rows]
    model = li.fit(docs_of(wide + wide[:3], schema))
    assert (li.fit(docs_of((wide + wide[:3])[::-1], schema).repartition(3)).matrix == model.matrix).all()
    long = (1000, "schung mente " * 100_000, None, 0, None, None)
    got = [(r.doc_id, r.lang_pred, r.score) for r in li.predict_language(docs_of([*wide, wide[0], long], schema), model).collect()]
    assert len(got) == 42 and len({x for x in got if x[0] == 0}) == 1
    even = li.LanguageModel([("b", 0, "wort", 5), ("a", 0, "wort", 5)], {"b": 1, "a": 1})
    assert even.predict("wort") == ("a", 0.5)  # a tie goes to the first language by name


def test_the_sample_is_bounded_by_bytes(spark):
    """Few long documents of many languages: less is learnt, and all languages still are; rows without an id are sampled by their text."""
    rows = [(i if i % 5 else None, f"wort{i % 3} sprache{i % 8} und " * 400, f"l{i % 8}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = lambda m: sum(len(t) for t in m.tables)
    whole, small = li.fit(docs), li.fit(docs, text_bytes=60_000)
    tiny = li.fit(docs, total_bytes=240_000)
    assert set(whole.languages) == set(small.languages) == set(tiny.languages) and size(small) <= size(whole)
