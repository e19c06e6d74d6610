import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloom.llm import byte_bpe, packing

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
THEIRS = tiktoken.Encoding("theirs", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = byte_bpe.ByteBpe(RANKS, P.PATTERN)
CASES = ["", " ", "\n\n  a", "It's ünder 1234567 $$$ Straße", "a" * 3000, "ab" * 2000, " " * 500 + "x", "日本語のテキスト" * 50, "<|endoftext|>", "‍🙂👩‍👩‍👧", "!?" * 900, "0" * 999, "eé" * 700]


@pytest.mark.parametrize("text", CASES)
def test_cases_equal_merges(text):
    ids = np.frombuffer(OURS.encode(text), "<u4").tolist()
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst enthéß\n")), max_size=60))
def test_any_text_equals_merges(text):
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == THEIRS.encode_ordinary(text)


def test_encode_frame(docs_of):
    rows = [(1, "héllo wörld", 1), (2, None, 1), (None, "x", 1), (1, "héllo wörld", 1)]
    got = byte_bpe.encode_documents(docs_of(rows, "doc_id long, text string, ids int"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert [(r.doc_id, r.ids, bytes(r.decoded)) for r in got] == [(i, THEIRS.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]


def test_packing_frame(docs_of):
    r = random.Random(1)
    texts = {i: " ".join(r.choice(["the", "of", "naïve", "Straße", "x9", "<|endoftext|>"]) for _ in range(r.choice([0, 3, 50, 700, 5000]))) for i in range(150)}
    rows = [(i, t, 0) for i, t in texts.items()] + [(500, None, 0), (None, "null id", 0)]
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert theirs.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = packing.pack_documents(docs_of(rows, "doc_id long, text string, piece int"), P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_bin.setdefault(p.sequence_id, []).append(p)
    for i, t, _ in rows:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda p: p.piece)
        assert [x for p in parts for x in p.ids] == ids
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 2048 for p in parts[1:])
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and ids[p.start : p.start + p.length] == p.ids for p in parts)
    for parts in by_bin.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(p.length for p in parts) <= 2048
    assert packing.pack_documents(docs_of([]), P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_best_fit_is_near_the_bound():
    r = random.Random(3)
    fit = packing.BestFit(2048, 64)
    lengths = [r.choice([r.randrange(1, 2049), r.randrange(1, 300)]) for _ in range(20_000)]
    used = {}
    for n in lengths:
        b, at = fit.place(n)
        assert at == used.get(b, 0)
        used[b] = at + n
        assert fit.open <= 64
    assert max(used.values()) <= 2048 and len(used) <= 1.03 * sum(lengths) / 2048


def brute_best_fit(lengths, size, most):
    """Places by a plain look at all open bins: (free space taken from, whether the bin is new)."""
    free, out = [], []
    for n in lengths:
        fits = [f for f in free if f >= n]
        space = min(fits) if fits else size
        if fits:
            free.remove(space)
        elif len(free) >= most and n < size:
            free.remove(min(free))  # the fullest closes
        out.append((space, not fits))
        if space > n:
            free.append(space - n)
    return out


@pytest.mark.parametrize(("most", "seed"), [(1, 1), (3, 2), (16, 3), (1000, 4)])
def test_best_fit_equals_a_plain_one(most, seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randrange(1, 65), 64, 1, 32, 33]) for _ in range(2000)]
    fit, seen, got = packing.BestFit(64, most), set(), []
    for n in lengths:
        b, at = fit.place(n)
        got.append((64 - at, b not in seen))
        seen.add(b)
    assert got == brute_best_fit(lengths, 64, most)


def test_a_hot_row_is_dealt_to_all_tasks(docs_of):
    """Rows that are all alike, and null ids, meet in no single task."""
    rows = [(None, "same text", 0)] * 3000 + [(5, "same text", 0)] * 3000
    docs = docs_of(rows, "doc_id long, text string, piece int").repartition(4)
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(deal" in plan
    assert sorted((x.doc_id is None, x.n) for x in got.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()) == [(False, 3000), (True, 3000)]


def test_ties_and_clashing_columns(docs_of):
    rows = [(i, "tie", 7, "x", 3) for i in range(50)] + [(1, "x " * 30_000, 8, "y", 4)]
    got = packing.pack_documents(docs_of(rows, "doc_id long, text string, length int, ids string, sequence_id int"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    by_bin = {}
    for x in got:
        by_bin.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by_bin.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    ids = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(x.length for x in got) == sum(len(ids.encode(t, add_special_tokens=False).ids) + 1 for _, t, *_ in rows)


def test_order_of_arrival_and_files_that_cannot_be_ranked(docs_of, tmp_path):
    import json

    docs = docs_of([(i, "word " * (i * 37 % 1500)) for i in range(120)])
    path = P.path("byte_bpe_50k.json")
    for runs in (1, 4096):
        packed = packing.pack_documents(docs, path, P.PATTERN, run_rows=runs, open_bins=8).collect()
        spans = {}
        for r in packed:
            spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in spans.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
    with open(path) as file:
        whole = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": whole["model"] | {"merges": whole["model"]["merges"][::-1]}}):
        (tmp_path / "other.json").write_text(json.dumps(whole | change))
        with pytest.raises(ValueError, match="file"):
            packing.vocabulary(str(tmp_path / "other.json"))
