"""Parts of the corpus operators against plain Python; no Spark."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweave.llm import near_join as nj
from rasterweave.llm import spans
from rasterweave.llm.ann import AdditiveQuantizer
from rasterweave.llm.boosting import BoostedTrees
from rasterweave.llm.exact_dedup import build_directory
from rasterweave.llm.packing import Packer, power_of_two_tail
from rasterweave.llm.quality import FEATURES, statistics
from rasterweave.llm.token_store import TokenFile, dac_levels, encode_file
from rasterweave.llm.tokens import WordEncoder, tokenizer_path
from rasterweave.llm.toxicity import fit_logistic
from rasterweave.llm.wordhash import LETTERS, NOT_SPACE, blocks, word_hashes

TEXTS = ["", None, "One two, three!", "  a\tb\x0bc\x85d e ", "Ångström ΣΑΣ İstanbul", "x" * 5000, "it's don't <|endoftext|> <|ENDOFTEXT|> a.b,c", "é É ﬁ 12 3.5 !!", "the the the, The. THE"]


def raw(texts):
    return [None if t is None else t.encode() for t in texts]


def test_words_are_those_of_the_pattern():
    h, edges, *_ = word_hashes(raw(TEXTS), NOT_SPACE)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert np.diff(edges).tolist() == [len(w) for w in words]
    flat, seen = [x for w in words for x in w], {}
    for word, value in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    letters, edges, *_ = word_hashes([b"ab1ab|ab"], LETTERS)
    assert len(set(letters.tolist())) == 1 and edges.tolist() == [0, 3]
    assert [b - a for a, b in blocks([b"1234", b"5", b"123456789", b""], 5)] == [2, 1, 1]


def test_encoder_equals_the_tokenizer():
    e = WordEncoder(tokenizer_path())
    for _ in range(2):
        ids, counts = e.encode(raw(TEXTS))
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert e.encode([])[1].tolist() == []


def test_encoder_forgets_beyond_its_bound(monkeypatch):
    monkeypatch.setattr("rasterweave.llm.tokens.REMEMBERED", 3)
    e = WordEncoder(tokenizer_path())
    for text in ("one two three, four five", "six seven one, eight", "five four three two one"):
        ids, _ = e.encode([text.encode()])
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(e.index) <= 3 and len(e.length) <= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_give_random_access(values, data):
    ids = np.array(values, np.uint32)
    cut = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=4)))
    starts = np.array([0, *cut, len(ids)])
    f = TokenFile(encode_file([None, *range(len(starts) - 2)], starts, ids))
    assert f.doc_ids == [None, *range(len(starts) - 2)]
    assert [f.document(k).tolist() for k in range(f.n_docs)] == [values[a:b] for a, b in zip(starts, starts[1:])]
    for i in range(0, len(values), 97):
        assert f.token(i) == values[i]
    assert sum(len(c) for c, _, _ in dac_levels(ids)) >= len(ids)


def test_token_file_rejects_other_bytes():
    with pytest.raises(ValueError):
        TokenFile(b"nothing of the kind")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(0, 900), max_size=60), st.integers(1, 500))
def test_directory_doubles_until_buckets_hold(counts, capacity):
    slots = build_directory(counts, capacity, 8)
    depth = (len(slots) - 1).bit_length()
    assert len(slots) == 1 << depth and [s for s, _, _ in slots] == list(range(len(slots)))
    for bucket, local in {(b, d) for _, b, d in slots}:
        cells = range(bucket, bucket + (256 >> local))
        total = sum(counts.get(c, 0) for c in cells)
        assert total <= capacity or local == 8
        assert {b for s, b, _ in slots if s << (8 - depth) in cells} == {bucket}
        if local:  # it was split for a reason
            parent = (bucket >> (8 - local + 1)) << (8 - local + 1)
            assert sum(counts.get(c, 0) for c in range(parent, parent + (256 >> (local - 1)))) > capacity


def check_packing(items, sequences, limits, cut):
    pieces: dict = {}
    for s in sequences:
        assert sum(n for _, _, n in s) <= limits[0] and len(s) <= limits[1]
        for key, start, n in s:
            pieces.setdefault(key, []).append((start, n))
    for key, _, n, _ in items:
        at = 0
        for start, k in sorted(pieces.get(key, [])):
            assert start == at
            at += k
        assert at == n and (cut or len(pieces[key]) == 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.floats(0, 1)), max_size=60), st.booleans())
def test_packing_keeps_limits_and_every_token(sizes, cut):
    limits = (32, 3, 20)
    items = [(k, 0, n if cut else min(n, 32), int(min(n, 32) * share) if not cut else int(n * share)) for k, (n, share) in enumerate(sizes)]
    if not cut:
        items = [(k, s, n, min(loss, 20)) for k, s, n, loss in items]
    p, out = Packer(limits, cut, waiting=8), []
    for a in range(0, len(items), 7):
        out += p.take(np.array(items[a : a + 7], np.int64).reshape(-1, 4))
    out += p.take(np.zeros((0, 4), np.int64), last=True)
    check_packing(items, out, limits, cut)


def test_packing_uses_room_and_closes_without_padding():
    p = Packer((64, 64, 64), waiting=8)
    items = np.array([(k, 0, 17, 17) for k in range(50)], np.int64)
    out = list(p.take(items)) + list(p.take(np.zeros((0, 4), np.int64), last=True))
    assert [sum(n for _, _, n in s) for s in out[:-1]] == [64] * (len(out) - 1)
    parts = power_of_two_tail(out[-1])
    assert all(n & (n - 1) == 0 for n in (sum(x for _, _, x in s) for s in parts))


def _sets(texts, words=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f g h".split()), max_size=40).map(" ".join), min_size=2, max_size=12), st.integers(0, 2))
def test_links_equal_brute_force(texts, hot):
    texts += [texts[0] + " z", texts[0].upper()]
    sets = nj.shingle_sets(raw(texts))
    plain = _sets(texts)
    assert [len(s) for s in sets] == [len(s) for s in plain]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values, counts = np.unique(flat, return_counts=True)
    orders = nj.TokenOrders(values[counts > hot], counts[counts > hot])
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if plain[i] and 100 * len(plain[i] & plain[j]) >= 75 * len(plain[i] | plain[j])}
    assert {tuple(p) for p in nj.links_between(sets, None, orders).tolist()} == want
    half = len(sets) // 2
    across = {(i, j) for i, j in want if i < half <= j}
    assert {(i, j + half) for i, j in nj.links_between(sets[:half], sets[half:], orders).tolist()} == across


def test_spanning_keeps_components():
    star = nj.spanning(np.array([[4, 2], [2, 7], [1, 5], [7, 8]]), 9)
    assert sorted(map(tuple, star.tolist())) == [(1, 5), (2, 4), (2, 7), (2, 8)]


def test_long_words_of_one_size_and_small_sets():
    assert nj.shingle_sets([b"", None, b"  ", b"one", b"one two", b"ONE"])[0].size == 0
    few = nj.shingle_sets([b"one", b"one two", b"ONE", b"one two three four"])
    assert [len(s) for s in few] == [1, 1, 1, 1] and few[0] == few[2] and few[0] != few[1]


def test_spans_find_a_passage_wherever_it_stands():
    passage = " ".join(f"word{k}" + ("." if k % 9 == 8 else "") for k in range(60))
    texts = [f"Alpha beta gamma {passage} the end here.", f"Quite other words before. And more\n{passage} then on", "nothing of it at all. " * 3]
    doc, h, _, start, end = spans.text_spans(raw(texts))
    first, second = set(h[doc == 0].tolist()), set(h[doc == 1].tolist())
    shared = first & second
    assert len(shared) >= 3
    cover = np.zeros(len(texts[1]), bool)
    for value, a, b in zip(h[doc == 1].tolist(), start[doc == 1].tolist(), end[doc == 1].tolist()):
        if value in shared:
            cover[a:b] = True
    place = texts[1].index(passage)
    assert cover[place : place + len(passage)].mean() > 0.5 and not cover[:place].any()
    assert all(len(x) == 0 for x in spans.text_spans([b"", b"short one."]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 14), min_size=4, max_size=12), st.integers(0, 6), st.integers(0, 6))
def test_every_whole_sentence_of_a_repeated_run_is_covered(lengths, a, b):
    run = " ".join(" ".join(f"u{i}x{k}" for k in range(n)) + "." for i, n in enumerate(lengths))
    texts = [f"{'p ' * a}start. {run} {'q ' * b}end", f"{'r ' * b}begin. {run} {'s ' * a}stop"]
    doc, h, _, start, end = spans.text_spans(raw(texts))
    shared = set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())
    if sum(lengths) < spans.MIN_WORDS:
        return
    cover = np.zeros(len(texts[1]), bool)
    for value, x, y in zip(h[doc == 1].tolist(), start[doc == 1].tolist(), end[doc == 1].tolist()):
        if value in shared:
            cover[x:y] = True
    place = texts[1].index(run)
    text = np.frombuffer(texts[1].encode(), np.uint8)
    inside = np.zeros(len(text), bool)
    inside[place : place + len(run)] = True
    assert cover[inside & (text != 32)].all() and not cover[: max(0, place - 1)].any()


def test_passages_without_stops_are_found():
    rng, missed = np.random.default_rng(7), 0
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    for _ in range(300):
        passage = word(51)
        texts = [" ".join([*word(rng.integers(0, 30)), *passage, *word(rng.integers(0, 30))]) for _ in range(2)]
        doc, h, check, *_ = spans.text_spans(raw(texts))
        missed += not set(zip(h[doc == 0].tolist(), check[doc == 0].tolist())) & set(zip(h[doc == 1].tolist(), check[doc == 1].tolist()))
    assert missed <= 3


def test_cuts_against_plain_python():
    texts = raw(["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "one two. three four five six seven eight nine ten eleven twelve\nthirteen " * 4])
    h, edges, *_ = word_hashes(texts, NOT_SPACE)
    doc = np.repeat(np.arange(2), np.diff(edges))
    want = [all(0 <= j < len(h) and doc[j] == doc[i] and h[i] < h[j] for j in (*range(i - 4, i), *range(i + 1, i + 5))) for i in range(len(h))]
    assert spans.least_around(h, doc, 4).tolist() == want and any(want)
    assert spans.least_around(h[:3], doc[:3], 4).tolist() == [False] * 3


def test_spans_of_one_hash_but_another_check_stay():
    s = np.zeros(4, spans._SPAN)
    s["hash"], s["check"], s["doc"], s["end"] = 9, [1, 1, 2, 2], [1, 2, 3, 3], 5
    found, fresh = spans._first_of_each(s)
    assert found["doc"].tolist() == [1, 2, 3] and fresh.tolist() == [True, False, True]


def test_ranges_are_disjoint():
    s = np.zeros(5, spans._RANGE)
    s["doc"], s["start"], s["end"] = [1, 1, 1, 2, 2], [0, 5, 20, 3, 3], [10, 12, 30, 6, 9]
    assert [(r["doc"], r["start"], r["end"]) for r in spans._ranges(s)] == [(1, 0, 12), (1, 20, 30), (2, 3, 9)]


def test_trees_learn_and_handle_one_kind():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = BoostedTrees(60, 3).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert BoostedTrees().fit(np.zeros((0, 4)), np.zeros(0)).predict(np.zeros((1, 4))).tolist() == [0.5]
    assert BoostedTrees().fit(x[:9], np.ones(9)).predict(x[:1])[0] > 0.99


def test_statistics_have_a_row_for_any_text():
    out = statistics(raw(TEXTS))
    assert out.shape == (len(TEXTS), len(FEATURES)) and np.isfinite(out).all() and (out[:2] == 0).all()
    assert (statistics(raw(TEXTS[::-1]))[::-1] == out).all()
    assert statistics([]).shape == (0, len(FEATURES))


def test_logistic_finds_the_boundary():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3)).astype(np.float32)
    y = (x[:, 1] > 0.3).astype(np.float32)
    beta = fit_logistic(x, y, np.ones(800, np.float32), 0.1)
    assert (((x @ beta[:3] + beta[3]) > 0) == (y > 0)).mean() > 0.97


def test_quantizer_scores_are_those_of_its_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = AdditiveQuantizer(4, 32, 4).fit(x)
    codes = q.encode(x)
    near = q.decode(codes)
    tables = np.einsum("qd,mkd->qmk", x[:5].astype(np.float32), q.words)
    assert np.allclose(q.scores(tables, codes, np.ones(600, np.float32)), x[:5] @ near.T, atol=1e-4)
    assert ((x - near) ** 2).sum(1).mean() < 0.6
    greedy = AdditiveQuantizer(4, 32, 1)
    greedy.words = q.words
    assert ((x - near) ** 2).sum() <= ((x - greedy.decode(greedy.encode(x))) ** 2).sum()
