"""Corpus operators in hard cases: names that clash, repeated and null ids, long values, collisions, against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import ann, boosting, exact_dedup, mixing, near_join, packing, pseudonyms, quality, spans, streams, tokens, toxicity
from rasterweave.llm.components import components
from rasterweave.llm.shared import free_names
from rasterweave.llm.tokens import WordEncoder, tokenizer_path

A, B, C, D, E, G = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcdeg")
#: Names that operators use inside, as columns of the input.
NAMES = ["__key", "__id", "__KEY2", "__text", "__m", "__pieces", "__new", "__joined", "__found", "__words", "__size", "__source", "__copies", "__copy", "__class", "hub", "bucket", "tag", "__tag", "class", "a.b", "place", "owner", "n"]
CASES = [(1, A), (2, A + " more"), (2, B), (3, C), (3, C), (5, C + " near"), (5, D), (None, E), (None, E + " near"), (None, E), (None, None), (7, None), (8, ""), (9, G.upper()), (10, G), (10, "x 10.0.0.1 y")]


@pytest.fixture(scope="module")
def clash(spark):
    """CASES with a number of its own in each row and columns of those names."""
    rows = [(i, t, "s", k, *(f"{n}{k}" for n in NAMES)) for k, (i, t) in enumerate(CASES)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", "serial", *NAMES]).repartition(3)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_free_names():
    assert free_names(["a", "__KEY", "__id_"], "__key", "__id", "a") == ["__key_", "__id", "a_"]


def test_drop_copies_keeps_rows_whole(clash):
    left = exact_dedup.drop_copies(clash)
    assert left.columns == clash.columns
    whole = {tuple(r) for r in clash.collect()}
    got = as_rows(left)
    assert set(got) <= whole and len(set(got)) == len(got)
    last = {}
    for i, t in CASES:
        last[lower(t)] = max((x for x in (i, last.get(lower(t))) if x is not None), default=None)
    assert sorted(((r[0], lower(r[1])) for r in got), key=str) == sorted(((i, t) for t, i in last.items()), key=str)


def test_texts_of_one_hash_are_compared(spark, monkeypatch):
    real, rows = F.xxhash64, [(i, f"text {i % 7:02d}" + " same" * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * (1 << 58) if len(c) == 1 else real(*c))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df, capacity=1, max_depth=4).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))


def test_one_of_each_keeps_rows_whole(clash):
    left = near_join.one_of_each(clash)
    assert left.columns == clash.columns
    got = as_rows(left)
    assert set(got) <= {tuple(r) for r in clash.collect()} and len(set(got)) == len(got)
    texts = Counter((r[0], r[1]) for r in got)
    near_e = texts.pop((None, E), 0) + texts.pop((None, E + " near"), 0)
    none = texts.pop((None, None))
    # one row of each component; unique texts under repeated ids stay
    assert near_e == none == 1
    assert texts == Counter([(1, A), (2, B), (3, C), (5, D), (7, None), (8, ""), (9, G.upper()), (10, "x 10.0.0.1 y")])


def test_mixed_documents_keep_rows_whole(clash):
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns
    got = Counter(tuple(r) for r in mixed.collect())
    assert set(got) <= {tuple(r) for r in clash.collect()} and max(got.values()) <= 3
    copies = defaultdict(int)
    for r in mixing.mix_sources(clash).collect():
        copies[r["doc_id"], r["size"]] = max(copies[r["doc_id"], r["size"]], r["copies"])
    for r in clash.collect():
        assert got[tuple(r)] == copies[r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))]


def test_pseudonyms_leak_nothing_through_other_columns(clash):
    out = pseudonyms.pseudonymize(clash, "secret")
    assert out.columns == [*clash.columns, "__found_"]
    before = {r["serial"]: r for r in clash.collect()}
    for r in out.collect():
        for c in clash.columns:
            if c != "text":
                assert r[c] == before[r["serial"]][c]
        assert "10.0.0.1" not in (r["text"] or "")
    with pytest.raises(ValueError):
        pseudonyms.pseudonymize(clash, "")


def test_clean_keep_passes_columns(clash, spark):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert as_rows(toxicity.keep_clean(clash, labels)) == as_rows(clash)


def test_dates_of_a_form_never_meet(spark):
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    us = days.select(F.date_format("d", "MM/dd/yyyy").alias("m"))
    eu = days.filter("day(d) > 12").select(F.date_format("d", "dd/MM/yyyy").alias("m"))
    both = us.unionByName(eu).repartition(8)
    out = both.select("m", F.expr(pseudonyms._date("k", "m")).alias("p"), F.expr(pseudonyms.kind_of("m")).alias("k"))
    n, different, same_kind = out.agg(F.count("*"), F.countDistinct("p"), F.sum((F.substring("m", 1, 2).cast("int") > 12).eqNullSafe(F.substring("p", 1, 2).cast("int") > 12).cast("int"))).first()
    assert n == different == same_kind > 110_000
    assert out.filter("k <> 'date' or p not rlike '^[0-9]{2}/[0-9]{2}/[0-9]{4}$'").count() == 0


def test_long_values_leave_nothing_in_clear(spark):
    secret, digits, name = "Zq9" * 334, "0a1b2c3d4e" * 14, "n" * 100
    texts = [f"password={secret} end", f"see {digits} end", f"write {name}@mail.example.org. Then", "password=password now", "token: 'abcdefgh12'", f"pwd={'x' * 50_000}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in pseudonyms.pseudonymize(df, "k").orderBy("doc_id").collect()]
    assert [len(t) for t in out[:2]] == [len(t) for t in texts[:2]] and out[0].startswith("password=") and out[0].endswith(" end")
    assert "Zq9" not in out[0] and digits[-12:] not in out[1] and "nnn" not in out[2] and out[2].endswith("@mail.example.org. Then")
    assert out[3].startswith("password=") and not out[3].startswith("password=password") and out[3].endswith(" now")
    assert re.fullmatch("token: '[0-9a-f]{10}'", out[4]) and "xxx" not in out[5] and len(out[5]) == len(texts[5])


def test_keys_are_drawn_or_set(spark):
    drawn = pseudonyms.session_key(spark)
    assert len(drawn) == 32 and pseudonyms.session_key(spark) == drawn
    spark.conf.set(pseudonyms.KEY_SETTING, "mine")
    assert pseudonyms.session_key(spark) == "mine"
    spark.conf.unset(pseudonyms.KEY_SETTING)


def cosine(a, b):
    a, b = np.array(a, np.longdouble), np.array(b, np.longdouble)
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def test_neighbours_of_tiny_and_huge_vectors_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=8) * (1e-200 if i % 7 == 0 else 1e200 if i % 5 == 0 else 1)).tolist()) for i in range(200)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(200, 260)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (300, [5e-324] * 5), (301, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 50 == 0 and v:
            near = sorted((-cosine(v, w), j) for c, (j, w) in enumerate(rows) if c != q and len(w) == len(v))[:5]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(near)]
    for options in ({}, {"query_rows": 2, "sample_rows": 100}, {"sample_rows": 1}):
        got = [tuple(r) for r in ann.search(df, **options).collect()]
        assert sorted(Counter((q, r) for q, r, *_ in got).items()) == sorted(Counter((q, r) for q, r, *_ in want).items())
        assert sorted((q, r, round(s, 9)) for q, r, _, s in got) == sorted((q, r, round(s, 9)) for q, r, _, s in want)
        assert {(q, j) for q, _, j, _ in got} == {(q, j) for q, _, j, _ in want}


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    a, b = (as_rows(ann.search(df.repartition(n), every=10)) for n in (1, 7))
    assert a == b


def plain_counts(text, vocabulary):
    found = Counter(re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode()))
    hashes = {w: int(toxicity.word_hashes([w], toxicity.LETTERS)[0][0]) for w in found}
    return [next((n for w, n in found.items() if hashes[w] == int(v)), 0) for v in vocabulary]


def test_chain_against_plain_python(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    rows = []
    for i in range(400):
        w = rng.choice(vocabulary, 40).tolist()
        if i % 4 == 0:
            w[3], w[9], w[20] = "Vile", "vile", rng.choice(["nasty", "VILE"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    chain = toxicity.fit_toxicity(df, df)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(df.unionByName(spark.createDataFrame([(-1, None, 0), (-2, "", 0)], df.schema)), chain).collect()}
    for i, text, _ in [*rows[:25], (-1, None, 0), (-2, "", 0)]:
        x = [np.log1p(n) for n in plain_counts(text, chain.vocabulary)]
        for name, beta in zip(toxicity.CATEGORIES, chain.models, strict=True):
            p = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, beta[:-1])) + beta[-1])))
            x.append(2 * p)
            assert scored[i][f"p_{name}"] == pytest.approx(p, abs=1e-4)
        assert scored[i]["rejected"] == (scored[i]["p_toxic"] >= chain.cut)
    assert np.mean([scored[i]["rejected"] == bool(t) for i, _, t in rows]) > 0.97


def test_out_of_fold_predictions_see_no_label_of_their_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 200, 30)) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fold = {r["doc_id"]: r["f"] for r in df.select("doc_id", ((F.xxhash64("doc_id") % toxicity.FOLDS + toxicity.FOLDS) % toxicity.FOLDS).alias("f")).collect()}
    turned = spark.createDataFrame([(i, t, y if fold[i] != 2 else 1 - y) for i, t, y in rows], df.schema)
    a, b = (toxicity.fit_toxicity(x, x).out_of_fold for x in (df, turned))
    own = np.array([fold[i] == 2 for i, _, _ in sorted(rows)])  # rows are fitted in order of id
    assert len(a) == 300 and np.allclose(a[own, 0], b[own, 0], atol=1e-5) and not np.allclose(a[~own, 0], b[~own, 0], atol=1e-5)


def test_trees_against_plain_traversal():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 5)), rng.integers(0, 3, (500, 5))])
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.BoostedTrees(20, 3).fit(x, y)
    edge = [[model.threshold[r, 0] if f == j else 0.0 for j in range(5)] for r in range(20) for f in [model.feature[r, 0]]]
    for row in [*x[::50], *np.array(edge)]:
        score = model.base
        for r in range(20):
            node = 0
            while model.feature[r, node] >= 0:
                node = 2 * node + (2 if row[model.feature[r, node]] > model.threshold[r, node] else 1)
            score += model.value[r, node]
        assert model.predict(row[None])[0] == pytest.approx(1 / (1 + np.exp(-score)), rel=1e-12)
    assert model.predict(np.zeros((0, 5))).shape == (0,)
    assert (model.predict(np.repeat(x[:1], 3, 0)) == model.predict(x[:1])[0]).all()


def test_statistics_against_plain_python():
    texts = ["", "One two, THREE! four\n\none two, THREE! four\nnext | line 12", "a" * 3000, "Ünder ünder. ünder! $x \"q\" (r)", "word\n" * 50]
    got = quality.statistics([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        raw, row = t.encode(), dict(zip(quality.FEATURES, row, strict=True))
        for name, members in quality._CLASSES.items():
            assert row[name] == pytest.approx(sum(c in members for c in raw) / max(1, len(raw)))
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
        n = max(1, len(words))
        lines = [tuple(w for w in re.split(rb"[\x20\x09-\x0d]+", x) if w) for x in raw.split(b"\n")]
        lines = [x for x in lines if x]
        want = {
            "log_bytes": np.log1p(len(raw)),
            "log_words": np.log1p(len(words)),
            "word_len": sum(map(len, words)) / n,
            "long_words": sum(len(w) > 12 for w in words) / n,
            "short_words": sum(len(w) <= 3 for w in words) / n,
            "distinct": len(set(words)) / n,
            "top_word": max(Counter(words).values(), default=0) / n,
            "line_words": len(words) / max(1, len(lines)),
            "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
            "stop_words": sum(w.endswith(b".") for w in words) / n,
            "one_case": sum(w[:1].isupper() for w in words) / n,
        }
        for name, value in want.items():
            assert row[name] == pytest.approx(value), name


def plain_ranges(docs):
    """Byte ranges that go, by comparing spans' own words; documents in order of id."""
    first, gone = {}, defaultdict(list)
    for i, text in sorted(docs):
        raw = text.encode()
        _, _, _, start, end = spans.text_spans([raw])
        for a, b in sorted(zip(start.tolist(), end.tolist())):
            words = tuple(raw[a:b].split())
            if first.setdefault(words, (i, a)) != (i, a):
                gone[i].append((a, b))
    return gone


def test_repeats_against_plain_python(spark):
    rng = np.random.default_rng(9)
    sentence = lambda: " ".join(f"v{k}" for k in rng.integers(0, 400, rng.integers(3, 25))).capitalize() + rng.choice([".", "!", "", "\n"])
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(8)]
    docs = [(i, " ".join([*(sentence() for _ in range(rng.integers(0, 5))), *(shared[k] for k in rng.integers(0, 8, rng.integers(0, 3))), *(sentence() for _ in range(rng.integers(0, 5)))])) for i in range(120)]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    gone = plain_ranges(docs)
    assert len(gone) > 30
    for i, text in docs:
        raw, keep = text.encode(), np.ones(len(text.encode()), bool)
        for a, b in gone[i]:
            keep[a:b] = False
        left = bytes(c for c, k in zip(raw, keep) if k)
        assert got[i]["text"].encode() == left and got[i]["removed_bytes"] == len(raw) - len(left) and got[i]["changed"] == bool(gone[i])


def test_many_short_texts_pack_without_padding(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).repartition(2)
    out = packing.pack_documents(df, max_tokens=2048, max_segments=512).groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["t"] for r in out) == 3000 * 4 and all(r["t"] == 2048 or r["t"] & (r["t"] - 1) == 0 for r in out) and max(r["n"] for r in out) <= 512
    with pytest.raises(ValueError):
        packing.pack_documents(df, max_loss=0)


def test_three_limits_bind_for_instruction_data():
    rng = np.random.default_rng(2)
    items = np.stack([np.arange(900), np.zeros(900, int), rng.integers(5, 300, 900), np.zeros(900, int)], 1)
    items[:, 3] = (items[:, 2] * rng.uniform(0, 1, 900)).astype(int)
    limits, bound = (1024, 12, 420), Counter()
    packer = packing.Packer(limits, cut=False, waiting=200)
    loss, size = dict(zip(items[:, 0].tolist(), items[:, 3].tolist())), dict(zip(items[:, 0].tolist(), items[:, 2].tolist()))
    seen = []
    for sequence in [*packer.take(items), *packer.take(items[:0], last=True)]:
        total = [sum(n for _, _, n in sequence), len(sequence), sum(loss[k] for k, _, _ in sequence)]
        assert all(a <= b for a, b in zip(total, limits)) and all(size[k] == n for k, _, n in sequence)
        bound.update(k for k in range(3) if total[k] > 0.95 * limits[k])
        seen += [k for k, _, _ in sequence]
    assert sorted(seen) == list(range(900)) and len(bound) == 3


def test_classes_whose_digests_clash_are_told_apart(spark, monkeypatch):
    rows = [(i, t, "s") for i, t in enumerate([A, A + " x", B, B, C, "", D])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    real = near_join.digests
    assert near_join.class_of(np.array([1, 2], np.uint64), frozenset([real(np.array([1, 2], np.uint64))[0]])) == real(np.array([1, 2], np.uint64))[1]
    own = near_join._sets

    def clashing(texts):
        return own(texts).withColumn("class", F.when(F.col("kind") == 0, F.lit(77)).otherwise(F.col("class")).cast("long"))

    monkeypatch.setattr(near_join, "_sets", clashing)
    monkeypatch.setattr(near_join, "class_of", lambda s, clashes=frozenset(): near_join.digests(s)[1] if 77 in clashes else near_join.digests(s)[0])
    got = {r["doc_id"]: r["component_id"] for r in near_join.near_components(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def test_tokens_of_very_many_classes(spark, monkeypatch):
    monkeypatch.setattr(near_join, "HOT_TOKEN", 6)
    monkeypatch.setattr(near_join, "HOT_CLASSES", 4)
    rng = np.random.default_rng(4)
    # ends of a few kinds in texts of many sizes; beginnings that make two in three of a kind alike
    ends = [" ".join(f"e{k}x{j}" for j in range(30)) for k in range(3)]
    rows = [(i, " ".join(f"b{i if i % 3 == 0 else i % 3}y{j}" for j in range(rng.integers(4, 9))) + " " + ends[i % 2]) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i in sets}
    for _ in range(60):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(set(want.values())) < 55


def test_units_hold_every_pair_once():
    rng = np.random.default_rng(5)
    cls, hub, size = np.arange(23), rng.integers(0, 5, 23), rng.integers(10, 40, 23)
    near_join_units = list(near_join._hot_units(cls, hub, size, 75))
    got = Counter()
    for raw, cut in near_join_units:
        a, b, need = near_join._pairs_of_unit(raw, cut, 75)
        got.update(zip(a.tolist(), b.tolist(), need.tolist()))
    want = Counter((i, j, 1 + min(size[i], size[j]) // 32) for i in range(23) for j in range(i + 1, 23) if hub[i] != hub[j] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]))
    assert got == want


def test_counts_shared_by_pairs():
    rng = np.random.default_rng(1)
    left, right = ([rng.integers(0, 30, n).astype(np.uint32) for n in rng.integers(0, 40, 50)] for _ in range(2))
    want = [sum((Counter(a.tolist()) & Counter(b.tolist())).values()) for a, b in zip(left, right)]
    assert near_join.shared_counts(left, right).tolist() == want and near_join.shared_counts([], []).tolist() == []


def test_runs_and_groups_of_sorted_batches():
    import pyarrow as pa

    batches = [pa.record_batch({"a": [1, 1, 2], "b": [0, 0, 0], "v": [1, 2, 3]}), pa.record_batch({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "v": pa.array([], pa.int64())}), pa.record_batch({"a": [2, 2, 3], "b": [0, 1, 1], "v": [4, 5, 6]})]
    assert [(k, t.column("v").to_pylist()) for k, t in streams.sorted_groups(batches, 2)] == [((1, 0), [1, 2]), ((2, 0), [3, 4]), ((2, 1), [5]), ((3, 1), [6])]


def test_components_ignore_repeats_and_have_null_free_nodes(spark):
    links = spark.createDataFrame([(5, 3), (3, 5), (5, 3), (4, 4), (9, 8), (8, 3)], "a long, b long")
    assert dict(components(links).collect()) == {3: 3, 5: 3, 8: 3, 9: 3}


def test_encoder_in_slices(monkeypatch):
    texts = [None, b"", b"one two", b"one two", ("long " * 5000).encode()]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 8)
    encode = WordEncoder(tokenizer_path())
    ids, counts = encode.encode(texts)
    want = [encode.tokenizer.encode((t or b"").decode(), add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert [x.tolist() for x in encode.encode([])] == [[], []]




def test_encoder_hands_over_bounded_runs_of_words(monkeypatch):
    words = [f"{a}{b}{c}" for a in ("al", "be", "ga") for b in ("x", "1", "é") for c in range(60)] + ["plain"] + [f"{x}{y}" for x in "abcdefgh" for y in "ijklmnop"]
    monkeypatch.setattr(tokens, "AT_ONCE", 16)
    monkeypatch.setattr(tokens, "LINE_WORDS", 4)
    encode, most = WordEncoder(tokenizer_path()), []
    tokenizer = encode.tokenizer

    class Watched:
        def encode_batch_fast(self, lines, **options):
            most.append(sum(len(x.split()) for x in lines))
            return tokenizer.encode_batch_fast(lines, **options)

    encode.tokenizer = Watched()
    ids, counts = encode.encode([" ".join(words).encode(), None])
    want = tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert ids.tolist() == want and counts.tolist() == [len(want), 0]
    assert sum(most) == len(words) and max(most) <= 16


def test_a_task_of_another_operator_drops_encoders():
    def fill(batches):
        held.append(tokens.encoder(remembered=3))
        yield from batches

    def other(batches):
        yield from batches

    held: list = []
    fill.__module__, other.__module__ = "one", "two"
    for _ in range(2):
        assert list(streams.trimmed(fill)(iter([1, 2]))) == [1, 2]
    assert held[0] is held[1] and tokens._BY_PATH
    assert list(streams.trimmed(other)(iter([3]))) == [3]
    assert not tokens._BY_PATH


def test_packing_is_the_same_whatever_is_remembered(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and other{i} words, {i}" * (i % 5)) for i in range(60)], "doc_id long, text string").coalesce(1)
    few, many = (packing.pack_documents(docs, tokenizer_path(), remembered=n).orderBy("sequence_id", "offset").collect() for n in (2, None))
    assert few == many and len(few) >= 60
