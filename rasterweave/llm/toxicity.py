"""Toxicity by a chain of linear classifiers over the categories ``CATEGORIES``.

Labelled documents give the words that speak for toxicity (``lexicon``: those seen in toxic documents and hardly
elsewhere, with the strongest evidence). The labels hold one verdict, so two categories are derived from it and the
lexicon: *explicit*, a toxic document with such a word, and *sustained*, one with several uses. Each category has a
logistic model; later ones also see the probabilities of the earlier ones. For training, these are out-of-fold
predictions, so a later model meets earlier ones as unsure as they are on new text: words, lexicon and models of a fold
are those of the other folds' labels alone. The cut for the last category, *toxic*, is the one with the best F1 on
out-of-fold predictions, weighted back to the labels' shares.

The models are fitted on at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents, those with the smallest
hashes; every document is scored from its whole text.

Defined cases: null text is empty; a text without words has the probability of the intercepts; repeated rows are
scored alike; a null id is scored too; ids labelled twice count with the larger label; with no label of one kind
the chain calls nothing toxic; other columns do not matter, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rasterweave.llm.shared import materialize, named, spread, text_batches
from rasterweave.llm.streams import trimmed
from rasterweave.llm.wordhash import LETTERS, blocks, word_hashes

SAMPLE_TOXIC, SAMPLE_CLEAN = 8_000, 12_000
#: Words that the models look at, and folds.
WORDS, FOLDS = 192, 5
#: Documents scored at once.
SLICE = 1_000
CATEGORIES = ("explicit", "sustained", "toxic")
_MET = [f"{kind}{k}" for k in range(FOLDS) for kind in ("good", "bad")]


def _lower(texts: list[str | None]) -> list[bytes]:
    return [t.lower().encode() if t else b"" for t in texts]


def count_words(texts: list[str | None], vocabulary: np.ndarray) -> np.ndarray:
    """How often each text has each word of the sorted hashes ``vocabulary``."""
    out = np.zeros((len(texts), len(vocabulary)), np.float32)
    if not len(vocabulary):
        return out
    raw = _lower(texts)
    for a, b in blocks(raw):
        h, edges, *_ = word_hashes(raw[a:b], LETTERS)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == h)
        doc = np.searchsorted(edges, hit, side="right") - 1
        np.add.at(out, (a + doc, at[hit]), 1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights, the intercept last, by accelerated gradient descent on the weighted logistic loss."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    beta = np.zeros(x.shape[1], np.float32)
    ahead, t = beta, 1.0
    ridge = np.full(len(beta), l2, np.float32)
    ridge[-1] = 1e-3
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = x.T @ (w * (x @ v))
        v /= max(np.linalg.norm(v), 1e-9)
    step = 1 / (0.25 * float(v @ (x.T @ (w * (x @ v)))) * 1.05 + l2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (w * (p - y)) + ridge * ahead)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, beta = new + (last - 1) / t * (new - beta), new
    return beta


def _predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    # a sum of each row by itself: a row's result does not depend on its neighbours
    return 1 / (1 + np.exp(-np.clip((x * beta[:-1]).sum(1, dtype=np.float64) + beta[-1], -30, 30)))


class ToxicityChain:
    """``vocabulary``: sorted word hashes; ``models``: a weight vector per category; ``cut``: for the last one."""

    def __init__(self, vocabulary: np.ndarray, models: list[np.ndarray] | None = None, cut: float = 2.0):
        self.vocabulary, self.models, self.cut, self.out_of_fold = vocabulary, models or [], cut, np.zeros((0, len(CATEGORIES)), np.float32)

    def fit(self, counts: np.ndarray, toxic: np.ndarray, weight: np.ndarray, fold: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> "ToxicityChain":
        """``counts``: how often each document has each word that any choice of words has.

        ``words``: for each fold the places in ``counts`` of the words chosen without its labels, and which of them are
        in the lexicon; last, those chosen from all labels, in the order of the vocabulary.
        """
        logs = np.log1p(counts)
        targets = []
        for at, lexicon in words:
            hits = counts[:, at[lexicon]].sum(1)
            targets.append([(toxic * (hits > least)).astype(np.float32) for least in (0, 2)] + [toxic.astype(np.float32)])
        earlier = np.zeros((len(toxic), 0), np.float32)
        for c in range(len(CATEGORIES)):
            out_of_fold = np.zeros(len(toxic))
            for k, (at, _) in enumerate(words[:-1]):
                use, x = fold != k, np.concatenate([logs[:, at], earlier], 1)
                out_of_fold[~use] = _predict(x[~use], fit_logistic(x[use], targets[k][c][use], weight[use]))
            self.models.append(fit_logistic(np.concatenate([logs[:, words[-1][0]], earlier], 1), targets[-1][c], weight))
            earlier = np.concatenate([earlier, out_of_fold[:, None].astype(np.float32) * 2], 1)
        self.out_of_fold = earlier / 2
        order = np.argsort(-out_of_fold, kind="stable")
        right = np.cumsum((toxic * weight)[order])
        f1 = 2 * right / (np.cumsum(weight[order]) + (toxic * weight).sum())
        best = int(np.argmax(f1))
        below = out_of_fold[order[best + 1]] if best + 1 < len(order) else 0.0
        self.cut = float((out_of_fold[order[best]] + below) / 2)
        return self

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A column of probabilities per category."""
        if not self.models:
            return np.zeros((len(texts), len(CATEGORIES)))
        x = np.log1p(count_words(texts, self.vocabulary))
        for beta in self.models:
            x = np.concatenate([x, _predict(x, beta)[:, None].astype(np.float32) * 2], 1)
        return x[:, -len(self.models) :].astype(float) / 2


def judge(chain: ToxicityChain, texts: pa.Array) -> np.ndarray:
    """The chain's probabilities for texts, some at a time."""
    parts = [chain.predict(texts.slice(at, SLICE).to_pylist()) for at in range(0, len(texts), SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES)))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled documents (y, fold, text), and how many labels of each kind there are."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = materialize(known, "toxic-labels")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    drawn = materialize(drawn[0].unionByName(drawn[1]), "toxic-drawn")
    texts = text_batches(spread(docs)).select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", (F.xxhash64("doc_id") % FOLDS + FOLDS).cast("int").alias("fold"), "text")
    return materialize(rows.withColumn("fold", F.col("fold") % FOLDS), "toxic-texts"), total


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN
) -> ToxicityChain:
    rows, total = _labelled(docs, labels, id_col, text_col, label_col, {1: sample_toxic, 0: sample_clean})
    if len(total) < 2:
        return ToxicityChain(np.zeros(0, np.uint64))

    def words(batches):
        for batch in batches:
            raw = _lower(batch.column("text").to_pylist())
            group = np.asarray(batch.column("fold")) * 2 + np.asarray(batch.column("y"))
            for a, b in blocks(raw):
                h, edges, *_ = word_hashes(raw[a:b], LETTERS)
                doc = np.repeat(np.arange(b - a), np.diff(edges))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                values, at = np.unique(h[fresh], return_inverse=True)
                met = np.bincount(at * 2 * FOLDS + group[a:b][doc[fresh]], minlength=2 * FOLDS * len(values)).reshape(-1, 2 * FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), *(pa.array(c) for c in np.ascontiguousarray(met.T))], names=["word", *_MET])

    # In how many clean and toxic documents of each fold a word is; a word rare in all folds is chosen by none.
    per_word = rows.mapInArrow(trimmed(words), "word long, " + ", ".join(f"{c} long" for c in _MET)).groupBy("word").agg(*[F.sum(c).alias(c) for c in _MET])
    per_word = materialize(per_word.filter(" + ".join(_MET[1::2]) + " >= 3"), "toxic-words")
    of_fold = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sampled = {y: sum(n for (_, z), n in of_fold.items() if z == y) for y in (0, 1)}
    if not all(sampled.values()):
        return ToxicityChain(np.zeros(0, np.uint64))

    def chosen(without: int | None) -> dict[int, bool]:
        """The words that speak loudest for toxicity in all folds but one, and whether they are in the lexicon."""
        folds = [k for k in range(FOLDS) if k != without]
        n = [max(1, sum(of_fold.get((k, y), 0) for k in folds)) for y in (0, 1)]
        good, bad = (sum((F.col(_MET[2 * k + y]) for k in folds), F.lit(0)) for y in (0, 1))
        rated = per_word.select("word", good.alias("good"), bad.alias("bad")).filter("bad >= 3")
        rated = rated.withColumn("evidence", F.col("bad") * F.log((F.col("bad") / n[1]) / ((F.col("good") + 0.5) / n[0])))
        ranked = rated.filter("evidence > 0").orderBy(F.col("evidence").desc(), "word").limit(WORDS).collect()
        return {r["word"] % (1 << 64): r["bad"] / n[1] > 20 * (r["good"] + 0.5) / n[0] and r["evidence"] > 12 for r in ranked}

    choices = [chosen(k) for k in (*range(FOLDS), None)]
    every = np.array(sorted(set().union(*choices)), np.uint64)
    places = [(np.flatnonzero([int(w) in c for w in every]), np.array([c[int(w)] for w in every if int(w) in c], bool)) for c in choices]

    def features(batches):
        for batch in batches:
            counts = count_words(batch.column("text").to_pylist(), every)
            packed = pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("fold"), packed], names=["doc_id", "y", "fold", "counts"])

    found = sorted((r["doc_id"], r["y"], r["fold"], bytes(r["counts"])) for r in rows.mapInArrow(trimmed(features), "doc_id long, y int, fold int, counts binary").collect())
    counts = np.stack([np.frombuffer(c, "<u2") for *_, c in found]).reshape(len(found), -1).astype(np.float32)
    y, fold = np.array([r[1] for r in found], np.float32), np.array([r[2] for r in found])
    weight = np.where(y > 0, total[1] / sampled[1], total[0] / sampled[0]).astype(np.float32)
    return ToxicityChain(every[places[-1][0]]).fit(counts, y, weight / weight.mean(), fold, places)


def score_toxicity(docs: DataFrame, chain: ToxicityChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, the probability of each category, rejected (toxic at or above the chain's cut)."""
    rows = text_batches(spread(docs)).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            p = judge(chain, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c), pa.float64()) for c in p.T), pa.array(p[:, -1] >= chain.cut)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "rejected"])

    return rows.mapInArrow(trimmed(run), f"doc_id long, {', '.join(f'p_{c} double' for c in CATEGORIES)}, rejected boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the chain rejects, all columns kept, in one pass over the texts.

    A null text is judged as empty; rows that repeat an id are judged each by its text; a null id is judged too; an empty
    table gives an empty one.
    """
    chain = fit_toxicity(docs, labels, **options)

    at = docs.columns.index("text")
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(docs.schema)])  # names may hold anything

    def run(batches):
        for batch in batches:
            p = judge(chain, batch.column(at))
            yield batch.filter(pa.array(p[:, -1] < chain.cut))

    return text_batches(spread(docs)).toDF(*plain.names).mapInArrow(trimmed(run), plain).toDF(*docs.columns)
