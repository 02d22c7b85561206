"""Document quality: boosted trees over statistics of the text alone.

The trees are fitted on at most ``SAMPLE_ROWS`` labelled documents outside the held-out fifth (crc32 of the id as
text, modulo 5, is 0), those with the smallest hashes; every document is scored from its whole text.

Defined cases: null text is empty; the empty text has all statistics 0 and a score like any other; rows that repeat
are scored alike; a null id is held in neither part and scored (held_out false); ids labelled twice count with the
larger label; without labels of both kinds, every score is the labels' mean (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.boosting import BoostedTrees
from rasterweave.llm.shared import materialize, named, spread, text_batches
from rasterweave.llm.streams import trimmed
from rasterweave.llm.wordhash import NOT_SPACE, blocks, word_hashes

#: Labelled documents that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000

_CLASSES = {
    "letter": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)),
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\v\f\r",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~_=+<>/\\{}[]",
    "quote": b"\"'()-",
    "wide": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros((len(_CLASSES), 256), np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[_k, list(_bytes)] = 1

FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_len", "long_words", "short_words", "distinct", "top_word", "ends_odd", "line_words", "repeated_lines", "stop_words", "one_case"]


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of ``FEATURES`` per text; each is a share or a logarithm, so short and long texts compare."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in blocks(texts):
        out[a:b] = _block(texts[a:b])
    return out


def _block(texts: list[bytes | None]) -> np.ndarray:
    n = len(texts)
    h, edges, raw, starts, at = word_hashes(texts, NOT_SPACE)
    size = np.maximum(np.diff(at) - 1, 0)
    out = np.zeros((n, len(FEATURES)))
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(_CLASS_OF[k][raw], dtype=np.int64)])
        out[:, k] = (total[at[1:] - 1] - total[at[:-1]]) / np.maximum(size, 1)
    words = np.diff(edges)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    gap = np.flatnonzero(~NOT_SPACE[raw])
    stop = gap[np.searchsorted(gap, starts)] if len(starts) else starts
    length = stop - starts
    mean = lambda x: np.bincount(doc, x, n) / some
    last = raw[stop - 1] if len(starts) else np.zeros(0, np.uint8)
    head = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][fresh], runs)
    # Lines: their hash is that of their words in turn.
    newline = np.cumsum(raw == 10)
    line = newline[starts] if len(starts) else np.zeros(0, np.int64)
    begins = np.ones(len(h), bool)
    begins[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at_line = np.flatnonzero(begins)
    in_line = np.arange(len(h)) - at_line[np.cumsum(begins) - 1] if len(h) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(h * (2 * in_line.astype(np.uint64) + np.uint64(1)), at_line) if len(h) else np.zeros(0, np.uint64)
    line_doc = doc[at_line]
    lines = np.bincount(line_doc, minlength=n)
    line_order = np.lexsort((line_hash, line_doc))
    same = np.zeros(len(line_hash), bool)
    same[1:] = (line_hash[line_order][1:] == line_hash[line_order][:-1]) & (line_doc[line_order][1:] == line_doc[line_order][:-1])
    upper = _CLASS_OF[1]
    values = [
        np.log1p(size),
        np.log1p(words),
        mean(length),
        mean(length > 12),
        mean(length <= 3),
        np.bincount(doc[order][fresh], minlength=n) / some,
        top / some,
        mean((_CLASS_OF[0][last] == 0) & (_CLASS_OF[5][last] == 0) & (_CLASS_OF[6][last] == 0)),
        words / np.maximum(lines, 1),
        np.bincount(line_doc[line_order][same], minlength=n) / np.maximum(lines, 1),
        mean(_CLASS_OF[5][last]),
        mean(upper[head].astype(float)),
    ]
    out[:, len(_CLASSES) :] = np.stack(values, 1)
    return out


def _with_statistics(rows: DataFrame, schema: str, make) -> DataFrame:
    """``rows``: text (binary) last, other columns before it; ``make(statistics)`` gives the new columns' arrays."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            cols, texts = [batch.column(f.name) for f in kept], batch.column("text")
            found = [statistics(texts.slice(at, 1000).to_pylist()) for at in range(0, len(texts), 1000)]
            new = make(np.concatenate([np.zeros((0, len(FEATURES))), *found]))
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[*(f.name for f in kept), *(f"c{i}" for i in range(len(new)))])

    return rows.mapInArrow(trimmed(run), schema)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BoostedTrees:
    """Trees fitted on at most ``sample_rows`` labelled documents outside the held-out fifth."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = text_batches(spread(docs)).select(named(id_col).alias("doc_id"), named(text_col).cast("string").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(materialize(known, "quality-labels")), "doc_id").select("y", "text")
    packed = _with_statistics(rows, "y double, c0 binary", lambda x: [pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())])
    found = sorted((r["c0"], r["y"]) for r in packed.collect())
    x = np.stack([np.frombuffer(c, "<f8") for c, _ in found]) if found else np.zeros((0, len(FEATURES)))
    return BoostedTrees().fit(x, np.array([y for _, y in found]))


def score_quality(docs: DataFrame, model: BoostedTrees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    rows = text_batches(spread(docs)).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").cast("binary").alias("text"))
    scored = _with_statistics(rows, "doc_id long, c0 double", lambda x: [pa.array(model.predict(x), pa.float64())])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("c0").alias("score"), (F.col("c0") >= threshold).cast("int").alias("predicted"))
