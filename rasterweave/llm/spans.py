"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after a word that ends in ``. ! ?``, at the end of a line, and, so that passages without
punctuation are cut alike wherever they stand, after a word whose hash is less than those of the ``CUT_RADIUS`` words
before it and after it in its sentence; so a cut depends on nothing beyond these, or beyond a stop.
A span starts at every sentence and runs over at least ``MIN_SENTENCES`` sentences until it has ``MIN_WORDS`` words,
and one ends with every sentence likewise; both are hashed twice, to 64 and to 32 bits, by polynomials of their own, and
count as equal only if both hashes are. Of all equal spans in the whole table the first, by document id and place,
stays; sentences covered by any other are removed.

A task first joins the spans that it has itself: all but its first of a hash are decided there, so a passage that is
in every document travels once from each task. The rest goes, packed in blocks, to the owner of its hash range; there
are as many ranges as the table's size needs for one to be small.

Defined cases: null text is empty; a text shorter than a span is kept whole; a null id comes first; rows that repeat
an id are told apart by their text's hash, and count as one document if that is the same too; a run of one repeated word
is not cut within; other columns do not matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.shared import BUCKET_BYTES, buckets_for, dealt, input_bytes, materialize, named, partitions, sized_join, spread, text_batches
from rasterweave.llm.streams import sorted_groups, trimmed
from rasterweave.llm.wordhash import NOT_SPACE, blocks, mix, word_hashes

MIN_WORDS, MIN_SENTENCES, CUT_RADIUS = 20, 2, 4
#: Spans that a task holds before it sends them on.
HELD = 1_500_000

_SPAN = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])
_RANGE = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])
_NULL_ID = np.iinfo(np.int64).min
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def least_around(h: np.ndarray, run: np.ndarray, radius: int) -> np.ndarray:
    """Marks the words whose hash is less than those of the ``radius`` words before and after, all of their run."""
    least = np.zeros(len(h), bool)
    least[radius : len(h) - radius] = True
    for d in range(1, radius + 1):
        same = run[d:] == run[:-d]
        least[d:] &= same & (h[d:] < h[:-d])
        least[:-d] &= same & (h[:-d] < h[d:])
    return least


def text_spans(texts: list[bytes], min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES, cut_radius: int = CUT_RADIUS):
    """(text index, hash, other hash, first byte, end byte) of every span of a block of texts."""
    h, edges, raw, starts, at = word_hashes(texts, NOT_SPACE)
    n = len(h)
    if not n:
        return (np.zeros(0, np.int64),) * 5
    doc = np.repeat(np.arange(len(texts)), np.diff(edges))
    gap = np.flatnonzero(~NOT_SPACE[raw])
    stop = gap[np.searchsorted(gap, starts)]
    line = np.cumsum(raw == 10)[starts]
    ends = _STOPS[raw[stop - 1]]
    ends[:-1] |= (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    ends[-1] = True
    ends |= least_around(h, np.cumsum(ends) - ends, cut_radius)
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    sentence_doc = doc[first]
    # The sentence where a span from sentence i may end: enough words and enough sentences, in the same text.
    want = np.maximum(np.searchsorted(last, first + min_words - 1), np.arange(len(first)) + min_sentences - 1)
    ok = want < len(first)
    want = np.minimum(want, len(first) - 1)
    ok &= sentence_doc[want] == sentence_doc
    # And the shortest that end with each sentence, so that no sentence of a repeated run is left at its end.
    back = np.minimum(np.searchsorted(first, last - min_words + 1, side="right") - 1, np.arange(len(last)) - min_sentences + 1)
    fine = back >= 0
    fine[fine] &= sentence_doc[back[fine]] == sentence_doc[fine]
    both = np.unique((np.concatenate([first[ok], first[back[fine]]]) << 32) | np.concatenate([last[want[ok]], last[fine]]))
    begin, finish = both >> 32, both & 0xFFFFFFFF
    spans = _polynomial(h, begin, finish, 0xD1342543DE82EF95)
    check = _polynomial(mix(h ^ np.uint64(0x9FB21C651E98DF25)), begin, finish, 0xAEF17502108EF2D9) >> np.uint64(32)
    return doc[begin], spans, check.astype(np.uint32), starts[begin] - at[doc[begin]], stop[finish] - at[doc[begin]]


def _polynomial(h: np.ndarray, begin: np.ndarray, finish: np.ndarray, odd: int) -> np.ndarray:
    """A hash of the words' hashes of each span, from running sums: a polynomial in ``odd``, moved to one place."""
    n = len(h)
    powers, inverse = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(n, np.uint64(odd)))
    inverse[1:] = np.multiply.accumulate(np.full(n, np.uint64(pow(odd, -1, 1 << 64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:-1], dtype=np.uint64)])
    return mix((sums[finish + 1] - sums[begin]) * inverse[begin] + (finish + 1 - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _first_of_each(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of both hashes, document, tag and place, the same one twice (a repeated row) once; marks firsts."""
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"], spans["check"], spans["hash"]))]
    if len(spans):
        spans = spans[np.append(True, spans[1:] != spans[:-1])]
    fresh = np.ones(len(spans), bool)
    fresh[1:] = (spans["hash"][1:] != spans["hash"][:-1]) | (spans["check"][1:] != spans["check"][:-1])
    return spans, fresh


def _ranges(spans: np.ndarray) -> np.ndarray:
    """Spans to remove as disjoint ranges per document."""
    order = np.lexsort((spans["start"], spans["tag"], spans["doc"]))
    s = spans[order]
    out = np.zeros(len(s), _RANGE)
    if not len(s):
        return out
    new = np.ones(len(s), bool)
    new[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["tag"][1:] != s["tag"][:-1])
    group = np.cumsum(new) - 1
    # Running maximum of ends within a document: lift each document above the one before.
    lift = group.astype(np.int64) << 33
    reach = np.maximum.accumulate(s["end"] + lift)
    apart = new.copy()
    apart[1:] |= (s["start"][1:] + lift[1:]) > reach[:-1]
    at = np.flatnonzero(apart)
    out = np.zeros(len(at), _RANGE)
    for k in ("doc", "tag", "start"):
        out[k] = s[k][at]
    out["end"] = reach[np.append(at[1:], len(s)) - 1] - lift[at]
    return out


def _blocks_of(records: np.ndarray, bucket: np.ndarray, decided: bool):
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    parts = [records[a:b] for a, b in zip(edges, [*edges[1:], len(records)], strict=True)]
    # Columns apart, so that the shuffle's compression finds their runs.
    packed = [b"".join(np.ascontiguousarray(p[k]).tobytes() for k in p.dtype.names) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array([decided] * len(parts), pa.bool_()), pa.array(packed, pa.binary())], names=["bucket", "decided", "packed"])


def _unpacked(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    out = []
    for raw in column.to_pylist():
        n, at = len(raw) // kind.itemsize, 0
        part = np.zeros(n, kind)
        for k in kind.names:
            part[k] = np.frombuffer(raw, kind[k], n, at)
            at += n * kind[k].itemsize
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, kind)


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """Byte ranges to remove: doc_id (null: the smallest long), tag (of the text), ranges (packed pairs of uint32)."""
    # spans hold as many bytes as their texts, or half as many again: twice or thrice what lies compressed in files
    buckets = buckets_for(docs.sparkSession, min(3 * input_bytes(docs), 64 * partitions(docs.sparkSession) * BUCKET_BYTES))
    rows = text_batches(spread(docs)).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("tag"), F.col("text").cast("binary").alias("text"))

    def home(ranges):
        return mix(ranges["doc"].astype(np.uint64) ^ mix(ranges["tag"].astype(np.uint64))) % np.uint64(buckets)

    def find(batches):
        held, size = [], 0

        def flush():
            spans, fresh = _first_of_each(np.concatenate(held))
            ours = _ranges(spans[~fresh])
            spans = spans[fresh]
            yield _blocks_of(spans, (spans["hash"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), False)
            if len(ours):
                yield _blocks_of(ours, home(ours), True)

        for batch in batches:
            ids, tags, texts = (batch.column(i).to_pylist() for i in range(3))
            del batch
            ids = np.array([_NULL_ID if x is None else x for x in ids], np.int64)
            tags = np.array(tags, np.int64).astype(np.uint32)
            for a, b in blocks(texts):
                doc, h, check, start, end = text_spans([t or b"" for t in texts[a:b]], min_words, min_sentences)
                spans = np.zeros(len(h), _SPAN)
                spans["hash"], spans["check"], spans["doc"], spans["tag"], spans["start"], spans["end"] = h, check, ids[a + doc], tags[a + doc], start, end
                held.append(spans)
                size += len(spans)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def decide(batches):
        for _, group in sorted_groups(batches, 1):
            mask = np.asarray(group.column("decided").to_pylist(), bool)
            spans, fresh = _first_of_each(_unpacked(group.filter(pa.array(~mask)).column("packed"), _SPAN))
            known = _unpacked(group.filter(pa.array(mask)).column("packed"), _RANGE)
            found = _ranges(np.concatenate([_ranges(spans[~fresh]), known]))
            if len(found):
                yield _blocks_of(found, home(found), True)

    def gather(batches):
        for _, group in sorted_groups(batches, 1):
            found = _ranges(_unpacked(group.column("packed"), _RANGE))
            new = np.ones(len(found), bool)
            new[1:] = (found["doc"][1:] != found["doc"][:-1]) | (found["tag"][1:] != found["tag"][:-1])
            at = np.flatnonzero(new)
            pairs = np.stack([found["start"], found["end"]], 1).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["doc"][at]), pa.array(found["tag"][at].astype(np.int64)), pa.array([p.tobytes() for p in np.split(pairs, at[1:])], pa.binary())], names=["doc_id", "tag", "ranges"]
            )

    schema = "bucket int, decided boolean, packed binary"
    decided = dealt(rows.mapInArrow(trimmed(find), schema), buckets).mapInArrow(trimmed(decide), schema)
    return dealt(decided, buckets).mapInArrow(trimmed(gather), "doc_id long, tag long, ranges binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, changed, removed_spans, removed_bytes, text (what stays of it)."""
    ranges = materialize(removed_ranges(docs, id_col, text_col, **options).withColumnRenamed("doc_id", "__id").withColumnRenamed("tag", "__tag"), "span-ranges")
    rows = text_batches(spread(docs)).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))
    on = [F.coalesce("doc_id", F.lit(int(_NULL_ID))) == F.col("__id"), F.col("tag") == F.col("__tag")]
    rows = sized_join(rows, ranges, on, "left", wide="ranges").select("doc_id", "ranges", "text")

    def cut(batches):
        for batch in batches:
            ids, ranges, texts = (batch.column(i) for i in range(3))
            kept, spans, gone = [], [], []
            for r, t in zip(ranges.to_pylist(), texts.to_pylist(), strict=True):
                pairs = np.frombuffer(r, "<u4").reshape(-1, 2).tolist() if r else []
                if pairs:
                    raw, at, out = t.encode(), 0, []
                    for a, b in pairs:
                        out.append(raw[at:a])
                        at = b
                    t = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
                kept.append(t)
                spans.append(len(pairs))
                gone.append(sum(b - a for a, b in pairs))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n > 0 for n in spans]), pa.array(spans, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "changed", "removed_spans", "removed_bytes", "text"])

    return rows.mapInArrow(trimmed(cut), "doc_id long, changed boolean, removed_spans long, removed_bytes long, text string")
