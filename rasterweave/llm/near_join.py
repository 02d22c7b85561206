"""N-gram Jaccard join by prefix filters under several global orders, with components of the links.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Equal sets are one class from the start. A pair
with Jaccard similarity t or more shares at least m tokens among the first n - ceil(t n) + m of each set, whatever the
global order of tokens: the first m that it has in common come no later. So candidates must do so under each of
several orders, with m growing with the set (``depth``), and the filters are intersected before a pair is verified.
All orders put frequent tokens last (by counts over the whole table) and differ in how they order the rest.

1. Sets: class, size, the smallest token hashes, and counts of tokens that a task meets in several documents. A class is
   named by one half of a 128-bit digest of the set; where the other halves differ, classes of one name are told apart.
2. Neighbourhoods: classes whose smallest hashes agree in part gather around a common class, their hub, which each of
   them is a candidate with. In a group of near copies nearly all are linked with the hub, and pairs of two such need no
   look: they are of one component. The few others meet all of their neighbourhood in blocks, as matrix products.
3. Prefix join under the first order for all pairs of different neighbourhoods, packed in blocks by token range, as many
   as the tokens need for a block to be small. Nothing is capped: neighbourhoods only say where a pair is compared.
4. Candidates must pass a bound from counts of tokens by hash cell and then the other orders, whose prefixes travel cut
   to 32 bits (that can only let more pass). Whole sets travel for the pairs that are left alone, and are compared exactly.
5. Components of the links.

Similarities are exact on the hashed sets (two shingles of one pair share a hash once in 1e13 pairs of documents).
Defined cases: null text and texts without words have an empty set, link with nothing and are their own component; a
text of fewer words than a shingle is one token; repeated rows are one class; a component's id is its smallest id,
nulls left out; a component of only null ids has null; other columns do not matter, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.components import components
from rasterweave.llm.shared import buckets_for, dealt, discard, keep_rows, materialize, named, partitions, sized_join, spread, text_batches
from rasterweave.llm.streams import sorted_groups, trimmed
from rasterweave.llm.textfn import filled
from rasterweave.llm.wordhash import NOT_SPACE, blocks, mix, word_hashes

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: Smallest hashes kept of each set, and how many of them look for a neighbourhood.
SKETCH, PROBES = 24, 6
#: A token counts as frequent if at least one document in so many has it; the list has at most this many times the
#: mean set size of entries, at any size of the table.
FREQUENT_ONE_IN = 5_000
#: Seeds of the orders.
ORDERS = (11, 23, 37)
CELLS = 256
#: Documents handled at once, tokens whose repeats a task counts at once, and prefix tokens held before they are sent.
SLICE, COUNTED, HELD = 500, 3_000_000, 1_500_000
#: Classes on each side of a block of a neighbourhood; larger ones are compared block by block.
BLOCK_CLASSES = 250
#: Classes that share a prefix token, beyond which their pairs are other tasks' work, so many on each side at once.
HOT_TOKEN, HOT_CLASSES = 2_000, 1_000

_STEP = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        h, edges, *_ = word_hashes([t.lower() if t else b"" for t in texts[a:b]], NOT_SPACE)
        n = len(h) - words + 1
        if n > 0:
            s = np.zeros(n, np.uint64)
            for j in range(words):
                s += h[j : j + n] * _STEP[j]
            s = mix(s)
        for i in range(b - a):
            first, last = int(edges[i]), int(edges[i + 1])
            if last - first >= words:
                out.append(np.unique(s[first : last - words + 1]))
            elif last > first:
                few = h[first:last] * _STEP[8 : 8 + last - first]
                out.append(mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(last - first)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's digest."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def class_of(tokens: np.ndarray, clashes: frozenset = frozenset()) -> int:
    """The name of a set's class: the first half of its digest, the second where sets that differ share the first."""
    first, second = digests(tokens)
    return second if first in clashes else first


def depth(n):
    """Tokens that prefixes must share: more for larger sets, where one token in common tells little."""
    return 1 + n // 32


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return min(n, n - -(-threshold * n // 100) + depth(n))


class TokenOrders:
    """Global orders: tokens not listed as frequent first, by a seeded hash; then the listed ones, rarest first.

    ``clashes``: first halves of digests that several sets share, for whoever names classes.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, clashes: frozenset = frozenset()):
        at = np.argsort(tokens)
        self.tokens, self.counts, self.clashes = tokens[at], counts[at], clashes

    def prefix(self, own: np.ndarray, seed: int, threshold: int = THRESHOLD) -> np.ndarray:
        key = mix(own ^ np.uint64(seed))
        p = prefix_length(len(own), threshold)
        common = np.zeros(len(own), np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
            common = np.where(self.tokens[at] == own, self.counts[at], 0)
        rare = np.flatnonzero(common == 0)
        if len(rare) > p:
            return own[rare[np.argpartition(key[rare], p - 1)[:p]]]
        return own[np.lexsort((key, common))[:p]]


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, orders: TokenOrders, threshold: int = THRESHOLD) -> np.ndarray:
    """Rows (i, j) of the linked pairs of two lists of sets, or (right None) of one list, i before j."""
    sets = left if right is None else left + right
    n, cut = np.array([len(s) for s in sets], np.int64), len(left)
    if not n.sum():
        return np.zeros((0, 2), np.int64)

    def shared(parts: list[np.ndarray]) -> np.ndarray:
        tokens, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        _, at, count = np.unique(tokens, return_inverse=True, return_counts=True)
        use = count[at] > 1
        column = np.unique(at[use], return_inverse=True)[1]
        owner, width = owner[use], int(column.max()) + 1 if use.any() else 0
        rows = cut, (cut if right is None else len(sets) - cut)
        total = np.zeros(rows, np.float32)
        by_column = np.argsort(column, kind="stable")
        column, owner = column[by_column], owner[by_column]
        for a in range(0, width, 2048):
            lo, hi = np.searchsorted(column, [a, a + 2048])
            m = np.zeros((len(sets), min(2048, width - a)), np.float32)
            m[owner[lo:hi], column[lo:hi] - a] = 1
            total += m[:cut] @ (m if right is None else m[cut:]).T
        return total

    deep = depth(n)
    need = np.minimum(deep[:cut, None], deep if right is None else deep[cut:])
    candidate = np.ones((cut, cut if right is None else len(sets) - cut), bool)
    if right is None:
        candidate &= np.triu(candidate, 1)
    for seed in ORDERS:
        candidate &= shared([orders.prefix(s, seed, threshold) if len(s) else s for s in sets]) >= need
        if not candidate.any():
            return np.zeros((0, 2), np.int64)
    i, j = np.nonzero(candidate)
    both = shared(sets)[i, j].astype(np.int64)
    n_right = n if right is None else n[cut:]
    linked = 100 * both >= threshold * (n[i] + n_right[j] - both)
    return np.stack([i[linked], j[linked]], 1)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of arrays has in common, repeated ones as often as both have them."""
    n = len(left)
    pair = np.concatenate([np.repeat(np.arange(n), [len(x) for x in side]) for side in (left, right)])
    values = np.concatenate([*left, *right]) if n else np.zeros(0, np.uint64)
    ours = np.arange(len(values)) < sum(map(len, left))
    order = np.lexsort((values, pair))
    pair, values, ours = pair[order], values[order], ours[order]
    at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (values[1:] != values[:-1]))[: len(pair)])
    if not len(at):
        return np.zeros(n, np.int64)
    mine = np.add.reduceat(ours.astype(np.int64), at)
    return np.bincount(pair[at], np.minimum(mine, np.diff(np.append(at, len(pair))) - mine), n).astype(np.int64)


def spanning(pairs: np.ndarray, size: int) -> np.ndarray:
    """A star from each connected part's first member to its others: as many rows as members at most."""
    parent = np.arange(size)
    while True:
        low = parent.copy()
        np.minimum.at(low, pairs[:, 0], parent[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], parent[pairs[:, 0]])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    own = np.flatnonzero(parent != np.arange(size))
    return np.stack([parent[own], own], 1)


def _key(text_col: str) -> Column:
    """What tells rows of one id apart: a hash of the text."""
    return F.xxhash64(filled(named(text_col)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(spread(docs)).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").cast("binary").alias("text"), _key(text_col).alias("key"))


def _sets(rows: DataFrame) -> DataFrame:
    """kind 0: a document (doc_id, n, class, other half of the digest, sketch, key); kind 1: a token that a task met in several documents, n times."""
    names = ["kind", "doc_id", "n", "class", "other", "sketch", "key"]

    def run(batches):
        tokens: list[np.ndarray] = []

        def counted():
            values, n = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.uint64), np.zeros(0, int))
            use = n >= 3
            values, n, k = values[use].astype(np.int64), n[use], int(use.sum())
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), none, pa.array(n, pa.int64()), pa.array(values, pa.int64()), none, pa.nulls(k, pa.list_(pa.int64())), none], names=names)

        held, seen = 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(1).to_pylist())
                halves = [digests(s) for s in sets]
                sketches = [np.sort(mix(s ^ np.uint64(3)))[:SKETCH].astype(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(sets), pa.int32()), part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*halves, strict=True)), pa.array(sketches, pa.list_(pa.int64())), part.column(2)],
                    names=names,
                )
                for c, s in zip(halves, sets, strict=True):
                    if c not in seen:
                        seen.add(c)
                        tokens.append(s)
                        held += len(s)
                if held > COUNTED:
                    yield counted()
                    tokens, held, seen = [], 0, set()
        yield counted()

    return rows.mapInArrow(trimmed(run), "kind int, doc_id long, n long, class long, other long, sketch array<long>, key long")


def _neighbourhoods(classes: DataFrame) -> DataFrame:
    """(class, hub): classes around a common class whose sketch theirs resembles, and that class itself."""
    probes = classes.select("class", F.explode(F.slice("sketch", 1, PROBES)).alias("token"))
    hubs = probes.groupBy("token").agg(F.min("class").alias("hub"), F.max("class").alias("other")).filter("hub <> other").drop("other")
    tried = materialize(probes.join(hubs, "token").filter("class <> hub").select("class", "hub").distinct(), "near-tried")
    sketch = classes.select(F.col("class").alias("c"), F.col("sketch"))
    some = tried.select(F.col("class").alias("c")).unionByName(tried.select(F.col("hub").alias("c"))).distinct()
    sketch = materialize(sketch.join(some, "c"), "near-sketches")
    own, its = sketch.select(F.col("c").alias("class"), F.col("sketch").alias("s1")), sketch.select(F.col("c").alias("hub"), F.col("sketch").alias("s2"))
    alike = F.size(F.array_intersect("s1", "s2")) >= 0.25 * F.size(F.array_union("s1", "s2"))
    first = materialize(tried.join(own, "class").join(its, "hub").filter(alike).groupBy("class").agg(F.min("hub").alias("hub")), "near-hubs")
    near = first
    for _ in range(2):
        up = first.select(F.col("class").alias("hub"), F.col("hub").alias("top"))
        near = near.join(up, "hub", "left").select("class", F.coalesce("top", "hub").alias("hub"))
    out = materialize(near.withColumn("pair", F.explode(F.array("class", "hub"))).groupBy(F.col("pair").alias("class")).agg(F.min("hub").alias("hub")), "near-hubs")
    for table in (tried, sketch, first):
        discard(table)
    return out


def _pairs_apart(token: np.ndarray, cls: np.ndarray, hub: np.ndarray, size: np.ndarray, threshold: int):
    """Blocks of (class, class, tokens needed) that share a token, are of different neighbourhoods and near enough in size."""
    order = np.lexsort((cls, hub, token))
    token, cls, hub, size = token[order], cls[order], hub[order], size[order]
    new = np.append(True, token[1:] != token[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(token))
    # For each entry, the first later one of its token with another neighbourhood: entries are sorted by it.
    change = np.append(new[1:] | (hub[1:] != hub[:-1]), True)
    later = np.flatnonzero(change)[np.searchsorted(np.flatnonzero(change), np.arange(len(token)))] + 1
    end = np.repeat(stop, stop - start)
    count = np.maximum(end - later, 0)
    at = 0
    while at < len(token):
        upto = int(np.searchsorted(np.cumsum(count[at:]), 2_000_000, side="right")) + at + 1
        c = count[at:upto]
        i = np.repeat(np.arange(at, min(upto, len(token))), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(later[at:upto], c)
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        near = 100 * small >= threshold * large
        a, b = cls[i[near]], cls[j[near]]
        yield np.minimum(a, b), np.maximum(a, b), depth(small[near])
        at = upto


def _hot_units(cls: np.ndarray, hub: np.ndarray, size: np.ndarray, threshold: int):
    """The pairs of one token's classes as work for other tasks: (packed classes, how many are on the left; 0: all on both)."""
    order = np.argsort(size, kind="stable")
    cls, hub, size = cls[order], hub[order], size[order].astype(np.uint32)
    parts = [slice(at, at + HOT_CLASSES) for at in range(0, len(cls), HOT_CLASSES)]
    packed = lambda *of: b"".join(np.concatenate([x[p] for p in of]).tobytes() for x in (cls, hub, size))
    for k, left in enumerate(parts):
        yield packed(left), 0
        for right in parts[k + 1 :]:
            if 100 * int(size[left][-1]) < threshold * int(size[right][0]):
                break
            yield packed(left, right), len(cls[left])


def _pairs_of_unit(raw: bytes, cut: int, threshold: int):
    """(class, class, tokens needed) of a unit's pairs of different neighbourhoods and near enough in size."""
    n = len(raw) // 20
    cls, hub, size = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n).astype(np.int64)
    i, j = (np.repeat(np.arange(cut), n - cut), np.tile(np.arange(cut, n), cut)) if cut else np.triu_indices(n, 1)
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    near = (hub[i] != hub[j]) & (100 * small >= threshold * large)
    a, b = cls[i[near]], cls[j[near]]
    return np.minimum(a, b), np.maximum(a, b), depth(small[near])


def near_links(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, class, key; links: a, b between classes, spanning all links of the join)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = _texts(docs, id_col, text_col)
    sets = materialize(_sets(texts), "near-sets")
    documents = sets.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "class", "other", "sketch", "key")
    total, tokens_of_all = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    frequent = sets.filter("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3, total // FREQUENT_ONE_IN)).toPandas()

    def by_class() -> DataFrame:
        found = documents.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"), (F.min("other") != F.max("other")).alias("clash"))
        return materialize(found, "near-classes")

    classes = by_class()
    clashes = frozenset(r["class"] for r in classes.filter("clash").select("class").collect())
    if clashes:  # n * n / 2 ** 65 of them in n sets
        documents = documents.withColumn("class", F.when(F.col("class").isin(*clashes), F.col("other")).otherwise(F.col("class")))
        classes = by_class()
    documents = documents.drop("other")
    shared_orders = spark.sparkContext.broadcast(TokenOrders(frequent["class"].to_numpy(np.int64).astype(np.uint64), frequent["n"].to_numpy(np.int64), clashes))
    hubs = _neighbourhoods(classes)
    placed = materialize(sized_join(documents, hubs, "class", "inner").select(F.col("doc_id").alias("__id"), F.col("class").alias("__class"), "hub").distinct(), "near-placed")
    # a prefix is 3 in 10 tokens at most, but for very small sets, and a record 28 bytes
    buckets = buckets_for(spark, int(tokens_of_all) * 9)

    def prefixes(batches):
        held, size = [], 0
        known = shared_orders.value

        def flush():
            token, cls, hub, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((cls, token))
            token, cls, hub, n = token[order], cls[order], hub[order], n[order]
            fresh = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])) if len(token) else np.zeros(0, bool)
            token, cls, hub, n = token[fresh], cls[fresh], hub[fresh], n[fresh]
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            for alone in (True, False):  # a class that is a neighbourhood of its own needs no second name
                use = (hub == cls) == alone
                edges = np.searchsorted(bucket[use], np.arange(buckets + 1))
                t, c, h, s = token[use], cls[use], hub[use], n[use]
                some = np.flatnonzero(np.diff(edges))
                packed = [b"".join(x[edges[k] : edges[k + 1]].tobytes() for x in ((t, c, s) if alone else (t, c, s, h))) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([alone] * len(some), pa.bool_()), pa.array(packed, pa.binary())], names=["bucket", "alone", "packed"])

        for batch in batches:
            named, hub = (batch.column(i).to_pylist() for i in (1, 2))
            for at in range(0, batch.num_rows, SLICE):
                for k, own in enumerate(shingle_sets(batch.slice(at, SLICE).column(0).to_pylist())):
                    if len(own):
                        c = class_of(own, known.clashes)
                        p = known.prefix(own, ORDERS[0], threshold)
                        held.append((p, np.full(len(p), c, np.int64), np.full(len(p), hub[at + k] if named[at + k] == c else c, np.int64), np.full(len(p), len(own), np.uint32)))
                        size += len(p)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    names = ["a", "b", "n", "need", "unit"]

    def meet(batches):
        for _, group in sorted_groups(batches, 1):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for alone, raw in zip(group.column("alone").to_pylist(), group.column("packed").to_pylist(), strict=True):
                n = len(raw) // (20 if alone else 28)
                t, c, s = np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n)
                for x, v in zip(cols, (t, c, s, c if alone else np.frombuffer(raw, "<i8", n, 20 * n)), strict=True):
                    x.append(v)
            token, cls, size, hub = (np.concatenate(x) for x in cols)
            order = np.lexsort((cls, token))
            token, cls, size, hub = token[order], cls[order], size[order], hub[order]
            same = np.append(False, (token[1:] == token[:-1]) & (cls[1:] == cls[:-1]))
            token, cls, size, hub = token[~same], cls[~same], size[~same], hub[~same]
            again = token[1:] == token[:-1]
            shared = np.append(again, False) | np.append(False, again)
            found: list[tuple] = []

            def counted():
                a, b, need = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((b, a))
                a, b, need = a[order], b[order], need[order]
                at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
                n = np.diff(np.append(at, len(a)))
                return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(n.astype(np.int64)), pa.array(need[at].astype(np.int64)), pa.nulls(len(at), pa.binary())], names=names)

            token, cls, hub, size = token[shared], cls[shared], hub[shared], size[shared]
            at = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
            many = np.diff(np.append(at, len(token)))
            for k in np.flatnonzero(many > HOT_TOKEN):
                own = slice(at[k], at[k] + many[k])
                for unit, cut in _hot_units(cls[own], hub[own], size[own], threshold):
                    yield pa.RecordBatch.from_arrays([pa.array([cut], pa.int64()), *(pa.array([0], pa.int64()),) * 3, pa.array([unit], pa.binary())], names=names)
            cool = np.repeat(many <= HOT_TOKEN, many)
            for part in _pairs_apart(token[cool], cls[cool], hub[cool], size[cool].astype(np.int64), threshold):
                found.append(part)
                if sum(len(x[0]) for x in found) > 2_000_000:
                    yield counted()
                    found = []
            if found:
                yield counted()

    labelled = sized_join(texts, placed, texts["doc_id"].eqNullSafe(placed["__id"]), "left").select("text", "__class", "hub")
    packed = dealt(labelled.mapInArrow(trimmed(prefixes), "bucket int, alone boolean, packed binary"), buckets)
    met = materialize(packed.mapInArrow(trimmed(meet), "a long, b long, n long, need long, unit binary"), "near-met")

    def crossed(batches):
        for batch in batches:
            for raw, cut in zip(batch.column("unit").to_pylist(), batch.column("a").to_pylist(), strict=True):
                a, b, need = _pairs_of_unit(raw, cut, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), np.int64)), pa.array(need.astype(np.int64))], names=names[:4])

    pairs, units = met.filter("unit is null").drop("unit"), met.filter("unit is not null")
    if units.limit(1).count():
        pairs = pairs.unionByName(units.select("a", "unit").repartition(parts).mapInArrow(trimmed(crossed), "a long, b long, n long, need long"))
    met_often = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b")
    stars = hubs.filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b"))
    apart = materialize(met_often.unionByName(stars), "near-apart")
    for table in (placed, met):
        discard(table)

    # The sets of all classes that are compared, each once.
    compared = apart.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    compared = materialize(classes.join(compared, "class").select(F.col("doc_id").alias("__id"), F.col("class").alias("__class")), "near-compared")

    def tokens(batches):
        known = shared_orders.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            found = zip(shingle_sets(batch.column("text").to_pylist()), batch.column("__class").to_pylist(), strict=True)
            kept = [(c, s) for s, c in found if class_of(s, known.clashes) == c]
            cells = [np.minimum(np.bincount((s >> np.uint64(24)) % np.uint64(CELLS), minlength=CELLS), 255).astype(np.uint8).tobytes() for _, s in kept]
            first = [b"".join(known.prefix(s, seed, threshold).astype(np.uint32).tobytes() for seed in ORDERS[1:]) for _, s in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()), pa.array(cells, pa.binary()), pa.array(first, pa.binary()), pa.array([s.tobytes() for _, s in kept], pa.binary())],
                names=["class", "n", "cells", "prefixes", "tokens"],
            )

    wanted = sized_join(texts, compared, texts["doc_id"].eqNullSafe(compared["__id"]), "inner").select("__class", "text")
    sets_of = materialize(wanted.mapInArrow(trimmed(tokens), "class long, n long, cells binary, prefixes binary, tokens binary"), "near-tokens")
    discard(compared)

    def possible(batches):
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(x)) for x in ("n_a", "n_b"))
            if not len(n_a):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, CELLS) for x in ("cells_a", "cells_b"))
            most = np.minimum(a, b).sum(1, dtype=np.int64)
            full = ((a == 255) | (b == 255)).any(1)
            left = np.flatnonzero(full | (100 * most >= threshold * (n_a + n_b - most)))
            need = depth(np.minimum(n_a, n_b))
            for k in range(len(ORDERS) - 1):
                if len(left):
                    sides = [[np.split(np.frombuffer(x, np.uint32), len(ORDERS) - 1)[k] for x in batch.column(c).take(pa.array(left)).to_pylist()] for c in ("prefixes_a", "prefixes_b")]
                    left = left[shared_counts(*sides) >= need[left]]
            yield batch.take(pa.array(left)).select(["a", "b"])

    def side(name: str, columns: list[str]) -> DataFrame:
        return sets_of.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns]).hint("merge")

    def verify(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("tokens_a", "tokens_b"))
            both = shared_counts(a, b)
            either = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) - both
            yield batch.filter(pa.array(100 * both >= threshold * either)).select(["a", "b"])

    seen = ["n", "cells", "prefixes"]
    likely = apart.join(side("a", seen), "a").join(side("b", seen), "b").select("a", "b", *(f"{c}_{x}" for c in seen for x in "ab")).mapInArrow(trimmed(possible), "a long, b long")
    likely = materialize(likely, "near-likely")
    # Whole sets travel only for the pairs that are left, and to their neighbourhood's block.
    verified = materialize(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "near-verified")
    sets_of_pairs = sized_join(sets_of.select("class", "tokens"), verified, "class", "left_semi")

    def whole(name: str) -> DataFrame:
        return sets_of_pairs.select(F.col("class").alias(name), F.col("tokens").alias(f"tokens_{name}")).hint("merge")

    crossing = likely.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(trimmed(verify), "a long, b long")
    crossing = materialize(crossing, "near-links")
    for table in (apart, likely, verified):
        discard(table)

    def inside(batches):
        known = shared_orders.value
        for _, group in sorted_groups(batches, 3):
            loose, names = (np.asarray(group.column(x)) for x in ("loose", "class"))
            raw = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
            left, right = np.flatnonzero(loose), np.flatnonzero(~loose)
            pairs = links_between([raw[k] for k in left], [raw[k] for k in right], known, threshold)
            nodes, place = np.unique(names, return_inverse=True)
            star = spanning(np.stack([place[left][pairs[:, 0]], place[right][pairs[:, 1]]], 1), len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[star[:, 0]], pa.int64()), pa.array(nodes[star[:, 1]], pa.int64())], names=["a", "b"])

    # Classes that are not linked with their hub meet all of its neighbourhood, block by block.
    loose = materialize(stars.join(crossing, ["a", "b"], "left_anti").select(F.col("a").alias("hub"), F.col("b").alias("class")), "near-loose")
    if not loose.limit(1).count():
        return documents.drop("sketch"), crossing
    some = lambda n: F.ceil(F.col(n) / BLOCK_CLASSES).cast("int")
    sizes = loose.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).join(hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("all")), "hub")
    sizes = materialize(sizes.select("hub", some("m").alias("rows"), some("all").alias("columns")), "near-sizes")
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = loose.join(sizes, "hub").select("hub", part("rows").alias("row"), every("columns").alias("col"), F.lit(True).alias("loose"), "class", "columns")
    right = hubs.join(sizes, "hub").select("hub", every("rows").alias("row"), part("columns").alias("col"), F.lit(False).alias("loose"), "class", "columns")
    # the blocks of a neighbourhood go to one task after the other
    place = ((F.pmod(F.xxhash64("hub"), F.lit(parts)) + F.col("row") * F.col("columns") + F.col("col")) % parts).cast("int")
    members = materialize(left.unionByName(right).withColumn("place", place).drop("columns"), "near-members")
    members = sized_join(sets_of.select("class", "tokens"), members, "class", "inner").select("hub", "row", "col", "loose", "class", "tokens", "place")
    members = members.repartitionById(parts, "place").sortWithinPartitions("hub", "row", "col")
    links = materialize(members.mapInArrow(trimmed(inside), "a long, b long").unionByName(crossing), "near-links")
    return documents.drop("sketch"), links


def near_components(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, class, key (the text's hash), label (of a component of several rows)."""
    documents, links = near_links(docs, threshold, id_col, text_col)
    labels = components(links)
    full = documents.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m"))
    full = full.join(labels.withColumnRenamed("node", "class"), "class", "left").filter("m > 1 or label is not null")
    full = materialize(full.withColumn("label", F.coalesce("label", "class")), "near-full")
    firsts = full.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialize(full.join(firsts, "label").select("class", "component_id", "label"), "near-named")
    out = sized_join(documents, named, "class", "left")
    own = F.when(F.col("label").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "class", "key", "label")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, by the text's hash where rows repeat it; of
    rows that repeat an id and a text one stays, of texts without words too. Rows with a null id are decided among
    themselves: one of each component stays, beside the one with an id.
    """
    found = near_components(docs, threshold)
    several = found.filter("label is not null").withColumn("none", F.col("doc_id").isNull())
    first = F.col("none") | F.col("doc_id").eqNullSafe(F.col("component_id"))
    chosen = materialize(several.filter(first).groupBy("label", "none").agg(F.min("key").alias("chosen")), "near-chosen")
    others = sized_join(several, chosen, ["label", "none"], "left").filter(~(first & (F.col("key") == F.col("chosen"))))
    repeats = found.filter("label is not null or n_shingles = 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keep_rows(docs, _key("text"), others.select("doc_id", "key").distinct(), repeats)
