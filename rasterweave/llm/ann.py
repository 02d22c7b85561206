"""Nearest neighbours by cosine with additive quantisation.

Codebooks of full dimension are fitted on a bounded sample, each on what the ones before leave of the unit vectors,
and refined in turn. A vector's code picks one entry of each book, found by beam search; the length of the sum and
its cosine with the vector are stored with it. A query scores codes with one table of dot products per book; the best
by that score are reranked by the exact cosine of the original vectors, in double precision. Their ``k``-th cosine is
a floor: a vector is left out only if its angle to the query, less that to its code, cannot reach the floor. All
others are reranked too, however many, so the result is that of comparing all vectors, and depends on no block or task.

Queries are dealt to groups of about ``QUERY_ROWS`` and codes to groups of their own; each pair of groups is a cell, and a
task that has a cell holds its queries and reads its codes block by block. A cell sends on the best ``k`` of each
query, so memory and traffic are bounded; nothing but the sample goes to the driver.

Vectors of different lengths are no neighbours: each length has codebooks, queries and candidates of its own. Before
any product a vector is scaled by the power of two that brings its largest component near 1, which changes no cosine
and keeps tiny and huge components from under- or overflowing.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do null ids;
each row is a candidate of all queries but itself, rows that repeat its id or vector too; ties go to the smaller id;
rows that repeat an id are queries of their own; a query without candidates gives no rows; other columns do not matter;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.shared import dealt, materialize, named, partitions
from rasterweave.llm.streams import runs, trimmed

#: Vectors that the codebooks are fitted on at most, books, entries of a book, codes kept by the beam.
SAMPLE_ROWS = 16_384
BOOKS, ENTRIES, BEAM = 12, 128, 6
#: Candidates of a block of codes that are reranked first for each query; rows of such a block; queries of a group;
#: queries scored at once.
SHORT_LIST, CODE_ROWS, QUERY_ROWS, SLICE = 40, 4_096, 4_096, 256


class AdditiveQuantizer:
    def __init__(self, books: int = BOOKS, entries: int = ENTRIES, beam: int = BEAM):
        self.books, self.entries, self.beam = books, entries, beam
        self.words = np.zeros((0, 0, 0), np.float32)

    def fit(self, x: np.ndarray, seed: int = 0, rounds: int = 2) -> "AdditiveQuantizer":
        rng, left = np.random.default_rng(seed), x.astype(np.float32).copy()
        k = min(self.entries, max(1, len(x)))
        self.words = np.zeros((self.books, k, x.shape[1]), np.float32)
        for m in range(self.books):
            centre = left[rng.choice(len(left), k, replace=False)]
            for _ in range(8):
                near = (left @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
                count = np.bincount(near, minlength=k)
                total = np.stack([np.bincount(near, left[:, d], k) for d in range(x.shape[1])], 1)
                centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre).astype(np.float32)
            near = (left @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            self.words[m], left = centre, left - centre[near]
        for _ in range(rounds):  # each book again, on what all the others leave
            codes = self.encode(x)
            total = self.decode(codes)
            for m in range(self.books):
                rest = x - (total - self.words[m][codes[:, m]])
                count = np.bincount(codes[:, m], minlength=k)
                mean = np.stack([np.bincount(codes[:, m], rest[:, d], k) for d in range(x.shape[1])], 1) / np.maximum(count, 1)[:, None]
                new = np.where(count[:, None] > 0, mean, self.words[m]).astype(np.float32)
                total += new[codes[:, m]] - self.words[m][codes[:, m]]
                self.words[m] = new
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by beam search: after each book the sums nearest to the vector stay."""
        out = np.zeros((len(x), self.books), np.uint8)
        norms = (self.words**2).sum(2)
        for a in range(0, len(x), 1024):
            v = x[a : a + 1024].astype(np.float32)
            n, rows = len(v), np.arange(len(v))[:, None]
            codes, left = np.zeros((n, 1, 0), np.uint8), v[:, None, :]
            for m in range(self.books):
                width = left.shape[1]
                gain = (left**2).sum(2)[:, :, None] - 2 * (left @ self.words[m].T) + norms[m]
                flat = gain.reshape(n, -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                prior, word = best // gain.shape[2], best % gain.shape[2]
                codes = np.concatenate([codes[rows, prior], word[:, :, None].astype(np.uint8)], 2)
                left = left[rows, prior] - self.words[m][word]
                del width
            out[a : a + 1024] = codes[np.arange(n), (left**2).sum(2).argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(self.books)).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Dot products of each query with each entry: query, book, entry."""
        return (q.astype(np.float32) @ self.words.reshape(-1, self.words.shape[2]).T).reshape(len(q), *self.words.shape[:2])

    def scores(self, tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Query by code: table lookups summed over the books, over the stored norms."""
        total = np.zeros((tables.shape[0], len(codes)), np.float32)
        for m in range(self.books):
            total += tables[:, m][:, codes[:, m]]
        return total / norms

    def reach(self, scores: np.ndarray, norms: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The greatest cosine that vectors with these scores can have, ``near`` being theirs with their codes' sums."""
        # what single precision may have taken from a score
        rounding = (self.words.shape[2] + 2 * self.books) * np.sqrt((self.words.astype(float) ** 2).sum(2)).max(1).sum() * 2.0**-23
        s = np.clip(scores + rounding / norms, -1, 1)
        return np.where(s >= near, 1.0, near * s + np.sqrt((1 - s * s) * (1 - near * near)))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = named(vector_col).cast("array<double>")
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select(named(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(sound & F.exists("v", lambda e: e != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to at least a half and less than 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def fit_codebooks(sample: list[np.ndarray]) -> dict[int, AdditiveQuantizer]:
    """A quantiser for each length of vectors."""
    out = {}
    for width in sorted({len(v) for v in sample}):
        x = scaled(np.stack([v for v in sample if len(v) == width]))
        out[width] = AdditiveQuantizer().fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


class _Block:
    """The queries of a group and, for each, the best found so far."""

    def __init__(self, model: AdditiveQuantizer | None, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, short_list: int):
        self.model, self.rows, self.ids, self.k, self.short_list = model, rows, ids, k, short_list
        self.q = vectors
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.best: dict[int, tuple] = {}

    def _rerank(self, i: int, vec_id: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
        exact = (v * self.q[i]).sum(1) / (size * self.length[i])
        old = self.best.get(i)
        e, w = (exact, vec_id) if old is None else (np.concatenate([old[0], exact]), np.concatenate([old[1], vec_id]))
        top = np.lexsort((w, -e))[: self.k]
        self.best[i] = (e[top], w[top])

    def meet(self, row: np.ndarray, vec_id: np.ndarray, v: np.ndarray, code: np.ndarray | None, norm: np.ndarray, near: np.ndarray) -> None:
        size = np.sqrt((v * v).sum(1))
        for a in range(0, len(self.rows), SLICE):
            q, length = self.q[a : a + SLICE], self.length[a : a + SLICE]
            if self.model is None:  # no vector of this length was in the sample
                score = np.zeros((len(q), len(v)), np.float32)
                reach = np.ones(score.shape)
            else:
                tables = self.model.tables(q / length[:, None])
                score = self.model.scores(tables, code, norm)
                reach = self.model.reach(score, norm, near)
            own = self.rows[a : a + SLICE, None] == row
            score[own] = reach[own] = -np.inf
            n = min(self.short_list, score.shape[1])
            first = np.argpartition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n :]
            for r, pick in enumerate(first):
                pick = pick[score[r][pick] > -np.inf]
                if len(pick):
                    self._rerank(a + r, vec_id[pick], v[pick], size[pick])
            np.put_along_axis(reach, first, -np.inf, axis=1)
            # of the others all that may reach the k-th so far; a matrix product, right to 1e-9, picks those that do
            known = [self.best.get(a + r, ((),))[0] for r in range(len(score))]
            floor = np.array([e[-1] if len(e) == self.k else -2.0 for e in known]) - 1e-9
            may = reach >= floor[:, None]
            some = np.flatnonzero(may.any(1))
            if len(some):
                at = np.flatnonzero(may.any(0))
                cosine = (q[some] / length[some, None]) @ (v[at] / size[at, None]).T
                does = may[np.ix_(some, at)] & (cosine >= floor[some, None])
                for r in np.flatnonzero(does.any(1)):
                    pick = at[does[r]]
                    self._rerank(a + some[r], vec_id[pick], v[pick], size[pick])


def search(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, sample_rows: int = SAMPLE_ROWS, short_list: int = SHORT_LIST, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """Queries: vectors whose id is divisible by ``every``; their ``k`` nearest others: query_id, rank, vec_id, score."""
    spark, parts = rows.sparkSession, partitions(rows.sparkSession)
    found = usable(rows, id_col, vector_col)
    sample = found.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).toPandas()
    models = spark.sparkContext.broadcast(fit_codebooks([np.asarray(v, float) for v in sample["v"]]))

    def encode(batches):
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for width in np.unique(lengths):
                part = batch.filter(pa.array(lengths == width))
                v = np.asarray(part.column(1).flatten(), float).reshape(-1, width)
                x, model, n = scaled(v), models.value.get(int(width)), len(v)
                codes, norms, near = np.zeros((n, 0), np.uint8), np.full(n, np.inf), np.zeros(n)
                if model is not None:
                    size = np.linalg.norm(x, axis=1)
                    codes = model.encode(x / size[:, None])
                    total = model.decode(codes).astype(float)
                    norms = np.linalg.norm(total, axis=1)
                    norms[norms < 1e-3] = np.inf  # no direction: such a code leaves nothing out
                    near = np.clip((total * x).sum(1) / size / norms - 1e-5 / np.minimum(norms, 1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(serial + np.arange(n)), part.column(0), pa.array(np.full(n, width, np.int32)), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(near)],
                    names=["row", "vec_id", "width", "v", "code", "norm", "near"],
                )
                serial += n

    index = materialize(found.mapInArrow(trimmed(encode), "row long, vec_id long, width int, v binary, code binary, norm float, near double"), "ann-index")
    queries = index.filter(F.col("vec_id") % every == 0)
    # Groups of queries and of codes; a length that has many vectors has many cells, whatever the others have.
    n_queries = queries.count()
    tall = max(1, -(-n_queries // query_rows))
    wide = max(1, -(-parts // tall))
    cells = tall * wide
    where = lambda n: F.pmod(F.xxhash64("width", "row"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["width", "row", "vec_id", "v", "code", "norm", "near"]
    asked = queries.withColumn("tall", where(tall)).withColumn("wide", every_of(wide)).withColumn("kind", F.lit(0))
    offered = index.withColumn("wide", where(wide)).withColumn("tall", every_of(tall)).withColumn("kind", F.lit(1))
    both = asked.unionByName(offered).select((F.col("tall") * wide + F.col("wide")).alias("bucket"), "width", "kind", *columns[1:])

    def run(batches):
        cell, asked_, held, waiting = None, [], None, []

        def meet(all_: bool):
            nonlocal waiting
            if waiting and (all_ or sum(map(len, waiting)) >= CODE_ROWS):
                table = pa.Table.from_batches(waiting).combine_chunks()
                whole = len(table) if all_ else len(table) // CODE_ROWS * CODE_ROWS
                for part in (table.slice(at, min(CODE_ROWS, whole - at)) for at in range(0, whole, CODE_ROWS)):
                    row, vec_id, norm, near = (np.asarray(part.column(c)) for c in ("row", "vec_id", "norm", "near"))
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1) if held.model else None
                    held.meet(row, vec_id, _vectors(part, cell[1]), code, norm, near)
                waiting = table.slice(whole).to_batches()

        def best():
            some = list(held.best.items())
            at = np.repeat([i for i, _ in some], [len(e) for _, (e, _) in some]).astype(np.int64)
            score, found_ = (np.concatenate([x[k_] for _, x in some]) if some else np.zeros(0) for k_ in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(held.rows[at]), pa.array(held.ids[at]), pa.array(found_.astype(np.int64)), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

        for (bucket, width, kind), part in runs(batches, 3):
            if (bucket, width) != cell:
                if held:
                    meet(True)
                    yield best()
                cell, asked_, held, waiting = (bucket, width), [], None, []
            if kind == 0:
                asked_.append(part)
            elif asked_:
                if not held:
                    block = pa.Table.from_batches(asked_)
                    held = _Block(models.value.get(width), *(np.asarray(block.column(c)) for c in ("row", "vec_id")), _vectors(block, width), k, short_list)
                waiting.append(part)
                meet(False)
        if held:
            meet(True)
            yield best()

    met = dealt(both, cells, "bucket", "width", "kind").mapInArrow(trimmed(run), "row long, query_id long, vec_id long, score double")
    nearest = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(rows: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("v").to_pylist()), "<f8").reshape(-1, width)
