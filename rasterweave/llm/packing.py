"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

An example is a vector (tokens, 1 segment, loss-bearing tokens), each part relative to its limit. The open
sequence has a vector of room; of the waiting examples that fit, the one with the largest dot product with the
room goes in, until none fits. Where examples may be cut, one more is then cut to fill the sequence to the last
token. A task packs what it reads, in blocks of waiting examples, so nothing is shuffled and memory is bounded (a
table so small that it would leave cores idle is dealt out first). A sequence that closes before it is full, for another
limit or at the task's end, is cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: null text is empty and packs as its end id alone; repeated rows and ids are packed as rows of
their own; null ids stay null; columns other than id, text and prompt are not read, whatever their names; a null or
negative prompt is 0; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.shared import named, spread, text_batches
from rasterweave.llm.streams import trimmed
from rasterweave.llm.tokens import encoder

#: Examples that wait at once in a task; the heuristic looks at all of them for each placement.
WAITING = 1024
#: Texts tokenised before their examples are placed.
SLICE = 1_000

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Packs (key, start, tokens, loss) examples. ``take`` yields finished sequences: lists of (key, start, length).

    ``limits``: tokens, segments and loss-bearing tokens of a sequence. A cut example shares its loss-bearing
    tokens out in proportion, rounded up in each piece.
    """

    def __init__(self, limits: tuple[int, int, int], cut: bool = True, waiting: int = WAITING):
        self.limits, self.cut, self.waiting = np.array(limits, float), cut, waiting
        self.items = np.zeros((0, 4), np.int64)  # key, start, tokens, loss

    def take(self, items: np.ndarray, last: bool = False):
        """Adds examples (rows key, start, tokens, loss) and yields sequences while enough examples wait."""
        size = int(self.limits[0])
        if self.cut:
            items, whole = self._full_pieces(items, size)
            for key, start in whole:
                yield [(key, start, size)]
        at = 0
        while True:
            if len(self.items) < self.waiting and at < len(items):
                more = items[at : at + 2 * self.waiting - len(self.items)]
                self.items, at = np.concatenate([self.items, more]), at + len(more)
            if not len(self.items) or (at >= len(items) and not last and len(self.items) < self.waiting):
                return
            yield self._sequence()

    def _full_pieces(self, items: np.ndarray, size: int):
        """Pieces of the greatest length are sequences of their own if the limits allow; the tails wait."""
        if not len(items) or self.limits[2] < size:
            return items, []
        n = items[:, 2] // size
        first = np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(items[:, 1], n) + (np.arange(n.sum()) - first) * size
        tails = items.copy()
        tails[:, 1] += n * size
        tails[:, 3] -= np.minimum(tails[:, 3], (tails[:, 3] * n * size) // np.maximum(tails[:, 2], 1))
        tails[:, 2] -= n * size
        tails[:, 3] = np.minimum(tails[:, 3], tails[:, 2])
        return tails[tails[:, 2] > 0], zip(np.repeat(items[:, 0], n).tolist(), starts.tolist(), strict=True)

    def _sequence(self) -> list[tuple[int, int, int]]:
        room, out = self.limits.copy(), []
        need = np.stack([self.items[:, 2], np.ones(len(self.items)), self.items[:, 3]], 1).astype(float)
        scaled, open_ = need / self.limits, np.ones(len(need), bool)
        while True:
            fits = open_ & (need <= room).all(1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, scaled @ (room / self.limits), -1.0)))
            out.append((int(self.items[best, 0]), int(self.items[best, 1]), int(self.items[best, 2])))
            room -= need[best]
            open_[best] = False
            if room[0] < 1 or room[1] < 1:
                break
        if (self.cut or not out) and room[0] >= 1 and room[1] >= 1 and open_.any():
            rest = np.flatnonzero(open_)
            best = int(rest[np.argmax((scaled @ (room / self.limits))[rest])])
            key, start, n, loss = (int(x) for x in self.items[best])
            part = int(min(room[0], n if not loss else room[2] * n // loss))
            if part < 1 and not out:
                part = 1
            if part >= 1:
                out.append((key, start, part))
                taken = -(-loss * part // n)
                self.items[best] = (key, start + part, n - part, min(loss - min(loss, taken), n - part))
                open_[best] = n > part
        self.items = self.items[open_]
        return out


def power_of_two_tail(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence's pieces cut again into sequences whose lengths are powers of two."""
    total, out = sum(n for _, _, n in pieces), []
    queue = list(pieces)[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out.append([])
        while size:
            key, start, n = queue.pop()
            part = min(n, size)
            out[-1].append((key, start, part))
            size -= part
            if n > part:
                queue.append((key, start + part, n - part))
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 512,
    max_loss: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
    remembered: int | None = None,
) -> DataFrame:
    """Tokenises and packs every document: a row per piece, with its ids (little-endian unsigned 32-bit).

    ``loss_from_col``: column with the number of leading tokens that bear no loss (a prompt); none: all tokens
    bear loss. ``max_loss``: most loss-bearing tokens of a sequence, 1 at least; None: as many as tokens. ``remembered``:
    most words that a worker's encoder remembers, for memory only; None: the encoder's own bound.
    """
    if max_loss is not None and max_loss < 1:
        raise ValueError("max_loss must be 1 at least")
    loss_from = F.greatest(F.coalesce(named(loss_from_col).cast("long"), F.lit(0)), F.lit(0)) if loss_from_col else F.lit(0).cast("long")
    rows = text_batches(spread(docs)).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").cast("binary").alias("text"), loss_from.alias("prompt"))
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)

    def run(batches):
        encode = encoder(tokenizer, remembered).encode
        packer, base = Packer(limits), TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # documents with pieces still to come: id, ids, ids left
        serial, sequence = 0, 0

        def rows_of(sequences):
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for pieces in (x for s in sequences for x in ([s] if sum(p[2] for p in s) == max_tokens else power_of_two_tail(s))):
                offset = 0
                for key, start, n in pieces:
                    doc_id, ids, left = held[key]
                    row = (doc_id, start, n, len(ids), base + sequence, offset, ids[start : start + n].astype("<u4").tobytes())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += n
                    if left == n:
                        del held[key]
                    else:
                        held[key] = (doc_id, ids, left - n)
                sequence += 1
                if len(cols[0]) >= 500:
                    yield table(cols)
                    cols = [[] for _ in range(7)]
            if cols[0]:
                yield table(cols)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                doc_ids, texts, prompts = (batch.column(i).slice(at, SLICE).to_pylist() for i in range(3))
                ids, counts = encode(texts)
                ends = np.cumsum(counts)
                items = np.zeros((len(counts), 4), np.int64)
                for k, (stop, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = np.empty(n + 1, ids.dtype)
                    own[:n], own[n] = ids[stop - n : stop], end_id
                    held[serial] = (doc_ids[k], own, n + 1)
                    items[k] = (serial, 0, n + 1, max(0, n + 1 - prompts[k]))
                    serial += 1
                yield from rows_of(packer.take(items))
        yield from rows_of(packer.take(np.zeros((0, 4), np.int64), last=True))

    def table(cols):
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(trimmed(run), SCHEMA)
