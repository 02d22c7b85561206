"""Token files of directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits, lowest first. Level k holds the k-th chunks of all ids that
have one, in order, and a bitmap of which of these ids go on at the next level. A rank directory holds the number
of set bits before every ``RANK_STEP``-th position, so the place of an id's next chunk is a lookup and a count of
few bits: any token, or run of tokens, is read without decoding what lies before it.

File: magic ``DAC1``; then little-endian unsigned 64-bit: number of documents, ids and levels; for each level its
number of chunks; document ids (signed 64-bit), a null flag for each, and document starts (n + 1); then for each
level chunks, bitmap and directory. Sections begin at multiples of 8 bytes. Files of one write cover rising ranges
of document ids, nulls first; the manifest row of each file tells its place.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.shared import materialize, named, partitions, shared_dir, text_batches
from rasterweave.llm.streams import trimmed
from rasterweave.llm.tokens import encoder

CHUNK_BITS = 8
RANK_STEP = 512
#: Ids of a file; a task begins another file beyond it. Texts tokenised at once.
FILE_IDS, SLICE = 16_000_000, 1_000

MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def _section(array: np.ndarray) -> bytes:
    raw = array.tobytes()
    return raw + bytes(-len(raw) % 8)


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level."""
    left, levels = ids.astype(np.uint32), []
    while True:
        chunks, left = (left & 0xFF).astype(np.uint8), left >> CHUNK_BITS
        more = left > 0
        padded = np.concatenate([more, np.zeros(-len(more) % RANK_STEP, bool)])
        steps = padded.reshape(-1, RANK_STEP).sum(1, dtype=np.uint32)
        levels.append((chunks, np.packbits(more, bitorder="little"), np.concatenate([[0], np.cumsum(steps)]).astype("<u4")))
        left = left[more]
        if not len(left):
            return levels


def encode_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = dac_levels(ids)
    out = [b"DAC1".ljust(8, b"\0"), np.array([len(doc_ids), len(ids), len(levels), *(len(c) for c, _, _ in levels)], "<u8").tobytes()]
    out += [_section(np.array([x or 0 for x in doc_ids], "<i8")), _section(np.array([x is None for x in doc_ids], np.uint8)), _section(starts.astype("<u8"))]
    for parts in levels:
        out += [_section(x) for x in parts]
    return b"".join(out)


class TokenFile:
    """Random access to the ids of one file, held in a buffer (bytes or a memory map)."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        if bytes(self.raw[:4]) != b"DAC1":
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, n_levels = (int(x) for x in np.frombuffer(self.raw, "<u8", 3, 8))
        sizes = np.frombuffer(self.raw, "<u8", n_levels, 32).tolist()
        self._at = 32 + 8 * n_levels
        values, nulls = self._read("<i8", self.n_docs), self._read("u1", self.n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(values, nulls, strict=True)]
        self.starts = self._read("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = [(self._read("u1", n), self._read("u1", -(-n // 8)), self._read("<u4", -(-n // RANK_STEP) + 1)) for n in sizes]

    def _read(self, kind: str, n: int) -> np.ndarray:
        found = np.frombuffer(self.raw, kind, n, self._at)
        self._at += -(-found.nbytes // 8) * 8
        return found

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the chunks of that run alone."""
        ids, level, where = np.zeros(stop - start, np.uint32), 0, None
        while stop > start:
            chunks, bitmap, ranks = self.levels[level]
            part = chunks[start:stop].astype(np.uint32) << (CHUNK_BITS * level)
            if where is None:
                ids = part
            else:
                ids[where] |= part
            low = start // RANK_STEP * RANK_STEP
            bits = np.unpackbits(bitmap[low // 8 : -(-stop // 8)], bitorder="little")
            before, own = int(ranks[low // RANK_STEP]) + int(bits[: start - low].sum()), np.flatnonzero(bits[start - low : stop - low])
            where = own if where is None else where[own]
            start, stop, level = before, before + len(own), level + 1
        return ids

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def _file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))  # Hadoop's names of one store


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every document, in rising order of its id, and returns the manifest, a row per file.

    Null text is empty and has its end id alone; a null document id comes first; rows that repeat an id follow
    one another; an empty table writes no file. Each task renames a finished file, so a repeated task is harmless.
    """
    rows = text_batches(docs).select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").cast("binary").alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        doc_ids, runs, counts, seq, held = [], [], [], 0, 0

        def flush():
            nonlocal doc_ids, runs, counts, seq, held
            ids, lengths = np.concatenate(runs), np.concatenate(counts)
            # every document's ids and its end id
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id) if end_id is not None else ids
            starts = np.concatenate([[0], np.cumsum(lengths + (end_id is not None))])
            system, root = _file_system(f"{folder}/ids-{part:06d}-{seq:04d}.dac")
            system.create_dir(root.rpartition("/")[0])
            with system.open_output_stream(f"{root}.{attempt}") as out:
                out.write(encode_file(doc_ids, starts, ids))
            system.move(f"{root}.{attempt}", root)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/ids-{part:06d}-{seq:04d}.dac", "n_docs": len(doc_ids), "n_ids": int(starts[-1])}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            doc_ids, runs, counts, seq, held = [], [], [], seq + 1, 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, lengths = encode(batch.column(1).slice(at, SLICE).to_pylist())
                doc_ids += batch.column(0).slice(at, SLICE).to_pylist()
                runs.append(ids)
                counts.append(lengths)
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    return materialize(ordered.mapInArrow(trimmed(run), MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids (uint32 bytes)."""
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.select("path", "base").repartition(max(1, manifest.count()), "path")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _file_system(path)
                with system.open_input_file(name) as f:
                    tokens = TokenFile(f.read())
                for at in range(0, tokens.n_docs, 1000):
                    these = range(at, min(at + 1000, tokens.n_docs))
                    ids = [tokens.document(k).astype("<u4") for k in these]
                    yield pa.RecordBatch.from_arrays([pa.array([tokens.doc_ids[k] for k in these], pa.int64()), pa.array([base + int(tokens.starts[k]) for k in these], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=schema)

    return files.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def token_folder(spark) -> str:
    """A new folder for token files in the shared folder; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
