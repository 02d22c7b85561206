"""The serial frame format as a Spark data source, ``framewire``: images, JPEG data and arrays on a byte stream.

Fixed values: a frame is ``ST`` and a kind: ``W`` (an image: width, height, format, depth, bytes), ``R`` (a request: the
same header), ``J`` (JPEG data: length, bytes), ``1`` to ``7`` (an array: count, bytes an element, bytes). Numbers are
little-endian, 32 bits, the array's element size 8 bits.

A frame has no name on the wire. Reading tells it by its file and its number there, ``file`` and ``seq``; ``frame_id`` is
one number for both: the file's place among the folder's, by name, and the frame's place in it. Files that come later have
later names, so numbers stay. An image's own id travels, if asked for, as an array frame of one 64-bit number before it.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from rasterweave.schema import DEPTH, require

FORMATS = ("GRAYSCALE", "RGB888", "RGB565", "YUV", "HSI", "MASK")
ARRAYS = ("HISTOGRAM", "PROJECTION", "LINE_PROFILE", "KERNEL", "TEMPORAL_TRACE", "GRADIENT", "OTHER")
SCHEMA = "seq long, kind string, width int, height int, format string, depth int, element_bytes int, payload binary, file string, frame_id long"


def swap16(raw: bytes) -> bytes:
    """The two bytes of each 16-bit pixel exchanged."""
    out = bytearray(raw)
    out[0::2], out[1::2] = raw[1::2], raw[0::2]
    return bytes(out)


def encode_frame(kind: str, width: int | None, height: int | None, fmt: str | None, element_bytes: int | None, payload: bytes, swap: bool = False) -> bytes:
    if kind in ("image", "request"):
        sent = "GRAYSCALE" if fmt == "MASK" else fmt
        require(sent in FORMATS, "INVALID_FORMAT", str(fmt))
        head = struct.pack("<4I", width, height, FORMATS.index(sent), DEPTH[sent])
        if kind == "request":
            return b"STR" + head
        require(len(payload) == width * height * DEPTH[sent], "INVALID_SIZE")
        return b"STW" + head + (swap16(payload) if swap and sent == "RGB565" else payload)
    if kind == "jpeg":
        return b"STJ" + struct.pack("<I", len(payload)) + payload
    require(kind in ARRAYS, "INVALID_ARG", kind)
    require(bool(element_bytes) and len(payload) % element_bytes == 0, "INVALID_SIZE")
    return f"ST{ARRAYS.index(kind) + 1}".encode() + struct.pack("<IB", len(payload) // element_bytes, element_bytes) + payload


def decode_frames(raw: bytes, swap: bool = False) -> Iterator[tuple]:
    """Frames of a stream: (kind, width, height, format, depth, element_bytes, payload)."""
    at = 0
    while at < len(raw):
        require(raw[at : at + 2] == b"ST", "COMMUNICATION", f"no frame at byte {at}")
        kind, at = raw[at + 2 : at + 3], at + 3
        if kind in (b"W", b"R"):
            width, height, fmt, depth = struct.unpack_from("<4I", raw, at)
            require(fmt < len(FORMATS) and DEPTH[FORMATS[fmt]] == depth, "INVALID_FORMAT")
            at, size = at + 16, width * height * depth if kind == b"W" else 0
            head = ("image" if kind == b"W" else "request", width, height, FORMATS[fmt], depth, None)
        elif kind == b"J":
            (size,), at = struct.unpack_from("<I", raw, at), at + 4
            head = ("jpeg", None, None, None, None, None)
        else:
            require(kind in b"1234567" and kind != b"", "COMMUNICATION")
            count, each = struct.unpack_from("<IB", raw, at)
            at, size = at + 5, count * each
            head = (ARRAYS[int(kind) - 1], None, None, None, None, each)
        require(at + size <= len(raw), "TIMEOUT", "the stream ends within a frame")
        payload, at = raw[at : at + size], at + size
        yield (*head, swap16(payload) if swap and head[3] == "RGB565" else payload)


def id_payload(number: Column) -> Column:
    """A 64-bit number as its bytes, lowest first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))), ""))


def payload_id(payload: Column) -> Column:
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(payload), F.lit("(..)"), F.lit(1))), ""), 16, -10).cast("long")


def name_frames(frames: DataFrame) -> DataFrame:
    """Before each frame of (image_id, kind, ...) an array frame with its id; a frame and its name stay together."""
    first = frames.select("image_id", F.lit("OTHER").alias("kind"), F.lit(8).alias("element_bytes"), id_payload(F.col("image_id")).alias("payload"), F.lit(0).alias("turn"))
    return first.unionByName(frames.withColumn("turn", F.lit(1)), allowMissingColumns=True).repartition("image_id").sortWithinPartitions("image_id", "turn")


def named_frames(frames: DataFrame) -> DataFrame:
    """Image frames with the ``image_id`` that the array frame before each of them holds."""
    ids = frames.filter("kind = 'OTHER' and element_bytes = 8 and length(payload) = 8").select((F.col("frame_id") + 1).alias("frame_id"), payload_id(F.col("payload")).alias("image_id"))
    return frames.filter("kind = 'image'").join(ids, "frame_id")


def wire_folder(spark: SparkSession) -> str:
    """A new folder for frames where executors and driver share one: under ``spark.checkpoint.dir``, which must be a path
    that all of them mount; a local one where none is set (tests, one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    require(not base or base.startswith(("/", "file:")), "NOT_SUPPORTED", f"frames need a mounted folder, not {base}")
    if base:
        base = re.sub("^file:/*", "/", base)
        os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="frames_", dir=base)


@dataclass
class _File(InputPartition):
    path: str
    place: int


@dataclass
class _Wrote(WriterCommitMessage):
    path: str
    frames: int


def _files(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.frames")) if os.path.isdir(path) else glob.glob(path))


def _rows(file: _File, swap: bool) -> Iterator[tuple]:
    with open(file.path, "rb") as f:
        for seq, (kind, width, height, fmt, depth, each, payload) in enumerate(decode_frames(f.read(), swap)):
            yield (seq, kind, width, height, fmt, depth, each, payload, os.path.basename(file.path), (file.place << 32) + seq)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.swap = options["path"], options.get("swap", "false").lower() == "true"

    def partitions(self):
        return [_File(p, k) for k, p in enumerate(_files(self.path))]

    def read(self, partition):
        return _rows(partition, self.swap)


class _StreamReader(DataSourceStreamReader):
    """Files that come to a folder, in order of name; an offset is the number of files."""

    def __init__(self, options):
        self.path, self.swap = options["path"], options.get("swap", "false").lower() == "true"

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        return {"files": len(_files(self.path))}

    def partitions(self, start, end):
        return [_File(p, k) for k, p in enumerate(_files(self.path)[: end["files"]]) if k >= start["files"]]

    def read(self, partition):
        return _rows(partition, self.swap)

    def commit(self, end):
        pass


class _Writer(DataSourceWriter):
    """A file for each task, named in place when all of it is written; later writes have later names."""

    def __init__(self, options, overwrite: bool):
        self.path, self.swap = options["path"], options.get("swap", "false").lower() == "true"
        self.stamp, self.old = f"{time.time_ns():020d}", _files(options["path"]) if overwrite else []

    def commit(self, messages):
        for path in self.old:
            os.remove(path)

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        name, n = os.path.join(self.path, f"{self.stamp}-{context.partitionId():05d}.frames"), 0
        with open(f"{name}.{context.taskAttemptId()}", "wb") as f:
            for row in iterator:
                f.write(encode_frame(row["kind"], row["width"], row["height"], row["format"], row["element_bytes"], bytes(row["payload"] or b""), self.swap))
                n += 1
        os.replace(f"{name}.{context.taskAttemptId()}", name)
        return _Wrote(name, n)


class FramewireSource(DataSource):
    """``spark.dataSource.register(FramewireSource)``, then ``format("framewire")`` to read, stream and write."""

    @classmethod
    def name(cls):
        return "framewire"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return _Reader(self.options)

    def streamReader(self, schema: StructType):
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options, overwrite)
