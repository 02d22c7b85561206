"""Running numpy kernels over images in dense form, many images of one size at a time.

``images``: image_id, width, height and int arrays (``p``, or ``p_<column>``), a row an image. Rows stay where they
are: an Arrow batch is one stack of arrays, a kernel sees (images, height, width), and nothing is shuffled, but for tables
so small that their files would leave cores idle: these are dealt out first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def input_bytes(df: DataFrame) -> int:
    """What the optimizer takes ``df`` to hold: for tables, the size of their files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt out over all cores if it is read from files and so small, less than a quarter of a split for
    each core, that its few files or row groups would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    shuffled = re.search(r"\b(Aggregate|Join|Window|Repartition|Sort)", df._jdf.queryExecution().optimizedPlan().toString())
    return df.repartition(cores) if not shuffled and 4 * input_bytes(df) <= cores * split else df


def _stacks(batch: pa.RecordBatch, planes: list[str]):
    """(image ids, planes as (n, h, w), places in the batch) of each size in a batch."""
    width, height = (np.asarray(batch.column(c)) for c in ("width", "height"))
    ids = np.asarray(batch.column("image_id"))
    shapes = np.unique(np.stack([height, width], 1), axis=0) if len(ids) else []
    for h, w in shapes:
        rows = pa.array(np.flatnonzero((height == h) & (width == w)))
        part = [np.asarray(batch.column(p).take(rows).flatten()).reshape(len(rows), h, w) for p in planes]
        yield ids[np.asarray(rows)], part, rows


def to_pixels(images: DataFrame, kernel: Callable, outputs: dict[str, str], planes: tuple[str, ...] = ("p",), carry: dict[str, str] | None = None) -> DataFrame:
    """Pixel rows (image_id, y, x, outputs) of ``kernel(*stacks)``, which gives an (n, h, w) array for each output.

    ``carry``: other columns of the images, and their types, repeated for each pixel.
    """
    carry = carry or {}
    names, kinds = list(outputs), [ARROW[k] for k in outputs.values()]

    def run(batches):
        for batch in batches:
            for ids, stacks, rows in _stacks(batch, list(planes)):
                found = kernel(*stacks)
                found = found if isinstance(found, tuple) else (found,)
                n, h, w = found[0].shape
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, h * w)), pa.array(np.tile(y, n)), pa.array(np.tile(x, n)), *(pa.array(f.ravel()).cast(k) for f, k in zip(found, kinds, strict=True)), *(batch.column(c).take(rows.take(pa.array(np.repeat(np.arange(n), h * w)))) for c in carry)],
                    names=["image_id", "y", "x", *names, *carry],
                )

    schema = "image_id long, y int, x int, " + ", ".join(f"{n} {k}" for n, k in (outputs | carry).items())
    return spread(images).select("image_id", "width", "height", *planes, *carry).mapInArrow(run, schema)


def to_rows(images: DataFrame, kernel: Callable, outputs: dict[str, str], planes: tuple[str, ...] = ("p",)) -> DataFrame:
    """A row an image (image_id, outputs): ``kernel(*stacks)`` gives an array of n values for each output."""
    names, kinds = list(outputs), [ARROW[k] for k in outputs.values()]

    def run(batches):
        for batch in batches:
            for ids, stacks, _ in _stacks(batch, list(planes)):
                found = kernel(*stacks)
                found = found if isinstance(found, tuple) else (found,)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.asarray(f)).cast(k) for f, k in zip(found, kinds, strict=True))], names=["image_id", *names])

    return spread(images).select("image_id", "width", "height", *planes).mapInArrow(run, "image_id long, " + ", ".join(f"{n} {k}" for n, k in outputs.items()))


def dense_rgb(px3: DataFrame) -> DataFrame:
    """Colour pixel rows to dense planes p_c0, p_c1, p_c2."""
    grouped = px3.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("y", "x", "c0", "c1", "c2"))).alias("all"))
    return grouped.select("image_id", "width", "height", *[F.col(f"all.c{k}").alias(f"p_c{k}") for k in range(3)])
