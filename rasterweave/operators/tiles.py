"""Kernels on images too large for one row: tiles with a margin, each a row of its own.

A pixel goes to its tile and, where it lies in their margin, to the neighbouring ones. A kernel that looks no further
than the margin gives the same values inside of a tile as on the whole image: at the image's border a tile ends there
too, so the kernel's own border rule holds. The exchange is by (image, tile), so one image spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.operators.dense import to_pixels
from rasterweave.schema import require


def run_tiled(px: DataFrame, kernel: Callable, kind: str, tile: int, margin: int, column: str = "v") -> DataFrame:
    """Pixel rows (image_id, y, x, v) of ``kernel`` run tile by tile; images may be of any sizes."""
    require(tile > 0 and 0 <= margin <= tile, "INVALID_ARG")
    y, x = F.col("y"), F.col("x")
    low = lambda c: F.greatest(F.lit(0), F.floor((c - margin) / tile))
    spread = px.select("image_id", "y", "x", F.col(column).alias("v"), F.explode(F.sequence(low(y), F.floor((y + margin) / tile))).alias("ty"))
    spread = spread.select("*", F.explode(F.sequence(low(x), F.floor((x + margin) / tile))).alias("tx"))
    keys = ["image_id", "ty", "tx"]
    packed = spread.groupBy(*keys).agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"),
        F.max(((F.floor(y / tile) == F.col("ty")) & (F.floor(x / tile) == F.col("tx"))).cast("int")).alias("own"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"),
    )
    # a tile beyond the border has a margin only
    packed = packed.filter("own = 1").select("image_id", "width", "height", F.col("p.v").alias("p"), *[F.col(c).cast("int").alias(c) for c in ("ty", "tx", "y0", "x0")])
    out = to_pixels(packed, kernel, {"v": kind}, carry=dict.fromkeys(("ty", "tx", "y0", "x0"), "int"))
    moved = out.select("image_id", "ty", "tx", (y + F.col("y0")).alias("y"), (x + F.col("x0")).alias("x"), "v")
    return moved.filter((F.floor(y / tile) == F.col("ty")) & (F.floor(x / tile) == F.col("tx"))).select("image_id", "y", "x", "v")
