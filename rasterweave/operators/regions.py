"""Connected regions of images too large for one row: labels by tile, then merged across the tiles' borders.

Each tile is labelled by itself. Pixels on both sides of a border that are set make their labels equal; only these
equalities, as many as border pixels at most, go through rounds of smallest-label propagation with pointer jumping.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions import kernels
from rasterweave.operators.dense import to_pixels
from rasterweave.schema import require


_LOCAL: list[str] = []


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that the session names (tests, one machine: a local one where it names none)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        _LOCAL[:] = _LOCAL or ["file://" + tempfile.mkdtemp(prefix="regions_")]
        folder = _LOCAL[0]
    path = f"{folder.rstrip('/')}/regions-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _discard(df: DataFrame) -> None:
    """Deletes a table of ``_written`` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _roots(stack: np.ndarray) -> np.ndarray:
    """Of each pixel that is set, the raster place of its region's first pixel; -1 for others."""
    label = kernels.label_components(stack)
    n, h, w = label.shape
    flat, place = label.reshape(n, -1), np.arange(h * w)
    first = np.full((n, h * w + 1), h * w)
    np.minimum.at(first, (np.arange(n)[:, None], flat), place)
    return np.where(flat > 0, np.take_along_axis(first, flat, 1), -1).reshape(n, h, w)


def merged_labels(links: DataFrame) -> DataFrame:
    """(image_id, node, label): the smallest node that each node of the links (image_id, a, b) reaches."""
    both = _written(links.select("image_id", "a", "b").unionByName(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _written(both.groupBy("image_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, ["image_id", "node"]).select("image_id", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lower.select("image_id", F.col("node").alias("label"), F.col("label").alias("top"))
        new = _written(lower.join(up, ["image_id", "label"], "left").select("image_id", "node", "old", F.coalesce("top", "label").alias("label")))
        _discard(labels)
        labels = new.drop("old")
        if not new.filter("old <> label").limit(1).count():
            _discard(both)
            return labels


def components_tiled(px: DataFrame, tile: int) -> DataFrame:
    """(image_id, y, x, v): 4-connected regions of pixels that are not 0, numbered by first appearance; others 0."""
    require(tile > 0, "INVALID_ARG")
    ty, tx = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")
    packed = px.groupBy("image_id", ty.alias("ty"), tx.alias("tx")).agg((F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("all"))
    y0, x0 = F.col("ty") * tile, F.col("tx") * tile
    tiles = packed.select("image_id", "ty", "tx", (F.col("x1") - x0).alias("width"), (F.col("y1") - y0).alias("height"), F.col("all.v").alias("p"))
    local = to_pixels(tiles, _roots, {"root": "long"}, carry={"ty": "int", "tx": "int"})
    # a region's name in the image: row and column of its first pixel in the tile, as one number
    wide = F.least(F.lit(tile), F.max("x").over(Window.partitionBy("image_id", "ty", "tx")) + 1)
    named = local.withColumn("w", wide).withColumn("node", F.when(F.col("root") >= 0, F.shiftleft((y0 + F.floor(F.col("root") / F.col("w"))).cast("long"), 31) + x0 + F.col("root") % F.col("w")))
    named = _written(named.select("image_id", (F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), "node"))

    set_ = named.filter("node is not null")
    pairs = []
    for axis in ("y", "x"):
        edge = set_.filter(F.col(axis) % tile == tile - 1).withColumn(axis, F.col(axis) + 1).withColumnRenamed("node", "a")
        other = set_.filter((F.col(axis) % tile == 0) & (F.col(axis) > 0)).withColumnRenamed("node", "b")
        pairs.append(edge.join(other, ["image_id", "y", "x"]).select("image_id", "a", "b"))
    merged = merged_labels(pairs[0].unionByName(pairs[1]).distinct())
    whole = named.join(merged, ["image_id", "node"], "left").select("image_id", "y", "x", F.coalesce("label", "node").alias("root"))
    number = whole.filter("root is not null").select("image_id", "root").distinct().withColumn("v", F.row_number().over(Window.partitionBy("image_id").orderBy("root")))
    return whole.join(number, ["image_id", "root"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))
