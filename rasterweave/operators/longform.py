"""Relational forms of neighbourhood and spectral operators: pixel rows joined with a small table of weights.

A neighbour is addressed by an equality on clamped coordinates, so the join hashes on (image_id, y, x) and its output
is the number of pixels times that of weights. The table of weights has a row per kernel entry and is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions.kernels import offsets


def _weights(px: DataFrame, kernel: np.ndarray) -> DataFrame:
    a, b = kernel.shape[0] // 2, kernel.shape[1] // 2
    rows = [(dy, dx, float(kernel[dy + a, dx + b])) for dy, dx in offsets(np.asarray(kernel))]
    return px.sparkSession.createDataFrame(rows, "dy int, dx int, weight double")


def neighbours(px: DataFrame, kernel: np.ndarray, border: str, width: int, height: int) -> DataFrame:
    """(image_id, y, x, weight, near): each pixel with the neighbours under the kernel.

    ``border``: "edge" repeats the nearest pixel, "shrink" has the pixels inside only.
    """
    wanted = px.select("image_id", "y", "x").join(F.broadcast(_weights(px, kernel)))
    sy, sx = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    if border == "edge":
        sy, sx = F.greatest(F.lit(0), F.least(F.lit(height - 1), sy)), F.greatest(F.lit(0), F.least(F.lit(width - 1), sx))
    else:
        wanted = wanted.filter(sy.between(0, height - 1) & sx.between(0, width - 1))
    wanted = wanted.select("image_id", "y", "x", "weight", sy.alias("sy"), sx.alias("sx"))
    source = px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("near"))
    return wanted.join(source, ["image_id", "sy", "sx"])


def correlate(px: DataFrame, kernel: np.ndarray, width: int, height: int) -> DataFrame:
    near = neighbours(px, np.asarray(kernel, float), "edge", width, height)
    return near.groupBy("image_id", "y", "x").agg(F.sum(F.col("weight") * F.col("near")).alias("v"))


def rank_filter(px: DataFrame, size: int, how: str, width: int, height: int) -> DataFrame:
    """min, max or median of the pixels inside of a square. The first two run as a window down and a window across."""
    r = size // 2
    if how in ("min", "max"):
        f = F.min if how == "min" else F.max
        down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-r, r)
        across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-r, r)
        return px.withColumn("v", f("v").over(down)).withColumn("v", f("v").over(across))
    near = neighbours(px, np.ones((size, size)), "shrink", width, height)
    return near.groupBy("image_id", "y", "x").agg(F.median("near").alias("v"))


def morphology(px: DataFrame, element: np.ndarray, how: str, width: int, height: int) -> DataFrame:
    """erode: all under the element lie inside and are set; dilate: any is."""
    near = neighbours(px, element, "shrink", width, height).groupBy("image_id", "y", "x").agg(F.sum(F.when(F.col("near") != 0, 1).otherwise(0)).alias("n"))
    whole = px.select("image_id", "y", "x").join(near, ["image_id", "y", "x"], "left")
    need = int(np.count_nonzero(element)) if how == "erode" else 1
    return whole.select("image_id", "y", "x", F.when(F.col("n") >= need, 255).otherwise(0).alias("v"))


def dft(px: DataFrame, size: int) -> DataFrame:
    """The spectrum as two joins with a table of cosines and sines, a line at a time: rows (image_id, y, x, re, im)."""
    rows = [(a, b, math.cos(2 * math.pi * a * b / size), -math.sin(2 * math.pi * a * b / size)) for a in range(size) for b in range(size)]
    turn = px.sparkSession.createDataFrame(rows, "k int, s int, c double, d double")
    first = px.join(F.broadcast(turn), F.col("x") == F.col("s")).groupBy("image_id", "y", "k").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("d")).alias("im"))
    first = first.withColumnRenamed("k", "kx")
    second = first.join(F.broadcast(turn), F.col("y") == F.col("s"))
    re, im = F.col("re") * F.col("c") - F.col("im") * F.col("d"), F.col("re") * F.col("d") + F.col("im") * F.col("c")
    return second.groupBy("image_id", F.col("k").alias("y"), F.col("kx").alias("x")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def shift_quadrants(px: DataFrame, width: int, height: int) -> DataFrame:
    """A projection: coordinates move by half the size."""
    return px.withColumn("y", (F.col("y") + height // 2) % height).withColumn("x", (F.col("x") + width // 2) % width)


def resize(px: DataFrame, width: int, height: int, from_width: int, from_height: int) -> DataFrame:
    """Nearest pixel to the upper left, by the positions that each source pixel fills: no join."""
    spread = px.withColumn("__y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).filter(F.floor(F.col("__y") * from_height / height) == F.col("y"))
    spread = spread.withColumn("__x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).filter(F.floor(F.col("__x") * from_width / width) == F.col("x"))
    return spread.select("image_id", F.col("__y").alias("y"), F.col("__x").alias("x"), "v")


def hough(px: DataFrame, thetas: list[tuple[float, float]], width: int, height: int) -> DataFrame:
    """Votes (image_id, r, t, votes) of pixels that are 255, for lines (cos, sin) of the listed angles."""
    most = int(math.hypot(width, height))
    table = px.sparkSession.createDataFrame([(t, c, s) for t, (c, s) in enumerate(thetas)], "t int, c double, s double")
    voted = px.filter("v = 255").join(F.broadcast(table))
    r = F.floor(F.col("x") * F.col("c") + F.col("y") * F.col("s") + F.lit(float(most))).cast("int")
    return voted.select("image_id", r.alias("r"), "t").filter(F.col("r").between(0, 2 * most)).groupBy("image_id", "r", "t").agg(F.count(F.lit(1)).alias("votes"))


def lines_of(votes: DataFrame, threshold: int, most: int, offset: int, resolution: float = 1.0, step: float = 1.0) -> DataFrame:
    """The first ``most`` cells of each image, in scan order, with enough votes."""
    scan = Window.partitionBy("image_id").orderBy("r", "t")
    found = votes.filter(F.col("votes") >= threshold).withColumn("k", F.row_number().over(scan)).filter(F.col("k") <= most)
    return found.select("image_id", (F.col("r") * resolution - offset).alias("rho"), (F.col("t") * step).alias("theta"), "votes")


def draw(px: DataFrame, points: list[tuple[int, int]], colour: int, width: int, height: int) -> DataFrame:
    """Pixels on the listed points take the colour; points outside are left out."""
    inside = sorted({(x, y) for x, y in points if 0 <= x < width and 0 <= y < height})
    line = px.sparkSession.createDataFrame(inside, "x int, y int").withColumn("__on", F.lit(True))
    drawn = px.join(F.broadcast(line), ["y", "x"], "left")
    return drawn.select("image_id", "y", "x", F.when(F.col("__on"), colour).otherwise(F.col("v")).alias("v"))
