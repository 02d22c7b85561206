"""Histograms and what follows from them. All plans aggregate per image and level first: 256 rows an image at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(px: DataFrame, dense: bool = True) -> DataFrame:
    """(image_id, level, n); ``dense``: all 256 levels, those not met with 0."""
    counts = px.groupBy("image_id", F.col("v").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        return counts
    filled = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    levels = filled.select("image_id", "m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    return levels.select("image_id", "level", F.coalesce(F.element_at("m", F.col("level")), F.lit(0)).alias("n"))


def _running(*order: str) -> Window:
    return Window.partitionBy("image_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def otsu(px: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The level with the largest variance between classes, the lowest on a tie; 0 for a flat image.

    Variances are compared as exact integers' quotients in double precision, over levels that occur; between them the
    variance does not change, so the first level of a tie is one that occurs.
    """
    counts = px.groupBy(*by, F.col("v").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    sums = counts.select(
        *by, "level", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("level")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s")
    )
    w1 = F.col("w") - F.col("w0")
    apart = F.col("s0") * F.col("w") - F.col("s") * F.col("w0")
    spread = F.when(w1 > 0, apart.cast("double") * apart.cast("double") / (F.col("w0").cast("double") * w1.cast("double"))).otherwise(0.0)
    best = sums.select(*by, "level", spread.alias("spread")).groupBy(*by).agg(F.max_by(F.col("level"), F.struct("spread", -F.col("level"))).alias("t"), F.max("spread").alias("most"))
    return best.select(*by, F.when(F.col("most") > 0, F.col("t")).otherwise(0).cast("int").alias("t"))


def binarize_otsu(px: DataFrame) -> DataFrame:
    return px.join(otsu(px), "image_id").select("image_id", "y", "x", F.when(F.col("v") >= F.col("t"), 255).otherwise(0).alias("v"))


def binarize_local_otsu(px: DataFrame, block: int) -> DataFrame:
    """Each tile of ``block`` x ``block`` pixels by its own threshold; tiles at the border are smaller."""
    tiled = px.withColumn("ty", F.floor(F.col("y") / block)).withColumn("tx", F.floor(F.col("x") / block))
    keys = ("image_id", "ty", "tx")
    return tiled.join(otsu(tiled, keys), list(keys)).select("image_id", "y", "x", F.when(F.col("v") >= F.col("t"), 255).otherwise(0).alias("v"))


def _cumulated(px: DataFrame) -> DataFrame:
    counts = px.groupBy("image_id", F.col("v").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("image_id", "level", "n", F.sum("n").over(_running("level")).alias("cdf"), F.sum("n").over(Window.partitionBy("image_id")).alias("total"))


def equalization(px: DataFrame) -> DataFrame:
    """(image_id, level, value): (cdf - cdf[0]) / (total - cdf[0]), null where that is 0 / 0."""
    zero = F.sum(F.when(F.col("level") == 0, F.col("n")).otherwise(0)).over(Window.partitionBy("image_id"))
    cum = _cumulated(px).withColumn("zero", zero)
    return cum.select("image_id", "level", F.try_divide((F.col("cdf") - F.col("zero")).cast("double"), (F.col("total") - F.col("zero")).cast("double")).alias("value"))


def equalize(px: DataFrame) -> DataFrame:
    lut = equalization(px).withColumnRenamed("level", "v")
    return px.join(lut, ["image_id", "v"]).select("image_id", "y", "x", "value")


def specification(px: DataFrame, target: list[int]) -> DataFrame:
    """(image_id, level, mapped): the level whose target cdf is nearest, the lowest on a tie.

    Both distributions rise, so the nearest level is a step function of the image's: with the target's distinct sums in
    order, it moves on where the image's share passes the middle of two of them. The step is found by bisection over an
    array literal, in integers: 2 * cdf * sum(target) > (sum + next sum) * total.
    """
    running, total = {}, 0
    for level, n in enumerate(target):
        total += n
        running.setdefault(total, level)
    goals, levels = list(running), list(running.values())
    middles = [a + b for a, b in zip(goals, goals[1:])]
    literal = lambda numbers: F.array(*[F.lit(n).cast("long") for n in numbers])
    at = F.lit(0)
    if middles:
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(middles).bit_length()))])
        beyond = lambda place: 2 * F.col("cdf") * F.lit(total) > F.element_at(literal(middles), place) * F.col("total")
        at = F.aggregate(steps, F.lit(0), lambda place, step: F.when((place + step <= len(middles)) & beyond(F.least(place + step, F.lit(len(middles)))), place + step).otherwise(place))
    found = _cumulated(px).withColumn("place", at + 1)
    found = found.select("image_id", "level", "total", F.abs(F.col("cdf") * F.lit(total) - F.element_at(literal(goals), F.col("place")) * F.col("total")).alias("apart"), F.element_at(literal(levels), F.col("place")).alias("nearest"))
    # a distance of 1 or more finds nothing, and level 0 stays
    return found.select("image_id", "level", F.when(F.col("apart") < F.col("total") * F.lit(total), F.col("nearest")).otherwise(0).cast("int").alias("mapped"))


def specify(px: DataFrame, target: list[int]) -> DataFrame:
    lut = specification(px, target).withColumnRenamed("level", "v")
    return px.join(lut, ["image_id", "v"]).select("image_id", "y", "x", F.col("mapped").alias("v"))


def normalize(px: DataFrame, column: str = "v", rounded: bool = False) -> DataFrame:
    """Stretched to 0..255 by the image's extremes, truncated (``rounded``: to the nearest); 0 if flat."""
    per_image = px.groupBy("image_id").agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    share = (F.col(column) - F.col("__low")) * 255.0 / (F.col("__high") - F.col("__low"))
    out = F.when(F.col("__high") == F.col("__low"), 0).otherwise(F.floor(share + (0.5 if rounded else 0.0)).cast("int"))
    return px.join(per_image, "image_id").withColumn(column, out).drop("__low", "__high")


def convert_to_pixels(px3: DataFrame, compat: bool = False) -> DataFrame:
    """Three float planes to 8 bits, each stretched by its own extremes. ``compat``: in the order c2, c1, c0."""
    names = ["c0", "c1", "c2"]
    per_image = px3.groupBy("image_id").agg(*[f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.min, "low"), (F.max, "high"))])
    source = [F.floor(F.col(c)) if compat else F.col(c) for c in names]
    low = [F.floor(F.col(f"{c}_low")) if compat else F.col(f"{c}_low") for c in names]
    high = [F.floor(F.col(f"{c}_high")) if compat else F.col(f"{c}_high") for c in names]
    out = [F.when(h == a, 0).otherwise(F.floor((v - a) * 255.0 / (h - a)).cast("int")) for v, a, h in zip(source, low, high)]
    return px3.join(per_image, "image_id").select("image_id", "y", "x", *[c.alias(n) for c, n in zip(reversed(out) if compat else out, names)])


def region_statistics(px: DataFrame, inside) -> DataFrame:
    """Counts, integer means and variances (at least 25) of the pixels inside and outside of a region."""
    parts = []
    for name, where in (("fg", inside), ("bg", ~inside)):
        v = F.when(where, F.col("v"))
        n = F.count(v)
        parts += [n.alias(f"{name}_n"), F.floor(F.try_divide(F.sum(v), n)).cast("int").alias(f"{name}_mean"), F.greatest(F.var_pop(v), F.lit(25.0)).alias(f"{name}_var")]
    return px.groupBy("image_id").agg(*parts)


def neighbour_contrast(px: DataFrame) -> DataFrame:
    """Mean squared difference to the right and lower neighbours, over one more than their number."""
    right = F.lead("v").over(Window.partitionBy("image_id", "y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy("image_id", "x").orderBy("y"))
    pairs = px.select("image_id", (F.col("v") - right).alias("a"), (F.col("v") - down).alias("b"))
    total = F.sum(F.coalesce(F.col("a") * F.col("a"), F.lit(0)) + F.coalesce(F.col("b") * F.col("b"), F.lit(0)))
    return pairs.groupBy("image_id").agg((total / (F.count("a") + F.count("b") + 1)).alias("contrast"))


def otsu_segments(px: DataFrame) -> DataFrame:
    """Per image: threshold, and number and sum of the pixels at or above it, all from its histogram."""
    counts = px.groupBy("image_id", F.col("v").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    weight = F.col("n") * F.col("level")
    sums = counts.select("image_id", "level", "n", F.sum("n").over(upto).alias("w0"), F.sum(weight).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(weight).over(whole).alias("s"))
    apart = (F.col("s0") * F.col("w") - F.col("s") * F.col("w0")).cast("double")
    spread = F.when(F.col("w") > F.col("w0"), apart * apart / (F.col("w0").cast("double") * (F.col("w") - F.col("w0")).cast("double"))).otherwise(0.0)
    # what lies from each level on comes with the level, so the best level brings its answer along
    each = sums.select("image_id", F.when(spread > 0, spread).otherwise(0.0).alias("spread"), "level", (F.col("w") - F.col("w0") + F.col("n")).alias("fg"), (F.col("s") - F.col("s0") + weight).alias("fg_sum"), "w", "s")
    best = each.groupBy("image_id").agg(F.max_by(F.struct("level", "fg", "fg_sum", "spread", "w", "s"), F.struct("spread", -F.col("level"))).alias("b"))
    flat = F.col("b.spread") <= 0
    return best.select(
        "image_id", F.when(flat, 0).otherwise(F.col("b.level")).cast("int").alias("t"), F.when(flat, F.col("b.w")).otherwise(F.col("b.fg")).alias("fg_count"), F.when(flat, F.col("b.s")).otherwise(F.col("b.fg_sum")).alias("fg_sum")
    )
