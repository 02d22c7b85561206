"""Image tables built from the driver's tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 grey images, a row a pixel: (image_id, y, x, v) from the 64 components of each embedding."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.6) * 200))).cast("int")
    return rows.select(F.col("vec_id").alias("image_id"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), level.alias("v"))


def img8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images, a row an image: (image_id, width, height, p array<int>), without a shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    level = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) * 200))).cast("int")
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", level).alias("p"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images (image_id, y, x, c0, c1, c2) from three consecutive vectors; incomplete triples are left out.

    One aggregation: the three values of a pixel meet on (image, position).
    """
    px = px8(spark, sf_dir).withColumn("k", F.col("image_id") % 3).withColumn("image_id", F.col("image_id") - F.col("image_id") % 3)
    picked = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"c{k}") for k in range(3)]
    return px.groupBy("image_id", "y", "x").agg(*picked).filter("c0 is not null and c1 is not null and c2 is not null")


def mask8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px8(spark, sf_dir).select("image_id", "y", "x", (F.col("v") >= 120).cast("int").alias("m"))


def edge8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px8(spark, sf_dir).select("image_id", "y", "x", F.when(F.col("v") >= 150, 255).otherwise(0).alias("v"))


def pair8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 2k and 2k + 1 side by side: (image_id = 2k, y, x, va, vb)."""
    px = px8(spark, sf_dir).withColumn("k", F.col("image_id") % 2).withColumn("image_id", F.col("image_id") - F.col("image_id") % 2)
    grouped = px.groupBy("image_id", "y", "x").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("va"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("vb"))
    return grouped.filter("va is not null and vb is not null")


def levels_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey levels of line items, an image per supplier: order-free histogram work (image_id, v)."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("image_id"), (F.col("l_quantity") * 5).cast("int").alias("v"))


PX = """px AS MATERIALIZED (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
        greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.6) * 200)))::INT AS v FROM embeddings, range(1, 65) r(i))"""
RGB = f"""{PX}, rgb AS MATERIALIZED (SELECT image_id - image_id % 3 AS image_id, y, x, max(v) FILTER (image_id % 3 = 0) AS c0,
        max(v) FILTER (image_id % 3 = 1) AS c1, max(v) FILTER (image_id % 3 = 2) AS c2 FROM px GROUP BY image_id - image_id % 3, y, x
        HAVING c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL)"""
PAIR = f"""{PX}, pr AS MATERIALIZED (SELECT image_id - image_id % 2 AS image_id, y, x, max(v) FILTER (image_id % 2 = 0) AS va,
        max(v) FILTER (image_id % 2 = 1) AS vb FROM px GROUP BY image_id - image_id % 2, y, x
        HAVING va IS NOT NULL AND vb IS NOT NULL)"""
LI = "li AS (SELECT l_suppkey AS image_id, trunc(l_quantity * 5)::INT AS v FROM lineitem)"
