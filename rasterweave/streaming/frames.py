"""Continuous capture: frames that arrive, processed a micro-batch at a time. Each frame is treated alone; no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterweave.sources.framewire import FramewireSource
from rasterweave.sources.images import pixels_of


def capture(spark: SparkSession, path: str, swap: bool = False) -> DataFrame:
    """A stream of frames from files that come to ``path``."""
    spark.dataSource.register(FramewireSource)
    return spark.readStream.format("framewire").option("path", path).option("swap", str(swap).lower()).load()


def frame_pixels(frames: DataFrame) -> DataFrame:
    """Pixel rows of the image frames, of a stream or a table."""
    images = frames.filter(F.col("kind") == "image").select(F.col("frame_id").alias("image_id"), "width", "height", "format", "depth", F.col("payload").alias("pixels"))
    return pixels_of(images)


def process(frames: DataFrame, step: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``step`` on each micro-batch of frames and hands the result to ``sink``."""
    writer = frames.writeStream.foreachBatch(lambda batch, n: sink(step(batch), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
