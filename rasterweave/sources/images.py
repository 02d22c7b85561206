"""Images as rows: creation, dense and pixel forms, views, and files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave import schema
from rasterweave.functions import kernels
from rasterweave.schema import DipError, require


def create_images(spark: SparkSession, width: int, height: int, fmt: str, ids: list[int] | None = None) -> DataFrame:
    """Zero-filled dense images of one size (state PIXELS)."""
    require(width > 0 and height > 0 and width * height < 1 << 32, "INVALID_SIZE")
    depth = schema.pixel_bytes(fmt)
    rows = spark.createDataFrame([(i,) for i in (ids or [0])], "image_id long")
    zeros = F.unhex(F.repeat(F.lit("00"), width * height * depth))
    return rows.select(
        "image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(fmt).alias("format"), F.lit(depth).alias("depth"), F.lit("PIXELS").alias("state"), zeros.alias("pixels"),
        F.lit(None).cast("array<array<float>>").alias("ch"),
    )


def create_images_named(spark: SparkSession, name: str, fmt: str, ids: list[int] | None = None) -> DataFrame:
    return create_images(spark, *schema.resolution(name), fmt, ids)


def with_channels(images: DataFrame, n: int) -> DataFrame:
    """Adds zeroed float planes: n of them, but four for three, as colours live in planes 1 to 3."""
    require(1 <= n <= 6, "INVALID_ARG")
    planes = 4 if n == 3 else n
    plane = F.array_repeat(F.lit(0.0).cast("float"), (F.col("width") * F.col("height")).cast("int"))
    return images.withColumn("ch", F.array_repeat(plane, planes))


def with_complex_planes(images: DataFrame, n: int) -> DataFrame:
    """Adds planes of interleaved real and imaginary parts."""
    require(1 <= n <= 6, "INVALID_ARG")
    plane = F.array_repeat(F.lit(0.0).cast("float"), (F.col("width") * F.col("height") * 2).cast("int"))
    return images.withColumn("ch", F.array_repeat(plane, n))


def release(images: DataFrame) -> None:
    """Gives back what a cached table holds."""
    images.unpersist()


def channels_empty(images: DataFrame) -> DataFrame:
    return images.withColumn("channels_empty", F.col("ch").isNull())


def pixels_of(images: DataFrame) -> DataFrame:
    """Dense to pixel form: (image_id, y, x, v) for one byte a pixel, else c0, c1, c2 (RGB565: the 16-bit value v).

    The bytes are taken apart inside the JVM as hexadecimal digits.
    """
    digits = F.hex("pixels")
    at = F.col("pos") * F.col("depth")

    def byte(k: int):
        return F.conv(F.substr(digits, (2 * (at + k) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")

    spread = images.select("image_id", "width", "format", "depth", "pixels", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("pos"))
    return spread.select(
        "image_id",
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        (F.col("pos") % F.col("width")).cast("int").alias("x"),
        F.when(F.col("depth") == 1, byte(0)).when(F.col("depth") == 2, byte(0) + 256 * byte(1)).alias("v"),
        *[F.when(F.col("depth") == 3, byte(k)).alias(f"c{k}") for k in range(3)],
    )


def dense_of(px: DataFrame, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Pixel to dense form: (image_id, width, height, and an int array p_<column> each, in raster order)."""
    packed = F.array_sort(F.collect_list(F.struct("y", "x", *columns)))
    grouped = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), packed.alias("all"))
    return grouped.select("image_id", "width", "height", *[F.col(f"all.{c}").alias(f"p_{c}") for c in columns])


def view(images: DataFrame, width: int, height: int, fmt: str, depth: int, stride: int) -> DataFrame:
    """A strided view of the pixel buffer as columns; nothing is copied."""
    require(width > 0 and height > 0, "INVALID_SIZE")
    require(fmt in schema.DEPTH and schema.DEPTH[fmt] == depth, "INVALID_FORMAT")
    require(width * height < 1 << 32, "OVERFLOW")
    require(stride >= width * depth, "INVALID_SIZE")
    return images.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(fmt).alias("format"), F.lit(depth).alias("depth"), F.lit(stride).alias("stride"), F.lit("DEFAULT").alias("region"), F.array(F.lit("CPU_READ"), F.lit("CPU_WRITE")).alias("flags"), "pixels")


def view_of_image(images: DataFrame) -> DataFrame:
    """The whole image as a view: stride is the width in bytes."""
    return images.select("image_id", "width", "height", "format", "depth", (F.col("width") * F.col("depth")).alias("stride"), F.lit("DEFAULT").alias("region"), F.array(F.lit("CPU_READ"), F.lit("CPU_WRITE")).alias("flags"), "pixels")


def view_row(views: DataFrame, y: int) -> DataFrame:
    """Row ``y`` of each view as bytes; null outside of the view."""
    start = F.lit(y) * F.col("stride") + 1
    return views.withColumn("row", F.when((F.lit(y) >= 0) & (F.lit(y) < F.col("height")), F.substr("pixels", start.cast("int"), (F.col("width") * F.col("depth")).cast("int"))))


_PNM = "path string, width int, height int, format string, depth int, state string, pixels binary, status string"


def _images_of(files: DataFrame) -> DataFrame:
    """An image's id is a 64-bit hash of its path."""
    found = files.select("path", "content").mapInPandas(_parse_pnm, _PNM)
    return found.select("path", F.xxhash64("path").alias("image_id"), "width", "height", "format", "depth", "state", "pixels", "status")


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """PGM and PPM files (binary, 8 bits) as dense images, through Spark's binary file source.

    ``status``: OK, or why a file holds no image; its other columns are null then.
    """
    return _images_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.p[gp]m").load(path))


def stream_pnm(spark: SparkSession, path: str) -> DataFrame:
    """The continuous form of ``read_pnm``: files that come to a folder, as a stream of images."""
    return _images_of(spark.readStream.format("binaryFile").option("pathGlobFilter", "*.p[gp]m").schema("path string, modificationTime timestamp, length long, content binary").load(path))


def parse_pnm(raw: bytes) -> tuple[int, int, str, bytes]:
    """(width, height, format, pixels)."""
    fields, at = [], 0
    while len(fields) < 4:  # magic, width, height, maximum; comments run to the line's end
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at) + 1 or len(raw)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        require(end > at, "INVALID_FORMAT", "the header ends early")
        fields.append(raw[at:end])
        at = end
    fmt = {b"P5": "GRAYSCALE", b"P6": "RGB888"}.get(fields[0])
    require(fmt is not None and fields[3] == b"255" and fields[1].isdigit() and fields[2].isdigit(), "INVALID_FORMAT")
    width, height = int(fields[1]), int(fields[2])
    size = width * height * schema.DEPTH[fmt]
    require(size > 0 and len(raw) >= at + 1 + size, "INVALID_SIZE")
    return width, height, fmt, raw[at + 1 : at + 1 + size]


def _parse_pnm(batches):
    for batch in batches:
        out = []
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            try:
                width, height, fmt, pixels = parse_pnm(raw)
                out.append((path, width, height, fmt, schema.DEPTH[fmt], "PIXELS", pixels, "OK"))
            except DipError as e:
                out.append((path, None, None, None, None, None, None, e.status))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _PNM.split(", ")]).astype({c: "Int32" for c in ("width", "height", "depth")})


def scaled(images: DataFrame, width: int, height: int) -> DataFrame:
    """Images of one byte a channel at another size, by the nearest pixel; those that have it stay as they are."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                pixels = bytes(r.pixels)
                if (r.width, r.height) != (width, height):
                    planes = np.frombuffer(pixels, np.uint8).reshape(r.height, r.width, r.depth).transpose(2, 0, 1)
                    pixels = kernels.resize(planes, width, height).astype(np.uint8).transpose(1, 2, 0).tobytes()
                out.append(pixels)
            yield batch.assign(pixels=out, width=width, height=height)

    return images.mapInPandas(run, images.schema)


def write_pnm(images: DataFrame, folder: str) -> int:
    """Shows images: writes each as a PGM or PPM file (the display of a system without one); counts them.

    ``folder`` must be one that every executor can write to.
    """
    import os

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for r in batch.itertuples():
                kinds = {"GRAYSCALE": ("P5", "pgm"), "MASK": ("P5", "pgm"), "RGB888": ("P6", "ppm")}
                if r.format not in kinds:
                    raise DipError("INVALID_FORMAT", r.format)
                magic, ending = kinds[r.format]
                name = f"{folder}/{r.image_id}.{ending}"
                with open(f"{name}.part", "wb") as f:
                    f.write(f"{magic}\n{r.width} {r.height}\n255\n".encode() + bytes(r.pixels))
                os.replace(f"{name}.part", name)
            yield pd.DataFrame({"n": [len(batch)]})

    shown = images.select("image_id", "width", "height", "format", "pixels").mapInPandas(run, "n long")
    return shown.agg(F.sum("n")).first()[0] or 0


#: Named colours of the display, as RGB565.
DISPLAY_COLOURS = {
    "BLACK": 0x0000,
    "WHITE": 0xFFFF,
    "RED": 0xF800,
    "GREEN": 0x07E0,
    "BLUE": 0x001F,
    "YELLOW": 0xFFE0,
    "CYAN": 0x07FF,
    "MAGENTA": 0xF81F,
    "GRAY": 0x8410,
    "LIGHT_GRAY": 0xC618,
    "DARK_GRAY": 0x4208,
    "ORANGE": 0xFD20,
    "PINK": 0xF81F,
    "BROWN": 0xA145,
    "PURPLE": 0x780F,
    "NAVY": 0x000F,
    "TEAL": 0x0410,
    "LIME": 0x07E0,
    "MAROON": 0x8000,
    "OLIVE": 0x8400,
}


def clear(px: DataFrame, colour: str = "BLACK") -> DataFrame:
    """Every pixel of the RGB565 images set to a named colour."""
    require(colour in DISPLAY_COLOURS, "INVALID_ARG", colour)
    return px.withColumn("v", F.lit(DISPLAY_COLOURS[colour]))


def luma_of_yuv422(frames: DataFrame) -> DataFrame:
    """Grey images of interleaved YUV 4:2:2 frames: every other byte is a pixel's brightness."""
    luma = F.unhex(F.regexp_replace(F.hex("pixels"), "(..)..", "$1"))
    return frames.select("image_id", "width", "height", F.lit("GRAYSCALE").alias("format"), F.lit(1).alias("depth"), F.lit("PIXELS").alias("state"), luma.alias("pixels"))


def centre_crop(px: DataFrame, width: int, height: int, from_width: int, from_height: int) -> DataFrame:
    """The middle of larger frames, with coordinates counted anew."""
    require(width <= from_width and height <= from_height, "INVALID_SIZE")
    x0, y0 = (from_width - width) // 2, (from_height - height) // 2
    inside = px.filter(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)
