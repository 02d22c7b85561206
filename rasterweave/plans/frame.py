"""A fluent interface: images of one size and format as a value, with every operator as a method.

An ``ImageFrame`` holds pixel rows (image_id, y, x and v, or c0, c1, c2); nothing runs until rows are asked for. Point
operators stay projections; order-free statistics are aggregations; kernels gather each image into a row first, on
one exchange by image. Kernels that follow one another run in one pass over these rows: pixels are made only for an
operator that needs them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import color, kernels, point
from rasterweave.operators import histogram as hist
from rasterweave.operators import longform, segment
from rasterweave.operators.dense import ARROW, to_pixels, to_rows
from rasterweave.operators.tiles import run_tiled
from rasterweave.schema import DEPTH, RESOLUTIONS, num_channels, require
from rasterweave.sources import framewire, jpeg
from rasterweave.sources import images as sources

AT = ["image_id", "y", "x"]


def _run(stack: np.ndarray, steps: tuple[tuple[Callable, str], ...]) -> np.ndarray:
    """Kernels one after the other, each result in its type; one that loses digits in it is an error."""
    for f, kind in steps:
        out = f(stack)
        stack = np.asarray(pa.array(out.ravel()).cast(ARROW[kind])).reshape(out.shape)
    return stack


class ImageFrame:
    def __init__(self, px: DataFrame | None, width: int, height: int, fmt: str = "GRAYSCALE"):
        require(fmt in DEPTH, "INVALID_FORMAT", fmt)
        require(width > 0 and height > 0, "INVALID_SIZE")
        self._px, self.width, self.height, self.fmt = px, width, height, fmt
        #: Instead of pixels: dense rows, and the kernels to run on them in turn, each with the type of its result.
        self._rows: DataFrame | None = None
        self._steps: tuple[tuple[Callable, str], ...] = ()

    @property
    def px(self) -> DataFrame:
        """Pixel rows."""
        if self._px is None:
            steps, names = self._steps, tuple(f"p_{c}" for c in self.columns)
            self._px = to_pixels(self._rows, lambda *s: tuple(_run(x, steps) for x in s), {c: steps[-1][1] for c in self.columns}, names)
        return self._px

    # --- making and leaving -------------------------------------------------------------------------------------

    @classmethod
    def of_images(cls, dense: DataFrame, width: int, height: int, fmt: str) -> "ImageFrame":
        """From dense rows with a pixel buffer."""
        px = sources.pixels_of(dense)
        return cls(px.select(*AT, *(["c0", "c1", "c2"] if DEPTH[fmt] == 3 else ["v"])), width, height, fmt)

    @property
    def columns(self) -> list[str]:
        return ["c0", "c1", "c2"] if DEPTH[self.fmt] == 3 else ["v"]

    def num_channels(self) -> int:
        return num_channels(self.fmt)

    def dense(self) -> DataFrame:
        """A row an image: int arrays p_<column>."""
        return sources.dense_of(self.px, tuple(self.columns)).withColumn("width", F.lit(self.width)).withColumn("height", F.lit(self.height))

    def images(self) -> DataFrame:
        """Dense rows with a pixel buffer."""
        low = self.px.select(*AT, *(F.col(c).cast("int").alias(c) for c in self.columns))
        per_pixel = F.concat(*[F.lpad(F.hex(F.col(c)), 2, "0") for c in self.columns]) if self.fmt != "RGB565" else F.concat(F.lpad(F.hex(F.col("v") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("v") / 256)), 2, "0"))
        packed = low.select("image_id", F.struct("y", "x", per_pixel.alias("b")).alias("p")).groupBy("image_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
        return packed.select("image_id", F.lit(self.width).alias("width"), F.lit(self.height).alias("height"), F.lit(self.fmt).alias("format"), F.lit(DEPTH[self.fmt]).alias("depth"), F.lit("PIXELS").alias("state"), F.unhex(F.array_join("p.b", "")).alias("pixels"))

    def compress_jpeg(self, quality: int = 75) -> DataFrame:
        return jpeg.compress(self.images(), quality)

    def _with(self, px: DataFrame | None, fmt: str | None = None, size: tuple[int, int] | None = None) -> "ImageFrame":
        width, height = size or (self.width, self.height)
        return ImageFrame(px, width, height, fmt or self.fmt)

    def map(self, f: Callable[[Column], Column], fmt: str | None = None) -> "ImageFrame":
        """``f`` on every channel."""
        return self._with(self.px.select(*AT, *(f(F.col(c)).alias(c) for c in self.columns)), fmt)

    def _gray(self) -> None:
        require(DEPTH[self.fmt] == 1, "INVALID_FORMAT", f"{self.fmt} is not of one channel")

    def _kernel(self, f: Callable, kind: str = "double", size: tuple[int, int] | None = None) -> "ImageFrame":
        """A numpy kernel on each channel."""
        out = self._with(None, None, size)
        out._rows, out._steps = (self.dense() if self._rows is None else self._rows), (*self._steps, (f, kind))
        return out

    def tiled(self, kernel: Callable, kind: str, tile: int, margin: int) -> "ImageFrame":
        """A kernel that looks no further than ``margin``, tile by tile: for images too large for one row."""
        self._gray()
        return self._with(run_tiled(self.px, kernel, kind, tile, margin))

    # --- points -------------------------------------------------------------------------------------------------

    def negative(self):
        return self.map(point.negative)

    def threshold(self, t: int):
        return self.map(lambda v: point.threshold(v, t))

    def power(self, gamma: float):
        return self.map(lambda v: point.power(v, gamma))

    def convert_scale_abs(self, alpha: float, beta: float):
        return self.map(lambda v: point.convert_scale_abs(v, alpha, beta))

    def piecewise(self, points: list[int], values: list[int]):
        return self.map(lambda v: point.piecewise(v, points, values))

    def log(self, shift: float = 0.0):
        return self.map(lambda v: point.log_plane(v, shift))

    def add_value(self, value: float):
        return self.map(lambda v: point.add_value(v, value))

    def invert(self):
        return self.map(point.bit_not)

    def extract_component(self, label: int):
        return self.map(lambda v: point.extract_label(v, label))

    def double_threshold(self, low: float, high: float):
        return self.map(lambda v: point.double_threshold(v, low, high))

    def distance(self, colour: tuple[int, int, int]):
        return self._with(self.px.select(*AT, point.colour_distance(tuple(map(F.col, self.columns)), colour).alias("v")), "GRAYSCALE")

    def in_range(self, low: tuple, high: tuple):
        require(DEPTH[self.fmt] == 3, "INVALID_FORMAT")
        return self._with(self.px.select(*AT, point.in_range(tuple(map(F.col, self.columns)), low, high).alias("v")), "MASK")

    def hue_threshold(self, low: int, high: int):
        require(self.fmt == "HSI", "INVALID_FORMAT")
        return self._with(self.px.select(*AT, point.hue_threshold(F.col("c0"), low, high).alias("v")), "MASK")

    def convert(self, fmt: str):
        """To another colour space."""
        return self._with(color.convert(self.px, self.fmt, fmt), fmt)

    def split(self) -> tuple["ImageFrame", ...]:
        require(self.fmt == "RGB888", "INVALID_FORMAT")
        return tuple(self._with(self.px.select(*AT, F.col(c).alias("v")), "GRAYSCALE") for c in self.columns)

    @staticmethod
    def merge(r: "ImageFrame", g: "ImageFrame", b: "ImageFrame") -> "ImageFrame":
        parts = [f.px.select(*AT, F.col("v").alias(f"c{k}")) for k, f in enumerate((r, g, b))]
        return r._with(parts[0].join(parts[1], AT).join(parts[2], AT), "RGB888")

    # --- two images ---------------------------------------------------------------------------------------------

    def zip(self, other: "ImageFrame", f: Callable[[Column, Column], Column], channel: str | None = None) -> "ImageFrame":
        """Pixels of equal position of two frames; ``channel``: the other's column for all of this one's."""
        require((self.width, self.height) == (other.width, other.height), "INVALID_SIZE")
        right = other.px.select(*AT, *(F.col(c).alias(f"o_{c}") for c in other.columns))
        out = [f(F.col(c), F.col(f"o_{channel or c}")).alias(c) for c in self.columns]
        return self._with(self.px.join(right, AT).select(*AT, *out))

    def add(self, other):
        return self.zip(other, lambda a, b: a + b)

    def subtract(self, other):
        return self.zip(other, point.difference)

    def multiply(self, other):
        return self.zip(other, lambda a, b: a * b)

    def masked(self, mask):
        mask._gray()
        return self.zip(mask, point.mask_and, "v")

    def union(self, other):
        return self.zip(other, point.mask_or)

    def exclusive(self, other):
        return self.zip(other, point.mask_xor)

    def magnitude_with(self, other):
        return self.zip(other, point.gradient_magnitude)

    def phase_with(self, other):
        return self.zip(other, point.gradient_phase)

    # --- statistics ---------------------------------------------------------------------------------------------

    def histogram(self) -> DataFrame:
        self._gray()
        return hist.histogram(self.px)

    def otsu_threshold(self) -> DataFrame:
        self._gray()
        return hist.otsu(self.px)

    def otsu(self):
        self._gray()
        return self._with(hist.binarize_otsu(self.px))

    def local_otsu(self, block: int):
        self._gray()
        return self._with(hist.binarize_local_otsu(self.px, block))

    def equalize(self):
        self._gray()
        return self._with(hist.equalize(self.px).withColumnRenamed("value", "v"))

    def specify(self, target: list[int]):
        self._gray()
        return self._with(hist.specify(self.px, target))

    def normalize(self, rounded: bool = False):
        self._gray()
        return self._with(hist.normalize(self.px, "v", rounded))

    def to_pixels(self, compat: bool = False):
        """Float planes stretched to 8 bits."""
        return self._with(hist.convert_to_pixels(self.px, compat)) if DEPTH[self.fmt] == 3 else self.normalize(rounded=True)

    # --- neighbourhoods -----------------------------------------------------------------------------------------

    def correlate(self, kernel: np.ndarray, relational: bool = False):
        if relational:
            self._gray()
            return self._with(longform.correlate(self.px, kernel, self.width, self.height))
        return self._kernel(lambda s: kernels.correlate(s, kernel))

    def separable(self, along_x: np.ndarray, along_y: np.ndarray, scale: float = 1.0, delta: float = 0.0, compat: bool = False):
        """``compat``: delta multiplies."""
        return self._kernel(lambda s: kernels.separable(s, along_x, along_y, delta if compat else scale, 0.0 if compat else delta))

    def minimum(self, size: int):
        return self._kernel(lambda s: kernels.minimum(s, size), "int")

    def maximum(self, size: int):
        return self._kernel(lambda s: kernels.maximum(s, size), "int")

    def median(self, size: int):
        return self._kernel(lambda s: kernels.median(s, size))

    def difference_of_gaussians(self, s1: float, s2: float):
        return self._kernel(lambda s: kernels.difference_of_gaussians(s, s1, s2))

    def laplacian_of_gaussian(self, sigma: float):
        return self._kernel(lambda s: kernels.laplacian_of_gaussian(s, sigma))

    def gradients(self, sigma: float) -> tuple["ImageFrame", "ImageFrame"]:
        return self._kernel(lambda s: kernels.gradients(s, sigma)[0]), self._kernel(lambda s: kernels.gradients(s, sigma)[1])

    def canny(self, t1: float, t2: float, aperture: int = 3, l2: bool = True):
        self._gray()
        return self._kernel(lambda s: kernels.canny(s, t1, t2, aperture, l2))

    def hysteresis(self, weak: float = 50.0, strong: float = 255.0):
        return self._kernel(lambda s: kernels.hysteresis(s, weak, strong))

    def erode(self, element: np.ndarray, times: int = 1):
        return self._kernel(lambda s: kernels.erode(s, element, times), "int")

    def dilate(self, element: np.ndarray, times: int = 1):
        return self._kernel(lambda s: kernels.dilate(s, element, times), "int")

    def opening(self, element: np.ndarray, times: int = 1):
        return self._kernel(lambda s: kernels.opening(s, element, times), "int")

    def closing(self, element: np.ndarray, times: int = 1):
        return self._kernel(lambda s: kernels.closing(s, element, times), "int")

    def resize(self, width: int, height: int):
        return self._kernel(lambda s: kernels.resize(s, width, height), "int", (width, height))

    def crop_centre(self, width: int, height: int):
        return self._with(sources.centre_crop(self.px, width, height, self.width, self.height), None, (width, height))

    # --- regions and lines --------------------------------------------------------------------------------------

    def components(self, compat: bool = False):
        """Labels of 4-connected regions; ``compat``: by two passes that lose merges, 254 labels at most."""
        self._gray()
        f = kernels.label_components_two_pass if compat else kernels.label_components
        return self._kernel(f, "int")

    def component_count(self) -> DataFrame:
        """Labels of each image, the background's with them."""
        self._gray()
        return to_rows(self.dense(), lambda s: kernels.label_components(s).max((1, 2)) + 1, {"n": "int"}, ("p_v",))

    def hough(self, thetas: list[tuple[float, float]]) -> DataFrame:
        self._gray()
        return longform.hough(self.px, thetas, self.width, self.height)

    def lines(self, thetas: list[tuple[float, float]], threshold: int, most: int, step: float = 1.0) -> DataFrame:
        import math

        return longform.lines_of(self.hough(thetas), threshold, most, int(math.hypot(self.width, self.height)), 1.0, step)

    def draw_line(self, x0: int, y0: int, x1: int, y1: int, colour: int = 255):
        self._gray()
        return self._with(longform.draw(self.px, kernels.line_points(x0, y0, x1, y1), colour, self.width, self.height))

    def draw_polar_line(self, rho: float, theta: float, colour: int = 255):
        return self.draw_line(*kernels.polar_line(rho, theta), colour)

    def kmeans(self, k: int, seed: int = 0):
        if DEPTH[self.fmt] == 1:
            return self._kernel(lambda s: segment.kmeans_gray(s, k))
        names, hue = tuple(f"p_{c}" for c in self.columns), self.fmt == "HSI"
        return self._with(to_pixels(self.dense(), lambda *s: segment.kmeans_color(*s, k, hue, seed), dict.fromkeys(self.columns, "int"), names))

    def grow(self, seeds: list[tuple[int, int]], tolerance: float, colourful: bool = True):
        if DEPTH[self.fmt] == 1:
            return self._kernel(lambda s: segment.grow_gray(s, seeds, int(tolerance)), "int")
        names, hue = tuple(f"p_{c}" for c in self.columns), self.fmt == "HSI"
        outputs = dict.fromkeys(self.columns if colourful else ["v"], "int")
        return self._with(to_pixels(self.dense(), lambda *s: segment.grow_color(*s, seeds, tolerance, hue, colourful), outputs, names), None if colourful else "GRAYSCALE")

    def grabcut_lite(self, roi: tuple[int, int, int, int], rounds: int):
        self._gray()
        return self._kernel(lambda s: segment.grabcut_lite(s, roi, rounds), "int")

    def grabcut(self, roi: tuple[int, int, int, int], rounds: int = 5):
        self._gray()
        return self._kernel(lambda s: segment.grabcut(s, roi, rounds), "int")

    # --- frequencies --------------------------------------------------------------------------------------------

    def fft(self) -> DataFrame:
        """(image_id, y, x, re, im)."""
        self._gray()

        def parts(s):
            z = kernels.fft(s)
            return z.real, z.imag

        return to_pixels(self.dense(), parts, {"re": "double", "im": "double"}, ("p_v",))

    def frequency_filter(self, kind: str, cut1: float, cut2: float = 0.0):
        mask = kernels.frequency_mask(kind, self.width, self.height, cut1, cut2)
        return self._kernel(lambda s: kernels.frequency_filter(s, mask))

    # --- other names of the same operators ------------------------------------------------------------------------

    compressJPEG = compress_jpeg
    grayscaleThresholdLocalOtsuTo = local_otsu
    convertScaleAbsTo = convert_scale_abs
    filter2D = correlate
    filter2DSeparable = sepFilter2D = separable
    drawHoughLine = draw_polar_line
    bitwiseAnd = masked
    bitwiseOr = union
    bitwiseXor = exclusive
    bitwiseNot = invert
    createFrequencyMask = staticmethod(kernels.frequency_mask)


class Camera:
    """A folder of image files or frames as a capture device: one batch, or a stream."""

    RESOLUTIONS = ("QQVGA", "QVGA", "WQVGA", "VGA")
    FORMATS = ("GRAYSCALE", "RGB565", "RGB888", "YUV")

    def __init__(self, spark, path: str):
        self.spark, self.path, self.resolution, self.fmt = spark, path, None, None

    def init(self, resolution: str, fmt: str) -> "Camera":
        require(resolution in self.RESOLUTIONS, "NOT_SUPPORTED", resolution)
        require(fmt in self.FORMATS, "INVALID_FORMAT", fmt)
        self.resolution, self.fmt = resolution, fmt
        return self

    def set_res(self, resolution: str) -> "Camera":
        """Another resolution, the format kept."""
        require(self.fmt is not None, "NOT_INITIALIZED")
        return self.init(resolution, self.fmt)

    def stop(self) -> None:
        """No more captures until ``init``."""
        self.resolution = self.fmt = None

    def capture(self, continuous: bool = False) -> DataFrame:
        """Images at the camera's resolution; files of another size are scaled to it, those that are no images left out."""
        require(self.resolution is not None, "NOT_INITIALIZED")
        found = sources.stream_pnm(self.spark, self.path) if continuous else sources.read_pnm(self.spark, self.path)
        return sources.scaled(found.filter("status = 'OK'").drop("status"), *RESOLUTIONS[self.resolution])

    setRes = set_res


class Serial:
    """Frames on a byte stream, in files."""

    def __init__(self, spark, path: str, swap: bool = False):
        spark.dataSource.register(framewire.FramewireSource)
        self.spark, self.path, self.swap = spark, path, str(swap).lower()

    def capture(self) -> DataFrame:
        return self.spark.read.format("framewire").option("path", self.path).option("swap", self.swap).load()

    def send(self, frames: DataFrame) -> None:
        frames.write.format("framewire").option("path", self.path).option("swap", self.swap).mode("append").save()

    def send_images(self, dense: DataFrame, named: bool = False) -> None:
        """``named``: each image after a frame with its id, for ``named_images``."""
        frames = dense.select("image_id", F.col("image_id").alias("seq"), F.lit("image").alias("kind"), "width", "height", "format", "depth", F.lit(None).cast("int").alias("element_bytes"), F.col("pixels").alias("payload"))
        self.send(framewire.name_frames(frames) if named else frames.drop("image_id"))

    def named_images(self) -> DataFrame:
        """The images that were sent with their ids, as dense rows."""
        return framewire.named_frames(self.capture()).select("image_id", "width", "height", "format", "depth", F.lit("PIXELS").alias("state"), F.col("payload").alias("pixels"))

    def send_jpeg(self, compressed: DataFrame) -> None:
        none = F.lit(None)
        self.send(compressed.select(F.col("image_id").alias("seq"), F.lit("jpeg").alias("kind"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("string").alias("format"), none.cast("int").alias("depth"), none.cast("int").alias("element_bytes"), F.col("jpeg").alias("payload")))

    def send_array(self, arrays: DataFrame, kind: str, element_bytes: int) -> None:
        """``arrays``: seq, payload."""
        none = F.lit(None)
        self.send(arrays.select("seq", F.lit(kind).alias("kind"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("string").alias("format"), none.cast("int").alias("depth"), F.lit(element_bytes).alias("element_bytes"), "payload"))


class Display:
    """Shows images as files in a folder."""

    FORMATS = ("RGB888", "RGB565", "GRAYSCALE")
    #: Width and height of the panel.
    SIZE = (480, 272)

    def __init__(self, folder: str):
        self.folder, self.on = folder, True

    def init(self) -> "Display":
        self.on = True
        return self

    def deinit(self) -> None:
        """Shows nothing more until ``init``."""
        self.on = False

    def reset(self) -> None:
        """There is nothing to set anew."""

    def clear(self, spark, colour: str = "BLACK") -> int:
        """A panel full of a named colour, as image 0."""
        width, height = self.SIZE
        px = spark.range(height).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), F.lit(0).alias("v"))
        return self.show(ImageFrame(sources.clear(px, colour), width, height, "RGB565"))

    def show(self, frame: ImageFrame) -> int:
        require(self.on, "NOT_INITIALIZED")
        require(frame.fmt in self.FORMATS, "INVALID_FORMAT", frame.fmt)
        shown = frame.convert("RGB888") if frame.fmt == "RGB565" else frame
        return sources.write_pnm(shown.images(), self.folder)
