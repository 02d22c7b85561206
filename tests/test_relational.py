"""Plans on pixel rows: goldens, the dense form against the relational one, and quirks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import color, kernels, point
from rasterweave.operators import histogram as hist
from rasterweave.operators import longform
from rasterweave.operators.regions import components_tiled
from rasterweave.operators.tiles import run_tiled
from rasterweave.plans.frame import ImageFrame
from rasterweave.schema import DipError
from rasterweave.sources import images


def rows_of(spark, stack):
    data = [(i, y, x, int(v)) for i, image in enumerate(stack) for y, line in enumerate(image) for x, v in enumerate(line)]
    return spark.createDataFrame(data, "image_id long, y int, x int, v int")


def stack_of(df, n, h, w, column="v"):
    out = np.full((n, h, w), np.nan)
    for r in df.select("image_id", "y", "x", column).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


#: RGB, grey, YUV, HSI, 565, 565 as RGB, YUV read back as RGB: first-principles values.
GOLDEN = [
    ((255, 0, 0), 76, (76, 90, 255), (0, 255, 255), 0xF800, (255, 0, 0), (254, 0, 8)),
    ((0, 255, 0), 149, (150, 54, 0), (85, 255, 255), 0x07E0, (0, 255, 0), (0, 255, 19)),
    ((0, 0, 255), 29, (29, 239, 102), (170, 255, 255), 0x001F, (0, 0, 255), (0, 9, 225)),
    ((255, 255, 255), 255, (255, 128, 128), (0, 0, 255), 0xFFFF, (255, 255, 255), (255, 255, 255)),
    ((128, 128, 128), 128, (128, 128, 128), (0, 0, 128), 0x8410, (132, 130, 132), (128, 128, 128)),
    ((10, 200, 30), 123, (124, 82, 28), (89, 242, 200), 0x0E43, (8, 203, 24), (0, 211, 42)),
]


def test_colour_goldens(spark):
    px = spark.createDataFrame([(i, 0, 0, *g[0]) for i, g in enumerate(GOLDEN)], "image_id long, y int, x int, c0 int, c1 int, c2 int")

    def read(df, columns):
        return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("image_id").select(*columns).collect()]

    three = ["c0", "c1", "c2"]
    assert read(color.convert(px, "RGB888", "GRAYSCALE"), ["v"]) == [g[1] for g in GOLDEN]
    yuv = color.convert(px, "RGB888", "YUV")
    assert read(yuv, three) == [g[2] for g in GOLDEN]
    assert read(color.convert(px, "RGB888", "HSI"), three) == [g[3] for g in GOLDEN]
    packed = color.convert(px, "RGB888", "RGB565")
    assert read(packed, ["v"]) == [g[4] for g in GOLDEN]
    assert read(color.convert(packed, "RGB565", "RGB888"), three) == [g[5] for g in GOLDEN]
    assert read(color.convert(yuv, "YUV", "RGB888"), three) == [g[6] for g in GOLDEN]
    assert read(color.convert(px, "RGB888", "RGB888"), three) == [g[0] for g in GOLDEN]
    for source in ("GRAYSCALE", "RGB565", "YUV", "HSI", "RGB888"):
        for target in ("GRAYSCALE", "RGB565", "YUV", "HSI", "RGB888"):
            color.convert(color.convert(px, "RGB888", source), source, target).collect()
    with pytest.raises(DipError):
        color.convert(px, "MASK", "RGB888")


def test_single_precision_gray(spark):
    df = spark.createDataFrame([(v,) for v in range(256)], "v int")
    out = [r[0] for r in df.select(color.rgb_to_gray(F.col("v"), F.col("v"), F.col("v"), "f32")).collect()]
    assert all(0 <= v - o <= 1 for v, o in enumerate(out)) and out != list(range(256))


def test_point_expressions(spark):
    df = spark.createDataFrame([(v,) for v in (0, 10, 255)], "v int")
    v = F.col("v")
    got = df.select(point.negative(v), point.bit_not(v), point.power(v, -1), point.log_plane(v), point.convert_scale_abs(v, 2, -30), point.piecewise(v, [5, 15], [0, 255])).collect()
    assert [tuple(r) for r in got] == [(255, 255, 0.0, float("-inf"), 30.0, 0.0), (245, 245, 0.0, pytest.approx(np.log(10)), 10.0, 0.5), (0, 0, 0.0, pytest.approx(np.log(255)), 480.0, 1.0)]
    with pytest.raises(DipError):
        point.piecewise(v, [1], [1])


def test_otsu(spark):
    sets = [[10, 10, 20, 200, 210, 210], [0, 0, 0, 255, 255, 255], [9] * 6]
    px = rows_of(spark, [[s] for s in sets])
    assert [r["t"] for r in hist.otsu(px).orderBy("image_id").collect()] == [20, 0, 0]
    out = stack_of(hist.binarize_otsu(px), 3, 1, 6)
    assert out[0, 0].tolist() == [0, 0, 255, 255, 255, 255] and out[1].min() == 255


def test_histograms_add_up(spark):
    stack = np.random.default_rng(2).integers(0, 256, (2, 5, 6))
    counts = hist.histogram(rows_of(spark, stack)).groupBy("image_id").agg(F.sum("n"), F.count("level")).collect()
    assert sorted(tuple(r) for r in counts) == [(0, 30, 256), (1, 30, 256)]
    flat = rows_of(spark, [[[0, 0]]])
    assert [r["value"] for r in hist.equalize(flat).collect()] == [None, None]
    assert stack_of(hist.specify(flat, [0] * 200 + [1] * 56), 1, 1, 2).tolist() == [[[255, 255]]]


def test_normalize_and_planes(spark):
    assert stack_of(hist.normalize(rows_of(spark, [[[5, 7, 9]], [[4, 4, 4]]])), 2, 1, 3).tolist() == [[[0, 127, 255]], [[0, 0, 0]]]
    px = spark.createDataFrame([(0, 0, 0, 0.0, 1.0, 2.0), (0, 0, 1, 1.0, 3.0, 2.0)], "image_id long, y int, x int, c0 double, c1 double, c2 double")
    assert [tuple(r)[3:] for r in hist.convert_to_pixels(px).orderBy("x").collect()] == [(0, 0, 0), (255, 255, 0)]
    assert [tuple(r)[3:] for r in hist.convert_to_pixels(px, compat=True).orderBy("x").collect()] == [(0, 0, 0), (0, 255, 255)]


@pytest.mark.parametrize("size", [3, 5])
def test_relational_form_equals_dense(spark, size):
    stack = np.random.default_rng(3).integers(0, 256, (2, 6, 7))
    px = rows_of(spark, stack)
    weights = np.random.default_rng(4).integers(-2, 3, (size, size)).astype(float)
    assert np.allclose(stack_of(longform.correlate(px, weights, 7, 6), 2, 6, 7), kernels.correlate(stack, weights))
    for how, f in (("min", kernels.minimum), ("max", kernels.maximum), ("median", kernels.median)):
        assert (stack_of(longform.rank_filter(px, size, how, 7, 6), 2, 6, 7) == f(stack, size)).all()
    bright = np.where(stack > 90, 255, 0)
    element = kernels.structuring_element("ELLIPSE", size)
    for how, f in (("erode", kernels.erode), ("dilate", kernels.dilate)):
        assert (stack_of(longform.morphology(rows_of(spark, bright), element, how, 7, 6), 2, 6, 7) == f(bright, element)).all()


@pytest.mark.parametrize("tile", [4, 16])
def test_tiles_give_the_whole_image(spark, tile):
    stack = np.random.default_rng(7).integers(0, 256, (2, 11, 13))
    px = rows_of(spark, stack)
    weights = np.arange(9.0).reshape(3, 3)
    for f, kind in ((lambda s: kernels.correlate(s, weights), "double"), (lambda s: kernels.median(s, 3), "double"), (lambda s: kernels.erode(s > 60, np.ones((3, 3))), "int")):
        assert np.allclose(stack_of(run_tiled(px, f, kind, tile, 1), 2, 11, 13), f(stack))


def test_components_across_tiles(spark):
    rng = np.random.default_rng(8)
    stack = (rng.random((3, 13, 17)) < [[[0.6]], [[0.45]], [[0.0]]]).astype(int)
    snake = np.zeros((13, 17), int)
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    stack[2] = snake
    out = stack_of(components_tiled(rows_of(spark, stack), 4), 3, 13, 17)
    assert (out == kernels.label_components(stack)).all()
    assert stack_of(components_tiled(rows_of(spark, stack[:1] * 0), 5), 1, 13, 17).max() == 0


def test_spectrum_forms_agree(spark):
    stack = np.random.default_rng(5).integers(0, 256, (1, 8, 8))
    out = longform.dft(rows_of(spark, stack), 8)
    want = kernels.fft(stack)
    assert np.allclose(stack_of(out, 1, 8, 8, "re"), want.real) and np.allclose(stack_of(out, 1, 8, 8, "im"), want.imag)
    assert (stack_of(longform.shift_quadrants(rows_of(spark, stack), 8, 8), 1, 8, 8) == kernels.fft_shift(stack)).all()
    assert (stack_of(longform.resize(rows_of(spark, stack), 5, 3, 8, 8), 1, 3, 5) == kernels.resize(stack, 5, 3)).all()


def test_containers(spark):
    made = images.with_channels(images.create_images(spark, 3, 2, "RGB888"), 3).first()
    assert (made["depth"], len(made["pixels"]), len(made["ch"])) == (3, 18, 4)
    assert images.channels_empty(images.create_images_named(spark, "QQVGA", "MASK")).first()["channels_empty"]
    assert len(images.with_complex_planes(images.create_images(spark, 2, 2, "GRAYSCALE"), 1).first()["ch"][0]) == 8
    for bad in (lambda: images.create_images(spark, 0, 2, "GRAYSCALE"), lambda: images.create_images(spark, 1, 1, "CMYK"), lambda: images.create_images_named(spark, "INVALID", "MASK")):
        with pytest.raises(DipError):
            bad()
    frames = spark.createDataFrame([(0, 2, 1, bytearray([9, 1, 8, 2]))], "image_id long, width int, height int, pixels binary")
    assert bytes(images.luma_of_yuv422(frames).first()["pixels"]) == b"\x09\x08"
    raw = spark.createDataFrame([(0, bytearray(range(18)))], "image_id long, pixels binary")
    view = images.view(raw, 2, 2, "RGB888", 3, 9)
    assert bytes(images.view_row(view, 1).first()["row"]) == bytes(range(9, 15)) and images.view_row(view, 2).first()["row"] is None
    for args, status in (((3, 2, "RGB888", 3, 8), "INVALID_SIZE"), ((0, 2, "RGB888", 3, 9), "INVALID_SIZE"), ((3, 2, "RGB888", 1, 9), "INVALID_FORMAT")):
        with pytest.raises(DipError) as e:
            images.view(raw, *args)
        assert e.value.status == status


@pytest.mark.parametrize("target", [list(range(256)), [0] * 100 + [7] * 5 + [0] * 50 + [1] * 101, [5] + [0] * 255, [0] * 255 + [9]])
def test_specification_against_plain_search(spark, target):
    stack = np.random.default_rng(3).integers(0, 256, (3, 8, 8)) // np.array([1, 9, 200])[:, None, None]
    px, total = rows_of(spark, stack), sum(target)
    got = {(r["image_id"], r["level"]): r["mapped"] for r in hist.specification(px, target).collect()}
    sums = np.cumsum(target)
    for i, image in enumerate(stack):
        for level in np.unique(image):
            cdf = int((image <= level).sum())
            apart = [abs(cdf * total - int(g) * 64) for g in sums]
            best = int(np.argmin(apart))
            assert got[i, level] == (best if apart[best] < 64 * total else 0)


def test_kernels_in_turn_gather_once(spark):
    stack = np.random.default_rng(8).integers(0, 256, (2, 8, 8))
    f = ImageFrame(rows_of(spark, stack), 8, 8)
    chain = f.median(3).canny(80, 160)
    plan = chain.px._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
    assert (stack_of(chain.px, 2, 8, 8) == kernels.canny(kernels.median(stack, 3), 80, 160)).all()
    element = kernels.structuring_element("CROSS", 3)
    assert (stack_of(f.erode(element).dilate(element).resize(4, 2).px, 2, 2, 4) == kernels.resize(kernels.dilate(kernels.erode(stack, element), element), 4, 2)).all()


def test_frame_methods(spark):
    stack = np.random.default_rng(6).integers(0, 256, (2, 8, 8))
    f = ImageFrame(rows_of(spark, stack), 8, 8)
    back = ImageFrame.of_images(f.images(), 8, 8, "GRAYSCALE")
    assert (stack_of(back.px, 2, 8, 8) == stack).all()
    assert (stack_of(f.negative().negative().px, 2, 8, 8) == stack).all()
    chain = f.median(3).map(lambda v: v.cast("int")).threshold(120).opening(kernels.structuring_element("CROSS", 3)).components()
    want = kernels.label_components(kernels.opening(np.where(kernels.median(stack, 3).astype(int) >= 120, 255, 0), kernels.structuring_element("CROSS", 3)))
    assert (stack_of(chain.px, 2, 8, 8) == want).all()
    assert (stack_of(f.subtract(f).px, 2, 8, 8) == 0).all() and (stack_of(f.masked(f.threshold(300)).px, 2, 8, 8) == 0).all()
    rgb = ImageFrame.merge(f, f, f)
    assert rgb.num_channels() == 3 and (stack_of(rgb.convert("GRAYSCALE").px, 2, 8, 8) == stack).all()
    assert (stack_of(rgb.split()[1].px, 2, 8, 8) == stack).all()
    assert rgb.kmeans(2).px.count() == 128 and rgb.grow([(1, 1)], 0.1, colourful=False).fmt == "GRAYSCALE"
    assert f.canny(80, 160).px.count() == 128 and f.fft().count() == 128 and f.component_count().count() == 2
    assert f.resize(4, 2).width == 4 and f.bitwiseNot().px.count() == 128
    assert f.frequency_filter("IDEAL_LOWPASS", 100).map(lambda v: F.round(v).cast("int")).px.exceptAll(f.px).count() == 0
    plan = f.negative().threshold(9).px._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    with pytest.raises(DipError):
        f.hue_threshold(1, 2)
    with pytest.raises(DipError):
        rgb.otsu()
