"""Every image operator as a query over the fixtures, with the SQL that an oracle can run."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions import color, kernels, point
from rasterweave.operators import histogram as hist
from rasterweave.operators import longform, segment
from rasterweave.operators.dense import dense_rgb, to_pixels, to_rows
from rasterweave.operators.regions import components_tiled
from rasterweave.operators.tiles import run_tiled
from rasterweave.plans import runtime
from rasterweave.plans.frame import Serial
from rasterweave.sources import fixtures as fx
from rasterweave.sources import framewire, images, jpeg
from rasterweave.sources.fixtures import LI, PAIR, PX, RGB

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Kernels and parameters of the queries.
SMOOTH = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]])
LINE = np.array([1.0, 2.0, 1.0])
CROSS3, RECT3, DISC5 = (kernels.structuring_element(*a) for a in (("CROSS", 3), ("RECT", 3), ("ELLIPSE", 5)))
TARGET = list(range(256))
ROI = (2, 2, 4, 4)
ANGLES = [(math.cos(math.pi * k / 12), math.sin(math.pi * k / 12)) for k in range(12)]
SEGMENT = (0, 1, 7, 6)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _v():
    return F.col("v")


def _c():
    return F.col("c0"), F.col("c1"), F.col("c2")


def _px(df: DataFrame, **columns) -> DataFrame:
    return df.select("image_id", "y", "x", *[c.alias(n) for n, c in columns.items()])


def _r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _sql(columns: str, source: str = "px", ctes: str = PX) -> str:
    return f"WITH {ctes} SELECT image_id, y, x, {columns} FROM {source}"


# --- histograms and thresholds ----------------------------------------------------------------------------------


def _otsu_cte(source: str, keys: str) -> str:
    return f"""h AS (SELECT {keys}, v AS level, count(*) AS n FROM {source} GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER w AS w0, sum(n * level) OVER w AS s0, sum(n) OVER k AS w, sum(n * level) OVER k AS s FROM h
          WINDOW w AS (PARTITION BY {keys} ORDER BY level ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY {keys})),
    d AS (SELECT *, CASE WHEN w > w0 THEN (s0 * w - s * w0)::DOUBLE * (s0 * w - s * w0)::DOUBLE / (w0::DOUBLE * (w - w0)::DOUBLE) ELSE 0 END AS spread FROM s),
    o AS (SELECT *, CASE WHEN spread > 0 THEN level ELSE 0 END AS t FROM d
          QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY spread DESC, level) = 1)"""


@query(f"""WITH {PX}, {_otsu_cte('px', 'image_id')}
    SELECT px.image_id, t, count(*) FILTER (px.v >= t) AS fg_count, (sum(px.v) FILTER (px.v >= t))::BIGINT AS fg_sum FROM px JOIN o USING (image_id) GROUP BY px.image_id, t""")  # fmt: skip
def otsu_segment_summary(spark, d):
    return hist.otsu_segments(fx.px8(spark, d))


@query(f"WITH {PX} SELECT i.image_id, l.level::INT AS level, count(px.v) AS n FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(256) l(level) LEFT JOIN px ON px.image_id = i.image_id AND px.v = l.level GROUP BY ALL")
def hist_form(spark, d):
    return hist.histogram(fx.px8(spark, d))


@query(f"WITH {LI} SELECT image_id, v AS level, count(*) AS n FROM li GROUP BY ALL")
def hist_form_lineitem(spark, d):
    return hist.histogram(fx.levels_li(spark, d), dense=False)


@query(f"WITH {PX}, {_otsu_cte('px', 'image_id')} SELECT image_id, t FROM o")
def otsu_threshold(spark, d):
    return hist.otsu(fx.px8(spark, d))


@query(f"WITH {LI}, {_otsu_cte('li', 'image_id')} SELECT image_id, t FROM o")
def otsu_threshold_lineitem(spark, d):
    return hist.otsu(fx.levels_li(spark, d))


@query(f"WITH {PX}, {_otsu_cte('px', 'image_id')} SELECT px.image_id, y, x, CASE WHEN v >= t THEN 255 ELSE 0 END AS v FROM px JOIN o USING (image_id)")
def otsu_binarize(spark, d):
    return hist.binarize_otsu(fx.px8(spark, d))


@query(f"""WITH {PX}, pt AS (SELECT *, y // 3 AS ty, x // 3 AS tx FROM px), {_otsu_cte('pt', 'image_id, ty, tx')}
    SELECT pt.image_id, y, x, CASE WHEN v >= t THEN 255 ELSE 0 END AS v FROM pt JOIN o USING (image_id, ty, tx)""")
def local_otsu(spark, d):
    return hist.binarize_local_otsu(fx.px8(spark, d), 3)


_CDF = "c AS (SELECT image_id, v, sum(count(*)) OVER (PARTITION BY image_id ORDER BY v) AS cdf, sum(count(*)) OVER (PARTITION BY image_id) AS total FROM {source} GROUP BY image_id, v)"


@query(f"""WITH {PX}, {_CDF.format(source='px')}, z AS (SELECT image_id, count(*) FILTER (v = 0) AS zero FROM px GROUP BY image_id)
    SELECT px.image_id, y, x, round((cdf - zero)::DOUBLE / nullif(total - zero, 0)::DOUBLE, 6) + 0.0 AS value FROM px JOIN c USING (image_id, v) JOIN z USING (image_id)""")
def hist_eq(spark, d):
    return hist.equalize(fx.px8(spark, d)).withColumn("value", _r(F.col("value")))


@query(f"""WITH {LI}, {_CDF.format(source='li')} SELECT image_id, v AS level, cdf::BIGINT AS cdf, total::BIGINT AS total FROM c""")
def cdf_lineitem(spark, d):
    return hist._cumulated(fx.levels_li(spark, d)).drop("n")


@query(f"""WITH {PX}, {_CDF.format(source='px')}, g AS (SELECT j, (j * (j + 1)) // 2 AS goal FROM range(256) r(j)),
    m AS (SELECT image_id, v AS level, j FROM c CROSS JOIN g QUALIFY row_number() OVER (PARTITION BY image_id, v ORDER BY abs(cdf * 32640 - goal * total), j) = 1)
    SELECT px.image_id, y, x, j::INT AS v FROM px JOIN m ON m.image_id = px.image_id AND m.level = px.v""")  # fmt: skip
def hist_spec(spark, d):
    return hist.specify(fx.px8(spark, d), TARGET)


# --- points -----------------------------------------------------------------------------------------------------


@query(_sql("255 - v AS v"))
def negative(spark, d):
    return _px(fx.px8(spark, d), v=point.negative(_v()))


@query(_sql("CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v"))
def threshold(spark, d):
    return _px(fx.px8(spark, d), v=point.threshold(_v(), 128))


@query(_sql("round(pow(v / 255.0::DOUBLE, 0.45), 6) AS v"))
def gamma(spark, d):
    return _px(fx.px8(spark, d), v=_r(point.power(_v(), 0.45)))


@query(_sql("abs(1.5 * v - 200)::DOUBLE AS v"))
def scale_abs(spark, d):
    return _px(fx.px8(spark, d), v=point.convert_scale_abs(_v(), 1.5, -200))


@query(_sql("round(CASE WHEN v <= 50 THEN 0 WHEN v >= 200 THEN 255 WHEN v <= 120 THEN (v - 50) * 80::DOUBLE / 70 ELSE 80 + (v - 120) * 175::DOUBLE / 80 END / 255, 6) AS v"))
def piecewise(spark, d):
    return _px(fx.px8(spark, d), v=_r(point.piecewise(_v(), [50, 120, 200], [0, 80, 255])))


@query(_sql("round(ln(v + 1) + 2, 6) AS v"))
def log_add(spark, d):
    return _px(fx.px8(spark, d), v=_r(point.add_value(point.log_plane(point.add_value(_v(), 1.0)), 2.0)))


@query(f"""WITH {PX}, m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id)
    SELECT px.image_id, y, x, CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) * 255.0::DOUBLE / (hi - lo))::INT END AS v FROM px JOIN m USING (image_id)""")
def normalize(spark, d):
    return hist.normalize(fx.px8(spark, d)).select("image_id", "y", "x", "v")


@query(f"""WITH {RGB}, m AS (SELECT image_id, min(c0) AS l0, max(c0) AS h0, min(c1) AS l1, max(c1) AS h1, min(c2) AS l2, max(c2) AS h2 FROM rgb GROUP BY image_id)
    SELECT rgb.image_id, y, x, {', '.join(f'CASE WHEN h{k} = l{k} THEN 0 ELSE floor((c{k} - l{k}) * 255.0::DOUBLE / (h{k} - l{k}))::INT END AS c{k}' for k in range(3))} FROM rgb JOIN m USING (image_id)""")
def convert_to(spark, d):
    return hist.convert_to_pixels(fx.rgb8(spark, d))


@query(_sql("round(sqrt((c0 - 200) * (c0 - 200) + (c1 - 100) * (c1 - 100) + (c2 - 50) * (c2 - 50)), 6) AS v", "rgb", RGB))
def color_dist(spark, d):
    return _px(fx.rgb8(spark, d), v=_r(point.colour_distance(_c(), (200, 100, 50))))


@query(_sql("CASE WHEN c0 BETWEEN 90 AND 150 AND c1 BETWEEN 100 AND 160 AND c2 BETWEEN 80 AND 140 THEN 255 ELSE 0 END AS v", "rgb", RGB))
def in_range(spark, d):
    return _px(fx.rgb8(spark, d), v=point.in_range(_c(), (90, 100, 80), (150, 160, 140)))


@query(_sql("CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN v ELSE 0 END AS v"))
def roi_mask(spark, d):
    return _px(fx.px8(spark, d), v=F.when(point.in_roi(F.col("y"), F.col("x"), ROI), _v()).otherwise(0))


@query(_sql("CASE WHEN v >= 140 THEN 255.0 WHEN v >= 110 THEN 50.0 ELSE 0.0 END::DOUBLE AS v"))
def double_threshold(spark, d):
    return _px(fx.px8(spark, d), v=point.double_threshold(_v(), 140, 110))


# --- colour -----------------------------------------------------------------------------------------------------

_GRAY = "(299 * c0 + 587 * c1 + 114 * c2) // 1000"
_565 = "((c0 & 248) << 8) | ((c1 & 252) << 3) | (c2 >> 3)"


def _near_sql(n: str, of: int) -> str:
    return f"(sign({n})::INT * ((abs({n}) + {of // 2}) // {of}))"


_YUV = ", ".join(
    f"greatest(0, least(255, {e}))::INT AS c{k}"
    for k, e in enumerate((_near_sql("(299 * c0 + 587 * c1 + 114 * c2)", 1000), _near_sql("(-14713 * c0 - 28886 * c1 + 43600 * c2)", 100000) + " + 128", _near_sql("(61500 * c0 - 51499 * c1 - 10001 * c2)", 100000) + " + 128"))
)
_FROM_YUV = ", ".join(f"least(255, greatest(0, {e}) // 1000)::INT AS c{k}" for k, e in enumerate(("1000 * c0 + 1403 * (c2 - 128)", "1000 * c0 - 344 * (c1 - 128) - 714 * (c2 - 128)", "1000 * c0 + 1770 * (c1 - 128)")))
_MAX, _MIN = "greatest(c0, c1, c2)", "least(c0, c1, c2)"
_HSI = f"""CASE WHEN {_MAX} = {_MIN} THEN 0
    WHEN {_MAX} = c0 THEN (425 * (c1 - c2) + CASE WHEN c1 < c2 THEN 2550 * ({_MAX} - {_MIN}) ELSE 0 END) // (10 * ({_MAX} - {_MIN}))
    WHEN {_MAX} = c1 THEN (425 * (c2 - c0) + 850 * ({_MAX} - {_MIN})) // (10 * ({_MAX} - {_MIN}))
    ELSE (425 * (c0 - c1) + 1700 * ({_MAX} - {_MIN})) // (10 * ({_MAX} - {_MIN})) END::INT AS c0,
    CASE WHEN {_MAX} = 0 THEN 0 ELSE 255 * ({_MAX} - {_MIN}) // {_MAX} END::INT AS c1, {_MAX} AS c2"""
_LOW, _MID = "(c2 * (255 - c1)) // 255", "(c2 * (65025 - c1 * abs((6 * c0) % 510 - 255))) // 65025"
_FROM_HSI = ", ".join(
    f"CASE least(5, (6 * c0) // 255) {' '.join(f'WHEN {s} THEN {e}' for s, e in enumerate(order))} END::INT AS c{k}"
    for k, order in enumerate((("c2", _MID, _LOW, _LOW, _MID, "c2"), (_MID, "c2", "c2", _MID, _LOW, _LOW), (_LOW, _LOW, _MID, "c2", "c2", _MID)))
)
_FROM_565 = "(((v >> 11) & 31) << 3) | (((v >> 11) & 31) >> 2) AS c0, (((v >> 5) & 63) << 2) | (((v >> 5) & 63) >> 4) AS c1, ((v & 31) << 3) | ((v & 31) >> 2) AS c2"


def _chain(ctes: str, first: str, *steps: str) -> str:
    """Projections one after the other over (image_id, y, x, ...)."""
    out, at = [f"WITH {ctes}"], first
    for k, step in enumerate(steps):
        out.append(f", t{k} AS (SELECT image_id, y, x, {step} FROM {at})")
        at = f"t{k}"
    return "".join(out) + f" SELECT * FROM {at}"


@query(_chain(RGB, "rgb", f"({_GRAY})::INT AS v"))
def rgb_gray(spark, d):
    return color.convert(fx.rgb8(spark, d), "RGB888", "GRAYSCALE")


@query(_sql("v AS c0, v AS c1, v AS c2"))
def gray_rgb(spark, d):
    return color.convert(fx.px8(spark, d), "GRAYSCALE", "RGB888")


@query(_chain(RGB, "rgb", f"{_565} AS v"))
def rgb_565(spark, d):
    return color.convert(fx.rgb8(spark, d), "RGB888", "RGB565")


@query(_chain(RGB, "rgb", f"{_565} AS v", _FROM_565))
def rgb_565_roundtrip(spark, d):
    return color.convert(color.convert(fx.rgb8(spark, d), "RGB888", "RGB565"), "RGB565", "RGB888")


@query(_chain(RGB, "rgb", _YUV))
def rgb_yuv(spark, d):
    return color.convert(fx.rgb8(spark, d), "RGB888", "YUV")


@query(_chain(RGB, "rgb", _FROM_YUV))
def yuv_rgb(spark, d):
    return color.convert(fx.rgb8(spark, d), "YUV", "RGB888")


@query(_chain(RGB, "rgb", _HSI))
def rgb_hsi(spark, d):
    return color.convert(fx.rgb8(spark, d), "RGB888", "HSI")


@query(_chain(RGB, "rgb", _FROM_HSI))
def hsi_rgb(spark, d):
    return color.convert(fx.rgb8(spark, d), "HSI", "RGB888")


@query(_chain(RGB, "rgb", f"{_565} AS v", _FROM_565, _HSI, _FROM_HSI, _YUV, _FROM_YUV, f"({_GRAY})::INT AS v"))
def composite_cvt(spark, d):
    px = color.convert(fx.rgb8(spark, d), "RGB888", "RGB565")
    return color.convert(color.convert(color.convert(px, "RGB565", "HSI"), "HSI", "YUV"), "YUV", "GRAYSCALE")


_HUE = _chain(RGB, "rgb", _HSI, "CASE WHEN {} THEN 255 ELSE 0 END AS v")


@query(_HUE.format("c0 BETWEEN 60 AND 130"))
def hue_threshold(spark, d):
    return _px(color.convert(fx.rgb8(spark, d), "RGB888", "HSI"), v=point.hue_threshold(F.col("c0"), 60, 130))


@query(_HUE.format("c0 >= 200 OR c0 <= 40"))
def hue_threshold_wrap(spark, d):
    return _px(color.convert(fx.rgb8(spark, d), "RGB888", "HSI"), v=point.hue_threshold(F.col("c0"), 200, 40))


@query(f"WITH {RGB} SELECT image_id, y, x, k AS channel, CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS v FROM rgb CROSS JOIN range(3) r(k)")
def rgb_split(spark, d):
    px = fx.rgb8(spark, d)
    return px.select("image_id", "y", "x", F.posexplode(F.array("c0", "c1", "c2")).alias("channel", "v"))


@query(_sql("c2 AS c0, c1, c0 AS c2", "rgb", RGB))
def rgb_merge(spark, d):
    px = fx.rgb8(spark, d)
    parts = [px.select("image_id", "y", "x", F.col(f"c{2 - k}").alias(f"c{k}")) for k in range(3)]
    return parts[0].join(parts[1], ["image_id", "y", "x"]).join(parts[2], ["image_id", "y", "x"])


# --- two images -------------------------------------------------------------------------------------------------


@query(_sql("va + vb AS v", "pr", PAIR))
def img_add(spark, d):
    return _px(fx.pair8(spark, d), v=F.col("va") + F.col("vb"))


@query(_sql("greatest(va - vb, 0) AS v", "pr", PAIR))
def img_difference(spark, d):
    return _px(fx.pair8(spark, d), v=point.difference(F.col("va"), F.col("vb")))


@query(_sql("va * vb AS v", "pr", PAIR))
def img_multiply(spark, d):
    return _px(fx.pair8(spark, d), v=F.col("va") * F.col("vb"))


@query(_sql("CASE WHEN vb >= 120 THEN va ELSE 0 END AS v", "pr", PAIR))
def mask_and(spark, d):
    return _px(fx.pair8(spark, d), v=point.mask_and(F.col("va"), (F.col("vb") >= 120).cast("int")))


@query(_sql("va | vb AS v", "pr", PAIR))
def mask_or(spark, d):
    return _px(fx.pair8(spark, d), v=point.mask_or(F.col("va"), F.col("vb")))


@query(_sql("xor(va, vb) AS v", "pr", PAIR))
def mask_xor(spark, d):
    return _px(fx.pair8(spark, d), v=point.mask_xor(F.col("va"), F.col("vb")))


@query(_sql("(~v) & 255 AS v"))
def mask_not(spark, d):
    return _px(fx.px8(spark, d), v=point.bit_not(_v()))


@query(f"WITH {PX} SELECT a.image_id, a.y, a.x, a.v FROM px a WHERE EXISTS (SELECT 1 FROM px b WHERE b.image_id = a.image_id + 1 AND b.y = a.y AND b.x = a.x AND b.v >= 120)")
def mask_select(spark, d):
    px = fx.px8(spark, d)
    mask = px.filter("v >= 120").select((F.col("image_id") - 1).alias("image_id"), "y", "x")
    return px.join(mask, ["image_id", "y", "x"], "left_semi").select("image_id", "y", "x", "v")


# --- neighbourhoods ---------------------------------------------------------------------------------------------


def _kernel_cte(name: str, kernel: np.ndarray) -> str:
    a, b = kernel.shape[0] // 2, kernel.shape[1] // 2
    rows = ", ".join(f"({dy}, {dx}, {float(kernel[dy + a, dx + b])!r}::DOUBLE)" for dy, dx in kernels.offsets(kernel))
    return f"{name}(dy, dx, w) AS (VALUES {rows})"


def _edge_sql(kernel: str, source: str = "px") -> str:
    return f"""SELECT p.image_id, p.y, p.x, sum(q.v * k.w) AS v FROM {source} p CROSS JOIN {kernel} k
        JOIN {source} q ON q.image_id = p.image_id AND q.y = least(7, greatest(0, p.y + k.dy)) AND q.x = least(7, greatest(0, p.x + k.dx)) GROUP BY ALL"""


def _near_join(kernel: str, source: str, agg: str) -> str:
    return f"""SELECT p.image_id, p.y, p.x, {agg} AS v FROM {source} p CROSS JOIN {kernel} k
        LEFT JOIN {source} q ON q.image_id = p.image_id AND q.y = p.y + k.dy AND q.x = p.x + k.dx GROUP BY ALL"""


def _dense(spark, d, f, kind: str = "int"):
    return to_pixels(fx.img8(spark, d), f, {"v": kind})


@query(f"WITH {PX}, {_kernel_cte('k', SMOOTH)}, f AS ({_edge_sql('k')}) SELECT image_id, y, x, v::BIGINT AS v FROM f")
def filter2d(spark, d):
    return _dense(spark, d, lambda s: np.rint(kernels.correlate(s, SMOOTH)), "long")


@query(f"WITH {PX}, {_kernel_cte('k', SMOOTH)}, f AS ({_edge_sql('k')}) SELECT image_id, y, x, v::BIGINT AS v FROM f")
def filter2d_relational(spark, d):
    out = longform.correlate(fx.px8(spark, d), SMOOTH, 8, 8)
    return out.select("image_id", "y", "x", F.col("v").cast("long").alias("v"))


@query(f"WITH {PX}, {_kernel_cte('k', SMOOTH)}, f AS ({_edge_sql('k')}) SELECT image_id, y, x, v::BIGINT AS v FROM f")
def filter2d_tiled(spark, d):
    return run_tiled(fx.px8(spark, d), lambda s: np.rint(kernels.correlate(s, SMOOTH)), "long", 4, 1)


@query(f"WITH {PX}, {_kernel_cte('k', np.outer([1, 0, 3], LINE))}, f AS ({_edge_sql('k')}) SELECT image_id, y, x, v / 16 + 5 AS v FROM f")
def sep_filter2d(spark, d):
    return _dense(spark, d, lambda s: kernels.separable(s, LINE, np.array([1.0, 0, 3.0]), 1 / 16, 5.0), "double")


@query(f"WITH {PX}, {_kernel_cte('k', RECT3)} SELECT image_id, y, x, v FROM ({_near_join('k', 'px', 'min(q.v)')})")
def min_filter(spark, d):
    return _dense(spark, d, lambda s: kernels.minimum(s, 3))


@query(f"WITH {PX}, {_kernel_cte('k', np.ones((5, 5)))} SELECT image_id, y, x, v FROM ({_near_join('k', 'px', 'max(q.v)')})")
def max_filter(spark, d):
    return longform.rank_filter(fx.px8(spark, d), 5, "max", 8, 8).select("image_id", "y", "x", "v")


@query(f"WITH {PX}, {_kernel_cte('k', RECT3)} SELECT image_id, y, x, v::DOUBLE AS v FROM ({_near_join('k', 'px', 'median(q.v)')})")
def median_filter(spark, d):
    return _dense(spark, d, lambda s: kernels.median(s, 3), "double")


@query(f"""WITH {PX}, {_kernel_cte('k1', kernels.gaussian_2d(0.6))}, {_kernel_cte('k2', kernels.gaussian_2d(1.0))}, a AS ({_edge_sql('k1')}), b AS ({_edge_sql('k2')})
    SELECT a.image_id, a.y, a.x, round(abs(a.v - b.v), 6) + 0.0 AS v FROM a JOIN b USING (image_id, y, x)""")
def dog(spark, d):
    return _dense(spark, d, lambda s: kernels.difference_of_gaussians(s, 0.6, 1.0), "double").withColumn("v", _r(_v()))


@query(f"WITH {PX}, {_kernel_cte('k', kernels.log_2d(0.8))}, f AS ({_edge_sql('k')}) SELECT image_id, y, x, round(v, 6) + 0.0 AS v FROM f")
def log_filter(spark, d):
    return _dense(spark, d, lambda s: kernels.laplacian_of_gaussian(s, 0.8), "double").withColumn("v", _r(_v()))


_G, _D = kernels.gaussian_and_derivative(0.8)
_GRADIENTS = f"""{PX}, {_kernel_cte('kx', np.outer(_G, _D))}, {_kernel_cte('ky', np.outer(_D, _G))}, fx AS ({_edge_sql('kx')}), fy AS ({_edge_sql('ky')}),
    g AS (SELECT fx.image_id, fx.y, fx.x, fx.v AS gx, fy.v AS gy FROM fx JOIN fy USING (image_id, y, x))"""


@query(f"WITH {_GRADIENTS} SELECT image_id, y, x, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM g")
def gauss_gradients(spark, d):
    out = to_pixels(fx.img8(spark, d), lambda s: kernels.gradients(s, 0.8), {"gx": "double", "gy": "double"})
    return _px(out, gx=_r(F.col("gx")), gy=_r(F.col("gy")))


@query(_sql("round(sqrt((va - 120) * (va - 120) + (vb - 120) * (vb - 120)), 6) AS magnitude, round(atan2(vb - 120, va - 120), 6) + 0.0 AS phase", "pr", PAIR))
def grad_mag_phase(spark, d):
    gx, gy = F.col("va") - 120, F.col("vb") - 120
    return _px(fx.pair8(spark, d), magnitude=_r(point.gradient_magnitude(gx, gy)), phase=_r(point.gradient_phase(gx, gy)))


@query(_sql("round(va * cos(vb / 50.0::DOUBLE), 6) + 0.0 AS re, round(va * sin(vb / 50.0::DOUBLE), 6) + 0.0 AS im", "pr", PAIR))
def polar_to_cart(spark, d):
    re, im = point.polar_to_cart(F.col("va"), F.col("vb") / F.lit(50.0))
    return _px(fx.pair8(spark, d), re=_r(re), im=_r(im))


def _nms_cte(size: str) -> str:
    """Non-maximum suppression of m(image_id, y, x, v, phase) as n."""
    return f"""a AS (SELECT *, CASE WHEN phase < 0 THEN phase * 180 / pi() + 180 ELSE phase * 180 / pi() END AS angle FROM {size}),
    b AS (SELECT *, CASE WHEN angle < 22.5 OR angle >= 157.5 THEN 0 WHEN angle < 67.5 THEN 1 WHEN angle < 112.5 THEN 2 ELSE 3 END AS sector FROM a),
    st(sector, dy, dx) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)),
    n AS (SELECT b.image_id, b.y, b.x, CASE WHEN b.y IN (0, 7) OR b.x IN (0, 7) THEN 0 WHEN b.v >= p.v AND b.v >= q.v THEN b.v ELSE 0 END AS v
          FROM b JOIN st USING (sector) LEFT JOIN {size} p ON p.image_id = b.image_id AND p.y = b.y + st.dy AND p.x = b.x + st.dx
          LEFT JOIN {size} q ON q.image_id = b.image_id AND q.y = b.y - st.dy AND q.x = b.x - st.dx)"""


_MAGNITUDE = f"{_GRADIENTS}, m AS (SELECT image_id, y, x, sqrt(gx * gx + gy * gy) AS v, atan2(gy, gx) AS phase FROM g)"


def _nms(stack):
    gx, gy = kernels.gradients(stack, 0.8)
    return kernels.suppress_non_maxima(np.sqrt(gx * gx + gy * gy), np.arctan2(gy, gx))


@query(f"WITH {_MAGNITUDE}, {_nms_cte('m')} SELECT image_id, y, x, round(v, 6) AS v FROM n")
def nms(spark, d):
    return _dense(spark, d, _nms, "double").withColumn("v", _r(_v()))


def _hysteresis_sql(before: str, source: str) -> str:
    return f"""WITH RECURSIVE {before}, reach AS (SELECT image_id, y, x FROM {source} WHERE v = 255 UNION
        SELECT w.image_id, w.y, w.x FROM reach r JOIN {source} w ON w.image_id = r.image_id AND abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1 AND w.v = 50)
    SELECT s.image_id, s.y, s.x, CASE WHEN r.y IS NULL THEN 0.0 ELSE 255.0 END::DOUBLE AS v FROM {source} s LEFT JOIN reach r USING (image_id, y, x)"""


@query(_hysteresis_sql(f"{PX}, dt AS (SELECT image_id, y, x, CASE WHEN v >= 150 THEN 255 WHEN v >= 125 THEN 50 ELSE 0 END AS v FROM px)", "dt"))
def hysteresis(spark, d):
    return _dense(spark, d, lambda s: kernels.hysteresis(kernels.double_threshold(s, 125, 150)), "double")


@query(
    _hysteresis_sql(
        f"""{_MAGNITUDE}, e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM m GROUP BY image_id),
        mm AS (SELECT m.image_id, y, x, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 255 + 0.5 ELSE 0 END AS v, phase FROM m JOIN e USING (image_id)),
        {_nms_cte('mm')}, dt AS (SELECT image_id, y, x, CASE WHEN v >= 160 THEN 255 WHEN v >= 80 THEN 50 ELSE 0 END AS v FROM n)""",
        "dt",
    )
)
def canny(spark, d):
    return _dense(spark, d, lambda s: kernels.canny(s, 80, 160), "double")


@query("SELECT * FROM (VALUES ('RECT', 9, '111111111'), ('CROSS', 5, '010111010'), ('ELLIPSE', 4, '000011011')) t(shape, n, mask)")
def struct_element(spark, d):
    rows = [(s, int(k.sum()), "".join(map(str, k.ravel().tolist()))) for s in ("RECT", "CROSS", "ELLIPSE") for k in [kernels.structuring_element(s, 3)]]
    return spark.createDataFrame(rows, "shape string, n int, mask string")


_SET = f"{PX}, s AS (SELECT image_id, y, x, CASE WHEN v >= 110 THEN 255 ELSE 0 END AS v FROM px)"
_ERODE, _DILATE = "min(coalesce(q.v, 0))", "max(coalesce(q.v, 0))"


def _bright(stack):
    return np.where(stack >= 110, 255, 0)


@query(f"WITH {_SET}, {_kernel_cte('k', CROSS3)} {_near_join('k', 's', _ERODE)}")
def erode(spark, d):
    return _dense(spark, d, lambda s: kernels.erode(_bright(s), CROSS3))


@query(f"WITH {_SET}, {_kernel_cte('k', DISC5)} {_near_join('k', 's', _DILATE)}")
def dilate(spark, d):
    return _dense(spark, d, lambda s: kernels.dilate(_bright(s), DISC5))


@query(f"WITH {_SET}, {_kernel_cte('k', CROSS3)} {_near_join('k', 's', _ERODE)}")
def erode_relational(spark, d):
    px = fx.px8(spark, d).withColumn("v", F.when(_v() >= 110, 255).otherwise(0))
    return longform.morphology(px, CROSS3, "erode", 8, 8)


@query(f"WITH {_SET}, {_kernel_cte('k', CROSS3)}, a AS ({_near_join('k', 's', _ERODE)}) {_near_join('k', 'a', _DILATE)}")
def opening(spark, d):
    return _dense(spark, d, lambda s: kernels.opening(_bright(s), CROSS3))


@query(f"WITH {_SET}, {_kernel_cte('k', CROSS3)}, a AS ({_near_join('k', 's', _DILATE)}) {_near_join('k', 'a', _ERODE)}")
def closing(spark, d):
    return _dense(spark, d, lambda s: kernels.closing(_bright(s), CROSS3))


@query(f"WITH {PX} SELECT image_id, ty::INT AS y, tx::INT AS x, v FROM range(5) a(ty) CROSS JOIN range(12) b(tx) JOIN px ON px.y = ty * 8 // 5 AND px.x = tx * 8 // 12")
def resize_nn(spark, d):
    return longform.resize(fx.px8(spark, d), 12, 5, 8, 8)


# --- regions ----------------------------------------------------------------------------------------------------

_LABELS = f"""{PX}, s AS (SELECT image_id, y, x FROM px WHERE v >= 120), reach AS (SELECT image_id, y, x, y * 8 + x AS root FROM s UNION
        SELECT s.image_id, s.y, s.x, r.root FROM reach r JOIN s ON s.image_id = r.image_id AND abs(s.y - r.y) + abs(s.x - r.x) = 1),
    low AS (SELECT image_id, y, x, min(root) AS root FROM reach GROUP BY ALL),
    lab AS (SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY root)::INT AS v FROM low),
    full_ AS (SELECT px.image_id, px.y, px.x, px.v AS level, coalesce(lab.v, 0) AS v FROM px LEFT JOIN lab USING (image_id, y, x))"""


def _labels(stack):
    return kernels.label_components(np.where(stack >= 120, 255, 0))


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, y, x, v FROM full_")
def connected_components(spark, d):
    return _dense(spark, d, _labels)


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, y, x, v FROM full_")
def connected_components_tiled(spark, d):
    return components_tiled(_px(fx.px8(spark, d), v=point.threshold(_v(), 120)), 4)


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, y, x, CASE WHEN v = 2 THEN 255 ELSE 0 END AS v FROM full_")
def extract_component(spark, d):
    return _px(_dense(spark, d, _labels), v=point.extract_label(_v(), 2))


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, v AS label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, sum(level)::BIGINT AS total FROM full_ WHERE v > 0 GROUP BY ALL")
def component_stats(spark, d):
    out = to_pixels(fx.img8(spark, d), lambda s: (_labels(s), s), {"v": "int", "level": "int"}).filter("v > 0")
    return out.groupBy("image_id", _v().alias("label")).agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("level").alias("total"))


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, max(v) + 1 AS n FROM full_ GROUP BY image_id")
def component_count(spark, d):
    return to_rows(fx.img8(spark, d), lambda s: _labels(s).max((1, 2)) + 1, {"n": "int"})


_EDGE = f"{PX}, e AS (SELECT image_id, y, x FROM px WHERE v >= 150), th(t, c, s) AS (VALUES {', '.join(f'({t}, {c!r}::DOUBLE, {s!r}::DOUBLE)' for t, (c, s) in enumerate(ANGLES))})"
_VOTES = f"{_EDGE}, acc AS (SELECT image_id, floor(x * c + y * s + 11::DOUBLE)::INT AS r, t, count(*) AS votes FROM e CROSS JOIN th GROUP BY ALL)"


@query(f"WITH {_VOTES} SELECT * FROM acc WHERE r BETWEEN 0 AND 22")
def hough_accumulate(spark, d):
    return longform.hough(fx.edge8(spark, d), ANGLES, 8, 8)


@query(f"""WITH {_VOTES} SELECT image_id, (r - 11)::DOUBLE AS rho, round(t * {math.pi / 12!r}::DOUBLE, 6) AS theta, votes FROM
    (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r, t) AS k FROM acc WHERE votes >= 3 AND r BETWEEN 0 AND 22) WHERE k <= 10""")
def hough_lines(spark, d):
    votes = longform.hough(fx.edge8(spark, d), ANGLES, 8, 8)
    return longform.lines_of(votes, 3, 10, 11, 1.0, math.pi / 12).withColumn("theta", _r(F.col("theta")))


@query(_sql("CASE WHEN (x, y) IN ((0, 1), (1, 2), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 6)) THEN 255 ELSE v END AS v"))
def draw_line(spark, d):
    return longform.draw(fx.px8(spark, d), kernels.line_points(*SEGMENT), 255, 8, 8)


@query(_sql("CASE WHEN x = 3 THEN 255 ELSE v END AS v"))
def draw_polar_line(spark, d):
    return longform.draw(fx.px8(spark, d), kernels.line_points(*kernels.polar_line(3.0, 0.0)), 255, 8, 8)


# --- frequencies ------------------------------------------------------------------------------------------------

_TURN = "cos(2 * pi() * (f.y * p.y + f.x * p.x) / 8)", "sin(2 * pi() * (f.y * p.y + f.x * p.x) / 8)"
_DFT = f"""{PX}, f AS (SELECT a.y::INT AS y, b.x::INT AS x FROM range(8) a(y) CROSS JOIN range(8) b(x)),
    sp AS (SELECT p.image_id, f.y, f.x, sum(p.v * {_TURN[0]}) AS re, -sum(p.v * {_TURN[1]}) AS im FROM px p CROSS JOIN f GROUP BY ALL)"""


def _parts(s):
    z = kernels.fft(s)
    return z.real, z.imag


def _spectrum(spark, d):
    return to_pixels(fx.img8(spark, d), _parts, {"re": "double", "im": "double"})


@query(f"WITH {_DFT} SELECT image_id, y, x, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM sp")
def fft2(spark, d):
    return _px(_spectrum(spark, d), re=_r(F.col("re"), 3), im=_r(F.col("im"), 3))


@query(f"WITH {_DFT} SELECT image_id, y, x, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM sp")
def fft2_relational(spark, d):
    return _px(longform.dft(fx.px8(spark, d), 8), re=_r(F.col("re"), 3), im=_r(F.col("im"), 3))


@query(_sql("v"))
def ifft2_roundtrip(spark, d):
    return _dense(spark, d, lambda s: np.rint(kernels.ifft(kernels.fft(s))))


@query(f"WITH {_DFT} SELECT image_id, y, x, round(sqrt(re * re + im * im), 3) AS magnitude FROM sp")
def fft_magnitude(spark, d):
    return _px(_spectrum(spark, d), magnitude=_r(F.hypot("re", "im"), 3))


@query(f"WITH {_DFT} SELECT image_id, y, x, round(atan2(round(im, 6) + 0.0, round(re, 6) + 0.0), 3) + 0.0 AS phase FROM sp")
def fft_phase(spark, d):
    # parts that are 0 but for rounding are 0, so that the phase of real values is 0 or pi in any summation
    return _px(_spectrum(spark, d), phase=_r(F.atan2(_r(F.col("im")), _r(F.col("re"))), 3))


@query(_sql("v").replace("y, x, v FROM", "((y + 4) % 8)::INT AS y, ((x + 4) % 8)::INT AS x, v FROM"))
def fftshift(spark, d):
    return longform.shift_quadrants(fx.px8(spark, d), 8, 8).select("image_id", "y", "x", "v")


_DIST2 = "((y - 4) * (y - 4) + (x - 4) * (x - 4))"
_MASKS = [
    ("IDEAL_LOWPASS", f"CASE WHEN sqrt({_DIST2}) <= 2 THEN 1.0 ELSE 0.0 END"),
    ("GAUSSIAN_LOWPASS", f"exp(-{_DIST2} / 8.0)"),
    ("IDEAL_HIGHPASS", f"CASE WHEN sqrt({_DIST2}) >= 2 THEN 1.0 ELSE 0.0 END"),
    ("GAUSSIAN_HIGHPASS", f"1 - exp(-{_DIST2} / 8.0)"),
    ("IDEAL_BANDPASS", f"CASE WHEN sqrt({_DIST2}) BETWEEN 2 AND 3 THEN 1.0 ELSE 0.0 END"),
    ("GAUSSIAN_BANDPASS", f"exp(-{_DIST2} / 18.0) - exp(-{_DIST2} / 8.0)"),
]


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, y::INT AS y, x::INT AS x, round(({e})::DOUBLE, 6) + 0.0 AS v FROM range(8) a(y) CROSS JOIN range(8) b(x)" for k, e in _MASKS))
def freq_mask(spark, d):
    rows = [(k, y, x, float(m[y, x])) for k, _ in _MASKS for m in [kernels.frequency_mask(k, 8, 8, 2, 3)] for y in range(8) for x in range(8)]
    return spark.createDataFrame(rows, "kind string, y int, x int, v double").withColumn("v", _r(_v()))


@query(f"""WITH {_DFT}, m AS (SELECT image_id, y, x, re * exp(-(((y + 4) % 8 - 4) ** 2 + ((x + 4) % 8 - 4) ** 2) / 8.0) AS re, im * exp(-(((y + 4) % 8 - 4) ** 2 + ((x + 4) % 8 - 4) ** 2) / 8.0) AS im FROM sp)
    SELECT f.image_id, p.y, p.x, round(sum(f.re * {_TURN[0]} - f.im * {_TURN[1]}) / 64, 3) + 0.0 AS v FROM m f CROSS JOIN f p GROUP BY ALL""")  # fmt: skip
def freq_filter(spark, d):
    mask = kernels.frequency_mask("GAUSSIAN_LOWPASS", 8, 8, 2)
    return _dense(spark, d, lambda s: kernels.frequency_filter(s, mask), "double").withColumn("v", _r(_v(), 3))


# --- segmentation -----------------------------------------------------------------------------------------------


def _kmeans_sql(k: int, rounds: int) -> str:
    out = [f"{PX}, c0 AS (SELECT DISTINCT image_id, j::INT AS j, 255.0::DOUBLE / {k - 1} * j AS c FROM px CROSS JOIN range({k}) r(j))"]
    for i in range(rounds):
        out.append(f"a{i} AS (SELECT px.image_id, y, x, v, arg_min(j, (abs(v - c), j)) AS j FROM px JOIN c{i} USING (image_id) GROUP BY ALL)")
        out.append(f"c{i + 1} AS (SELECT c.image_id, c.j, coalesce(avg(a.v), any_value(c.c)) AS c FROM c{i} c LEFT JOIN a{i} a ON a.image_id = c.image_id AND a.j = c.j GROUP BY c.image_id, c.j)")
    return f"WITH {', '.join(out)} SELECT a.image_id, y, x, round(c, 6) AS v FROM a{rounds - 1} a JOIN c{rounds} c ON c.image_id = a.image_id AND c.j = a.j"


@query(_kmeans_sql(3, segment.ROUNDS))
def kmeans_gray(spark, d):
    return _dense(spark, d, lambda s: segment.kmeans_gray(s, 3), "double").withColumn("v", _r(_v()))


_THREE = ("p_c0", "p_c1", "p_c2")


@query()
def kmeans_color(spark, d):
    return to_pixels(dense_rgb(fx.rgb8(spark, d)), lambda *c: segment.kmeans_color(*c, 3), {"c0": "int", "c1": "int", "c2": "int"}, _THREE)


@query()
def region_grow_gray(spark, d):
    return _dense(spark, d, lambda s: segment.grow_gray(s, [(3, 3), (4, 4)], 25))


@query()
def region_grow_color(spark, d):
    return to_pixels(dense_rgb(fx.rgb8(spark, d)), lambda *c: segment.grow_color(*c, [(3, 3)], 0.2), {"c0": "int", "c1": "int", "c2": "int"}, _THREE)


_IN = "(x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)"


@query(f"""WITH {PX}, m1 AS (SELECT image_id, sum(v) FILTER ({_IN}) // 16 AS fg, sum(v) FILTER (NOT {_IN}) // 48 AS bg FROM px GROUP BY image_id),
    l1 AS (SELECT px.*, {_IN} AND abs(v - fg) < abs(v - bg) AS o FROM px JOIN m1 USING (image_id)),
    m2 AS (SELECT image_id, sum(v) FILTER (o) // nullif(count(*) FILTER (o), 0) AS fg, sum(v) FILTER (NOT o) // nullif(count(*) FILTER (NOT o), 0) AS bg FROM l1 GROUP BY image_id)
    SELECT l1.image_id, y, x, CASE WHEN CASE WHEN fg IS NULL OR bg IS NULL THEN o ELSE {_IN} AND abs(v - fg) < abs(v - bg) END THEN 255 ELSE 0 END AS v FROM l1 JOIN m2 USING (image_id)""")
def grabcut_lite(spark, d):
    return _dense(spark, d, lambda s: segment.grabcut_lite(s, ROI, 2))


@query()
def grabcut(spark, d):
    return to_pixels(fx.img8(spark, d).withColumn("p", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.element_at("p", (F.floor(y / 2) * 8 + F.floor(x / 2) + 1).cast("int")))))).withColumn("width", F.lit(16)).withColumn("height", F.lit(16)), lambda s: segment.grabcut(s, (0, 0, 16, 16), 2), {"v": "int"})


@query(f"""WITH {PX} SELECT image_id, count(*) FILTER ({_IN}) AS fg_n, (sum(v) FILTER ({_IN}) // 16)::INT AS fg_mean, round(greatest(25, var_pop(v) FILTER ({_IN})), 4) AS fg_var,
    count(*) FILTER (NOT {_IN}) AS bg_n, (sum(v) FILTER (NOT {_IN}) // 48)::INT AS bg_mean, round(greatest(25, var_pop(v) FILTER (NOT {_IN})), 4) AS bg_var FROM px GROUP BY image_id""")
def region_statistics(spark, d):
    out = hist.region_statistics(fx.px8(spark, d), point.in_roi(F.col("y"), F.col("x"), ROI))
    return out.withColumn("fg_var", _r(F.col("fg_var"), 4)).withColumn("bg_var", _r(F.col("bg_var"), 4))


@query(f"""WITH {PX}, n AS (SELECT image_id, v - lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS a, v - lead(v) OVER (PARTITION BY image_id, x ORDER BY y) AS b FROM px)
    SELECT image_id, round((sum(coalesce(a * a, 0)) + sum(coalesce(b * b, 0)))::DOUBLE / (count(a) + count(b) + 1), 6) AS contrast FROM n GROUP BY image_id""")
def neighbour_contrast(spark, d):
    return hist.neighbour_contrast(fx.px8(spark, d)).withColumn("contrast", _r(F.col("contrast")))


# --- containers, wire, files and models ---------------------------------------------------------------------------


def _packed(spark, d) -> DataFrame:
    """The fixtures as dense images with a pixel buffer."""
    digits = F.array_join(F.transform("p", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return fx.img8(spark, d).select("image_id", "width", "height", F.lit("GRAYSCALE").alias("format"), F.lit(1).alias("depth"), F.lit("PIXELS").alias("state"), F.unhex(digits).alias("pixels"))


@query(f"WITH {PX} SELECT image_id, string_agg(upper(printf('%02x', v)), '' ORDER BY x) AS row_hex FROM px WHERE y = 3 GROUP BY image_id")
def view_rows(spark, d):
    return images.view_row(images.view_of_image(_packed(spark, d)), 3).select("image_id", F.hex("row").alias("row_hex"))


@query(f"WITH {PX} SELECT image_id, y, x, v FROM px")
def dense_roundtrip(spark, d):
    return images.pixels_of(_packed(spark, d)).select("image_id", "y", "x", "v")


@query(f"WITH {PX} SELECT image_id, y - 2 AS y, x - 1 AS x, v FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def center_crop(spark, d):
    return images.centre_crop(fx.px8(spark, d), 6, 4, 8, 8)


@query("SELECT 0::BIGINT AS image_id, 160 AS width, 120 AS height, 'RGB565' AS format, 2 AS depth, 'PIXELS' AS state, 38400 AS bytes, 4 AS planes")
def create_image(spark, d):
    made = images.with_channels(images.create_images_named(spark, "QQVGA", "RGB565"), 3)
    return made.select("image_id", "width", "height", "format", "depth", "state", F.length("pixels").alias("bytes"), F.size("ch").alias("planes"))


@query(f"WITH {PX} SELECT image_id, y, x, v FROM px")
def framewire_roundtrip(spark, d):
    wire = Serial(spark, framewire.wire_folder(spark))
    wire.send_images(_packed(spark, d), named=True)
    return images.pixels_of(wire.named_images()).select("image_id", "y", "x", "v")


@query("SELECT vec_id AS image_id, 'FFD8' AS starts, 'FFD9' AS ends, 8 AS width, 8 AS height, TRUE AS within FROM embeddings")
def jpeg_encode(spark, d):
    packed = _packed(spark, d)
    return jpeg.check(packed, jpeg.compress(packed, 80), 80)


_GOOD = {
    "model": {"id": "probe", "onnx_file": "probe.onnx", "source_sha256": "a" * 64},
    "generated": {"artifact_sha256": "0" * 64, "weights_blob": "probe.bin"},
    "deployment": {"inference_location": "mcu", "stedgeai_version": "1", "cube_n6_version": "1"},
    "legal": {"license": "free", "label_map_id": "labels", "dataset_license": "free"},
    "provenance": {"training_recipe": "t", "quantization_recipe": "q"},
    "io": {k: {"width": 8, "height": 8, "channels": 1, "type": "u8", "layout": "hwc", "scale": 1.0, "zero_point": 0} for k in ("input", "output")},
    "memory": {"weights_bytes": 64, "activations_bytes": 128, "weights_region": "external_flash", "activations_region": "psram"},
}


def _variant(*path, value=None) -> str:
    m = json.loads(json.dumps(_GOOD))
    at = m
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    return json.dumps(m)


_MANIFESTS = [
    ("good", json.dumps(_GOOD), True),
    ("host", _variant("deployment", "inference_location", value="host"), False),
    ("hash", _variant("model", "source_sha256", value="ab"), False),
    ("type", _variant("io", "input", "type", value="u16"), False),
    ("wide", _variant("io", "input", "width", value=65536), False),
    ("widest", _variant("io", "input", "width", value=65535), True),
    ("weights", _variant("memory", "weights_bytes", value=0), False),
    ("region", _variant("memory", "activations_region", value="dma"), False),
    ("extra", _variant("more", value={}), False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {ok})" for n, _, ok in _MANIFESTS) + ") t(name, valid)")
def manifest_validate(spark, d):
    rows = spark.createDataFrame([(n, t) for n, t, _ in _MANIFESTS], "name string, manifest string")
    return rows.select("name", runtime.manifest_valid(F.col("manifest")).alias("valid"))


@query(f"WITH {PX} SELECT image_id AS tensor_id, 0 AS status, upper(printf('%02x', (sum(v) // 64)::INT)) AS mean_hex FROM px GROUP BY image_id")
def runtime_infer(spark, d):
    model = runtime.Runtime().init(lambda raw: bytes([sum(raw) // len(raw)]), runtime.Contract(64, 8, 8, 1), runtime.Contract(1, 1, 1, 1))
    out = model.run(_packed(spark, d).select(F.col("image_id").alias("tensor_id"), F.col("pixels").alias("payload")))
    return out.select("tensor_id", "status", F.hex("payload").alias("mean_hex"))
