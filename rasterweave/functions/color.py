"""Colour space conversions as expressions.

Exact integer arithmetic by default: every formula is a quotient of integers, so a result is the same in every
engine. ``rgb_to_gray(mode="f32")`` follows single precision step by step instead. HSI has the largest channel as its
intensity, and a hue scaled to 255.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.point import clamp255
from rasterweave.schema import require

Triple = tuple[Column, Column, Column]


def _div(a: Column, b: Column | int) -> Column:
    """Quotient of non-negative integers, rounded down."""
    return F.floor(a.cast("long") / (b if isinstance(b, Column) else F.lit(b))).cast("int")


def rgb_to_gray(r: Column, g: Column, b: Column, mode: str = "exact") -> Column:
    if mode == "f32":
        f = lambda x: F.lit(x).cast("float")
        return (f(0.299) * r.cast("float") + f(0.587) * g.cast("float") + f(0.114) * b.cast("float")).cast("int")
    return _div(299 * r + 587 * g + 114 * b, 1000)


def gray_to_rgb(v: Column) -> Triple:
    return v, v, v


def rgb_to_565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.bitwiseAND(0xF8), 8).bitwiseOR(F.shiftleft(g.bitwiseAND(0xFC), 3)).bitwiseOR(F.shiftright(b, 3))


def rgb_from_565(v: Column) -> Triple:
    """The top bits of each channel are repeated below."""
    r, g, b = F.shiftright(v, 11).bitwiseAND(0x1F), F.shiftright(v, 5).bitwiseAND(0x3F), v.bitwiseAND(0x1F)
    return F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2))


def _nearest(n: Column, d: int) -> Column:
    """n / d to the nearest integer, halves away from zero."""
    return F.signum(n).cast("int") * _div(F.abs(n) + d // 2, d)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> Triple:
    y = _nearest(299 * r + 587 * g + 114 * b, 1000)
    u = _nearest(-14713 * r - 28886 * g + 43600 * b, 100000) + 128
    v = _nearest(61500 * r - 51499 * g - 10001 * b, 100000) + 128
    return clamp255(y), clamp255(u), clamp255(v)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Triple:
    d, e = u - 128, v - 128
    parts = 1000 * y + 1403 * e, 1000 * y - 344 * d - 714 * e, 1000 * y + 1770 * d
    return tuple(F.least(F.lit(255), _div(F.greatest(p, F.lit(0)), 1000)) for p in parts)


def rgb_to_hsi(r: Column, g: Column, b: Column) -> Triple:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    # hue of 360 degrees is 255, so a sector of 60 degrees is 42.5
    red = 425 * (g - b) + F.when(g < b, 2550 * delta).otherwise(0)
    hue = F.when(top == r, red).when(top == g, 425 * (b - r) + 850 * delta).otherwise(425 * (r - g) + 1700 * delta)
    h = F.when(delta == 0, 0).otherwise(_div(hue, F.greatest(10 * delta, F.lit(1))))
    s = F.when(top == 0, 0).otherwise(_div(255 * delta, F.greatest(top, F.lit(1))))
    return h, s, top


def hsi_to_rgb(h: Column, s: Column, v: Column) -> Triple:
    turn = 6 * h
    rise = 255 - F.abs(turn % 510 - 255)
    low = _div(v * (255 - s), 255)
    mid = _div(v * (65025 - s * (255 - rise)), 65025)
    sector = F.least(_div(turn, 255), F.lit(5))
    pick = lambda order: F.element_at(F.array(*order), sector + 1)
    return pick([v, mid, low, low, mid, v]), pick([mid, v, v, mid, low, low]), pick([low, low, mid, v, v, mid])


_TO_RGB = {"GRAYSCALE": gray_to_rgb, "RGB888": lambda r, g, b: (r, g, b), "RGB565": rgb_from_565, "YUV": yuv_to_rgb, "HSI": hsi_to_rgb}
_FROM_RGB = {"GRAYSCALE": lambda *c: (rgb_to_gray(*c),), "RGB888": lambda *c: c, "RGB565": lambda *c: (rgb_to_565(*c),), "YUV": rgb_to_yuv, "HSI": rgb_to_hsi}
_COLUMNS = {"GRAYSCALE": ("v",), "RGB565": ("v",), "RGB888": ("c0", "c1", "c2"), "YUV": ("c0", "c1", "c2"), "HSI": ("c0", "c1", "c2")}


def convert(px: DataFrame, source: str, target: str) -> DataFrame:
    """Pixels of one format as another: each goes through RGB888, quantised to 8 bits there.

    Columns: v for grey and RGB565, else c0, c1, c2. The same format copies.
    """
    require(source in _TO_RGB and target in _TO_RGB, "NOT_SUPPORTED", f"{source} to {target}")
    rest = [c for c in px.columns if c not in ("v", "c0", "c1", "c2")]
    if source == target:
        return px.select(*rest, *_COLUMNS[source])
    rgb = px.select(*rest, *[c.cast("int").alias(f"__{i}") for i, c in enumerate(_TO_RGB[source](*map(F.col, _COLUMNS[source])))])
    out = _FROM_RGB[target](*(F.col(f"__{i}") for i in range(3)))
    return rgb.select(*rest, *[c.cast("int").alias(name) for c, name in zip(out, _COLUMNS[target])])
