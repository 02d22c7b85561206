"""Expressions on single pixels: intensity, thresholds and masks. Grey values are integers from 0 to 255."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterweave.schema import require


def clamp255(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def negative(v: Column) -> Column:
    return F.lit(255) - v


def bit_not(v: Column) -> Column:
    return F.bitwise_not(v).bitwiseAND(255)


def threshold(v: Column, t: Column | int) -> Column:
    """255 from ``t`` on, 0 below."""
    return F.when(v >= t, 255).otherwise(0)


def power(v: Column, gamma: float, scaled: bool = True) -> Column:
    """v / 255 (``scaled``; else v itself) to a power; 0 for a negative or non-finite exponent."""
    if gamma < 0 or not math.isfinite(gamma):
        return F.lit(0.0)
    return F.pow(v / F.lit(255.0) if scaled else v.cast("double"), F.lit(float(gamma)))


def convert_scale_abs(v: Column, alpha: float, beta: float) -> Column:
    """|alpha v + beta|, not limited to 8 bits."""
    return F.abs(F.lit(float(alpha)) * v + F.lit(float(beta)))


def piecewise(v: Column, points: list[int], values: list[int]) -> Column:
    """Linear between breakpoints, constant outside, scaled to [0, 1]."""
    require(len(points) >= 2 and len(points) == len(values), "INVALID_ARG")
    out = F.when(v <= points[0], values[0] / 255.0).when(v >= points[-1], values[-1] / 255.0)
    for (a, b), (fa, fb) in zip(zip(points, points[1:]), zip(values, values[1:])):
        if b > a:
            out = out.when(v.between(a, b), (F.lit(float(fa)) + (v - a) * F.lit(float(fb - fa)) / F.lit(float(b - a))) / 255.0)
    return out


def log_plane(v: Column, shift: float = 0.0) -> Column:
    """Natural logarithm; minus infinity at 0."""
    x = v.cast("double") + F.lit(float(shift))
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def add_value(v: Column, value: float) -> Column:
    return v + F.lit(value)


def colour_distance(c: tuple[Column, Column, Column], colour: tuple[int, int, int]) -> Column:
    """Euclidean distance to a colour."""
    squares = [(x - k) * (x - k) for x, k in zip(c, colour)]
    return F.sqrt((squares[0] + squares[1] + squares[2]).cast("double"))


def in_range(c: tuple[Column, ...], low: tuple[int, ...], high: tuple[int, ...]) -> Column:
    """255 where every channel lies in its closed range."""
    inside = F.lit(True)
    for x, a, b in zip(c, low, high):
        inside = inside & x.between(a, b)
    return F.when(inside, 255).otherwise(0)


def hue_threshold(h: Column, low: int, high: int) -> Column:
    """255 for hues in the closed range, which runs through 0 if ``low`` is above ``high``."""
    inside = h.between(low, high) if low <= high else (h >= low) | (h <= high)
    return F.when(inside, 255).otherwise(0)


def in_roi(y: Column, x: Column, roi: tuple[int, int, int, int]) -> Column:
    """Inside of the rectangle (x, y, width, height)."""
    rx, ry, w, h = roi
    return (x >= rx) & (x < rx + w) & (y >= ry) & (y < ry + h)


def double_threshold(v: Column, low: float, high: float, weak: float = 50.0, strong: float = 255.0) -> Column:
    low, high = min(low, high), max(low, high)
    return F.when(v >= high, strong).when(v >= low, weak).otherwise(0.0)


def extract_label(v: Column, label: int) -> Column:
    return F.when(v == label, 255).otherwise(0)


def mask_and(v: Column, m: Column) -> Column:
    """The value where the mask is set, else 0."""
    return F.when(m != 0, v).otherwise(0)


def mask_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def mask_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def difference(a: Column, b: Column) -> Column:
    """a - b, not below 0."""
    return F.greatest(a - b, F.lit(0))


def gradient_magnitude(gx: Column, gy: Column) -> Column:
    return F.sqrt((gx * gx + gy * gy).cast("double"))


def gradient_phase(gx: Column, gy: Column) -> Column:
    return F.atan2(gy.cast("double"), gx.cast("double"))


def polar_to_cart(magnitude: Column, phase: Column) -> tuple[Column, Column]:
    return magnitude * F.cos(phase), magnitude * F.sin(phase)
