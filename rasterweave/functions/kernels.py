"""Numpy kernels on stacks of images (n, h, w), and the weights that they use.

Borders differ by family: ``edge`` repeats the nearest pixel (correlations), ``shrink`` looks at what lies inside
only (order statistics), erosion counts the outside as background, dilation leaves it out.
"""

from __future__ import annotations

import math

import numpy as np

from rasterweave.schema import require

# --- weights ----------------------------------------------------------------------------------------------------


def odd_size(sigma: float) -> int:
    return int(6 * sigma + 1) | 1


def gaussian_2d(sigma: float) -> np.ndarray:
    """Sums to 1."""
    require(sigma > 0, "INVALID_ARG")
    r = odd_size(sigma) // 2
    line = np.arange(-r, r + 1.0)
    k = np.exp(-(line[:, None] ** 2 + line**2) / (2 * sigma * sigma))
    return k / k.sum()


def log_2d(sigma: float) -> np.ndarray:
    """Laplacian of a Gaussian; its mean is taken off, so it sums to 0."""
    require(sigma > 0, "INVALID_ARG")
    r, s2 = odd_size(sigma) // 2, sigma * sigma
    line = np.arange(-r, r + 1.0)
    r2 = line[:, None] ** 2 + line**2
    k = (r2 - 2 * s2) / (2 * math.pi * s2 * s2) * np.exp(-r2 / (2 * s2))
    return k - k.mean()


def gaussian_and_derivative(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian line (sum 1) and its derivative (sum 0)."""
    require(sigma > 0, "INVALID_ARG")
    r = odd_size(sigma) // 2
    line = np.arange(-r, r + 1.0)
    g = np.exp(-(line**2) / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)
    d = -line / (sigma * sigma) * g
    return g / g.sum(), d - d.mean()


def structuring_element(shape: str, size: int) -> np.ndarray:
    """RECT, CROSS or ELLIPSE of an odd size. The ellipse is centred on size / 2, half a pixel off the middle."""
    require(size > 0 and size % 2 == 1, "INVALID_ARG")
    y, x = np.mgrid[:size, :size]
    if shape == "RECT":
        return np.ones((size, size), np.uint8)
    if shape == "CROSS":
        return ((y == size // 2) | (x == size // 2)).astype(np.uint8)
    require(shape == "ELLIPSE", "INVALID_ARG", shape)
    half = size / 2
    return ((x - half) ** 2 + (y - half) ** 2 <= half * half).astype(np.uint8)


def rank_one(kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Column and row whose outer product is the kernel, if there are such."""
    u, s, v = np.linalg.svd(np.asarray(kernel, float))
    if len(s) > 1 and s[1] > 1e-12 * s[0]:
        return None
    root = math.sqrt(s[0])
    return u[:, 0] * root, v[0] * root


# --- neighbourhoods ---------------------------------------------------------------------------------------------


def shifted(stack: np.ndarray, dy: int, dx: int, outside: float | None = None) -> np.ndarray:
    """The stack's value at (y + dy, x + dx); outside of the image the nearest pixel, or ``outside``."""
    _, h, w = stack.shape
    y, x = np.arange(h) + dy, np.arange(w) + dx
    out = stack[:, np.clip(y, 0, h - 1)][:, :, np.clip(x, 0, w - 1)]
    if outside is not None:
        out = np.where(((y < 0) | (y >= h))[:, None] | ((x < 0) | (x >= w)), outside, out)
    return out


def offsets(mask: np.ndarray) -> list[tuple[int, int]]:
    a, b = mask.shape[0] // 2, mask.shape[1] // 2
    return [(int(y) - a, int(x) - b) for y, x in np.argwhere(mask != 0)]


def correlate(stack: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of neighbours by weight, not flipped; a kernel of rank one runs as two lines."""
    kernel = np.asarray(kernel, float)
    require(kernel.shape[0] % 2 == 1 and kernel.shape[1] % 2 == 1, "INVALID_ARG")
    lines = rank_one(kernel) if min(kernel.shape) > 3 else None
    if lines is not None:
        return correlate(correlate(stack, lines[0][:, None]), lines[1][None, :])
    out = np.zeros(stack.shape)
    for dy, dx in offsets(kernel):
        out += kernel[dy + kernel.shape[0] // 2, dx + kernel.shape[1] // 2] * shifted(stack, dy, dx)
    return out


def separable(stack: np.ndarray, along_x: np.ndarray, along_y: np.ndarray, scale: float = 1.0, delta: float = 0.0) -> np.ndarray:
    """A line down, then a line across; times ``scale`` plus ``delta``."""
    return correlate(correlate(stack, np.asarray(along_y)[:, None]), np.asarray(along_x)[None, :]) * scale + delta


def minimum(stack: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    rows = np.min([shifted(stack, d, 0) for d in range(-r, r + 1)], axis=0)  # repeating an edge adds no new value
    return np.min([shifted(rows, 0, d) for d in range(-r, r + 1)], axis=0)


def maximum(stack: np.ndarray, size: int) -> np.ndarray:
    return -minimum(-stack.astype(np.int64), size)


def median(stack: np.ndarray, size: int) -> np.ndarray:
    """Of the pixels inside; the mean of the two middle ones if their number is even."""
    r = size // 2
    near = [shifted(stack.astype(float), dy, dx, np.nan) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return np.nanmedian(np.stack(near), axis=0)


def erode(stack: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    set_ = stack != 0
    for _ in range(times):
        set_ = np.all([shifted(set_, dy, dx, False) != 0 for dy, dx in offsets(element)], axis=0)
    return np.where(set_, 255, 0)


def dilate(stack: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    set_ = stack != 0
    for _ in range(times):
        set_ = np.any([shifted(set_, dy, dx, False) != 0 for dy, dx in offsets(element)], axis=0)
    return np.where(set_, 255, 0)


def opening(stack: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    return dilate(erode(stack, element, times), element, times)


def closing(stack: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    return erode(dilate(stack, element, times), element, times)


def difference_of_gaussians(stack: np.ndarray, s1: float, s2: float) -> np.ndarray:
    return np.abs(correlate(stack, gaussian_2d(s1)) - correlate(stack, gaussian_2d(s2)))


def laplacian_of_gaussian(stack: np.ndarray, sigma: float) -> np.ndarray:
    return correlate(stack, log_2d(sigma))


def gradients(stack: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed derivatives across and down; brightness that grows to the right gives a negative one."""
    g, d = gaussian_and_derivative(sigma)
    return separable(stack, d, g), separable(stack, g, d)


def resize(stack: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixel to the upper left."""
    require(width > 0 and height > 0, "INVALID_SIZE")
    _, h, w = stack.shape
    y, x = np.arange(height) * h // height, np.arange(width) * w // width
    return stack[:, np.minimum(y, h - 1)][:, :, np.minimum(x, w - 1)]


# --- edges ------------------------------------------------------------------------------------------------------


def suppress_non_maxima(magnitude: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Keeps magnitudes not below both neighbours along the gradient; 0 at the border."""
    angle = phase * 180 / math.pi
    angle = np.where(angle < 0, angle + 180, angle)
    sector = np.select([(angle < 22.5) | (angle >= 157.5), angle < 67.5, angle < 112.5], [0, 1, 2], 3)
    keep = np.zeros(magnitude.shape, bool)
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        ahead, behind = shifted(magnitude, dy, dx), shifted(magnitude, -dy, -dx)
        keep |= (sector == k) & (magnitude >= ahead) & (magnitude >= behind)
    out = np.where(keep, magnitude, 0.0)
    out[:, [0, -1]] = 0
    out[:, :, [0, -1]] = 0
    return out


def double_threshold(stack: np.ndarray, low: float, high: float, weak: float = 50.0, strong: float = 255.0) -> np.ndarray:
    low, high = min(low, high), max(low, high)
    return np.where(stack >= high, strong, np.where(stack >= low, weak, 0.0))


def hysteresis(stack: np.ndarray, weak: float = 50.0, strong: float = 255.0) -> np.ndarray:
    """Weak pixels that touch strong ones, through others if need be, become strong; the rest 0."""
    weak_, reached = stack == weak, stack == strong
    while True:
        grown = reached | (weak_ & np.any([shifted(reached, dy, dx, False) != 0 for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0))
        if (grown == reached).all():
            return np.where(reached, strong, 0.0)
        reached = grown


def canny(stack: np.ndarray, t1: float, t2: float, aperture: int = 3, l2: bool = True) -> np.ndarray:
    k = min(max(aperture, 3) | 1, 7)
    gx, gy = gradients(stack, 0.3 * ((k - 1) * 0.5 - 1) + 0.8)
    size = np.sqrt(gx * gx + gy * gy) if l2 else np.abs(gx) + np.abs(gy)
    low, high = size.min((1, 2), keepdims=True), size.max((1, 2), keepdims=True)
    size = np.where(high > low, (size - low) / np.where(high > low, high - low, 1) * 255 + 0.5, 0.0)
    return hysteresis(double_threshold(suppress_non_maxima(size, np.arctan2(gy, gx)), t1, t2))


# --- regions ----------------------------------------------------------------------------------------------------


def label_components(stack: np.ndarray) -> np.ndarray:
    """Labels from 1, in order of first appearance, of the 4-connected regions that are not 0."""
    n, h, w = stack.shape
    far = h * w
    label = np.where(stack != 0, np.arange(far).reshape(h, w), far)
    while True:
        near = np.min([label, *(shifted(label, dy, dx, far) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))], axis=0).astype(np.int64)
        low = np.where(stack != 0, near, far)
        # jump to the label of the label
        flat = np.concatenate([low.reshape(n, -1), np.full((n, 1), far)], 1)
        low = np.take_along_axis(flat, flat, 1)[:, :-1].reshape(n, h, w)
        if (low == label).all():
            break
        label = low
    own = (label == np.arange(far).reshape(h, w)).reshape(n, -1)
    rank = np.concatenate([np.cumsum(own, 1), np.zeros((n, 1), np.int64)], 1)
    return np.take_along_axis(rank, label.reshape(n, -1), 1).reshape(n, h, w)


def label_components_two_pass(stack: np.ndarray) -> np.ndarray:
    """As a two-pass labelling that keeps one equivalence a label: later ones replace earlier ones, so some regions
    stay apart. More than 254 provisional labels are an overflow."""
    out = np.zeros(stack.shape, np.int64)
    for image, label in zip(stack, out, strict=True):
        same = [0]
        for y, x in np.argwhere(image != 0):
            up, left = int(label[y - 1, x]) if y else 0, int(label[y, x - 1]) if x else 0
            if not up and not left:
                require(len(same) < 255, "OVERFLOW")
                same.append(len(same))
                label[y, x] = len(same) - 1
            else:
                label[y, x] = min(v for v in (up, left) if v)
                if up and left and up != left:
                    same[max(up, left)] = min(up, left)
        roots = list(range(len(same)))
        for v in range(1, len(same)):
            roots[v] = roots[same[v]] if same[v] != v else v
        order: dict[int, int] = {}
        for v in label[label > 0]:
            order.setdefault(roots[v], len(order) + 1)
        label[label > 0] = [order[roots[v]] for v in label[label > 0]]
    return out


# --- lines ------------------------------------------------------------------------------------------------------


def hough_votes(stack: np.ndarray, thetas: np.ndarray, resolution: float = 1.0) -> np.ndarray:
    """Votes (n, rho bins, theta bins) of the pixels that are 255; bins of rho start at minus the diagonal."""
    n, h, w = stack.shape
    most = int(math.hypot(h, w) / resolution)
    bins = int(2 * most / resolution) + 1
    out = np.zeros((n, bins, len(thetas)), np.int64)
    image, y, x = np.nonzero(stack == 255)
    for t, theta in enumerate(thetas):
        r = ((x * math.cos(theta) + y * math.sin(theta) + most) / resolution).astype(int)
        ok = (r >= 0) & (r < bins)
        np.add.at(out[:, :, t], (image[ok], r[ok]), 1)
    return out


def line_points(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Integer points (x, y) of a line, by its error against the longer axis."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    error, out = dx + dy, []
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        double = 2 * error
        if double >= dy:
            error, x0 = error + dy, x0 + sx
        if double <= dx:
            error, y0 = error + dx, y0 + sy


def polar_line(rho: float, theta: float, reach: int = 1000) -> tuple[int, int, int, int]:
    """End points of a segment through the foot of a polar line."""
    c, s = math.cos(theta), math.sin(theta)
    return int(c * rho - reach * s), int(s * rho + reach * c), int(c * rho + reach * s), int(s * rho - reach * c)


# --- frequencies ------------------------------------------------------------------------------------------------


def fft(stack: np.ndarray) -> np.ndarray:
    _, h, w = stack.shape
    require(h == w and h & (h - 1) == 0, "INVALID_SIZE", "square of a power of two")
    return np.fft.fft2(stack)


def ifft(spectrum: np.ndarray) -> np.ndarray:
    return np.fft.ifft2(spectrum).real


def fft_shift(stack: np.ndarray) -> np.ndarray:
    """Quadrants swapped across the middle."""
    return np.roll(stack, (stack.shape[1] // 2, stack.shape[2] // 2), (1, 2))


FILTERS = ("IDEAL_LOWPASS", "GAUSSIAN_LOWPASS", "IDEAL_HIGHPASS", "GAUSSIAN_HIGHPASS", "IDEAL_BANDPASS", "GAUSSIAN_BANDPASS")


def frequency_mask(kind: str, width: int, height: int, cut1: float, cut2: float = 0.0) -> np.ndarray:
    """Weights by the distance from the middle, in pixels."""
    require(kind in FILTERS, "INVALID_ARG", kind)
    require(cut1 >= 0 and ("BAND" not in kind or 0 <= cut1 < cut2), "INVALID_ARG")
    y, x = np.mgrid[:height, :width]
    d2 = (x - width // 2) ** 2 + (y - height // 2) ** 2
    d = np.sqrt(d2)
    bell = lambda c: np.exp(-d2 / (2 * c * c)) if c else (d2 == 0).astype(float)
    if kind == "IDEAL_LOWPASS":
        return (d <= cut1).astype(float)
    if kind == "IDEAL_HIGHPASS":
        return (d >= cut1).astype(float)
    if kind == "IDEAL_BANDPASS":
        return ((d >= cut1) & (d <= cut2)).astype(float)
    if kind == "GAUSSIAN_BANDPASS":
        return bell(cut2) - bell(cut1)
    return bell(cut1) if kind == "GAUSSIAN_LOWPASS" else 1 - bell(cut1)


def frequency_filter(stack: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return ifft(fft_shift(fft_shift(fft(stack)) * mask))
