"""Kernels against plain loops and first principles; no Spark."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterweave.functions import kernels as k
from rasterweave.operators import segment as s
from rasterweave.schema import DipError, num_channels, pixel_bytes, resolution, status_text

RNG = np.random.default_rng(1)
STACK = RNG.integers(0, 256, (3, 7, 9))


def each(stack, f):
    return np.array([[[f(i, y, x) for x in range(stack.shape[2])] for y in range(stack.shape[1])] for i in range(len(stack))])


def inside(i, y, x, r):
    return [STACK[i, b, a] for b in range(max(0, y - r), min(7, y + r + 1)) for a in range(max(0, x - r), min(9, x + r + 1))]


def test_schema():
    assert resolution("QVGA") == (320, 240) and num_channels("RGB565") == 3 and pixel_bytes("RGB565") == 2
    assert status_text(-5) == "Invalid size" and status_text(5) == "Unrecognized error code"
    with pytest.raises(DipError):
        resolution("CUSTOM")


def test_correlation_repeats_the_edge_and_does_not_flip():
    w = RNG.integers(-3, 4, (3, 5)).astype(float)
    want = each(STACK, lambda i, y, x: sum(w[a, b] * STACK[i, min(6, max(0, y + a - 1)), min(8, max(0, x + b - 2))] for a in range(3) for b in range(5)))
    assert np.allclose(k.correlate(STACK, w), want)


def test_rank_one_kernels_run_as_lines():
    assert k.rank_one(np.ones((5, 5))) is not None and k.rank_one(np.eye(5)) is None
    w = np.outer([1, 2, 3, 2, 1], [1, 0, 5, 0, 2.0])
    assert np.allclose(k.correlate(STACK, w), sum(w[a, b] * k.shifted(STACK, a - 2, b - 2) for a in range(5) for b in range(5)))


@pytest.mark.parametrize("size", [1, 3, 5])
def test_order_statistics_shrink_at_the_border(size):
    r = size // 2
    assert (k.minimum(STACK, size) == each(STACK, lambda i, y, x: min(inside(i, y, x, r)))).all()
    assert (k.maximum(STACK, size) == each(STACK, lambda i, y, x: max(inside(i, y, x, r)))).all()
    assert (k.median(STACK, size) == each(STACK, lambda i, y, x: np.median(inside(i, y, x, r)))).all()


def test_morphology():
    image = np.zeros((1, 5, 5), int)
    image[0, 1:4, 1:4] = 9
    cross = k.structuring_element("CROSS", 3)
    assert k.erode(image, cross).sum() == 255 and k.dilate(image, cross)[0, 0].tolist() == [0, 255, 255, 255, 0]
    assert (k.erode(np.ones((1, 3, 3)), cross)[0] == [[0, 0, 0], [0, 255, 0], [0, 0, 0]]).all()  # the border erodes
    assert k.structuring_element("ELLIPSE", 5).tolist() == [[0, 0, 0, 0, 0], [0, 1, 1, 1, 1], [0, 1, 1, 1, 1], [0, 1, 1, 1, 1], [0, 1, 1, 1, 1]]
    wide = "0000000 0011110 0111111 0111111 0111111 0111111 0011110".split()
    assert ["".join(map(str, row)) for row in k.structuring_element("ELLIPSE", 7).tolist()] == wide


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=20, max_size=20))
def test_properties(values):
    image = np.array(values).reshape(1, 4, 5)
    bright = np.where(image > 127, 255, 0)
    cross = k.structuring_element("CROSS", 3)
    assert (k.erode(bright, cross) <= bright).all() and (bright <= k.dilate(bright, cross)).all()
    assert (k.minimum(image, 3) <= k.median(image, 3)).all() and (k.median(image, 3) <= k.maximum(image, 3)).all()
    assert k.label_components(bright).max() == k.label_components(bright.swapaxes(1, 2)).max()
    square = np.array(values[:16]).reshape(1, 4, 4)
    assert np.allclose(k.ifft(k.fft(square)), square) and (k.fft_shift(k.fft_shift(square)) == square).all()
    assert np.isclose((np.abs(k.fft(square)) ** 2).sum() / 16, (square.astype(float) ** 2).sum())


def test_components_and_their_two_pass_form():
    image = np.array([[[0, 0, 0, 1], [1, 0, 1, 1], [1, 1, 1, 0]]])
    assert k.label_components(image).max() == 1
    assert k.label_components_two_pass(image).max() == 2
    board = np.indices((40, 40)).sum(0)[None] % 2
    assert k.label_components(board).max() == 800
    with pytest.raises(DipError):
        k.label_components_two_pass(board)


def test_gradient_sign_and_zero_sums():
    ramp = np.tile(np.arange(9.0) * 10, (1, 9, 1))
    gx, gy = k.gradients(ramp, 0.8)
    assert gx[0, 4, 4] < 0 and abs(gy[0, 4, 4]) < 1e-9
    assert abs(k.log_2d(0.8).sum()) < 1e-12 and abs(k.gaussian_2d(1.1).sum() - 1) < 1e-12


def test_edges():
    flat = np.full((1, 8, 8), 7.0)
    assert k.canny(flat, 10, 20).sum() == 0
    step = np.zeros((1, 12, 12))
    step[:, :, 6:] = 200
    assert set(np.unique(k.canny(step, 60, 120))) == {0.0, 255.0}
    weak = np.zeros((1, 3, 5))
    weak[0, 1] = [255, 50, 50, 0, 50]
    assert k.hysteresis(weak)[0, 1].tolist() == [255, 255, 255, 0, 0]
    assert (k.double_threshold(np.array([[[1, 5, 9]]]), 9, 5) == [[[0, 50, 255]]]).all()  # limits may be swapped


def test_lines():
    assert k.line_points(0, 1, 7, 6) == [(0, 1), (1, 2), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 6)]
    assert k.line_points(3, 3, 3, 3) == [(3, 3)] and len(k.line_points(-5, 2, 4, 2)) == 10
    image = np.zeros((1, 6, 6), int)
    image[0, :, 2] = 255
    votes = k.hough_votes(image, np.array([0.0, math.pi / 2]))
    assert votes[0, 2 + 8, 0] == 6 and votes[0, :, 1].max() == 1


def test_resize_and_frequency_masks():
    assert (k.resize(np.arange(4).reshape(1, 2, 2), 4, 3)[0] == [[0, 0, 1, 1], [0, 0, 1, 1], [2, 2, 3, 3]]).all()
    low, high = (k.frequency_mask(f"GAUSSIAN_{x}PASS", 8, 8, 2) for x in ("LOW", "HIGH"))
    assert np.allclose(low + high, 1) and (k.frequency_mask("GAUSSIAN_BANDPASS", 8, 8, 1, 3) >= 0).all()
    for bad in (("IDEAL_BANDPASS", 8, 8, 3, 2), ("OTHER", 8, 8, 1), ("IDEAL_LOWPASS", 8, 8, -1)):
        with pytest.raises(DipError):
            k.frequency_mask(*bad)
    with pytest.raises(DipError):
        k.fft(np.zeros((1, 6, 6)))


def test_kmeans():
    assert set(np.unique(s.kmeans_gray(np.array([[[0, 10, 20, 200, 210, 220]]]), 2))) == {10.0, 210.0}
    colours = [np.array([[[0, 0, 250, 250]]]) for _ in range(3)]
    out = s.kmeans_color(*colours, 2, seed=3)
    assert all(o.tolist() == s.kmeans_color(*colours, 2, seed=3)[i].tolist() for i, o in enumerate(out))


def test_region_growing():
    image = np.array([[[10, 12, 90], [11, 80, 91], [12, 13, 92]]])
    assert s.grow_gray(image, [(0, 0)], 5).tolist() == [[[255, 255, 0], [255, 0, 0], [255, 255, 0]]]
    with pytest.raises(DipError):
        s.grow_gray(image, [(5, 5)], 5)
    mask = s.grow_color(image, image, image, [(0, 0), (9, 9)], 0.05, colourful=False)[0]
    assert mask.tolist() == [[[255, 255, 0], [255, 0, 0], [255, 255, 0]]]


def test_cuts():
    flow = {0: {1: 3.0, 2: 2.0}, 1: {3: 2.0, 2: 1.0}, 2: {3: 2.0}, 3: {}}
    assert s.max_flow_side(flow, 0, 3) == {0, 1, 2} or s.max_flow_side(flow, 0, 3) == {0, 1}
    image = np.full((1, 24, 24), 20)
    image[0, 8:16, 8:16] = 220
    mask = s.grabcut(image, (0, 0, 24, 24), 3)
    assert mask[0, 9:15, 9:15].min() == 255 and mask[0, :4].max() == 0
    assert s.grabcut_lite(image, (6, 6, 12, 12), 2)[0, 8:16, 8:16].min() == 255
