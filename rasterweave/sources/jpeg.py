"""Baseline JPEG in numpy: 8x8 cosine transform, quantisation, Huffman codes; grey and 4:4:4 colour, there and back."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rasterweave.schema import DEPTH, DipError, require

# --- Fixed values: the standard's quantisation tables (raster order) and Huffman tables --------------------------
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: The standard's typical codes for brightness and for colour: how many of 1 to 16 bits, for DC sizes (0 to 11 in order) and
#: for AC symbols, (run << 4) | size: the shorter codes' symbols; all others follow in rising order.
DC_LENGTHS = [[0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]]
AC_LENGTHS = [[0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]]
AC_FIRST = [
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
]


def _zigzag() -> list[int]:
    """Raster places in order of the diagonals, each other one upwards."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return [8 * y + x for y, x in cells]


ZIGZAG = _zigzag()


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: (value, bits) of each symbol."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _ac_symbols(first: str) -> list[int]:
    known = list(bytes.fromhex(first))
    return known + sorted({0x00, 0xF0, *((run << 4) | size for run in range(16) for size in range(1, 11))} - set(known))


AC_SYMBOLS = [_ac_symbols(first) for first in AC_FIRST]


def _dct_matrix() -> np.ndarray:
    k, n = np.mgrid[:8, :8]
    m = np.cos((2 * n + 1) * k * math.pi / 16) / 2
    m[0] /= math.sqrt(2)
    return m


DCT = _dct_matrix()


def _quality(table: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


class _Bits:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, bits: int) -> None:
        self.held, self.n = (self.held << bits) | value, self.n + bits
        while self.n >= 8:
            byte = (self.held >> (self.n - 8)) & 0xFF
            self.out.append(byte)
            if byte == 0xFF:
                self.out.append(0)
            self.n -= 8
        self.held &= (1 << self.n) - 1

    def done(self) -> bytes:
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)
        return bytes(self.out)


def _planes(raw: bytes, width: int, height: int, fmt: str) -> list[np.ndarray]:
    a = np.frombuffer(raw, np.uint8)
    if fmt in ("GRAYSCALE", "MASK"):
        return [a.reshape(height, width).astype(float)]
    if fmt == "RGB565":
        v = a.view("<u2").astype(int)
        rgb = [(v >> 11 & 31) << 3, (v >> 5 & 63) << 2, (v & 31) << 3]
    else:
        require(fmt == "RGB888", "INVALID_FORMAT", fmt)
        rgb = [a[k::3].astype(int) for k in range(3)]
    r, g, b = (c.reshape(height, width).astype(float) for c in rgb)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]


def encode(raw: bytes, width: int, height: int, fmt: str, quality: int = 75) -> bytes:
    """A JPEG file of one image; ``quality`` is brought into 1 to 100."""
    quality = min(100, max(1, quality))
    require(width > 0 and height > 0 and len(raw) == width * height * DEPTH.get(fmt, 0), "INVALID_SIZE")
    planes = _planes(raw, width, height, fmt)
    tables = [_quality(LUMA, quality), _quality(CHROMA, quality)][: min(2, len(planes))]
    codes = [(_codes(DC_LENGTHS[k], list(range(12))), _codes(AC_LENGTHS[k], AC_SYMBOLS[k])) for k in range(len(tables))]
    blocks = []
    for k, plane in enumerate(planes):
        padded = np.pad(plane, ((0, -height % 8), (0, -width % 8)), "edge") - 128
        h, w = padded.shape
        cut = padded.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        found = np.rint((DCT @ cut @ DCT.T).reshape(-1, 64) / tables[min(k, 1)]).astype(int)
        blocks.append(found[:, ZIGZAG].tolist())
    bits, last = _Bits(), [0] * len(planes)

    def amplitude(v: int, size: int) -> None:
        if size:
            bits.put(v if v > 0 else v + (1 << size) - 1, size)

    for group in zip(*blocks, strict=True):
        for k, block in enumerate(group):
            dc, ac = codes[min(k, 1)]
            step, last[k] = block[0] - last[k], block[0]
            bits.put(*dc[abs(step).bit_length()])
            amplitude(step, abs(step).bit_length())
            run = 0
            end = max((i for i in range(1, 64) if block[i]), default=0)
            for v in block[1 : end + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*ac[0xF0])
                    run -= 16
                size = abs(v).bit_length()
                bits.put(*ac[(run << 4) | size])
                amplitude(v, size)
                run = 0
            if end < 63:
                bits.put(*ac[0x00])

    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    n = len(planes)
    out = [b"\xff\xd8", part(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))]
    out += [part(0xDB, bytes([k, *t[ZIGZAG].tolist()])) for k, t in enumerate(tables)]
    out.append(part(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(n))))
    for k in range(len(tables)):
        out.append(part(0xC4, bytes([k, *DC_LENGTHS[k], *range(12)])))
        out.append(part(0xC4, bytes([0x10 | k, *AC_LENGTHS[k], *AC_SYMBOLS[k]])))
    out.append(part(0xDA, bytes([n, *(x for k in range(n) for x in (k + 1, min(k, 1) * 0x11)), 0, 63, 0])))
    return b"".join([*out, bits.done(), b"\xff\xd9"])


def _segments(raw: bytes):
    """(marker, body) of each segment up to the scan, whose body is its header and all that follows."""
    at = 2
    while at < len(raw):
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if marker == 0xDA:
            yield marker, raw[at + 4 :]
            return
        yield marker, raw[at + 4 : at + 2 + size]
        at += 2 + size


def decode(raw: bytes) -> np.ndarray:
    """The planes of a file that ``encode`` wrote: (1 or 3, height, width), brightness and colour differences, as floats."""
    if raw[:2] != b"\xff\xd8" or raw[-2:] != b"\xff\xd9":
        raise DipError("INVALID_FORMAT", "no JPEG")
    quantum, codes, height, width, n, scan = {}, {}, 0, 0, 0, b""
    for marker, body in _segments(raw):
        if marker == 0xDB:
            quantum[body[0]] = np.frombuffer(body, np.uint8, 64, 1).astype(float)
        elif marker == 0xC0:
            height, width, n = struct.unpack_from(">HHB", body, 1)
        elif marker == 0xC4:
            codes[body[0]] = {(bits, code): s for s, (code, bits) in _codes(list(body[1:17]), list(body[17:])).items()}
        elif marker == 0xDA:
            scan = body[2 * n + 4 : -2].replace(b"\xff\x00", b"\xff")
    bits, at = int.from_bytes(scan, "big"), 8 * len(scan)

    def take(k: int) -> int:
        nonlocal at
        at -= k
        return (bits >> at) & ((1 << k) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for k in range(1, 17):
            code = code << 1 | take(1)
            if (k, code) in table:
                return table[k, code]
        raise DipError("INVALID_FORMAT", "no such code")

    def amplitude(size: int) -> int:
        v = take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    down, across = -(-height // 8), -(-width // 8)
    found, last = np.zeros((n, down * across, 64)), [0] * n
    for b in range(down * across):
        for k in range(n):
            t = min(k, 1)
            last[k] += amplitude(symbol(codes[t]))
            found[k, b, 0], i = last[k], 1
            while i < 64:
                s = symbol(codes[0x10 | t])
                if s == 0x00:
                    break
                i += s >> 4
                if s != 0xF0:
                    found[k, b, i] = amplitude(s & 15)
                i += 1
    planes = np.zeros((n, down * 8, across * 8))
    for k in range(n):
        block = np.zeros((down * across, 64))
        block[:, ZIGZAG] = found[k] * quantum[min(k, 1)]
        cut = DCT.T @ block.reshape(-1, 8, 8) @ DCT + 128
        planes[k] = cut.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
    return planes[:, :height, :width]


def error_bound(quality: int) -> float:
    """The greatest root mean square error of a grey plane of whole blocks: half a quantum in every coefficient."""
    return math.sqrt(float(((_quality(LUMA, quality) / 2) ** 2).mean()))


def check(images: DataFrame, compressed: DataFrame, quality: int) -> DataFrame:
    """Grey images and their files, decoded: (image_id, starts, ends, width, height, within), the last by ``error_bound``."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                plane = decode(bytes(r.jpeg))[0]
                apart = plane - np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width)
                within = math.sqrt(float((apart**2).mean())) <= error_bound(quality) + 1e-9
                out.append((r.image_id, bytes(r.jpeg[:2]).hex().upper(), bytes(r.jpeg[-2:]).hex().upper(), plane.shape[1], plane.shape[0], within))
            yield pd.DataFrame(out, columns=["image_id", "starts", "ends", "width", "height", "within"])

    both = images.select("image_id", "width", "height", "pixels").join(compressed.select("image_id", "jpeg"), "image_id")
    return both.mapInPandas(run, "image_id long, starts string, ends string, width int, height int, within boolean")


def compress(images: DataFrame, quality: int = 75, capacity: int | None = None) -> DataFrame:
    """Dense images (width, height, format, pixels) as JPEG: (image_id, size, jpeg); more bytes than ``capacity``
    fail, with size -1 and no data."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                jpeg = encode(bytes(r.pixels), r.width, r.height, r.format, quality)
                fits = capacity is None or len(jpeg) <= capacity
                out.append((r.image_id, len(jpeg) if fits else -1, jpeg if fits else None))
            yield pd.DataFrame(out, columns=["image_id", "size", "jpeg"])

    return images.select("image_id", "width", "height", "format", "pixels").mapInPandas(run, "image_id long, size int, jpeg binary")
