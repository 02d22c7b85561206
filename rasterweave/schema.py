"""The image data model: formats, resolutions, status codes and row types."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: formats and their bytes a pixel, channels a pixel -------------------------------------------
DEPTH = {"GRAYSCALE": 1, "RGB888": 3, "RGB565": 2, "YUV": 3, "HSI": 3, "MASK": 1}
CHANNELS = {"GRAYSCALE": 1, "RGB888": 3, "RGB565": 3, "YUV": 3, "HSI": 3, "MASK": 1}

# --- Fixed values: named resolutions (width, height) ------------------------------------------------------------
RESOLUTIONS = {
    "96X96": (96, 96),
    "QQVGA": (160, 120),
    "QCIF": (176, 144),
    "HQVGA": (240, 176),
    "240X240": (240, 240),
    "QVGA": (320, 240),
    "CIF": (352, 288),
    "HVGA": (480, 320),
    "VGA": (640, 480),
    "SVGA": (800, 600),
    "XGA": (1024, 768),
    "HD": (1280, 720),
    "SXGA": (1280, 1024),
    "UXGA": (1600, 1200),
    "FHD": (1920, 1080),
    "P_HD": (720, 1280),
    "P_3MP": (864, 1536),
    "QXGA": (2048, 1536),
    "QHD": (2560, 1440),
    "WQXGA": (2560, 1600),
    "P_FHD": (1080, 1920),
    "QSXGA": (2560, 1920),
    "WQVGA": (480, 272),
}

# --- Fixed values: status codes and their texts -----------------------------------------------------------------
STATUS = {
    "OK": (0, "Success"),
    "OUT_OF_MEMORY": (-1, "Out of memory"),
    "NULL_PTR": (-2, "Null pointer"),
    "INVALID_ARG": (-3, "Invalid argument"),
    "INVALID_FORMAT": (-4, "Invalid format"),
    "INVALID_SIZE": (-5, "Invalid size"),
    "INVALID_DEPTH": (-6, "Invalid depth"),
    "NOT_SUPPORTED": (-7, "Operation not supported"),
    "NOT_INITIALIZED": (-8, "Not initialized"),
    "BUSY": (-9, "Resource busy"),
    "TIMEOUT": (-10, "Timeout"),
    "DEVICE_ERROR": (-11, "Device error"),
    "IO_ERROR": (-12, "I/O error"),
    "COMMUNICATION": (-13, "Communication error"),
    "OVERFLOW": (-14, "Overflow"),
    "UNDERFLOW": (-15, "Underflow"),
    "OUT_OF_RANGE": (-16, "Out of range"),
    "UNKNOWN": (-99, "Unknown error"),
}

# --- Fixed values: where a buffer lies and who may use it --------------------------------------------------------
MEMORY_REGIONS = ("DEFAULT", "FAST_SRAM", "DMA", "PSRAM", "EXTERNAL_FLASH")
BUFFER_FLAGS = ("CPU_READ", "CPU_WRITE", "DMA", "NPU_READ", "NPU_WRITE", "READ_ONLY")


class DipError(ValueError):
    """An operator's arguments are not valid; ``code`` is the status code."""

    def __init__(self, status: str, detail: str = ""):
        self.status, self.code = status, STATUS[status][0]
        super().__init__(f"{STATUS[status][1]}{': ' + detail if detail else ''}")


def status_text(code: int) -> str:
    """The text of a status code."""
    return next((text for c, text in STATUS.values() if c == code), "Unrecognized error code")


def require(ok: bool, status: str, detail: str = "") -> None:
    if not ok:
        raise DipError(status, detail)


def resolution(name: str) -> tuple[int, int]:
    """Width and height of a named resolution."""
    require(name in RESOLUTIONS, "INVALID_SIZE", name)
    return RESOLUTIONS[name]


def num_channels(fmt: str) -> int:
    require(fmt in CHANNELS, "INVALID_FORMAT", fmt)
    return CHANNELS[fmt]


def pixel_bytes(fmt: str) -> int:
    require(fmt in DEPTH, "INVALID_FORMAT", fmt)
    return DEPTH[fmt]


#: One row an image: the dense form.
IMAGE = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("pixels", T.BinaryType()),
        T.StructField("ch", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)

POSITION = ["image_id", "y", "x"]
