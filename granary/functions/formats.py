"""Texture formats: a fixed dimension of twelve rows, as data and as a DataFrame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Format(NamedTuple):
    code: int
    key: str
    name: str
    compressed: bool
    block_bytes: int
    pixel_bytes: int
    dx9: int  # 0: none
    dxgi: int
    wtd: int  # 0: none
    gpu: bool
    has_alpha: bool


# Fixed values of the file formats.
FORMATS = (
    Format(0, "BC1", "D3DFMT_DXT1", True, 8, 0, 0x31545844, 71, 0x31545844, True, False),
    Format(1, "BC3", "D3DFMT_DXT5", True, 16, 0, 0x35545844, 77, 0x35545844, True, True),
    Format(2, "BC4", "D3DFMT_ATI1", True, 8, 0, 0x31495441, 80, 0x31495441, False, False),
    Format(3, "BC5", "D3DFMT_ATI2", True, 16, 0, 0x32495441, 83, 0x32495441, False, False),
    Format(4, "BC7", "D3DFMT_BC7", True, 16, 0, 0x20374342, 98, 0, True, True),
    Format(5, "A8R8G8B8", "D3DFMT_A8R8G8B8", False, 0, 4, 21, 87, 21, False, True),
    Format(6, "BC2", "D3DFMT_DXT3", True, 16, 0, 0x33545844, 74, 0x33545844, False, True),
    Format(10, "R8G8B8A8", "R8G8B8A8", False, 0, 4, 0, 28, 0, False, True),
    Format(11, "B5G6R5", "D3DFMT_R5G6B5", False, 0, 2, 23, 85, 23, False, False),
    Format(12, "B5G5R5A1", "D3DFMT_A1R5G5B5", False, 0, 2, 25, 86, 25, False, True),
    Format(20, "R8", "D3DFMT_L8", False, 0, 1, 50, 61, 50, False, False),
    Format(21, "A8", "D3DFMT_A8", False, 0, 1, 28, 65, 28, False, True),
)
#: The sRGB variants that readers accept beside the codes above; writers never emit them.
DXGI_SRGB = {72: 0, 75: 6, 78: 1, 99: 4}
UNKNOWN = -1
UNKNOWN_NAME = "Unknown"
BY_CODE = {f.code: f for f in FORMATS}
BY_KEY = {f.key: f.code for f in FORMATS}
FROM_DX9 = {f.dx9: f.code for f in FORMATS if f.dx9}
FROM_DXGI = {f.dxgi: f.code for f in FORMATS} | DXGI_SRGB
FROM_WTD = {f.wtd: f.code for f in FORMATS if f.wtd}
SCHEMA = "code int, key string, name string, compressed boolean, block_bytes int, pixel_bytes int, dx9 long, dxgi long, wtd long, gpu boolean, has_alpha boolean"


def format_dim(spark: SparkSession) -> DataFrame:
    """The dimension as a table (twelve rows, always small enough to broadcast)."""
    return spark.createDataFrame([tuple(f) for f in FORMATS], SCHEMA)


def mip_bytes(w: int, h: int, code: int) -> int:
    f = BY_CODE[code]
    return max(1, -(-w // 4)) * max(1, -(-h // 4)) * f.block_bytes if f.compressed else w * h * f.pixel_bytes


def chain(w: int, h: int, mips: int) -> list[tuple[int, int]]:
    """Sizes of the levels 0 to mips - 1."""
    return [(max(1, w >> i), max(1, h >> i)) for i in range(mips)]


def total_bytes(w: int, h: int, code: int, mips: int) -> int:
    return sum(mip_bytes(a, b, code) for a, b in chain(w, h, mips))


def stride(w: int, h: int, code: int) -> int:
    """The stored stride: bytes of a level over its height, rounded down."""
    return mip_bytes(w, max(1, h), code) // max(1, h)
