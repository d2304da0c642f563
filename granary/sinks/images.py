"""DDS images: headers as column expressions, so that an export never leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import texture as T
from granary.functions.formats import FORMATS
from granary.operators.naming import export_names

# Fixed values of the format.
DDS_MAGIC, FOURCC_DX10 = 0x20534444, 0x30315844
CAPS, HEIGHT, WIDTH, PITCH, PIXELFORMAT, MIPMAPCOUNT, LINEARSIZE = 0x1, 0x2, 0x4, 0x8, 0x1000, 0x20000, 0x80000
PF_ALPHA_PIXELS, PF_ALPHA, PF_FOURCC, PF_RGB, PF_LUMINANCE = 0x1, 0x2, 0x4, 0x40, 0x20000
CAPS_COMPLEX, CAPS_TEXTURE, CAPS_MIPMAP = 0x8, 0x1000, 0x400000
#: Bits and channel masks (red, green, blue, alpha) of the formats without blocks.
MASKS = {
    "A8R8G8B8": (PF_RGB | PF_ALPHA_PIXELS, 32, 0x00FF0000, 0x0000FF00, 0x000000FF, 0xFF000000),
    "R8G8B8A8": (PF_RGB | PF_ALPHA_PIXELS, 32, 0x000000FF, 0x0000FF00, 0x00FF0000, 0xFF000000),
    "B5G6R5": (PF_RGB, 16, 0xF800, 0x07E0, 0x001F, 0),
    "B5G5R5A1": (PF_RGB | PF_ALPHA_PIXELS, 16, 0x7C00, 0x03E0, 0x001F, 0x8000),
    "R8": (PF_LUMINANCE, 8, 0xFF, 0, 0, 0),
    "A8": (PF_ALPHA, 8, 0, 0, 0, 0xFF),
}


def _u32(x: Column) -> Column:
    """Four bytes, least first."""
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def _pixel_format(fmt: Column) -> Column:
    """flags, fourcc, bits, masks as an array of seven numbers."""
    out = F.array(*[F.lit(0).cast("long")] * 7)
    for f in FORMATS:
        if f.key in MASKS:
            flags, *rest = MASKS[f.key]
            values = [flags, 0, *rest]
        else:
            values = [PF_FOURCC, f.wtd or FOURCC_DX10, 0, 0, 0, 0, 0]
        out = F.when(fmt == f.code, F.array(*[F.lit(v).cast("long") for v in values])).otherwise(out)
    return out


def header(w: Column, h: Column, fmt: Column, mips: Column) -> Column:
    """The 128 bytes before a payload, and 20 more for BC7."""
    many, blocks = mips > 1, T.is_compressed(fmt)
    zero = F.lit(0)
    flags = F.lit(CAPS | HEIGHT | WIDTH | PIXELFORMAT) + F.when(blocks, LINEARSIZE).otherwise(PITCH) + F.when(many, MIPMAPCOUNT).otherwise(0)
    size = F.when(blocks, T.mip_bytes(w, h, fmt)).otherwise(T.row_pitch(w, fmt))
    pf = _pixel_format(fmt)
    caps = F.lit(CAPS_TEXTURE) + F.when(many, CAPS_COMPLEX | CAPS_MIPMAP).otherwise(0)
    words = [F.lit(DDS_MAGIC), F.lit(124), flags, h, w, size, F.lit(1), mips, *[zero] * 11, F.lit(32), *[pf[i] for i in range(7)], caps, *[zero] * 4]
    dx10 = F.concat(*[_u32(F.lit(v)) for v in (98, 3, 0, 1, 0)])
    return F.concat(*[_u32(x) for x in words], F.when(T.dx9_code(fmt) == 0x20374342, dx10).otherwise(F.unhex(F.lit(""))))


def dds(textures: DataFrame, mips_col: str = "mip_count") -> DataFrame:
    """textures (width, height, format, data and the level count) with the image file in dds; null without data."""
    return textures.withColumn("dds", F.concat(header(F.col("width"), F.col("height"), F.col("format"), F.col(mips_col)), F.col("data")))


def export(textures: DataFrame) -> DataFrame:
    """archive_id, ordinal, file_name, dds: every texture with data, under names that don't clash in their archive."""
    rows = textures.where(F.col("data").isNotNull())
    names = export_names(rows.select(F.col("archive_id").alias("archive"), "ordinal", "name")).select(F.col("archive").alias("archive_id"), F.col("ordinal").cast("int").alias("ordinal"), "file_name")
    return dds(rows).select("archive_id", "ordinal", "dds").join(names, ["archive_id", "ordinal"])
