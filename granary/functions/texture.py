"""Column expressions over texture metadata: everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.formats import FORMATS, UNKNOWN_NAME

MIB = 1024 * 1024
MAX_LEVELS = 13
#: Upper bounds of the size grades in MiB; the last is exclusive, the others inclusive.
TEXTURE_GRADES = (0.70, 1.0, 1.5, 2.0, 2.5, 3.5, 4.5)
ARCHIVE_GRADES = (12.0, 16.0, 20.0, 24.0, 32.0, 48.0, 64.0)
#: Page-flag fields: (first bit, width); the k-th counts pages of 512 << base << k bytes.
PAGE_FIELDS = ((27, 1), (26, 1), (25, 1), (24, 1), (17, 7), (11, 6), (7, 4), (5, 2), (4, 1))


def _int(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def shr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x, _int(n).cast("int"))


def shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, _int(n).cast("int"))


def div(x: Column, y: Column | int) -> Column:
    """Integer division, rounding towards zero."""
    return F.call_function("div", x, _int(y))


def _by_format(fmt: Column, value, other) -> Column:
    return reduce(lambda rest, f: F.when(fmt == f.code, F.lit(value(f))).otherwise(rest), FORMATS, F.lit(other))


def format_name(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.name, UNKNOWN_NAME)


def short_format_name(fmt: Column) -> Column:
    return F.regexp_replace(format_name(fmt), "^D3DFMT_", "")


def is_compressed(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.compressed, False)


def block_bytes(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.block_bytes, 0)


def pixel_bytes(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.pixel_bytes, 0)


def dx9_code(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.dx9, 0).cast("long")


def dxgi_code(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.dxgi, 0).cast("long")


def wtd_code(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.wtd, 0).cast("long")


def may_have_alpha(fmt: Column) -> Column:
    return _by_format(fmt, lambda f: f.has_alpha, True)


def _blocks(n: Column) -> Column:
    return F.greatest(F.lit(1), div(n + 3, 4))


def mip_bytes(w: Column, h: Column, fmt: Column) -> Column:
    """Bytes of one level."""
    w, h = w.cast("long"), h.cast("long")
    return F.when(is_compressed(fmt), _blocks(w) * _blocks(h) * block_bytes(fmt)).otherwise(w * h * pixel_bytes(fmt)).cast("long")


def levels(w: Column, h: Column, mips: Column) -> Column:
    """array<struct<level, w, h>> of the levels 0 to mips - 1; empty without levels."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(mips, F.lit(1)) - 1), lambda i: F.struct(i.alias("level"), F.greatest(F.lit(1), shr(w, i)).alias("w"), F.greatest(F.lit(1), shr(h, i)).alias("h")))
    return F.slice(some, F.lit(1), F.greatest(F.lit(0), mips))


def _sum(levels_: Column, fmt: Column) -> Column:
    return F.aggregate(levels_, F.lit(0).cast("long"), lambda t, x: t + mip_bytes(x["w"], x["h"], fmt))


def total_mip_bytes(w: Column, h: Column, fmt: Column, mips: Column) -> Column:
    return _sum(levels(w, h, mips), fmt)


def large_mip_bytes(w: Column, h: Column, fmt: Column, mips: Column) -> Column:
    """Bytes of the levels of 16 by 16 pixels and more."""
    return _sum(F.filter(levels(w, h, mips), lambda x: (x["w"] >= 16) & (x["h"] >= 16)), fmt)


def row_pitch(w: Column, fmt: Column) -> Column:
    return F.when(is_compressed(fmt), _blocks(w) * block_bytes(fmt)).otherwise(w * pixel_bytes(fmt)).cast("long")


def stride(w: Column, h: Column, fmt: Column) -> Column:
    """The stored stride: bytes of level 0 over its height."""
    tall = F.greatest(F.lit(1), h)
    return F.when(is_compressed(fmt), div(row_pitch(w, fmt) * _blocks(tall), tall)).otherwise(w * pixel_bytes(fmt)).cast("long")


def bit_length(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x.cast("long")))).otherwise(0)


def natural_levels(w: Column, h: Column, cap: int = MAX_LEVELS) -> Column:
    """Levels of a full chain down to 1 by 1, at most cap."""
    return F.least(F.lit(cap), bit_length(F.greatest(w, h)))


def preview_level(w: Column, h: Column, mips: Column, target: Column | int) -> Column:
    """The deepest level whose longer side is still at least target; 0 where that is level 0."""
    longest, target = F.greatest(w, h), _int(target)
    deepest = F.least(mips - 1, bit_length(longest) - 1)
    fits = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), deepest)), lambda i: F.greatest(F.lit(1), shr(longest, i)) >= target)
    return F.when((mips <= 1) | (target <= 0), F.lit(0)).otherwise(F.coalesce(F.array_max(fits), F.lit(0)))


def halvings(w: Column, h: Column, max_w: Column | int, max_h: Column | int) -> Column:
    """The least number of halvings of both sides after which they are within the limits."""
    ok = lambda k: (F.greatest(F.lit(1), shr(w, k)) <= _int(max_w)) & (F.greatest(F.lit(1), shr(h, k)) <= _int(max_h))
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(31)), ok))


def resized(side: Column, halved: Column) -> Column:
    return F.greatest(F.lit(4), shr(side, halved))


def scaled(side: Column, how: str, custom: int | None = None) -> Column:
    """A manual new side: half, quarter or custom, 4 at least."""
    new = {"half": div(side, 2), "quarter": div(side, 4), "custom": F.lit(custom)}[how]
    return F.greatest(F.lit(4), new).cast("int")


def level_policy(current: Column, policy: Column | int) -> Column:
    """-2: keep, -1: as many as a chain may have, else that number."""
    p = _int(policy)
    return F.when(p == -2, current).when(p == -1, F.lit(MAX_LEVELS)).otherwise(p)


def recompress_target(fmt: Column, alpha_used: Column) -> Column:
    """BC2, BC3 and BC7 without alpha become BC1, all others stay."""
    return F.when(fmt.isin(6, 1, 4) & ~alpha_used, F.lit(0)).otherwise(fmt)


def resize_needed(w: Column, h: Column, max_w: int, max_h: int) -> Column:
    return (w > max_w) | (h > max_h)


def grade(size: Column, bounds: tuple[float, ...]) -> Column:
    """0 for sizes up to the first bound in MiB, then 1, ...; beyond the last bound the number of bounds."""
    mib = size / float(MIB)
    out = F.when(mib < bounds[-1], F.lit(len(bounds) - 1)).otherwise(len(bounds))
    for i in reversed(range(len(bounds) - 1)):
        out = F.when(mib <= bounds[i], F.lit(i)).otherwise(out)
    return out


def mib_text(size: Column) -> Column:
    """Two decimals, ties to even."""
    return F.format_string("%.2f", F.bround(size / float(MIB), 2))


def grouped_text(n: Column) -> Column:
    return F.format_number(n, 0)


def aligned(v: Column, unit: int) -> Column:
    """v rounded up to a multiple of unit."""
    return div(v + (unit - 1), unit) * unit


# 32-bit unsigned arithmetic in longs
_MASK = 0xFFFFFFFF


def _u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _mixed(values: Column) -> Column:
    """One-at-a-time hash of an array of byte values."""

    def step(h: Column, b: Column) -> Column:
        a = _u32(h + b)
        a = _u32(a + shl(a, 10))
        return a.bitwiseXOR(shr(a, 6))

    def last(h: Column) -> Column:
        a = _u32(h + shl(h, 3))
        a = a.bitwiseXOR(shr(a, 11))
        return _u32(a + shl(a, 15))

    return F.aggregate(values, F.lit(0).cast("long"), step, last)


def byte_values(data: Column) -> Column:
    """The bytes of a binary value as array<long>."""
    n = F.octet_length(data)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(F.hex(data), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.slice(pairs, F.lit(1), n)


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased, all else kept."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name_hash(name: Column, lower: bool = True) -> Column:
    """The dictionary hash of a name: over the bytes of its UTF-8 form, A-Z lower-cased (unless lower is false)."""
    text = ascii_lower(name) if lower else name
    # ASCII names take their characters' codes; others go through their bytes
    chars = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    chars = F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(chars)
    return _mixed(F.when(F.octet_length(text) == F.length(text), chars).otherwise(byte_values(text.cast("binary"))))


def data_hash(data: Column) -> Column:
    """The same hash of raw bytes."""
    return _mixed(byte_values(data))


def page_bytes(flags: Column) -> Column:
    """Bytes of the pages that RSC7 page flags (a long of 32 unsigned bits) describe."""
    count = reduce(lambda a, b: a + b, [shl(shr(flags, bit).bitwiseAND(F.lit((1 << width) - 1)), k) for k, (bit, width) in enumerate(PAGE_FIELDS)])
    return count * shl(F.lit(512).cast("long"), flags.bitwiseAND(F.lit(15)))


def page_count(flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [shr(flags, bit).bitwiseAND(F.lit((1 << width) - 1)) for bit, width in PAGE_FIELDS])


def single_page_flags(size: Column, version: Column | int = 0) -> Column:
    """Flags of one page that holds size bytes: 512 << shift while that is enough, else 16 MiB << k."""
    version = _int(version).cast("long").bitwiseAND(F.lit(15))
    size = size.cast("long")
    shift = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda s: shl(F.lit(512).cast("long"), s) >= size))
    weight = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda k: shl(F.lit(512 << 15).cast("long"), k) >= size)), F.lit(8))
    bits = F.array(*[F.lit(1 << bit).cast("long") for bit, _ in PAGE_FIELDS])
    one = F.when(shift.isNotNull(), F.lit(1 << 27).cast("long") + shift).otherwise(F.element_at(bits, weight + 1) + 15)
    return shl(version, 28) + F.when(size == 0, F.lit(0).cast("long")).otherwise(one)


def rsc5_virtual_bytes(flags: Column) -> Column:
    return shl(flags.bitwiseAND(F.lit(0x7FF)), shr(flags, 11).bitwiseAND(F.lit(15)) + 8)


def rsc5_physical_bytes(flags: Column) -> Column:
    return shl(shr(flags, 15).bitwiseAND(F.lit(0x7FF)), shr(flags, 26).bitwiseAND(F.lit(15)) + 8)


def rsc5_next_size(size: Column) -> Column:
    """The least size of 11 bits of units of 256 << shift bytes that holds size, with the least such shift."""
    size = size.cast("long")
    units = lambda s: div(size + shl(F.lit(256).cast("long"), s) - 1, shl(F.lit(256).cast("long"), s))
    shift = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda s: units(s) <= 0x7FF))
    return F.when(size == 0, F.lit(256).cast("long")).otherwise(F.coalesce(units(shift) * shl(F.lit(256).cast("long"), shift), size))


def rsc5_flags(virtual: Column, physical: Column) -> Column:
    """Flags of two segment sizes: the greatest exact shift of each; 0 for a size that has none."""

    def field(size: Column) -> tuple[Column, Column]:
        size = size.cast("long")
        unit = lambda s: shl(F.lit(256).cast("long"), s)
        shift = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda s: (size % unit(s) == 0) & (div(size, unit(s)) <= 0x7FF)))
        return F.coalesce(div(size, unit(shift)), F.lit(0)).cast("long"), F.coalesce(shift, F.lit(0)).cast("long")

    (vb, vs), (pb, ps) = field(virtual), field(physical)
    return vb + shl(vs, 11) + shl(pb, 15) + shl(ps, 26)
