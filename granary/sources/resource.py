"""RSC7 and RSC5 resource envelopes, and the packing of blocks into pages: pure functions over bytes."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

from granary.functions.texture import PAGE_FIELDS

# Fixed values of the formats.
RSC7_MAGIC, RSC5_MAGIC = 0x37435352, 0x05435352
VIRTUAL, PHYSICAL = 0x50000000, 0x60000000
MAX_PAGES = 128
PAGE_ALIGN, MAX_SHIFT = 16, 15


class Rejected(ValueError):
    """A file that can't be read, with the reason."""


def page_bytes(flags: int) -> int:
    pages = sum((flags >> bit & (1 << width) - 1) << k for k, (bit, width) in enumerate(PAGE_FIELDS))
    return (512 << (flags & 15)) * pages


def page_count(flags: int) -> int:
    return sum(flags >> bit & (1 << width) - 1 for bit, width in PAGE_FIELDS)


def single_page(size: int, version: int = 0) -> int:
    """Flags of one page that holds size bytes."""
    top = (version & 15) << 28
    if not size:
        return top
    shift = max(0, (size - 1).bit_length() - 9)
    if shift <= MAX_SHIFT:
        return top | 1 << 27 | shift
    return top | 1 << PAGE_FIELDS[min(shift - MAX_SHIFT, 8)][0] | MAX_SHIFT


@dataclass
class Resource:
    version: int
    system_flags: int
    graphics_flags: int
    system: bytes
    graphics: bytes


def inflated(data: bytes, size: int, wbits: int) -> bytes:
    """At most size bytes; a stream that stops short of its end is refused."""
    engine = zlib.decompressobj(wbits)
    try:
        out = engine.decompress(data, size)
    except zlib.error as e:
        raise Rejected("decompression failed (corrupt or unsupported)") from e
    if not engine.eof and len(out) < size:
        raise Rejected("decompression failed (truncated)")
    return out


def deflated(data: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, -15, 9)
    return engine.compress(data) + engine.flush()


def read_rsc7(raw: bytes) -> Resource:
    if len(raw) < 16:
        raise Rejected("file too small or unreadable")
    magic, version, system_flags, graphics_flags = struct.unpack_from("<4I", raw)
    if magic != RSC7_MAGIC:
        raise Rejected(f"not an RSC7 file (bad magic 0x{magic:08X})")
    system, graphics = page_bytes(system_flags), page_bytes(graphics_flags)
    if not system + graphics:
        raise Rejected("computed total size is 0")
    body = inflated(raw[16:], system + graphics, -15)
    body += bytes(system + graphics - len(body))
    return Resource(version, system_flags, graphics_flags, body[:system], body[system:])


def write_rsc7(version: int, system_flags: int, graphics_flags: int, system: bytes, graphics: bytes) -> bytes:
    """Both segments padded to the sizes that their flags declare."""
    body = b"".join(part[:size] + bytes(size - min(size, len(part))) for part, size in ((system, page_bytes(system_flags)), (graphics, page_bytes(graphics_flags))))
    return struct.pack("<4I", RSC7_MAGIC, version, system_flags, graphics_flags) + deflated(body)


def _best_fit(order: list[int], need: list[int], shift: int, first: int, max_pages: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]] | None:
    """Blocks in order of falling size, each into the page with the least room that takes it: (page, place in it) of each
    block, and (class, bytes used) of each page. The first page is of the class first, no other is larger."""
    unit, left = 512 << shift, [(1 << width) - 1 for _, width in PAGE_FIELDS]
    pages: list[list[int]] = []
    free: list[tuple[int, int]] = []  # room and page, sorted
    place = {}
    for i in order:
        at = bisect_left(free, (need[i], -1))
        if at < len(free):
            room, page = free.pop(at)
        else:
            some = (k for k in (range(first + 1) if pages else (first,)) if left[k] and unit << k >= need[i])
            kind = next(some, None)
            if kind is None or len(pages) == max_pages:
                return None
            left[kind] -= 1
            room, page = unit << kind, len(pages)
            pages.append([kind, 0])
        place[i] = page, pages[page][1]
        pages[page][1] += need[i]
        if room > need[i]:
            insort(free, (room - need[i], page))
    for page in sorted(pages[1:], key=lambda p: p[1]):  # pages that are not full may do with a smaller class
        kind = next((k for k in range(page[0]) if left[k] and unit << k >= page[1]), None)
        if kind is not None:
            left[kind] -= 1
            left[page[0]] += 1
            page[0] = kind
    return place, pages


def pack_pages(sizes: list[int], max_pages: int = MAX_PAGES) -> tuple[list[int], int, int]:
    """Blocks into pages of all classes that flags can count: (offset of each block, page flags, total bytes).

    No block straddles pages, each starts at a multiple of 16, the largest at 0. Of the units that will do the two least
    are tried, and the one with the smaller total is taken."""
    need = [-(-s // PAGE_ALIGN) * PAGE_ALIGN for s in sizes]
    order = sorted((i for i, s in enumerate(need) if s), key=lambda i: (-need[i], i))
    if not order:
        return [0] * len(sizes), 0, 0
    largest, found = need[order[0]], []
    for shift in range(MAX_SHIFT + 1):
        for first in range(len(PAGE_FIELDS)):
            if 512 << shift << first >= largest and (packed := _best_fit(order, need, shift, first, max_pages)):
                found.append((sum(512 << shift << k for k, _ in packed[1]), shift, *packed))
                break
        if len(found) == 2:
            break
    if not found:
        raise ValueError("the blocks need larger or more pages than flags can count")
    total, shift, place, pages = min(found, key=lambda f: f[:2])
    starts, at, flags = {}, 0, shift
    for page in sorted(range(len(pages)), key=lambda p: (-pages[p][0], p)):  # large pages come first
        starts[page], at = at, at + (512 << shift << pages[page][0])
        flags += 1 << PAGE_FIELDS[pages[page][0]][0]
    return [starts[place[i][0]] + place[i][1] if i in place else 0 for i in range(len(sizes))], flags, total


def pointer(value: int, base: int) -> int:
    """The offset that a pointer has in its segment, or -1."""
    return value - base if value >= base else -1


def c_string(data: bytes, at: int, most: int | None = None) -> bytes:
    end = data.find(b"\0", at)
    out = data[at : end if end >= 0 else len(data)]
    return out if most is None else out[:most]


def name_hash(name: bytes, lower: bool = True) -> int:
    """The dictionary hash of a name's bytes."""
    h = 0
    for b in name.lower() if lower else name:
        h = h + b & 0xFFFFFFFF
        h = h + (h << 10) & 0xFFFFFFFF
        h ^= h >> 6
    h = h + (h << 3) & 0xFFFFFFFF
    h ^= h >> 11
    return h + (h << 15) & 0xFFFFFFFF
