"""RPF7 containers with plain tables of contents: listing, extraction of resources, layout-preserving rewrites.

Encrypted containers are reported as such and never opened.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from granary.functions.paths import SUPPORTED_INSIDE
from granary.sources.resource import RSC7_MAGIC, Rejected, c_string, page_bytes

# Fixed values of the format.
MAGIC, BLOCK, DIRECTORY = 0x52504637, 512, 0x7FFFFF00
ENCRYPTED = {0x0FFFFFF9, 0x0FEFFFFF}
SIZE_LIMIT, MAX_DEPTH = 0xFFFFFF, 16


class Encrypted(Rejected):
    pass


def _read(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise Rejected("truncated container entry")
    return data[at : at + n]


def entries(data: bytes, base: int = 0) -> list[dict]:
    """The table of contents of the container that starts at base."""
    magic, count, n_names, mode = struct.unpack("<4I", _read(data, base, 16))
    if magic != MAGIC:
        raise Rejected("not a valid RPF7 container")
    if mode in ENCRYPTED:
        raise Encrypted("the table of contents is encrypted")
    table, names = _read(data, base + 16, 16 * count), _read(data, base + 16 + 16 * count, n_names)
    out = []
    for i in range(count):
        first, second, third, fourth = struct.unpack_from("<4I", table, 16 * i)
        low = first | second << 32
        e = {"idx": i, "name": c_string(names, first & 0xFFFF).decode("utf-8", "replace") if first & 0xFFFF < len(names) else "", "base_offset": base, "encryption": mode}
        if second == DIRECTORY:
            e |= {"kind": "directory", "first": third, "children": fourth}
        elif not second >> 31:
            e |= {"kind": "binary", "file_size": low >> 16 & 0xFFFFFF, "file_offset": low >> 40 & 0xFFFFFF, "uncompressed_size": third}
        else:
            e |= {"kind": "resource", "file_size": low >> 16 & 0xFFFFFF, "file_offset": low >> 40 & 0x7FFFFF, "system_flags": third, "graphics_flags": fourth}
        out.append(e)
    if not out or out[0]["kind"] != "directory":
        raise Rejected("the root entry is not a directory")
    return out


def leaves(toc: list[dict], prefix: str = "") -> Iterator[tuple[str, dict]]:
    """(logical path, entry) of the files below the root, depth first; each directory is entered once."""
    stack, seen = [(0, prefix)], {0}
    pending: list = []
    while stack:
        item, path = stack.pop()
        if not isinstance(item, int):
            yield path, item
            continue
        d = toc[item]
        pending.clear()
        for e in toc[d["first"] : d["first"] + d["children"]]:
            logical = f"{path}/{e['name']}" if path else e["name"]
            if e["kind"] != "directory":
                pending.append((e, logical))
            elif e["idx"] not in seen:
                seen.add(e["idx"])
                pending.append((e["idx"], logical))
        stack.extend(reversed(pending))


def stored_size(data: bytes, e: dict) -> int:
    at = e["base_offset"] + e["file_offset"] * BLOCK
    if e["kind"] == "binary":
        return e["file_size"] or e["uncompressed_size"]
    if not e["file_size"]:
        return page_bytes(e["system_flags"]) + page_bytes(e["graphics_flags"])
    if e["file_size"] != SIZE_LIMIT:
        return e["file_size"]
    head = _read(data, at, 16)
    return head[7] | head[14] << 8 | head[5] << 16 | head[2] << 24


def payload(data: bytes, e: dict) -> bytes:
    """The bytes of a file: resources with a header of their own, binaries inflated where they are stored deflated."""
    raw = _read(data, e["base_offset"] + e["file_offset"] * BLOCK, stored_size(data, e))
    if e["kind"] == "binary":
        if e["file_size"] and e["uncompressed_size"] and e["file_size"] != e["uncompressed_size"]:
            try:
                return zlib.decompress(raw, -15)
            except zlib.error:
                return raw
        return raw
    if raw[:4] == struct.pack("<I", RSC7_MAGIC):
        return raw
    version = (e["system_flags"] >> 28 & 15) << 4 | e["graphics_flags"] >> 28 & 15
    return struct.pack("<4I", RSC7_MAGIC, version, e["system_flags"], e["graphics_flags"]) + raw[16:]


def walk(data: bytes, base: int = 0, prefix: str = "", depth: int = 0) -> Iterator[dict]:
    """All files of a container and of those nested in it: entries with logical_path and depth. Binaries named .rpf
    that are no containers are passed over."""
    for path, e in leaves(entries(data, base), prefix):
        if e["kind"] == "binary" and e["name"].lower().endswith(".rpf"):
            if depth < MAX_DEPTH:
                try:
                    yield from list(walk(data, base + e["file_offset"] * BLOCK, path, depth + 1))
                except (Rejected, struct.error):
                    pass
            continue
        yield e | {"logical_path": path, "depth": depth}


def supported(e: dict) -> bool:
    return e["name"].lower().endswith(SUPPORTED_INSIDE)


def rewritten(data: bytes, replacements: dict[str, bytes]) -> tuple[bytes, int]:
    """(container, replaced entries): new payloads are put behind the old bytes at block bounds, and only their entries
    change; without a match the container stays as it is. Paths match whatever their case."""
    wanted = {k.lower(): v for k, v in reversed(list(replacements.items()))}
    image, done = bytearray(data), 0
    for path, e in leaves(entries(data)):
        new = wanted.get(path.lower())
        if new is None:
            continue
        resource = e["kind"] == "resource"
        if resource and (len(new) < 16 or new[:4] != struct.pack("<I", RSC7_MAGIC)):
            raise ValueError("the replacement of a resource is no RSC7 file")
        if len(new) >= SIZE_LIMIT:
            raise ValueError("the replacement is too large for the size field")
        image += bytes(-len(image) % BLOCK)
        block = len(image) // BLOCK
        if block > (0x7FFFFF if resource else 0xFFFFFF):
            raise ValueError("the container has grown beyond the offset field")
        image += new + bytes(-len(new) % BLOCK)
        at = 16 + 16 * e["idx"]
        (low,) = struct.unpack_from("<Q", image, at)
        low = low & 0xFFFF | len(new) << 16 | (block | (1 << 23 if resource else 0)) << 40
        struct.pack_into("<Q", image, at, low)
        if resource:
            image[at + 8 : at + 16] = new[8:16]
        else:
            struct.pack_into("<I", image, at + 8, len(new))
        done += 1
    return (bytes(image), done) if done else (data, 0)
