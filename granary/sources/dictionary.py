"""Texture dictionaries: reading and writing of YTD and WTD files, and of the dictionaries inside models.

Readers give one dict per texture: name, name_hash, width, height, format, mip_count, stride, data_size, data and,
where a writer needs it, meta.  Entries that make no sense are left out; a file without a valid entry is refused.
"""

from __future__ import annotations

import struct
import zlib

from granary.functions.formats import BY_CODE, FROM_DX9, FROM_DXGI, FROM_WTD, UNKNOWN, chain, mip_bytes, stride, total_bytes
from granary.sources.resource import PHYSICAL, RSC5_MAGIC, VIRTUAL, Rejected, c_string, inflated, name_hash, pack_pages, page_bytes, pointer, read_rsc7, single_page, write_rsc7

# Fixed values of the formats: where the fields of a texture's entry lie.
LEGACY_VERSION, GEN9_VERSION = 13, 5
MAX_TEXTURES, MAX_NAME, MAX_WTD_NAME = 4096, 255, 127
LAYOUTS = {
    "legacy": {"size": 0x90, "dims": 0x50, "stride": 0x56, "format": 0x58, "mips": 0x5D, "data": 0x70, "codes": FROM_DX9},
    "gen9": {"size": 0x80, "dims": 0x40, "stride": 0x46, "format": 0x48, "mips": 0x4D, "data": 0x60, "codes": FROM_DXGI},
}
WTD_META = ("vft", "unknown1", "unknown2", "unknown3", "unknown4", "unknown5", "unknown6", "texture_type", "unknown7", "unknown8", "unknown9", "unknown10", "unknown11", "unknown12", "unknown13")
WTD_ENTRY = struct.Struct("<IIHHIIIIHHIHBB6fIIII")


def read_entries(system: bytes, graphics: bytes, at: int, layout: str = "legacy") -> list[dict]:
    """The valid textures of the dictionary at an offset of the system segment; [] if there is none."""
    if at < 0 or at + 0x40 > len(system):
        return []
    (count,), (items,) = struct.unpack_from("<H", system, at + 0x28), struct.unpack_from("<Q", system, at + 0x30)
    first = pointer(items, VIRTUAL)
    if not 0 < count <= MAX_TEXTURES:
        raise Rejected(f"invalid texture count {count}")
    if first < 0 or first + 8 * count > len(system):
        raise Rejected("item pointers out of bounds")
    out = (_entry(system, graphics, pointer(p, VIRTUAL), LAYOUTS[layout]) for p in struct.unpack_from(f"<{count}Q", system, first))
    return [t for t in out if t is not None]


def _entry(system: bytes, graphics: bytes, at: int, f: dict) -> dict | None:
    if at < 0 or at + f["size"] > len(system):
        return None
    name_at = pointer(struct.unpack_from("<Q", system, at + 0x28)[0], VIRTUAL)
    if not 0 <= name_at < len(system):
        return None
    name = c_string(system, name_at)
    w, h = struct.unpack_from("<hh", system, at + f["dims"])
    (stored,), (code,) = struct.unpack_from("<h", system, at + f["stride"]), struct.unpack_from("<I", system, at + f["format"])
    mips, fmt = system[at + f["mips"]], f["codes"].get(code, UNKNOWN)
    if fmt == UNKNOWN or w <= 0 or h <= 0 or not mips:
        return None
    size, data_at = total_bytes(w, h, fmt, mips), pointer(struct.unpack_from("<Q", system, at + f["data"])[0], PHYSICAL)
    if data_at < 0 or data_at + size > len(graphics):
        return None
    return {
        "name": name[:MAX_NAME].decode("utf-8", "replace"), "name_hash": name_hash(name), "width": w, "height": h, "format": fmt, "mip_count": mips,
        "stride": stored, "data_size": size, "data": graphics[data_at : data_at + size], "entry_off": at, "data_off": data_at,
    }


def read_ytd(raw: bytes) -> tuple[dict, list[dict]]:
    """(version and flags, textures)."""
    r = read_rsc7(raw)
    if len(r.system) < 0x40:
        raise Rejected("system segment too small")
    textures = read_entries(r.system, r.graphics, 0, "gen9" if r.version == GEN9_VERSION else "legacy")
    if not textures:
        raise Rejected("no valid textures")
    return {"version": r.version, "sys_flags": r.system_flags, "gfx_flags": r.graphics_flags}, textures


def check_savable(textures: list[dict], code: str) -> None:
    if not textures:
        raise ValueError("no textures")
    for t in textures:
        if not t["data"] or not t["name"] or t["format"] not in BY_CODE or not getattr(BY_CODE[t["format"]], code):
            raise ValueError(f"texture {t['name']!r} can't be saved")


def write_ytd(textures: list[dict]) -> bytes:
    """A legacy dictionary: sorted by name hash, payloads packed into pages."""
    check_savable(textures, "dx9")
    rows = sorted(((name_hash(t["name"].encode()), i, t) for i, t in enumerate(textures)), key=lambda r: r[:2])
    n, up = len(rows), lambda v: -(-v // 16) * 16
    keys = 0x40
    pointers = up(keys + 4 * n)
    entries = up(pointers + 8 * n)
    names, at = [], entries + 0x90 * n
    for _, _, t in rows:
        names.append(at)
        at += len(t["name"].encode()) + 1
    pagemap = up(at)
    system = bytearray(pagemap + 16)
    offsets, pages, total = pack_pages([len(t["data"]) for _, _, t in rows], 127)
    graphics = bytearray(total)
    struct.pack_into("<QQQIIQHHIQHHI", system, 0, 0, VIRTUAL + pagemap, 0, 1, 0, VIRTUAL + keys, n, n, 0, VIRTUAL + pointers, n, n, 0)
    struct.pack_into(f"<{n}I", system, keys, *(h for h, _, _ in rows))
    struct.pack_into(f"<{n}Q", system, pointers, *(VIRTUAL + entries + 0x90 * i for i in range(n)))
    for i, (_, _, t) in enumerate(rows):
        e, (w, h, fmt, mips) = entries + 0x90 * i, (t["width"], t["height"], t["format"], t["mip_count"])
        large = sum(mip_bytes(a, b, fmt) for a, b in chain(w, h, mips) if a >= 16 and b >= 16)
        struct.pack_into("<QH", system, e + 0x28, VIRTUAL + names[i], 1)
        struct.pack_into("<I", system, e + 0x40, large)
        struct.pack_into("<HHHHI", system, e + 0x50, w, h, 1, stride(w, h, fmt) & 0xFFFF, BY_CODE[fmt].dx9)
        system[e + 0x5D] = mips
        struct.pack_into("<Q", system, e + 0x70, PHYSICAL + offsets[i])
        raw_name = t["name"].encode() + b"\0"
        system[names[i] : names[i] + len(raw_name)] = raw_name
        graphics[offsets[i] : offsets[i] + len(t["data"])] = t["data"]
    system[pagemap : pagemap + 2] = b"\1\1"
    return write_rsc7(LEGACY_VERSION, single_page(len(system), LEGACY_VERSION >> 4), pages | (LEGACY_VERSION & 15) << 28, bytes(system), bytes(graphics))


def rsc5_sizes(flags: int) -> tuple[int, int]:
    return (flags & 0x7FF) << (flags >> 11 & 15) + 8, (flags >> 15 & 0x7FF) << (flags >> 26 & 15) + 8


def rsc5_padded(size: int) -> int:
    if not size:
        return 256
    return next((-(-size // (256 << s)) * (256 << s) for s in range(16) if -(-size // (256 << s)) <= 0x7FF), size)


def rsc5_flags(virtual: int, physical: int) -> int:
    def field(size: int) -> tuple[int, int]:
        fits = [s for s in range(16) if size % (256 << s) == 0 and size // (256 << s) <= 0x7FF]
        return (size // (256 << fits[-1]), fits[-1]) if fits else (0, 0)

    (vb, vs), (pb, ps) = field(virtual), field(physical)
    return vb | vs << 11 | pb << 15 | ps << 26


def clean_wtd_name(name: str) -> str:
    """Without the pack:/ in front and the .dds behind."""
    name = name[6:] if name[:6].lower() == "pack:/" else name
    return name[:-4] if name[-4:].lower() == ".dds" else name


def read_wtd(raw: bytes) -> tuple[dict, list[dict]]:
    """(file fields, textures). Textures of unknown formats are kept without data; short data is cut."""
    if len(raw) < 12:
        raise Rejected("file too small or unreadable")
    magic, kind, flags = struct.unpack_from("<3I", raw)
    if magic != RSC5_MAGIC:
        raise Rejected(f"not an RSC5 file (bad magic 0x{magic:08X})")
    n_system, n_graphics = rsc5_sizes(flags)
    if n_system < 32:
        raise Rejected("system segment too small")
    body = inflated(raw[12:], n_system + n_graphics, 15)
    system, graphics = body[:n_system], body[n_system:]
    vft, block_map, parent, usage, hashes_ptr, n_hashes, _, items_ptr, count, _ = struct.unpack_from("<5I2HI2H", system)
    hashes = _words(system, hashes_ptr, n_hashes, "hash table")
    items = _words(system, items_ptr, count, "texture pointers")
    out = []
    for i, p in enumerate(items):
        at = pointer(p, VIRTUAL)
        if not p or at < 0 or at + WTD_ENTRY.size > len(system):
            continue
        (v, u1, u2, u3, u4, u5, name_ptr, u6, w, h, code, stored, kind_, mips, *floats, prev, nxt, data_ptr, u13) = WTD_ENTRY.unpack_from(system, at)
        name_at, fmt = pointer(name_ptr, VIRTUAL), FROM_WTD.get(code, UNKNOWN)
        name = clean_wtd_name(c_string(system, name_at, MAX_WTD_NAME).decode("utf-8", "replace")) if name_ptr and 0 <= name_at < len(system) else ""
        data, data_at = None, pointer(data_ptr, PHYSICAL)
        if fmt != UNKNOWN and data_ptr and 0 <= data_at < len(graphics):
            data = graphics[data_at : data_at + total_bytes(w, h, fmt, mips)]
        meta = dict(zip(WTD_META, (v, u1, u2, u3, u4, u5, u6, kind_, *floats, u13))) | {"original_hash": hashes[i] if i < len(hashes) else 0, "prev_tex_offset": prev, "next_tex_offset": nxt}
        out.append({"name": name, "name_hash": name_hash(name.encode()), "width": w, "height": h, "format": fmt, "mip_count": mips, "stride": stored, "data_size": len(data or b""), "data": data, "meta": meta})
    return {"resource_type": kind, "vft": vft, "block_map_ptr": block_map, "parent_dict": parent, "usage_count": usage, "flags": flags}, out


def _words(system: bytes, ptr: int, count: int, what: str) -> tuple[int, ...]:
    if not ptr:
        return (0,) * count
    at = pointer(ptr, VIRTUAL)
    if at < 0 or at + 4 * count > len(system):
        raise Rejected(f"{what} out of bounds")
    return struct.unpack_from(f"<{count}I", system, at)


def write_wtd(fields: dict, textures: list[dict]) -> bytes:
    """Entries sorted by their original hash, or that of the lower-cased name; each tied to its neighbours."""
    check_savable(textures, "wtd")
    n, up = len(textures), lambda v: -(-v // 16) * 16
    hashes, pointers = 32, 32 + 4 * n
    entries = pointers + 4 * n
    at, name_at, data_at, used = entries + 80 * n, [], [], 0
    for t in textures:
        name_at.append(at)
        at += len(t["name"].encode()) + 1
        data_at.append(used)
        used += len(t["data"])
    system, graphics = bytearray(rsc5_padded(up(at))), bytearray(rsc5_padded(up(used)))
    for t, a, b in zip(textures, name_at, data_at):
        raw_name = t["name"].encode()
        system[a : a + len(raw_name)] = raw_name
        graphics[b : b + len(t["data"])] = t["data"]
    meta = [t.get("meta") or {} for t in textures]
    order = sorted(range(n), key=lambda i: (meta[i].get("original_hash") or name_hash(textures[i]["name"].encode()), i))
    place = lambda i: VIRTUAL + entries + 80 * i if 0 <= i < n else 0
    for slot, i in enumerate(order):
        t, m = textures[i], meta[i]
        struct.pack_into("<I", system, hashes + 4 * slot, m.get("original_hash") or name_hash(t["name"].encode()))
        struct.pack_into("<I", system, pointers + 4 * slot, place(slot))
        f = BY_CODE[t["format"]]
        pitch = mip_bytes(t["width"], t["height"], t["format"]) // max(1, t["height"]) if f.compressed else t["stride"]
        g = m.get
        WTD_ENTRY.pack_into(
            system, entries + 80 * slot, g("vft") or 0x00D50104, g("unknown1", 0), g("unknown2", 0), g("unknown3", 0), g("unknown4", 0), g("unknown5", 0), VIRTUAL + name_at[i], g("unknown6", 0),
            t["width"], t["height"], f.wtd, pitch & 0xFFFF, g("texture_type", 0), t["mip_count"], *(g(f"unknown{k}", 0.0) for k in range(7, 13)), place(slot - 1), place(slot + 1), PHYSICAL + data_at[i], g("unknown13", 0),
        )
    struct.pack_into("<5I2HI2H", system, 0, fields.get("vft") or 0x00D6F028, 0, 0, fields.get("usage_count", 0), VIRTUAL + hashes, n, n, VIRTUAL + pointers, n, n)
    flags = rsc5_flags(len(system), len(graphics))
    return struct.pack("<3I", RSC5_MAGIC, fields.get("resource_type") or 8, flags) + zlib.compress(bytes(system) + bytes(graphics))


def _shader_dictionary(system: bytes, drawable: int) -> int:
    """The offset of a drawable's texture dictionary, or -1."""
    if drawable < 0 or drawable + 0x18 > len(system):
        return -1
    group = pointer(struct.unpack_from("<Q", system, drawable + 0x10)[0], VIRTUAL)
    if group < 0 or group + 0x10 > len(system):
        return -1
    return pointer(struct.unpack_from("<Q", system, group + 8)[0], VIRTUAL)


def model_dictionaries(system: bytes, ext: str) -> list[int]:
    """Offsets of the dictionaries of a model file: .ydr, .yft or .ydd (one for each drawable)."""
    if ext == ".ydr":
        drawables = [0]
    elif ext == ".yft":
        drawables = [pointer(struct.unpack_from("<Q", system, 0x30)[0], VIRTUAL)] if len(system) >= 0x38 else []
    else:
        if len(system) < 0x3A:
            return []
        (items,), (count,) = struct.unpack_from("<Q", system, 0x30), struct.unpack_from("<H", system, 0x38)
        at = pointer(items, VIRTUAL)
        if not 0 < count < 1024 or at < 0 or at + 8 * count > len(system):
            return []
        drawables = [pointer(p, VIRTUAL) for p in struct.unpack_from(f"<{count}Q", system, at)]
    return [d for x in drawables if (d := _shader_dictionary(system, x)) >= 0]


def read_model(raw: bytes, ext: str) -> tuple[dict, list[dict]]:
    r = read_rsc7(raw)
    textures: list[dict] = []
    for at in model_dictionaries(r.system, ext):
        try:
            textures += read_entries(r.system, r.graphics, at)
        except Rejected:
            continue
    if not textures:
        raise Rejected("no embedded textures (model has no texture dictionary)")
    return {"version": r.version, "sys_flags": r.system_flags, "gfx_flags": r.graphics_flags}, textures[:MAX_TEXTURES]


def recompose_model(raw: bytes, ext: str, edited: dict[int, dict]) -> bytes:
    """The model with some textures (by ordinal) replaced. A smaller one takes its old place unless another entry
    shares it; others are appended. The pages stay as they were unless the graphics segment grows."""
    r = read_rsc7(raw)
    _, textures = read_model(raw, ext)
    system, graphics = bytearray(r.system), bytearray(r.graphics)
    users: dict[int, int] = {}
    for t in textures:
        users[t["data_off"]] = users.get(t["data_off"], 0) + 1
    for i, new in sorted(edited.items()):
        old, e = textures[i], textures[i]["entry_off"]
        if not BY_CODE[new["format"]].dx9:
            raise ValueError("format can't be saved")
        at = old["data_off"]
        if users[at] > 1 or len(new["data"]) > old["data_size"]:
            graphics += bytes(-len(graphics) % 16)
            at = len(graphics)
            graphics += new["data"]
        else:
            graphics[at : at + old["data_size"]] = new["data"] + bytes(old["data_size"] - len(new["data"]))
        struct.pack_into("<HH", system, e + 0x50, new["width"], new["height"])
        struct.pack_into("<HI", system, e + 0x56, stride(new["width"], new["height"], new["format"]) & 0xFFFF, BY_CODE[new["format"]].dx9)
        system[e + 0x5D] = new["mip_count"]
        struct.pack_into("<Q", system, e + 0x70, PHYSICAL + at)
    gfx = r.graphics_flags if len(graphics) <= len(r.graphics) else single_page(len(graphics), r.version)
    assert page_bytes(gfx) >= len(graphics)
    return write_rsc7(r.version, r.system_flags, gfx, bytes(system), bytes(graphics))
