"""Pixels: decoding to and encoding from BGRA, whole images at a time in NumPy, and level chains.

Images are (height, width, 4) arrays of bytes in blue, green, red, alpha order.
"""

from __future__ import annotations

import numpy as np

from granary.functions.formats import BY_CODE, BY_KEY, chain, mip_bytes
from granary.pixels import bc7

BC1, BC2, BC3, BC4, BC5, BC7 = (BY_KEY[k] for k in ("BC1", "BC2", "BC3", "BC4", "BC5", "BC7"))


def level(data: bytes, w: int, h: int, fmt: int, index: int) -> tuple[bytes, int, int]:
    """The bytes and size of one level of a payload."""
    sizes = chain(w, h, index + 1)
    at = sum(mip_bytes(a, b, fmt) for a, b in sizes[:-1])
    a, b = sizes[-1]
    n = mip_bytes(a, b, fmt)
    if at + n > len(data):
        raise ValueError("the payload ends before the level")
    return data[at : at + n], a, b


def decode(data: bytes, w: int, h: int, fmt: int, index: int = 0, partitions: bc7.Partitions | None = None) -> np.ndarray:
    """A level as BGRA. partitions: the format's tables for BC7 blocks of several subsets, which fail without them."""
    raw, w, h = level(data, w, h, fmt, index)
    f = BY_CODE[fmt]
    if f.compressed:
        return _from_blocks(_decode_blocks(np.frombuffer(raw, np.uint8).reshape(-1, f.block_bytes), fmt, partitions), w, h)
    out = np.empty((h, w, 4), np.uint8)
    if f.pixel_bytes == 4:
        px = np.frombuffer(raw, np.uint8).reshape(h, w, 4)
        out[:] = px if f.key == "A8R8G8B8" else px[..., [2, 1, 0, 3]]
    elif f.pixel_bytes == 1:
        v = np.frombuffer(raw, np.uint8).reshape(h, w)
        out[:] = v[..., None]
        if f.key == "R8":
            out[..., 3] = 255
    else:
        v = np.frombuffer(raw, "<u2").reshape(h, w).astype(np.uint32)
        fields = ((0, 5), (5, 6), (11, 5)) if f.key == "B5G6R5" else ((0, 5), (5, 5), (10, 5))
        for k, (shift, bits) in enumerate(fields):
            most = (1 << bits) - 1
            out[..., k] = (v >> shift & most) * 255 // most
        out[..., 3] = 255 if f.key == "B5G6R5" else np.where(v >> 15, 255, 0)
    return out


def _from_blocks(blocks: np.ndarray, w: int, h: int) -> np.ndarray:
    """(blocks, 16, 4) in RGBA as an image in BGRA."""
    bw, bh = -(-w // 4), -(-h // 4)
    out = blocks.reshape(bh, bw, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)
    return np.ascontiguousarray(out[:h, :w, [2, 1, 0, 3]])


def _to_blocks(image: np.ndarray) -> np.ndarray:
    """An image in BGRA as (blocks, 16, 4) in RGBA; edges are repeated."""
    h, w = image.shape[:2]
    padded = np.pad(image, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")[..., [2, 1, 0, 3]]
    bh, bw = padded.shape[0] // 4, padded.shape[1] // 4
    return padded.reshape(bh, 4, bw, 4, 4).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 4)


def _565(v: np.ndarray) -> np.ndarray:
    """Colours of 16 bits as (..., 3) of 8 bits."""
    r, g, b = v >> 11 & 31, v >> 5 & 63, v & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=-1).astype(np.int32)


def _colours(block: np.ndarray, punch: bool) -> np.ndarray:
    """The colour half of a block, as (blocks, 16, 4); punch: whether three-colour blocks may be transparent."""
    ends = block[:, :4].copy().view("<u2").astype(np.uint32)
    c = _565(ends)
    four = ends[:, 0] > ends[:, 1] if punch else np.ones(len(block), bool)
    palette = np.zeros((len(block), 4, 4), np.int32)
    palette[..., 3] = 255
    palette[:, 0, :3], palette[:, 1, :3] = c[:, 0], c[:, 1]
    palette[:, 2, :3] = np.where(four[:, None], (2 * c[:, 0] + c[:, 1]) // 3, (c[:, 0] + c[:, 1]) // 2)
    palette[:, 3, :3] = np.where(four[:, None], (c[:, 0] + 2 * c[:, 1]) // 3, 0)
    palette[~four, 3, 3] = 0
    bits = block[:, 4:8].copy().view("<u4")[:, 0]
    index = bits[:, None] >> (2 * np.arange(16, dtype=np.uint32)) & 3
    return np.take_along_axis(palette, index[..., None].astype(np.int64), axis=1)


def _ramp(block: np.ndarray) -> np.ndarray:
    """An interpolated channel of 8 bytes, as (blocks, 16)."""
    a, b = block[:, 0].astype(np.int32), block[:, 1].astype(np.int32)
    eight = a > b
    palette = np.empty((len(block), 8), np.int32)
    palette[:, 0], palette[:, 1] = a, b
    for i in range(2, 8):
        palette[:, i] = np.where(eight, ((8 - i) * a + (i - 1) * b) // 7, ((6 - i) * a + (i - 1) * b) // 5 if i < 6 else 0 if i == 6 else 255)
    bits = np.zeros(len(block), np.uint64)
    for k in range(6):
        bits |= block[:, 2 + k].astype(np.uint64) << np.uint64(8 * k)
    index = bits[:, None] >> (np.uint64(3) * np.arange(16, dtype=np.uint64)) & np.uint64(7)
    return np.take_along_axis(palette, index.astype(np.int64), axis=1)


def _decode_blocks(b: np.ndarray, fmt: int, partitions: bc7.Partitions | None = None) -> np.ndarray:
    if fmt == BC1:
        return _colours(b, True).astype(np.uint8)
    if fmt == BC7:
        return bc7.decode_blocks(b, partitions)
    out = np.full((len(b), 16, 4), 255, np.int32)
    if fmt in (BC2, BC3):
        out = _colours(b[:, 8:], False)
        if fmt == BC2:
            nibbles = np.stack([b[:, :8] & 15, b[:, :8] >> 4], axis=-1).reshape(len(b), 16).astype(np.int32)
            out[..., 3] = nibbles * 17
        else:
            out[..., 3] = _ramp(b[:, :8])
    elif fmt == BC4:
        out[..., :3] = _ramp(b)[..., None]
    else:
        out[..., 0], out[..., 1] = _ramp(b[:, :8]), _ramp(b[:, 8:])
    return out.astype(np.uint8)


def _encode_colours(px: np.ndarray, transparent: np.ndarray | None = None) -> np.ndarray:
    """Colour halves (blocks, 8) of (blocks, 16, 3): end points on the principal axis, nearest palette entry."""
    p = px.astype(np.float64)
    mean = p.mean(axis=1, keepdims=True)
    d = p - mean
    cov = np.einsum("bij,bik->bjk", d, d)
    axis = np.ones((len(p), 3))
    for _ in range(8):  # power iteration
        axis = np.einsum("bjk,bk->bj", cov, axis) + 1e-9
        axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    t = np.einsum("bij,bj->bi", d, axis)
    lo, hi = t.min(axis=1, keepdims=True), t.max(axis=1, keepdims=True)
    ends = np.clip(np.stack([mean[:, 0] + hi * axis, mean[:, 0] + lo * axis], axis=1), 0, 255)
    q = np.round(ends * np.array([31, 63, 31]) / 255).astype(np.uint32)
    code = q[..., 0] << 11 | q[..., 1] << 5 | q[..., 2]
    three = np.zeros(len(p), bool) if transparent is None else transparent.any(axis=1)
    swap = np.where(three, code[:, 0] > code[:, 1], code[:, 0] < code[:, 1])
    code[swap] = code[swap][:, ::-1]
    same = ~three & (code[:, 0] == code[:, 1])
    c = _565(code).astype(np.float64)
    mid = np.where(three[:, None], (c[:, 0] + c[:, 1]) / 2, (2 * c[:, 0] + c[:, 1]) / 3)
    far = np.where(three[:, None], 1e9, (c[:, 0] + 2 * c[:, 1]) / 3)
    palette = np.stack([c[:, 0], c[:, 1], mid, far], axis=1)
    index = ((p[:, :, None] - palette[:, None]) ** 2).sum(axis=-1).argmin(axis=2).astype(np.uint32)
    index[same] = 0
    if transparent is not None:
        index[transparent] = 3
    bits = (index << (2 * np.arange(16, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
    out = np.empty((len(p), 8), np.uint8)
    out[:, :4] = code.astype("<u2").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = bits.astype("<u4")[:, None].view(np.uint8).reshape(-1, 4)
    return out


def _encode_ramp(v: np.ndarray) -> np.ndarray:
    """Interpolated channels (blocks, 8) of (blocks, 16)."""
    a, b = v.max(axis=1).astype(np.int32), v.min(axis=1).astype(np.int32)
    i = np.arange(2, 8)
    palette = np.concatenate([a[:, None], b[:, None], ((8 - i) * a[:, None] + (i - 1) * b[:, None]) // 7], axis=1)
    index = np.abs(v[:, :, None].astype(np.int32) - palette[:, None]).argmin(axis=2)
    index[a == b] = 0
    bits = (index.astype(np.uint64) << (np.uint64(3) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    out = np.empty((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = a, b
    for k in range(6):
        out[:, 2 + k] = bits >> np.uint64(8 * k) & np.uint64(255)
    return out


def encode(image: np.ndarray, fmt: int) -> bytes:
    """One level of an image in BGRA."""
    f = BY_CODE[fmt]
    if not f.compressed:
        return _encode_plain(image, f.key)
    px = _to_blocks(image)
    if fmt == BC7:
        return bc7.encode_blocks(px).tobytes()
    if fmt == BC1:
        clear = px[..., 3] < 128
        return _encode_colours(px[..., :3], clear).tobytes()
    if fmt == BC2:
        a = (px[..., 3].astype(np.uint32) * 15 + 127) // 255
        return np.concatenate([(a[:, ::2] | a[:, 1::2] << 4).astype(np.uint8), _encode_colours(px[..., :3])], axis=1).tobytes()
    if fmt == BC3:
        return np.concatenate([_encode_ramp(px[..., 3]), _encode_colours(px[..., :3])], axis=1).tobytes()
    if fmt == BC4:
        return _encode_ramp(px[..., 0]).tobytes()
    return np.concatenate([_encode_ramp(px[..., 0]), _encode_ramp(px[..., 1])], axis=1).tobytes()


def _encode_plain(image: np.ndarray, key: str) -> bytes:
    if key == "A8R8G8B8":
        return image.tobytes()
    if key == "R8G8B8A8":
        return image[..., [2, 1, 0, 3]].tobytes()
    if key in ("A8", "R8"):
        return image[..., 3 if key == "A8" else 2].tobytes()
    b, g, r, a = (image[..., k].astype(np.uint32) for k in range(4))
    if key == "B5G6R5":
        v = r * 31 // 255 << 11 | g * 63 // 255 << 5 | b * 31 // 255
    else:
        v = (a >= 128).astype(np.uint32) << 15 | r * 31 // 255 << 10 | g * 31 // 255 << 5 | b * 31 // 255
    return v.astype("<u2").tobytes()


def alpha_in_use(data: bytes | None, w: int, h: int, fmt: int, partitions: bc7.Partitions | None = None) -> bool:
    """Whether level 0 has an alpha below 250; unreadable payloads count as using it."""
    if fmt in BY_CODE and not BY_CODE[fmt].has_alpha:
        return False
    try:
        return bool((decode(data, w, h, fmt, 0, partitions)[..., 3] < 250).any())
    except (ValueError, KeyError, TypeError):
        return True


_TO_LINEAR = np.where(np.arange(256) / 255 <= 0.04045, np.arange(256) / 255 / 12.92, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4)


def _weights(n: int, m: int) -> np.ndarray:
    """(m, n) rows of Mitchell weights that resample n samples to m."""
    scale = max(1.0, n / m)
    x = np.abs(((np.arange(m) + 0.5) * n / m)[:, None] - (np.arange(n) + 0.5)[None]) / scale
    w = np.where(x < 1, (7 * x**3 - 12 * x**2 + 16 / 3) / 6, np.where(x < 2, (-7 / 3 * x**3 + 12 * x**2 - 20 * x + 32 / 3) / 6, 0))
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """The image at another size: Mitchell filter in linear light, weighted by alpha."""
    if image.shape[:2] == (h, w):
        return image
    alpha = image[..., 3:4] / 255.0
    linear = np.concatenate([_TO_LINEAR[image[..., :3]] * alpha, alpha], axis=2)
    out = np.einsum("ij,jkc->ikc", _weights(image.shape[0], h), linear)
    out = np.einsum("ij,kjc->kic", _weights(image.shape[1], w), out)
    a = np.clip(out[..., 3:4], 0, 1)
    c = np.clip(np.where(a > 1e-6, out[..., :3] / np.maximum(a, 1e-6), 0), 0, 1)
    s = np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)
    return np.round(np.concatenate([s, a], axis=2) * 255).astype(np.uint8)


def with_levels(image: np.ndarray, fmt: int, most: int) -> tuple[bytes, int]:
    """(payload, levels): every level is resampled from level 0, down to 1 by 1 or most levels."""
    h, w = image.shape[:2]
    n = max(1, min(most, max(w, h).bit_length()))
    return b"".join(encode(resized(image, a, b), fmt) for a, b in chain(w, h, n)), n
