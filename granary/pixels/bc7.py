"""BC7 blocks: a decoder for all eight modes and an encoder in mode 6, after the public format description. Both work on
all blocks of a mode at once; decode_block() is the plain version of one block.

Modes of several subsets need the format's partition shapes (64 each for two and three subsets, with their anchor
pixels).  These tables are too large to be held here and follow no rule, so they are a parameter of all that decodes:
Partitions, which can be read from a file.  Without it, blocks of one subset (modes 4, 5 and 6, which the encoder emits) are decoded; decode_blocks() raises at others, and
decode_block() makes them opaque black, as blocks without a valid mode are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: interpolation weights by index bits, and the fields of modes 0 to 7: (subsets, partition
# bits, rotation bits, index selection bits, colour bits, alpha bits, p-bits per end, p-bits per subset, index bits,
# bits of the second indices).
WEIGHTS = {2: np.array([0, 21, 43, 64]), 3: np.array([0, 9, 18, 27, 37, 46, 55, 64]), 4: np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64])}
MODES = (
    (3, 4, 0, 0, 4, 0, 1, 0, 3, 0),
    (2, 6, 0, 0, 6, 0, 0, 1, 3, 0),
    (3, 6, 0, 0, 5, 0, 0, 0, 2, 0),
    (2, 6, 0, 0, 7, 0, 1, 0, 2, 0),
    (1, 0, 2, 1, 5, 6, 0, 0, 2, 3),
    (1, 0, 2, 0, 7, 8, 0, 0, 2, 2),
    (1, 0, 0, 0, 7, 7, 1, 0, 4, 0),
    (2, 6, 0, 0, 5, 5, 1, 0, 2, 0),
)


@dataclass(frozen=True)
class Partitions:
    """For two and three subsets: the subset of each of 16 pixels of each shape, and the anchor pixels of the second
    (and third) subset of each shape."""

    two: np.ndarray  # (64, 16)
    three: np.ndarray  # (64, 16)
    anchors_two: np.ndarray  # (64, 1)
    anchors_three: np.ndarray  # (64, 2)

    def __post_init__(self) -> None:
        for name, shape, most in (("two", (64, 16), 1), ("three", (64, 16), 2), ("anchors_two", (64, 1), 15), ("anchors_three", (64, 2), 15)):
            table = np.asarray(getattr(self, name))
            if table.shape != shape or table.min() < 0 or table.max() > most:
                raise ValueError(f"{name}: numbers from 0 to {most} in shape {shape} are wanted")

    @classmethod
    def read(cls, path: str) -> Partitions:
        """From a JSON file of four lists under the names of the fields, in a folder or store."""
        from granary.sources import stores

        held = json.loads(stores.whole(path))
        return cls(*(np.array(held[n], np.int64) for n in ("two", "three", "anchors_two", "anchors_three")))


def _expand(v: int, bits: int) -> int:
    return (v << 8 - bits | v >> 2 * bits - 8) & 255 if bits < 8 else v


def decode_block(raw: bytes, partitions: Partitions | None = None) -> np.ndarray:
    """(16, 4) in RGBA."""
    block, at = int.from_bytes(raw, "little"), 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return block >> at - n & (1 << n) - 1

    mode = (block & -block).bit_length() - 1
    out = np.zeros((16, 4), np.int64)
    out[:, 3] = 255
    if not 0 <= mode < 8 or MODES[mode][0] > 1 and partitions is None:
        return out
    subsets, part_bits, rot_bits, sel_bits, c_bits, a_bits, p_end, p_subset, n1, n2 = MODES[mode]
    take(mode + 1)
    shape, rotation, select = take(part_bits), take(rot_bits), take(sel_bits)
    ends = np.full((subsets, 2, 4), 255, np.int64)
    for ch in range(4 if a_bits else 3):
        for s in range(subsets):
            for e in range(2):
                ends[s, e, ch] = take(a_bits if ch == 3 else c_bits)
    extra = 0
    if p_end or p_subset:
        extra = 1
        for s in range(subsets):
            bits = [take(1), take(1)] if p_end else [take(1)] * 2
            for e in range(2):
                ends[s, e] = ends[s, e] << 1 | bits[e]
    for s in range(subsets):
        for e in range(2):
            for ch in range(4):
                ends[s, e, ch] = 255 if ch == 3 and not a_bits else _expand(int(ends[s, e, ch]), (a_bits if ch == 3 else c_bits) + extra)
    owner, anchors = np.zeros(16, np.int64), {0}
    if subsets > 1:
        owner = np.asarray(partitions.two if subsets == 2 else partitions.three)[shape]
        anchors |= {int(x) for x in np.asarray(partitions.anchors_two if subsets == 2 else partitions.anchors_three)[shape]}
    first = WEIGHTS[n1][[take(n1 - (i in anchors)) for i in range(16)]]
    second = WEIGHTS[n2][[take(n2 - (i == 0)) for i in range(16)]] if n2 else first
    wc, wa = (second, first) if select else (first, second)
    for ch in range(4):
        w = wa if ch == 3 else wc
        out[:, ch] = (ends[owner, 0, ch] * (64 - w) + ends[owner, 1, ch] * w + 32) >> 6
    if rotation:
        out[:, [rotation - 1, 3]] = out[:, [3, rotation - 1]]
    return out


def _bits(lo: np.ndarray, hi: np.ndarray, at: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """n bits from the place at, of blocks in two halves of 64 bits."""
    at, n = np.asarray(at, np.uint64), np.asarray(n, np.uint64)
    inside = at < 64
    low = np.where(inside, lo >> np.minimum(at, 63), np.uint64(0))
    over = np.where(inside, (hi << np.uint64(1)) << np.uint64(63) - np.minimum(at, 63), hi >> np.where(inside, np.uint64(0), at - np.uint64(64)))
    return ((low | over) & (np.uint64(1) << n) - np.uint64(1)).astype(np.int64)


def _decode_mode(lo: np.ndarray, hi: np.ndarray, mode: int, partitions: Partitions | None) -> np.ndarray:
    """(blocks, 16, 4) in RGBA of blocks of one mode: decode_block() for all of them at once."""
    subsets, part_bits, rot_bits, sel_bits, c_bits, a_bits, p_end, p_subset, n1, n2 = MODES[mode]
    at = mode + 1

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return _bits(lo, hi, at - n, n)

    count = len(lo)
    shape, rotation, select = take(part_bits), take(rot_bits), take(sel_bits)
    ends = np.full((count, subsets, 2, 4), 255, np.int64)
    for ch in range(4 if a_bits else 3):
        for s in range(subsets):
            for e in range(2):
                ends[:, s, e, ch] = take(a_bits if ch == 3 else c_bits)
    extra = int(bool(p_end or p_subset))
    if extra:
        for s in range(subsets):
            first = take(1)
            second = take(1) if p_end else first
            ends[:, s, 0] = ends[:, s, 0] << 1 | first[:, None]
            ends[:, s, 1] = ends[:, s, 1] << 1 | second[:, None]
    for ch in range(3 + bool(a_bits)):
        width = (a_bits if ch == 3 else c_bits) + extra
        if width < 8:
            v = ends[..., ch]
            ends[..., ch] = (v << 8 - width | v >> 2 * width - 8) & 255
    if not a_bits:
        ends[..., 3] = 255
    owner, anchor = np.zeros((count, 16), np.int64), np.zeros((count, 16), np.int64)
    anchor[:, 0] = 1
    if subsets > 1:
        owner = np.asarray(partitions.two if subsets == 2 else partitions.three)[shape]
        np.put_along_axis(anchor, np.asarray(partitions.anchors_two if subsets == 2 else partitions.anchors_three)[shape], 1, axis=1)

    def indices(n: int, short: np.ndarray) -> np.ndarray:
        nonlocal at
        sizes = n - short
        places = at + np.cumsum(sizes, axis=1) - sizes
        at = at + sizes.sum(axis=1, keepdims=True)
        return WEIGHTS[n][_bits(lo[:, None], hi[:, None], places, sizes)]

    first = indices(n1, anchor)
    alone = np.zeros((count, 16), np.int64)
    alone[:, 0] = 1
    second = indices(n2, alone) if n2 else first
    swap = select[:, None] > 0
    colour, alpha = np.where(swap, second, first), np.where(swap, first, second)
    rows = np.arange(count)[:, None]
    w = np.stack([colour, colour, colour, alpha], axis=2)
    out = ends[rows, owner, 0] * (64 - w) + ends[rows, owner, 1] * w + 32 >> 6
    for r in range(1, 4):
        at_r = np.flatnonzero(rotation == r)
        out[np.ix_(at_r, range(16), (r - 1, 3))] = out[np.ix_(at_r, range(16), (3, r - 1))]
    return out


def decode_blocks(b: np.ndarray, partitions: Partitions | None = None) -> np.ndarray:
    """(blocks, 16, 4) in RGBA. Blocks of several subsets without partitions are an error: made-up pixels would be kept."""
    out = np.zeros((len(b), 16, 4), np.uint8)
    out[..., 3] = 255  # what has no mode is opaque black
    lowest = b[:, 0] & -b[:, 0].astype(np.int64)
    halves = np.ascontiguousarray(b).view("<u8").reshape(-1, 2)
    if partitions is None:
        bad = sum(int((lowest == 1 << mode).sum()) for mode, fields in enumerate(MODES) if fields[0] > 1)
        if bad:
            raise ValueError(f"BC7: {bad} blocks of several subsets, whose partition tables are not held")
    for mode in range(8):
        at = np.flatnonzero(lowest == 1 << mode)
        for a in range(0, len(at), 1 << 14):
            some = at[a : a + (1 << 14)]
            out[some] = _decode_mode(halves[some, 0], halves[some, 1], mode, partitions)
    return out


def encode_blocks(px: np.ndarray) -> np.ndarray:
    """Mode 6 blocks (blocks, 16) of (blocks, 16, 4): end points on the principal axis, 16 steps between them."""
    p = px.astype(np.float64)
    mean = p.mean(axis=1, keepdims=True)
    d = p - mean
    cov = np.einsum("bij,bik->bjk", d, d)
    axis = np.ones((len(p), 4))
    for _ in range(8):
        axis = np.einsum("bjk,bk->bj", cov, axis) + 1e-9
        axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    t = np.einsum("bij,bj->bi", d, axis)
    ends = np.clip(np.stack([mean[:, 0] + t.min(axis=1, keepdims=True) * axis, mean[:, 0] + t.max(axis=1, keepdims=True) * axis], axis=1), 0, 255)
    # the p-bit that all four channels of an end share: the one of less error
    options = np.stack([(np.clip(np.round((ends - q) / 2), 0, 127) * 2 + q) for q in (0, 1)])
    best = ((options - ends) ** 2).sum(axis=-1).argmin(axis=0)
    full = np.take_along_axis(options, best[None, ..., None], axis=0)[0].astype(np.int64)
    w = WEIGHTS[4]
    palette = (full[:, :1] * (64 - w)[None, :, None] + full[:, 1:] * w[None, :, None] + 32) >> 6
    index = ((p[:, :, None] - palette[:, None]) ** 2).sum(axis=-1).argmin(axis=2)
    flip = index[:, 0] >= 8  # the first index has no highest bit
    index[flip] = 15 - index[flip]
    full[flip] = full[flip][:, ::-1]
    out, at = np.zeros((len(p), 2), np.uint64), 0
    fields = [(np.full(len(p), 1 << 6), 7)] + [(full[:, e, ch] >> 1, 7) for ch in range(4) for e in range(2)] + [(full[:, e, 0] & 1, 1) for e in range(2)] + [(index[:, i], 4 - (i == 0)) for i in range(16)]
    for value, n in fields:
        v = value.astype(np.uint64)
        if at < 64:
            out[:, 0] |= v << np.uint64(at)
            if at + n > 64:
                out[:, 1] |= v >> np.uint64(64 - at)
        else:
            out[:, 1] |= v << np.uint64(at - 64)
        at += n
    return out.astype("<u8").view(np.uint8).reshape(-1, 16)
