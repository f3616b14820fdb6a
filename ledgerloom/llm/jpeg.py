"""Progressive JPEG in numpy: a decoder for many files side by side, and a writer that stores bytes losslessly.

Decoding: every scan of every file is split at its restart markers into segments, and all segments of alike scans
advance together, one symbol (or, in refinement scans, one coefficient) a step. The scans of spectral selection and
successive approximation accumulate in one array of coefficients; these are dequantised, inverse-transformed by a
matrix product, chroma is upsampled by repetition, and the result is a full-resolution RGB tensor.

Storing: 64 bytes are the 64 quantised coefficients of a block; byte b is the coefficient b (128 and up) or b - 255, so
all have magnitude category 8 and nothing is lost. Blocks fill 4:2:0 units in order (four of luma, two of chroma). The
scans: DC of all components without the last bit, luma AC without the last bit, chroma AC, luma AC refinement, DC
refinement. The payload's length stands in a comment segment.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

RESTART = 8
BLOCKS = 6
#: Order of coefficients in a scan: index in the block by place in the zigzag.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)


def _transform() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    return np.einsum("uy,vx->uvyx", one, one).reshape(64, 64).astype(np.float32)


INVERSE = _transform()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks that carry samples
    high: int = 0
    stride: int = 0  # blocks kept, whole units
    rows: int = 0
    base: int = 0  # first block among those of all files


@dataclass
class Scan:
    parts: list[tuple[int, bytes, bytes]]  # component, DC table, AC table
    first: int
    last: int
    high: int
    low: int
    restart: int
    segments: list[bytes]


@dataclass
class File:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)

    def layout(self, base: int) -> int:
        """Places the blocks from ``base`` on; returns the end."""
        hm, vm = max(c.h for c in self.components), max(c.v for c in self.components)
        across, down = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        for c in self.components:
            c.wide, c.high = -(-(-(-self.width * c.h // hm)) // 8), -(-(-(-self.height * c.v // vm)) // 8)
            c.stride, c.rows, c.base = across * c.h, down * c.v, base
            base += c.stride * c.rows
        return base

    def order(self, members: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks in the order of a scan over components ``members``, each one's place among them, blocks a unit."""
        own = [self.components[m] for m in members]
        blocks, part, unit = _order(tuple((c.base - own[0].base, c.stride, c.rows, c.wide, c.high, c.h, c.v) for c in own))
        return blocks + own[0].base, part, unit


@lru_cache(4096)
def _order(members: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(members) == 1:
        base, stride, _, wide, high, _, _ = members[0]
        blocks = (base + np.arange(high)[:, None] * stride + np.arange(wide)).ravel()
        return blocks, np.zeros(blocks.size, np.int64), 1
    _, stride, rows, _, _, h, v = members[0]
    across, down = stride // h, rows // v
    y, x = np.arange(down)[:, None, None], np.arange(across)[None, :, None]
    parts, own = [], []
    for k, (base, stride, _, _, _, h, v) in enumerate(members):
        dy, dx = np.repeat(np.arange(v), h), np.tile(np.arange(h), v)
        parts.append(base + (y * v + dy) * stride + x * h + dx)
        own += [k] * (h * v)
    blocks = np.concatenate(parts, axis=2).ravel()
    return blocks, np.tile(np.array(own), down * across), len(own)


@lru_cache(256)
def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol by the next 16 bits; a table is its 16 counts and its symbols."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at, code = 16, 0
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            low = code << (16 - bits)
            length[low : low + (1 << (16 - bits))] = bits
            symbol[low : low + (1 << (16 - bits))] = table[at]
            at += 1
            code += 1
        code <<= 1
    return length, symbol


def parse(data: bytes) -> File:
    """Headers and entropy-coded segments of a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    following = raw[marks + 1]
    stuffed = marks[following == 0]
    real = marks[(following != 0) & (following != 0xFF)]
    restarts = (raw[real + 1] & 0xF8) == 0xD0
    others = real[~restarts]
    restarts = real[restarts]
    out, at, restart = File(), 2, 0
    tables: dict[int, bytes] = {}
    while at < len(data):
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xD9:
            break
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC2:
            depth, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3):
                raise ValueError("only 8-bit files of one or three components")
            out.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive file")
        elif kind == 0xC4:
            p = 0
            while p < len(body):
                end = p + 17 + sum(body[p + 1 : p + 17])
                tables[body[p]] = body[p + 1 : end]
                p = end
        elif kind == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                out.quantisers[body[p] & 15] = np.frombuffer(body[p + 1 : p + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                p += 1 + 64 * (1 + wide)
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            out.comments.append(body)
        elif kind == 0xDA:
            n = body[0]
            index = {c.ident: i for i, c in enumerate(out.components)}
            parts = [(index[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4, b""), tables.get(16 | body[2 + 2 * i] & 15, b"")) for i in range(n)]
            first, last, both = body[1 + 2 * n : 4 + 2 * n]
            k = int(np.searchsorted(others, at))
            end = int(others[k]) if k < others.size else len(data)
            cuts = restarts[np.searchsorted(restarts, at) : np.searchsorted(restarts, end)].tolist()
            segments = [data[a:b] for a, b in zip([at, *[c + 2 for c in cuts]], [*cuts, end], strict=True)]
            if np.searchsorted(stuffed, at) < np.searchsorted(stuffed, end):
                segments = [x.replace(b"\xff\x00", b"\xff") for x in segments]
            out.scans.append(Scan(parts, first, last, both >> 4, both & 15, restart, segments))
            at = end
    return out


class _Bits:
    """Segments side by side; ``at`` holds each one's place in bits."""

    def __init__(self, segments: list[bytes]):
        sizes = np.array([len(x) for x in segments], np.int64)
        data = np.frombuffer(b"".join(segments) + bytes(8), np.uint8).astype(np.int64)
        self.words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.most = (self.words.size - 1) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.most)
        return (self.words[at >> 3] >> (16 - (at & 7))) & 0xFFFF


def _magnitude(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(raw >> np.maximum(size - 1, 0), raw, raw - (1 << size) + 1)


def _dc_first(bits: _Bits, order, part, begin, end, tables, low, coefficients) -> None:
    length, symbol = (np.stack(x) for x in zip(*(_codes(t) for t in tables), strict=True))
    live, at, now = np.arange(begin.size), bits.at.copy(), begin.copy()
    before = np.zeros((begin.size, len(tables)), np.int64)
    while live.size:
        c, p = part[now], at
        code = bits.peek(p)
        p = p + length[c, code]
        size = symbol[c, code]
        value = _magnitude(bits.peek(p) >> (16 - size), size)
        before[live, c] += np.where(size > 0, value, 0)
        coefficients[order[now] * 64] = before[live, c] << low
        at, now = p + size, now + 1
        if (more := now < end).all():
            continue
        live, at, now, end = live[more], at[more], now[more], end[more]


def _ac_first(bits: _Bits, order, begin, end, table, first, last, low, coefficients) -> None:
    length, symbol = _codes(table)
    at, now, k = bits.at.copy(), begin.copy(), np.full(begin.size, first)
    while now.size:
        code = bits.peek(at)
        at = at + length[code]
        both = symbol[code]
        size, run = both & 15, both >> 4
        plain = size > 0
        extra = np.where(plain, size, np.where(run < 15, run, 0))
        raw = bits.peek(at) >> (16 - extra)
        at = at + extra
        if plain.all():
            k = k + run
            coefficients[order[now] * 64 + ZIGZAG[k]] = _magnitude(raw, size) << low
            k = k + 1
        else:
            over = ~plain & (run < 15)
            k = k + np.where(over, 0, run)
            own = np.flatnonzero(plain)
            coefficients[order[now[own]] * 64 + ZIGZAG[k[own]]] = _magnitude(raw[own], size[own]) << low
            k = np.where(over, first, k + 1)
            now = now + np.where(over, (1 << run) + raw, 0)
        turn = k > last
        now = now + turn
        k = np.where(turn, first, k)
        if (more := now < end).all():
            continue
        at, now, k, end = at[more], now[more], k[more], end[more]


def _ac_refine(bits: _Bits, order, begin, end, table, first, last, low, coefficients) -> None:
    length, symbol = _codes(table)
    n = begin.size
    at, now, k = bits.at.copy(), begin.copy(), np.full(n, first)
    run, value, over, wants = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    while now.size:
        if (own := np.flatnonzero(wants & (over == 0))).size:
            p = at[own]
            code = bits.peek(p)
            p = p + length[code]
            size, r = symbol[code] & 15, symbol[code] >> 4
            ends = (size == 0) & (r < 15)
            extra = np.where(ends, r, size)
            raw = bits.peek(p) >> (16 - extra)
            over[own] = np.where(ends, (1 << r) + raw, 0)
            run[own], wants[own], at[own] = r, ends, p + extra
            value[own] = np.where(size > 0, np.where(raw > 0, 1, -1) << low, 0)
        place = order[now] * 64 + ZIGZAG[k]
        held = coefficients[place]
        known = held != 0
        bit = (bits.peek(at) >> 15) & known
        at = at + known
        change = np.where(bit & ~(np.abs(held) >> low) & 1, np.sign(held) << low, 0)
        free = ~known & (over == 0)
        here = free & (run == 0)
        coefficients[place] = held + change + np.where(here, value, 0)
        wants |= here
        run = run - (free & ~here)
        k = k + 1
        turn = k > last
        now, k, over = now + turn, np.where(turn, first, k), over - (turn & (over > 0))
        wants |= turn
        if (more := now < end).all():
            continue
        at, now, k, end, run, value, over, wants = (x[more] for x in (at, now, k, end, run, value, over, wants))


def coefficients_of(files: list[File]) -> np.ndarray:
    """The coefficients of all files, 64 a block in natural order, all scans accumulated."""
    total = 0
    for f in files:
        total = f.layout(total)
    out = np.zeros(total * 64, np.int64)
    for step in range(max((len(f.scans) for f in files), default=0)):
        alike: dict[tuple, list[File]] = {}
        for f in files:
            if step < len(f.scans):
                s = f.scans[step]
                alike.setdefault((tuple(s.parts), s.first, s.last, s.high, s.low), []).append(f)
        for (parts, first, last, high, low), own in alike.items():
            orders, places, begin, end, segments = [], [], [], [], []
            base = 0
            for f in own:
                s = f.scans[step]
                order, place, unit = f.order([p[0] for p in parts])
                stride = s.restart * unit if s.restart else order.size
                starts = np.arange(0, order.size, max(1, stride))
                if starts.size != len(s.segments):
                    raise ValueError("restart markers do not fit the picture")
                begin.append(base + starts)
                end.append(base + np.minimum(starts + stride, order.size))
                orders.append(order)
                places.append(place)
                segments += s.segments
                base += order.size
            order, place, begin, end, bits = np.concatenate(orders), np.concatenate(places), np.concatenate(begin), np.concatenate(end), _Bits(segments)
            if first == 0 and high:
                at = np.repeat(bits.at, end - begin) + np.arange(order.size) - np.repeat(begin, end - begin)
                out[order * 64] |= (bits.peek(at) >> 15) << low
            elif first == 0:
                _dc_first(bits, order, place, begin, end, [p[1] for p in parts], low, out)
            elif high:
                _ac_refine(bits, order, begin, end, parts[0][2], first, last, low, out)
            else:
                _ac_first(bits, order, begin, end, parts[0][2], first, last, low, out)
    return out.reshape(-1, 64)


def samples(files: list[File], coefficients: np.ndarray) -> np.ndarray:
    """Inverse transform of all blocks [block, 8, 8], before the level shift."""
    scaled = coefficients.astype(np.float32)
    for f in files:
        for c in f.components:
            if (table := f.quantisers[c.table]).max() > 1:
                scaled[c.base : c.base + c.stride * c.rows, ZIGZAG] *= table.astype(np.float32)
    return (scaled @ INVERSE).reshape(-1, 8, 8)


def pictures(files: list[File], coefficients: np.ndarray) -> list[np.ndarray]:
    """RGB tensors [height, width, 3] of 8 bits."""
    out, blocks = [], samples(files, coefficients)
    for f in files:
        planes = []
        hm, vm = max(c.h for c in f.components), max(c.v for c in f.components)
        for c in f.components:
            plane = blocks[c.base : c.base + c.stride * c.rows].reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
            if (c.h, c.v) != (hm, vm):
                y = np.arange(f.height) * c.v // vm
                x = np.arange(f.width) * c.h // hm
                plane = plane.take(y, axis=0).take(x, axis=1)
            planes.append(plane[: f.height, : f.width])
        rgb = np.empty((f.height, f.width, 3), np.uint8)
        luma = planes[0] + np.float32(128.5)  # cut to whole numbers below, so this rounds
        if len(planes) == 1:
            rgb[...] = np.clip(luma, 0, 255)[..., None]
        else:
            blue, red = planes[1:]
            rgb[..., 0] = np.clip(luma + np.float32(1.402) * red, 0, 255)
            rgb[..., 1] = np.clip(luma - np.float32(0.344136) * blue - np.float32(0.714136) * red, 0, 255)
            rgb[..., 2] = np.clip(luma + np.float32(1.772) * blue, 0, 255)
        out.append(rgb)
    return out


# Storing bytes ------------------------------------------------------------------------------------------------------


def _table(kind: int, counts: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(counts.get(n, [])) for n in range(1, 17)) + bytes(x for n in range(1, 17) for x in counts.get(n, []))


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_TABLES = _marker(0xC4, _table(0x00, {4: list(range(12))}) + _table(0x10, {1: [0x07]}) + _table(0x11, {1: [0x08]}) + _table(0x12, {3: [0x00, 0x10, 0x20, 0x30]}))
_HEAD = b"\xff\xd8" + _marker(0xDB, b"\x00" + bytes([1] * 64)) + _TABLES + _marker(0xDD, struct.pack(">H", RESTART))


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _marker(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([first, last, high << 4 | low]))


_SCANS = [
    _scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _scan([(1, 0)], 1, 63, 0, 1), _scan([(2, 1)], 1, 63, 0, 0), _scan([(3, 1)], 1, 63, 0, 0), _scan([(1, 2)], 1, 63, 1, 0), _scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0),
]


def frame_of(blocks: int) -> File:
    """A 4:2:0 picture with room for so many blocks."""
    units = max(1, -(-blocks // BLOCKS))
    across = min(units, max(64, -(-units // 4095)))
    if across > 4095:
        raise ValueError("payload too long for one picture")
    return File(16 * across, 16 * -(-units // across), [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)])


def _packed(value: np.ndarray, width: np.ndarray, owner: np.ndarray, count: int) -> list[bytes]:
    """Values of given widths (bits), by segment, each filled up with ones to whole bytes."""
    total = np.bincount(owner, width, count).astype(np.int64)
    size = -(-total // 8)
    start = (np.cumsum(size) - size) * 8
    bits = np.ones(int(size.sum()) * 8, np.uint8)
    before = np.cumsum(width) - width
    shift = start - (np.cumsum(total) - total)
    each = np.repeat(np.arange(value.size), width)
    inner = np.arange(each.size) - before[each]
    bits[before[each] + inner + shift[owner[each]]] = (value[each] >> (width[each] - 1 - inner)) & 1
    return _cut(bits, start // 8, size)


def _cut(bits: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    data = np.packbits(bits).tobytes()
    return [data[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def _rows(bits: np.ndarray, owner: np.ndarray, count: int, head: np.ndarray | None = None) -> list[bytes]:
    """Rows of bits, by segment; ``head`` are bits [segment, n] before a segment's first row, -1 for none."""
    width = bits.shape[1]
    lead = np.zeros(count, np.int64) if head is None else (head >= 0).sum(axis=1)
    total = np.bincount(owner, minlength=count) * width + lead
    size = -(-total // 8)
    start = (np.cumsum(size) - size) * 8
    out = np.ones(int(size.sum()) * 8, np.uint8)
    if head is not None:
        row, column = np.nonzero(head >= 0)
        out[start[row] + column] = head[row, column]
    nth = np.arange(owner.size) - np.searchsorted(owner, np.arange(count))[owner]
    out[((start + lead)[owner] + nth * width)[:, None] + np.arange(width)] = bits
    return _cut(out, start // 8, size)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as a file."""
    frames = [frame_of(len(x) // 64) for x in payloads]
    total = 0
    for f in frames:
        total = f.layout(total)
    orders = [f.order([0, 1, 2]) for f in frames]
    byte = np.zeros((total, 64), np.uint8)
    for x, (order, _, _) in zip(payloads, orders, strict=True):
        byte[order[: len(x) // 64]] = np.frombuffer(x, np.uint8).reshape(-1, 64)

    def segments(members: list[int], unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks, their components, their segments, segments by file."""
        own = orders if len(members) > 1 else [f.order(members) for f in frames]
        counts = np.array([-(-o[0].size // (RESTART * unit)) for o in own])
        base = np.cumsum(counts) - counts
        owner = np.concatenate([b + np.arange(o[0].size) // (RESTART * unit) for b, o in zip(base.tolist(), own, strict=True)])
        return np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]), owner, counts

    made: list[tuple[list[bytes], np.ndarray]] = []
    blocks, part, owner, counts = segments([0, 1, 2], BLOCKS)
    first = byte[blocks, 0].astype(np.int64)
    value = np.where(first < 128, first - 255, first)
    difference = value >> 1
    for c in range(3):
        own = np.flatnonzero(part == c)
        v = value[own] >> 1
        same = np.append(False, owner[own][1:] == owner[own][:-1])
        difference[own] = v - np.where(same, np.append(0, v[:-1]), 0)
    size = np.ceil(np.log2(np.abs(difference) + 1)).astype(np.int64)
    made.append((_packed((size << size) | np.where(difference < 0, difference + (1 << size) - 1, difference), size + 4, owner, int(counts.sum())), counts))
    dc_last = (_rows((value & 1).astype(np.uint8)[:, None], owner, int(counts.sum())), counts)
    blocks, _, owner, counts = segments([0], 1)
    luma = byte[blocks][:, ZIGZAG[1:]]
    sizes = np.bincount(owner, minlength=int(counts.sum()))
    data = (luma >> 1).tobytes()  # code 0 and seven bits: a byte each
    ends = (np.cumsum(sizes) * 63).tolist()
    made.append(([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], counts))
    for c in (1, 2):
        blocks_c, _, owner_c, counts_c = segments([c], 1)
        chroma = byte[blocks_c][:, ZIGZAG[1:]]
        bits = np.zeros((*chroma.shape, 9), np.uint8)
        bits[..., 1:] = np.unpackbits(chroma[..., None], axis=2)
        made.append((_rows(bits.reshape(chroma.shape[0], -1), owner_c, int(counts_c.sum())), counts_c))
    run = np.log2(sizes).astype(np.int64)
    rest = sizes - (1 << run)
    head = np.full((sizes.size, 6), -1, np.int64)  # symbol: 3 bits, then as many as the run says
    for i in range(3):
        head[:, i] = (run >> (2 - i)) & 1
        has = run > i
        head[has, 3 + i] = (rest[has] >> (run[has] - 1 - i)) & 1
    made.append((_rows((luma ^ (luma < 128)) & 1, owner, sizes.size, head), counts))
    made.append(dc_last)

    marks = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    files = [[_HEAD, _marker(0xFE, struct.pack(">Q", len(x))), _marker(0xC2, struct.pack(">BHHB", 8, f.height, f.width, 3) + b"".join(bytes([c.ident, c.h << 4 | c.v, 0]) for c in f.components))] for x, f in zip(payloads, frames, strict=True)]
    for head, (parts, counts) in zip(_SCANS, made, strict=True):
        at = 0
        for own, n in zip(files, counts.tolist(), strict=True):
            own.append(head)
            for i, x in enumerate(parts[at : at + n]):
                if i:
                    own.append(marks[(i - 1) % 8])
                own.append(x.replace(b"\xff", b"\xff\x00"))
            at += n
    return [b"".join([*own, b"\xff\xd9"]) for own in files]


def load(media: list[bytes]) -> tuple[list[File], np.ndarray, list[bytes]]:
    """Parsed files, their coefficients, and the payloads that ``store`` put in."""
    files = [parse(x) for x in media]
    coefficients = coefficients_of(files)
    payloads = []
    for f in files:
        length = struct.unpack(">Q", f.comments[0])[0]
        own = coefficients[f.order([0, 1, 2])[0][: length // 64]]
        payloads.append(np.where(own < 0, own + 255, own).astype(np.uint8).tobytes())
    return files, coefficients, payloads
