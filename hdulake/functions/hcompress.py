"""HCOMPRESS_1: the H-transform of a tile, its bit planes as quadtrees, and both ways back.

The transform and the quadtrees' levels are NumPy operations over whole planes; only the prefix codes of
the quadtrees are read and written one after the other.
"""

from __future__ import annotations

import struct

import numpy as np

from hdulake.errors import HduError

#: Fixed by the format: the first two bytes, and the prefix code of each 4-bit value as text.
MAGIC = b"\xdd\x99"
CODES = ["111110", "000", "001", "1000", "010", "1001", "11010", "11011", "011", "11100", "1010", "11101", "1011", "11110", "111111", "1100"]

_LOOK = [next((v, len(c)) for v, c in enumerate(CODES) if format(k, "06b").startswith(c)) for k in range(64)]


def _levels(nx: int, ny: int) -> int:
    return max(max(nx, ny) - 1, 0).bit_length()


def _sizes(n: int, levels: int) -> list[int]:
    """The extent that each level works on, the largest first."""
    out = [n]
    for _ in range(levels - 1):
        out.append((out[-1] + 1) // 2)
    return out[:levels]


def _evens_first(a: np.ndarray) -> np.ndarray:
    a = np.concatenate([a[0::2], a[1::2]])
    return np.concatenate([a[:, 0::2], a[:, 1::2]], axis=1)


def _interleaved(a: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    rows, columns = (a.shape[0] + 1) // 2, (a.shape[1] + 1) // 2
    out[0::2, 0::2], out[0::2, 1::2] = a[:rows, :columns], a[:rows, columns:]
    out[1::2, 0::2], out[1::2, 1::2] = a[rows:, :columns], a[rows:, columns:]
    return out


def _round(v: np.ndarray, positive: int, negative: int, mask: int) -> np.ndarray:
    return (v + np.where(v >= 0, positive, negative)) & mask


def transform(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    levels = _levels(*a.shape)
    for k, (nx, ny) in enumerate(zip(_sizes(a.shape[0], levels), _sizes(a.shape[1], levels), strict=True)):
        shift, one, two = min(k, 1), 1 << k, 2 << k
        part, ex, ey = a[:nx, :ny].copy(), nx // 2 * 2, ny // 2 * 2
        small = lambda v, one=one, two=two: _round(v, one, 0, -two)
        large = lambda v, two=two: _round(v, two, two - 1, -2 * two)
        p, q, r, s = part[0:ex:2, 0:ey:2], part[0:ex:2, 1:ey:2], part[1:ex:2, 0:ey:2], part[1:ex:2, 1:ey:2]
        h0, hx, hy, hc = (s + r + q + p) >> shift, (s + r - q - p) >> shift, (s - r + q - p) >> shift, (s - r - q + p) >> shift
        new = part.copy()
        new[0:ex:2, 0:ey:2], new[0:ex:2, 1:ey:2], new[1:ex:2, 0:ey:2], new[1:ex:2, 1:ey:2] = large(h0), small(hy), small(hx), hc
        if ny % 2:
            p, r = part[0:ex:2, -1], part[1:ex:2, -1]
            new[0:ex:2, -1], new[1:ex:2, -1] = large((r + p) << 1 - shift), small((r - p) << 1 - shift)
        if nx % 2:
            p, q = part[-1, 0:ey:2], part[-1, 1:ey:2]
            new[-1, 0:ey:2], new[-1, 1:ey:2] = large((q + p) << 1 - shift), small((q - p) << 1 - shift)
            if ny % 2:
                new[-1, -1] = large(part[-1:, -1] << 2 - shift)[0]
        a[:nx, :ny] = _evens_first(new)
    return a


def _smooth(a: np.ndarray, scale: int) -> None:
    """Move the differences of a level towards those of a smooth surface, by no more than digitizing may have."""
    most = scale >> 1
    if most <= 0:
        return
    nx, ny = a.shape

    def moved(diff, low, high, now, bits):
        diff = np.where(low < high, np.clip(diff, low, high), diff)
        s = diff - (now << bits)
        s = np.where(s >= 0, s >> bits, (s + (1 << bits) - 1) >> bits)
        return now + np.clip(s, -most, most)

    def first(h0, hm, hp, now):
        up, down = hp - h0, h0 - hm
        return moved(hp - hm, np.minimum(np.maximum(up, down), 0) << 2, np.maximum(np.minimum(up, down), 0) << 2, now, 3)

    i, j = np.arange(2, nx - 2, 2), np.arange(0, ny, 2)
    if len(i):
        a[np.ix_(i + 1, j)] = first(a[np.ix_(i, j)], a[np.ix_(i - 2, j)], a[np.ix_(i + 2, j)], a[np.ix_(i + 1, j)])
    k, m = np.arange(0, nx, 2), np.arange(2, ny - 2, 2)
    if len(m):
        a[np.ix_(k, m + 1)] = first(a[np.ix_(k, m)], a[np.ix_(k, m - 2)], a[np.ix_(k, m + 2)], a[np.ix_(k, m + 1)])
    if len(i) and len(m):
        h0, mm, pm, mp, pp = (a[np.ix_(i + x, m + y)] for x, y in ((0, 0), (-2, -2), (2, -2), (-2, 2), (2, 2)))
        hx, hy = a[np.ix_(i + 1, m)] << 1, a[np.ix_(i, m + 1)] << 1

        def bound(outer, inner):
            sides = (outer(pp - h0, 0) - hx - hy, outer(h0 - pm, 0) + hx - hy, outer(h0 - mp, 0) - hx + hy, outer(mm - h0, 0) + hx + hy)
            return inner(inner(sides[0], sides[1]), inner(sides[2], sides[3])) << 4

        a[np.ix_(i + 1, m + 1)] = moved(pp + mm - mp - pm, bound(np.minimum, np.maximum), bound(np.maximum, np.minimum), a[np.ix_(i + 1, m + 1)], 6)


def inverse(a: np.ndarray, smooth: bool = False, scale: int = 0) -> np.ndarray:
    a = a.astype(np.int64)
    levels = _levels(*a.shape)
    if not levels:
        return a
    top = 1 << levels - 1
    a[0, 0] = _round(a[:1, 0], 2 * top, 2 * top - 1, -4 * top)[0]
    for k, (nx, ny) in reversed(list(enumerate(zip(_sizes(a.shape[0], levels), _sizes(a.shape[1], levels), strict=True)))):
        bit0, bit1, shift = 1 << k, 2 << k, 1 if k else 2
        low0 = (bit0 >> 1) - 1 if k else 0
        part = _interleaved(a[:nx, :ny])
        if smooth:
            _smooth(part, scale)
        ex, ey = nx // 2 * 2, ny // 2 * 2
        mid = lambda v, bit0=bit0, bit1=bit1: _round(v, bit0, bit0 - 1, -bit1)
        new = part.copy()
        h0, hy, hx, hc = part[0:ex:2, 0:ey:2], mid(part[0:ex:2, 1:ey:2]), mid(part[1:ex:2, 0:ey:2]), _round(part[1:ex:2, 1:ey:2], bit0 >> 1, low0, -bit0)
        odd0 = hc & bit0
        hx, hy = np.where(hx >= 0, hx - odd0, hx + odd0), np.where(hy >= 0, hy - odd0, hy + odd0)
        odd1 = (hc ^ hx ^ hy) & bit1
        h0 = np.where(h0 >= 0, h0 + odd0 - odd1, h0 + np.where(odd0 == 0, odd1, odd0 - odd1))
        new[1:ex:2, 1:ey:2], new[1:ex:2, 0:ey:2] = (h0 + hx + hy + hc) >> shift, (h0 + hx - hy - hc) >> shift
        new[0:ex:2, 1:ey:2], new[0:ex:2, 0:ey:2] = (h0 - hx + hy - hc) >> shift, (h0 - hx - hy + hc) >> shift
        edge = lambda h, d, bit1=bit1: np.where(h >= 0, h - (d & bit1), h + (d & bit1))
        if ny % 2:
            hx = mid(part[1:ex:2, -1])
            h0 = edge(part[0:ex:2, -1], hx)
            new[1:ex:2, -1], new[0:ex:2, -1] = (h0 + hx) >> shift, (h0 - hx) >> shift
        if nx % 2:
            hy = mid(part[-1, 1:ey:2])
            h0 = edge(part[-1, 0:ey:2], hy)
            new[-1, 1:ey:2], new[-1, 0:ey:2] = (h0 + hy) >> shift, (h0 - hy) >> shift
            if ny % 2:
                new[-1, -1] = part[-1, -1] >> shift
        a[:nx, :ny] = new
    return a


def _quadrants(nx: int, ny: int) -> list[tuple[slice, slice, int]]:
    """The four quadrants of a transformed tile and the number of each one's bit-plane count."""
    x, y = (nx + 1) // 2, (ny + 1) // 2
    return [(slice(0, x), slice(0, y), 0), (slice(0, x), slice(y, ny), 1), (slice(x, nx), slice(0, y), 1), (slice(x, nx), slice(y, ny), 2)]


def _fours(bits: np.ndarray) -> np.ndarray:
    """Each 2 by 2 block as one number; what is missing at odd edges is 0."""
    b = np.pad(bits, ((0, bits.shape[0] % 2), (0, bits.shape[1] % 2))).astype(np.uint8)
    return b[0::2, 0::2] << 3 | b[0::2, 1::2] << 2 | b[1::2, 0::2] << 1 | b[1::2, 1::2]


def _spread(fours: np.ndarray, nx: int, ny: int) -> np.ndarray:
    out = np.empty((2 * fours.shape[0], 2 * fours.shape[1]), dtype=np.uint8)
    out[0::2, 0::2], out[0::2, 1::2], out[1::2, 0::2], out[1::2, 1::2] = fours >> 3 & 1, fours >> 2 & 1, fours >> 1 & 1, fours & 1
    return out[:nx, :ny]


def encode(tile: np.ndarray, scale: int = 0) -> bytes:
    """A tile of two axes; a scale over 1 loses what is below it."""
    a = transform(tile)
    if scale > 1:
        d = (scale + 1) // 2 - 1
        a = np.where(a > 0, (a + d) // scale, -((d - a) // scale))
    nx, ny = a.shape
    total, a[0, 0] = int(a[0, 0]), 0
    negative = np.packbits(a[a != 0] < 0).tobytes()
    a = np.abs(a)
    planes = [0, 0, 0]
    for x, y, q in _quadrants(nx, ny):
        planes[q] = max(planes[q], int(a[x, y].max(initial=0)).bit_length())
    text: list[str] = []
    for x, y, q in _quadrants(nx, ny):
        part = a[x, y]
        if not part.size:
            continue
        for bit in range(planes[q] - 1, -1, -1):
            direct = level = _fours(part >> bit & 1)
            codes = [CODES[v] for v in level[level != 0].tolist()]
            for _ in range(_levels(*part.shape) - 1):
                level = _fours(level != 0)
                codes += [CODES[v] for v in level[level != 0].tolist()]
            if sum(map(len, codes)) // 8 >= (direct.size + 1) // 2:
                text += ["0000", *(format(v, "04b") for v in direct.ravel().tolist())]
            else:
                text += ["1111", *(reversed(codes) if codes else [CODES[0]])]
    bits = "".join(text) + "0000"
    bits += "0" * (-len(bits) % 8)
    return MAGIC + struct.pack(">iiiq3B", nx, ny, scale, total, *planes) + int(bits, 2).to_bytes(len(bits) // 8, "big") + negative


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)), 0
        self.sixes = np.convolve(np.concatenate([self.bits, np.zeros(6, dtype=np.uint8)]).astype(np.int64), 1 << np.arange(6), mode="full")[5 : 5 + len(self.bits)].tolist()

    def four(self) -> int:
        self.at += 4
        if self.at > len(self.bits):
            raise HduError("UnexpectedEof", "HCOMPRESS")
        return self.sixes[self.at - 4] >> 2

    def codes(self, n: int) -> list[int]:
        out, at, sixes = [], self.at, self.sixes
        for _ in range(n):
            if at >= len(sixes):
                raise HduError("UnexpectedEof", "HCOMPRESS")
            value, size = _LOOK[sixes[at]]
            out.append(value)
            at += size
        self.at = at
        return out

    def fours(self, n: int) -> np.ndarray:
        part = self.bits[self.at : self.at + 4 * n].reshape(-1, 4)
        if len(part) < n:
            raise HduError("UnexpectedEof", "HCOMPRESS")
        self.at += 4 * n
        return part @ np.array([8, 4, 2, 1], dtype=np.uint8)


def decode(data: bytes, smooth: bool = False, most: int | None = None) -> np.ndarray:
    """The tile, of two axes; with ``most`` elements at most."""
    if data[:2] != MAGIC or len(data) < 25:
        raise HduError("InvalidValue", "HCOMPRESS")
    nx, ny, scale, total, *planes = struct.unpack(">iiiq3B", data[2:25])
    if nx < 0 or ny < 0 or (most is not None and nx * ny > most):
        raise HduError("DataSizeMismatch", f"{nx} x {ny}")
    a, bits = np.zeros((nx, ny), dtype=np.int64), _Bits(data[25:])
    for x, y, q in _quadrants(nx, ny):
        part = a[x, y]
        if not part.size:
            continue
        levels = _levels(*part.shape)
        shapes = list(zip(_sizes(part.shape[0], levels + 1), _sizes(part.shape[1], levels + 1), strict=True))  # the plane first, one code last
        for bit in range(planes[q] - 1, -1, -1):
            kind = bits.four()
            half = ((part.shape[0] + 1) // 2, (part.shape[1] + 1) // 2)
            if kind == 0:
                level = bits.fours(half[0] * half[1]).reshape(half)
            elif kind == 15:
                level = np.array(bits.codes(1), dtype=np.uint8).reshape(1, 1)
                for shape in reversed(shapes[1:-1]):
                    flat = _spread(level, *shape).ravel()
                    where = np.flatnonzero(flat)[::-1]
                    flat[where] = bits.codes(len(where))
                    level = flat.reshape(shape)
            else:
                raise HduError("InvalidValue", "HCOMPRESS plane")
            part |= _spread(level, *part.shape).astype(np.int64) << bit
    if bits.four():
        raise HduError("InvalidValue", "HCOMPRESS end")
    bits.at = -(-bits.at // 8) * 8
    some = a != 0
    n = int(some.sum())
    signs = bits.bits[bits.at : bits.at + n]
    if len(signs) < n:
        raise HduError("UnexpectedEof", "HCOMPRESS signs")
    a[some] = np.where(signs == 1, -a[some], a[some])
    a[0, 0] = total
    if scale > 1:
        a *= scale
    return inverse(a, smooth, scale)
