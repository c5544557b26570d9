"""Tile codecs: GZIP_1, GZIP_2, RICE_1, PLIO_1, HCOMPRESS_1, NOCOMPRESS, and the quantisation of floats with dither."""

from __future__ import annotations

import gzip
import zlib
from functools import cache

import numpy as np

from hdulake.errors import HduError
from hdulake.functions import hcompress

#: Fixed by the format: bits of a block's parameter and its largest value, by bytes of a pixel.
RICE = {1: (3, 6), 2: (4, 14), 4: (5, 25)}
#: Fixed by the format: reserved quantised values.
NULL_VALUE, ZERO_VALUE = -2147483647, -2147483646
#: Fixed by the format: length, multiplier and modulus of the dither sequence.
N_RANDOM, MULTIPLIER, MODULUS = 10000, 16807, 2147483647


def gunzip(data: bytes, most: int) -> bytes:
    """Inflate, but never more than ``most`` bytes."""
    d = zlib.decompressobj(31)
    out = d.decompress(data, most)
    if d.unconsumed_tail and d.decompress(d.unconsumed_tail, 1):
        raise HduError("DataSizeMismatch", "more bytes than the tile has")
    return out


def shuffle_bytes(data: bytes, width: int) -> bytes:
    """All first bytes, then all second ones, and so on."""
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, width).T.tobytes()


def unshuffle_bytes(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T.tobytes()


def gzip_bytes(data: bytes, level: int = 1) -> bytes:
    return gzip.compress(data, level, mtime=0)


def gzip_tile(raw: np.ndarray, planes: bool = False, level: int = 1) -> bytes:
    big = raw.astype(raw.dtype.newbyteorder(">")).tobytes()
    return gzip_bytes(shuffle_bytes(big, raw.dtype.itemsize) if planes else big, level)


def rice_encode(values: np.ndarray, width: int, block: int = 32) -> bytes:
    """Differences of neighbours, folded to be positive, in blocks of one split parameter each."""
    if width not in RICE:
        raise HduError("UnsupportedCompression", f"BYTEPIX {width}")
    n_bits, most = RICE[width]
    bits, modulus = 8 * width, 1 << 8 * width
    stored = [int(v) % modulus for v in values]
    if not stored:
        return b""
    parts = [format(stored[0], f"0{bits}b")]
    before = stored[0]
    for at in range(0, len(stored), block):
        folded = []
        for v in stored[at : at + block]:
            d = (v - before + modulus // 2) % modulus - modulus // 2
            folded.append(2 * d if d >= 0 else -2 * d - 1)
            before = v
        total = sum(folded)
        if not total:
            parts.append("0" * n_bits)
            continue
        split = max(0, int(max(0.0, total - len(folded) / 2 - 1) / len(folded) / 2)).bit_length()
        if split >= most:
            parts.append(format(most + 1, f"0{n_bits}b"))
            parts += [format(f, f"0{bits}b") for f in folded]
        else:
            parts.append(format(split + 1, f"0{n_bits}b"))
            parts += ["0" * (f >> split) + "1" + (format(f & ((1 << split) - 1), f"0{split}b") if split else "") for f in folded]
    text = "".join(parts)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def rice_decode(data: bytes, n: int, width: int, block: int = 32) -> np.ndarray:
    """The ``n`` pixels; what is read past the end counts as zero bits."""
    if width not in RICE:
        raise HduError("UnsupportedCompression", f"BYTEPIX {width}")
    n_bits, most = RICE[width]
    bits, modulus = 8 * width, 1 << 8 * width
    text = "".join(map("{:08b}".format, data)) + "0" * (64 + bits)
    at = 0

    def take(k: int) -> int:
        nonlocal at
        at += k
        return int(text[at - k : at] or "0", 2) if k else 0

    out: list[int] = []
    before = take(bits)
    while len(out) < n:
        count = min(block, n - len(out))
        split = take(n_bits) - 1
        if split < 0:
            folded = [0] * count
        elif split >= most:
            folded = [take(bits) for _ in range(count)]
        else:
            folded = []
            for _ in range(count):
                one = text.find("1", at)
                high = max(0, one - at)
                at = one + 1 if one >= 0 else len(text)
                folded.append(high << split | take(split))
        for f in folded:
            before = (before + (f >> 1 if not f & 1 else -(f >> 1) - 1)) % modulus
            out.append(before)
    signed = np.array(out, dtype=np.int64)
    return np.where(signed >= modulus // 2, signed - modulus, signed)


def plio_decode(words: np.ndarray, n: int) -> np.ndarray:
    """A line list of 16-bit instructions to the mask's pixels."""
    w = [int(x) for x in words]
    if len(w) < 3:
        return np.zeros(n, dtype=np.int32)
    length, at = (w[2], 3) if w[2] > 0 else ((w[4] << 15) + w[3], 7)
    out, place, high = np.zeros(n, dtype=np.int32), 0, 1
    while at < min(length, len(w)):
        code, data = (w[at] & 0xFFFF) >> 12, w[at] & 0xFFF
        at += 1
        if code == 1:
            high = (w[at] << 12) + data
            at += 1
        elif code in (2, 3):
            high += data if code == 2 else -data
        elif code in (6, 7):
            high += data if code == 6 else -data
            out[place : place + 1] = high
            place += 1
        else:
            if code == 4:
                out[place : place + data] = high
            elif code == 5 and 0 < data <= n - place:
                out[place + data - 1] = high
            place += data
    return out


def plio_encode(mask: np.ndarray) -> np.ndarray:
    """Runs of the mask as instructions; negative pixels count as 0."""
    v = np.maximum(np.asarray(mask, dtype=np.int64), 0)
    words: list[int] = []
    high = 1
    edges = np.flatnonzero(np.diff(v)) + 1
    for run in np.split(v, edges) if len(v) else []:
        value, left = int(run[0]), len(run)
        if value and value != high:
            step = value - high
            if abs(step) < 4096:
                words.append((2 if step > 0 else 3) << 12 | abs(step))
            else:
                words += [1 << 12 | value & 0xFFF, value >> 12]
            high = value
        while left:
            k = min(left, 4095)
            words.append((4 if value else 0) << 12 | k)
            left -= k
    n = len(words) + 7
    return np.array([0, 7, -100, n % 32768, n // 32768, 0, 0, *words], dtype=np.int32).astype(np.uint16).view(np.int16)


@cache
def randoms() -> np.ndarray:
    out, seed = np.empty(N_RANDOM, dtype=np.float32), 1
    for i in range(N_RANDOM):
        seed = MULTIPLIER * seed % MODULUS
        out[i] = np.float32(seed / MODULUS)
    return out


def dither_of(row: int, n: int) -> np.ndarray:
    """The offsets of a tile's n pixels; ``row`` counts from 1 and has the seed in it."""
    r, start = randoms(), (row - 1) % N_RANDOM
    at, out = int(r[start] * 500), []
    while n > 0:
        part = r[at : at + n]
        out.append(part)
        n -= len(part)
        start = (start + 1) % N_RANDOM
        at = int(r[start] * 500)
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def dequantize(raw: np.ndarray, scale: float, zero: float, method: str, row: int, blank=None) -> np.ndarray:
    q = raw.astype(np.float64)
    if method.startswith("SUBTRACTIVE_DITHER"):
        out = (q - dither_of(row, len(q)) + 0.5) * scale + zero
    else:
        out = q * scale + zero
    if method == "SUBTRACTIVE_DITHER_2":
        out[raw == ZERO_VALUE] = 0.0
    if blank is not None:
        out[raw == blank] = np.nan
    return out


def noise_of(x: np.ndarray) -> float:
    """Third-order noise estimate: 0.6052697 times the median over rows of their lower median absolute difference.

    A row's pixels that aren't finite are passed over, windows of five equal ones don't count, and a tile
    under five pixels wide is one row.
    """
    x = np.atleast_2d(x).astype(np.float64)
    found = []
    for row in x.reshape(1, -1) if x.shape[1] < 5 else x:
        row = row[np.isfinite(row)]
        if len(row) < 5:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(row, 5)
        d = np.abs(2 * windows[:, 2] - windows[:, 0] - windows[:, 4])[(windows != windows[:, :1]).any(axis=1)]
        if len(d):
            k = (len(d) - 1) // 2
            found.append(np.partition(d, k)[k])
    return 0.6052697 * float(np.median(found)) if found else 0.0


def quantize(x: np.ndarray, method: str, row: int, level: float = 4.0) -> tuple[np.ndarray, float, float] | None:
    """Integers, scale and zero of a tile of floats, or None if it can't be quantised. A level of 0 counts as 4."""
    if x.size <= 1:
        return None
    delta = noise_of(x) / (level or 4.0)
    flat = x.ravel().astype(np.float64)
    bad = ~np.isfinite(flat)
    good = flat[~bad]
    if not delta or not len(good) or (good.max() - good.min()) / delta > 2.0 * 2147483647 - 10:
        return None
    if bad.any() or method == "SUBTRACTIVE_DITHER_2":
        zero = good.min() - delta * (NULL_VALUE + 10)
    elif (good.max() - good.min()) / delta < 2147483647 - 10:
        zero = int(good.min() / delta + 0.5) * delta
    else:
        zero = (good.min() + good.max()) / 2
    offset = dither_of(row, len(flat)) - 0.5 if method.startswith("SUBTRACTIVE") else 0.0
    with np.errstate(invalid="ignore"):
        q = np.floor((flat - zero) / delta + offset + 0.5)
    q[bad] = NULL_VALUE
    if method == "SUBTRACTIVE_DITHER_2":
        q[flat == 0.0] = ZERO_VALUE
    return q.astype(np.int64), delta, zero


def decode_tile(cell: dict, codec: str, bitpix: int, n: int, dims: list[int], parameters: dict) -> np.ndarray:
    """A tile's stored values, from the first of its columns that has any bytes."""
    whole = np.dtype({8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix])
    packed = cell.get("COMPRESSED_DATA", [])
    if not len(packed):
        if len(cell.get("GZIP_COMPRESSED_DATA", [])):
            raw = gunzip(bytes(bytearray(cell["GZIP_COMPRESSED_DATA"])), n * whole.itemsize)
            return np.frombuffer(raw, dtype=whole).astype(whole.newbyteorder("="))
        return np.asarray(cell["UNCOMPRESSED_DATA"])
    kind = whole if bitpix > 0 else np.dtype(">i4")
    if codec == "PLIO_1":
        return plio_decode(np.asarray(packed), n)
    data = np.asarray(packed).astype(np.uint8).tobytes()
    if codec == "GZIP_1":
        return np.frombuffer(gunzip(data, n * kind.itemsize), dtype=kind).astype(kind.newbyteorder("="))
    if codec == "GZIP_2":
        return np.frombuffer(unshuffle_bytes(gunzip(data, n * kind.itemsize), kind.itemsize), dtype=kind).astype(kind.newbyteorder("="))
    if codec in ("RICE_1", "RICE_ONE"):
        width = int(parameters.get("BYTEPIX", 4))
        out = rice_decode(data, n, width, int(parameters.get("BLOCKSIZE", 32)))
        return out & 0xFF if bitpix == 8 else out
    if codec == "HCOMPRESS_1":
        return hcompress.decode(data, bool(parameters.get("SMOOTH", 0)), n).ravel()
    if codec == "NOCOMPRESS":
        return np.frombuffer(data, dtype=whole).astype(whole.newbyteorder("="))
    raise HduError("UnsupportedCompression", codec)
