"""Tile-compressed images and tables: writing both, and reading tables back as the bytes of their rows."""

from __future__ import annotations

from itertools import product

import numpy as np

from hdulake.errors import HduError
from hdulake.functions import codecs, hcompress
from hdulake.functions.codecs import gunzip, gzip_bytes, shuffle_bytes, unshuffle_bytes
from hdulake.sources.header import Header
from hdulake.sources.layout import TableColumn, parse_form
from hdulake.sources.writers import Column, big_endian, bintable, image_header


def resolve_tile(axes: list[int], tile: list[int]) -> list[int]:
    """A tile's extents: rows of the first axis unless given; each at least 1 and at most its axis."""
    tile = list(tile) or [axes[0], *[1] * (len(axes) - 1)]
    if len(tile) != len(axes):
        raise HduError("DimensionMismatch", f"{tile} of {axes}")
    return [min(max(1, t), max(1, a)) for t, a in zip(tile, axes, strict=True)]


def tiles_of(axes: list[int], tile: list[int]) -> list[tuple[slice, ...]]:
    """The tiles, the first axis fastest, as slices of an array whose last axis is the first."""
    starts = [range(0, a, t) for a, t in zip(reversed(axes), reversed(tile), strict=True)]
    return [tuple(slice(i, i + t) for i, t in zip(at, reversed(tile), strict=True)) for at in product(*starts)]


def _plain(raw: np.ndarray, codec: str, level: int, scale: int) -> bytes:
    """A tile of integers, encoded."""
    width = raw.dtype.itemsize
    if codec in ("GZIP_1", "GZIP_2"):
        return codecs.gzip_tile(raw.ravel(), codec == "GZIP_2", level)
    if codec == "RICE_1":
        return codecs.rice_encode(raw.ravel().astype(np.int64), width)
    if codec == "HCOMPRESS_1":
        shape = [n for n in raw.shape if n > 1]
        if len(shape) > 2:
            raise HduError("UnsupportedCompression", "HCOMPRESS_1 of more than two axes")
        return hcompress.encode(raw.astype(np.int64).reshape(-1, raw.shape[-1]) if len(shape) < 2 else raw.astype(np.int64).reshape(shape), scale)
    if codec == "PLIO_1":
        if raw.max(initial=0) >= 1 << 24:
            raise HduError("InvalidValue", "PLIO_1 holds 24 bits")
        return codecs.plio_encode(raw.ravel()).astype(">i2").tobytes()
    if codec == "NOCOMPRESS":
        return big_endian(raw)
    raise HduError("UnsupportedCompression", codec)


def compress_image(pixels: np.ndarray, codec: str, tile: list[int] | None = None, level: int = 1, hcompress_scale: int = 0, smooth: bool = False, quantize_level: float = 0.0, dither: str = "SUBTRACTIVE_DITHER_1", seed: int = 1, scale: float = 1.0, zero: float = 0.0, blank: int | None = None, name: str | None = None) -> tuple[Header, bytes]:
    """Header and data of a compressed image. Floats are quantised; a tile that can't be goes as it is, gzipped."""
    axes, kind = list(reversed(pixels.shape)), pixels.dtype
    if not axes or 0 in axes:
        raise HduError("DimensionMismatch", "an image without pixels")
    tile = resolve_tile(axes, tile or [])
    floats = kind.kind == "f"
    if floats and codec not in ("GZIP_1", "GZIP_2", "RICE_1") or not floats and kind.itemsize == 8 and codec in ("RICE_1", "HCOMPRESS_1", "PLIO_1"):
        raise HduError("UnsupportedCompression", f"{codec} of {kind}")
    packed, whole, scales, zeros = [], [], [], []
    for k, at in enumerate(tiles_of(axes, tile)):
        raw = pixels[at]
        if floats:
            found = codecs.quantize(raw.reshape(-1, raw.shape[-1]), dither, seed + k, quantize_level)
            if found is None:
                packed.append(b"")
                whole.append(codecs.gzip_tile(raw.ravel(), False, level))
                scales.append(0.0)
                zeros.append(0.0)
                continue
            raw, step, first = found
            raw = raw.astype(np.int32)
            scales.append(step)
            zeros.append(first)
            whole.append(b"")
        packed.append(_plain(raw, codec, level, hcompress_scale))
    letter = "I" if codec == "PLIO_1" else "B"
    columns = [Column.variable("COMPRESSED_DATA", letter, packed)]
    if floats:
        columns.append(Column.variable("GZIP_COMPRESSED_DATA", "B", whole))
        columns += [Column(n, "D", 1, np.frombuffer(np.array(v, dtype=">f8").tobytes(), dtype=np.uint8)) for n, v in (("ZSCALE", scales), ("ZZERO", zeros))]
    h, data = bintable(columns, len(packed), name)
    like = image_header(pixels, scale, zero, blank)
    h.set("ZIMAGE", True).set("ZCMPTYPE", codec).set("ZBITPIX", like.need("BITPIX")).set("ZNAXIS", len(axes))
    for i, (a, t) in enumerate(zip(axes, tile, strict=True), 1):
        h.set(f"ZNAXIS{i}", a).set(f"ZTILE{i}", t)
    parameters = {"RICE_1": {"BLOCKSIZE": 32, "BYTEPIX": 4 if floats else kind.itemsize}, "HCOMPRESS_1": {"SCALE": hcompress_scale, "SMOOTH": int(smooth)}}.get(codec, {})
    for i, (k, v) in enumerate(parameters.items(), 1):
        h.set(f"ZNAME{i}", k).set(f"ZVAL{i}", v)
    if floats:
        h.set("ZQUANTIZ", dither).set("ZDITHER0", seed).set("ZBLANK", codecs.NULL_VALUE)
    for key in ("BSCALE", "BZERO", "BLANK"):
        if (v := like.get(key)) is not None:
            h.set(key, v)
    return h, data


#: Bytes that GZIP_2 shuffles together, by TFORM letter; one for all others.
_SHUFFLED = {"I": 2, "J": 4, "E": 4, "K": 8, "D": 8}
#: Bytes of a pixel that RICE_1 takes, by TFORM letter.
_RICE = {"B": 1, "I": 2, "J": 4}


def codec_of(letter: str, asked: str) -> str:
    """The codec that a column of this letter gets when ``asked`` is asked for."""
    if asked not in ("GZIP_1", "GZIP_2", "RICE_1"):
        raise HduError("UnsupportedCompression", asked)
    if letter in "PQ":
        raise HduError("UnsupportedCompression", "a column of variable length")
    if asked == "RICE_1" and letter not in _RICE:
        return "GZIP_2" if letter in "EDK" else "GZIP_1"
    return asked


def _encode_cell(raw: bytes, letter: str, codec: str) -> bytes:
    if codec == "RICE_1":
        width = _RICE[letter]
        return codecs.rice_encode(np.frombuffer(raw, dtype=f">i{width}" if width > 1 else "u1").astype(np.int64), width)
    return gzip_bytes(shuffle_bytes(raw, _SHUFFLED.get(letter, 1)) if codec == "GZIP_2" else raw)


def _decode_cell(data: bytes, letter: str, codec: str, size: int) -> bytes:
    if codec == "RICE_1":
        width = _RICE[letter]
        out = big_endian(codecs.rice_decode(data, size // width, width).astype(f"i{width}" if width > 1 else np.int64).astype(f"i{width}" if width > 1 else "u1"))
    else:
        out = gunzip(data, size)
        if codec == "GZIP_2" and len(out) == size:
            out = unshuffle_bytes(out, _SHUFFLED.get(letter, 1))
    if len(out) != size:
        raise HduError("DataSizeMismatch", "a compressed column")
    return out


def compress_table(columns: list[Column], n: int, codec: str = "GZIP_2", rows_per_tile: int = 4096, name: str | None = None) -> tuple[Header, bytes]:
    """Header and data of a compressed table: tiles of rows, each column of a tile on its own."""
    plain = bintable([c for c in columns], n, name)[0]
    rows_per_tile = max(1, min(rows_per_tile, max(n, 1)))
    packed = []
    for c in columns:
        own = codec_of("P" if c.fixed is None else c.letter, codec)
        rows = np.ascontiguousarray(c.fixed.reshape(n, c.width))
        packed.append((own, [_encode_cell(rows[at : at + rows_per_tile].tobytes(), c.letter, own) for at in range(0, n, rows_per_tile)]))
    h, data = bintable([Column.variable(c.name, "B", cells, wide=True) for c, (_, cells) in zip(columns, packed, strict=True)], -(-n // rows_per_tile), name)
    h.set("ZTABLE", True).set("ZTILELEN", rows_per_tile).set("ZNAXIS1", plain.need("NAXIS1")).set("ZNAXIS2", n).set("ZPCOUNT", 0)
    for i, (c, (own, _)) in enumerate(zip(columns, packed, strict=True), 1):
        h.set(f"ZFORM{i}", f"{c.repeat}{c.letter}").set(f"ZCTYP{i}", own)
        for key in ("tunit", "tscal", "tzero", "tnull", "tdim", "tdisp"):
            if c.about.get(key) is not None:
                h.set(f"{key.upper()}{i}", c.about[key])
    return h, data


def plain_header(h: Header) -> Header:
    """The header of the table that a compressed one holds."""
    out = Header().set("XTENSION", "BINTABLE").set("BITPIX", 8).set("NAXIS", 2).set("NAXIS1", h.need("ZNAXIS1")).set("NAXIS2", h.need("ZNAXIS2"))
    out.set("PCOUNT", 0).set("GCOUNT", 1).set("TFIELDS", h.need("TFIELDS"))
    for i in range(1, h.need("TFIELDS") + 1):
        form = h.text(f"ZFORM{i}")
        if form is None:
            raise HduError("MissingKeyword", f"ZFORM{i}")
        if parse_form(form)[1] in "PQ":
            raise HduError("UnsupportedCompression", "a column of variable length")
        out.set(f"TFORM{i}", form)
        for key in ("TTYPE", "TUNIT", "TSCAL", "TZERO", "TNULL", "TDIM", "TDISP"):
            if (v := h.get(f"{key}{i}")) is not None:
                out.set(f"{key}{i}", v)
    return out


def expand_rows(cells: dict[int, bytes], columns: list[TableColumn], places: list[int], h: Header, rows: int) -> np.ndarray:
    """The bytes of a tile's rows, of the asked columns side by side; ``places`` are their numbers in the table."""
    parts = []
    for c, i in zip(columns, places, strict=True):
        codec = h.text(f"ZCTYP{i + 1}") or "GZIP_2"
        parts.append(np.frombuffer(_decode_cell(cells[i], c.letter, codec, rows * c.width), dtype=np.uint8).reshape(rows, c.width))
    return np.concatenate(parts, axis=1) if parts else np.zeros((rows, 0), dtype=np.uint8)
