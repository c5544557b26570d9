"""Where things lie in a file: HDUs, their kinds and extents, table columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from hdulake.errors import HduError
from hdulake.sources.header import BLOCK, Header

#: Fixed by the format: big-endian element types by BITPIX.
BITPIX = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Fixed by the format: element types of binary-table columns by TFORM letter.
ELEMENTS = {"L": "u1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "S1", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16", "P": ">u4", "Q": ">u8"}


def padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def kind_of(h: Header, first: bool) -> str:
    x = (h.text("XTENSION") or "").strip()
    if x == "IMAGE":
        return "Image"
    if x == "TABLE":
        return "AsciiTable"
    if x in ("BINTABLE", "A3DTABLE"):
        if h.logical("ZIMAGE"):
            return "CompressedImage"
        return "CompressedTable" if h.logical("ZTABLE") else "BinTable"
    if x:
        return "Other"
    if h.logical("GROUPS") and (h.integer("NAXIS") or 0) > 0:
        return "RandomGroups"
    return "Primary"


def data_bytes(h: Header) -> int:
    axes = h.axes()
    if not axes:
        return 0
    bitpix = h.need("BITPIX")
    if bitpix not in BITPIX:
        raise HduError("InvalidBitpix", str(bitpix))
    groups = bool(h.logical("GROUPS")) and axes[0] == 0
    n = 1
    for a in axes[1:] if groups else axes:
        n *= a
    pcount, gcount = h.integer("PCOUNT", 0), h.integer("GCOUNT", 1)
    if pcount < 0 or gcount < 0:
        raise HduError("KeywordOutOfRange", "PCOUNT/GCOUNT")
    total = abs(bitpix) // 8 * gcount * (pcount + n)
    if total >= 1 << 64:
        raise HduError("DataUnitOverflow")
    return total


@dataclass
class Hdu:
    index: int
    header: Header
    kind: str
    header_offset: int
    data_offset: int
    data_bytes: int
    truncated: bool = False  # the file ends within the data unit


def scan(f, size: int) -> list[Hdu]:
    """All HDUs of an open file. Only headers are read; what trails the last HDU is ignored.

    A data unit that the file is too short for is listed as truncated; reading it fails.
    """
    out: list[Hdu] = []
    at = 0
    while at < size:
        raw = b""
        f.seek(at)
        while True:
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                raw = b""
                break
            raw += block
            if any(block[i : i + 80].rstrip() == b"END" for i in range(0, BLOCK, 80)):
                break
            if not out and len(raw) == BLOCK and not raw.startswith(b"SIMPLE  ="):
                raise HduError("MissingKeyword", "SIMPLE")
            if out and len(raw) == BLOCK and not raw.startswith(b"XTENSION"):
                raw = b""
                break
        if not raw:
            if not out:
                raise HduError("UnexpectedEof")
            break
        h = Header.parse(raw)
        n, offset = data_bytes(h), at + len(raw)
        out.append(Hdu(len(out), h, kind_of(h, not out), at, offset, n, offset + n > size))
        at = min(size, offset + padded(n))
    return out


@dataclass
class TableColumn:
    name: str
    form: str
    letter: str
    repeat: int
    offset: int
    element: str = ""  # of variable-length columns
    decimals: int = 0
    unit: str | None = None
    scale: float = 1.0
    zero: float = 0.0
    null: object = None
    dims: list[int] = field(default_factory=list)
    display: str | None = None

    @property
    def width(self) -> int:
        if self.letter == "X":
            return -(-self.repeat // 8)
        return self.repeat * np.dtype(ELEMENTS[self.letter]).itemsize * (2 if self.letter in "PQ" else 1)


_FORM = re.compile(r"\s*(\d*)([LXBIJKAEDCMPQ])(.*)\Z")


def parse_form(text: str) -> tuple[int, str, str]:
    """Repeat, letter and the element letter of a variable-length column."""
    m = _FORM.match(text)
    if not m:
        raise HduError("InvalidTform", text)
    repeat, letter, rest = int(m[1] or 1), m[2], m[3].strip()
    if letter in "PQ":
        if repeat > 1 or not rest or rest[0] not in ELEMENTS or rest[0] in "PQ":
            raise HduError("InvalidTform", text)
        return repeat, letter, rest[0]
    return repeat, letter, ""


_DISPLAY = re.compile(r"(EN|ES|[ALIBOZFEGD])(\d+)(?:\.(\d+))?(?:E(\d+))?\Z")


def parse_display(text: str) -> tuple[str, int, int | None, int | None] | None:
    """Kind, width, digits and exponent digits of a TDISP, or None."""
    m = _DISPLAY.match(text.strip().upper())
    return (m[1], int(m[2]), int(m[3]) if m[3] else None, int(m[4]) if m[4] else None) if m else None


def _names(raw: list[str | None]) -> list[str]:
    """Column names that Spark can tell apart: unnamed ones by place, repeated ones with a number."""
    out, seen = [], set()
    for i, name in enumerate(raw):
        base = (name or "").strip() or f"col{i + 1}"
        unique, k = base, 2
        while unique.lower() in seen:
            unique, k = f"{base}_{k}", k + 1
        seen.add(unique.lower())
        out.append(unique)
    return out


def bin_columns(h: Header) -> list[TableColumn]:
    n = h.need("TFIELDS")
    if not 0 <= n <= 999:
        raise HduError("KeywordOutOfRange", "TFIELDS")
    names = _names([h.text(f"TTYPE{i}") for i in range(1, n + 1)])
    out, at = [], 0
    for i in range(1, n + 1):
        form = h.text(f"TFORM{i}")
        if form is None:
            raise HduError("MissingKeyword", f"TFORM{i}")
        repeat, letter, element = parse_form(form)
        dims = [int(x) for x in re.findall(r"\d+", h.text(f"TDIM{i}") or "")]
        product = int(np.prod(dims)) if dims else repeat
        if dims and letter not in "PQ" and product != repeat:
            raise HduError("KeywordOutOfRange", f"TDIM{i}")
        c = TableColumn(names[i - 1], form, letter, repeat, at, element, 0, h.text(f"TUNIT{i}"), h.real(f"TSCAL{i}", 1.0), h.real(f"TZERO{i}", 0.0), h.integer(f"TNULL{i}"), dims, h.text(f"TDISP{i}"))
        out.append(c)
        at += c.width
    if at != h.need("NAXIS1"):
        raise HduError("RowWidthMismatch", f"{at} and {h.need('NAXIS1')}")
    return out


_ASCII_FORM = re.compile(r"\s*([AIFED])(\d+)(?:\.(\d+))?\s*\Z")


def ascii_columns(h: Header) -> list[TableColumn]:
    n, width = h.need("TFIELDS"), h.need("NAXIS1")
    names = _names([h.text(f"TTYPE{i}") for i in range(1, n + 1)])
    out = []
    for i in range(1, n + 1):
        m = _ASCII_FORM.match(h.text(f"TFORM{i}") or "")
        if not m:
            raise HduError("InvalidTform", h.text(f"TFORM{i}") or "")
        start = h.need(f"TBCOL{i}") - 1
        if start < 0 or start + int(m[2]) > width:
            raise HduError("KeywordOutOfRange", f"TBCOL{i}")
        out.append(TableColumn(names[i - 1], m[0].strip(), m[1], int(m[2]), start, "", int(m[3] or 0), h.text(f"TUNIT{i}"), h.real(f"TSCAL{i}", 1.0), h.real(f"TZERO{i}", 0.0), h.text(f"TNULL{i}")))
    return out
