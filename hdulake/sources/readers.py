"""Spark data sources over the files: ``hdu_catalog``, ``hdu_cards``, ``hdu_image``, ``hdu_table``, ``hdu_groups``, ``hdu_data``, ``hdu_checksums``.

Options: ``path`` (a file, folder or glob that driver and executors see, or the URI of a file system that Arrow
knows), ``hdu`` (index) or ``extname`` and ``extver``, and ``rows`` (rows or pixels of a partition).
``physical`` turns stored values into physical ones, ``unsigned`` into exact unsigned ones where the zero says so.

A partition is a byte range of one HDU: it is opened, sought and read on the executor, so no file is read whole
anywhere. Of up to ``PLANNED`` files the driver reads the headers to cut them; of more it reads the first one's alone (for the
schema), and each file is a partition whose headers its executor reads.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hdulake.errors import HduError
from hdulake.functions.checksum import ones_sum
from hdulake.functions.codecs import decode_tile, dequantize
from hdulake.sources.header import ComplexInteger
from hdulake.sources.layout import BITPIX, ELEMENTS, Hdu, TableColumn, ascii_columns, bin_columns, padded, scan
from hdulake.sources.tiles import expand_rows, plain_header

ROWS = 1 << 18
#: Files whose headers the driver reads to cut them into partitions.
PLANNED = 64
#: Bytes of a data unit that are read at a time.
CHUNK = 2880 << 10


def _remote(path: str):
    """The file system and path within it of a URI; None for local paths."""
    if "://" not in path:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    suffixes = (".fits", ".fit", ".fts")
    if (there := _remote(path)) is not None:
        from pyarrow import fs

        system, inner = there
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return [path]
        base = path[: len(path) - len(inner)] if path.endswith(inner) else path[: path.index("://") + 3]
        return sorted(base + f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.lower().endswith(suffixes))
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/**/*", recursive=True) if p.lower().endswith(suffixes))
    return sorted(glob.glob(path)) or [path]


def open_file(path: str):
    """The file, open for reading and seeking; a local one is mapped into memory."""
    there = _remote(path)
    if there is not None:
        return there[0].open_input_file(there[1])
    return pa.memory_map(path) if os.path.getsize(path) else open(path, "rb")


def hdus_of(path: str) -> list[Hdu]:
    with open_file(path) as f:
        size = f.seek(0, os.SEEK_END)
        return scan(f, size if size is not None else f.tell())


def whole(h: Hdu) -> Hdu:
    if h.truncated:
        raise HduError("UnexpectedEof")
    return h


def extname_of(h: Hdu) -> str | None:
    return h.header.text("EXTNAME")


class Piece(InputPartition):
    def __init__(self, path: str, hdu: Hdu | None = None, first: int = 0, last: int = 0):
        super().__init__((path, first))
        self.path, self.hdu, self.first, self.last = path, hdu, first, last


class _Source(DataSource):
    kinds: tuple[str, ...] = ()

    @property
    def files(self) -> list[str]:
        return files_of(self.options["path"])

    def pick(self, path: str) -> Hdu:
        """The HDU that the options name, or the first of a fitting kind that has data, or else the first table without rows."""
        hdus = hdus_of(path)
        if "hdu" in self.options:
            k = int(self.options["hdu"])
            if not 0 <= k < len(hdus):
                raise HduError("HduIndexOutOfBounds", str(k))
            found = hdus[k]
        elif "extname" in self.options:
            name, version = self.options["extname"].lower(), self.options.get("extver")
            fits = [h for h in hdus if (extname_of(h) or "").lower() == name and (version is None or h.header.integer("EXTVER", 1) == int(version))]
            if not fits:
                raise HduError("HduIndexOutOfBounds", name)
            found = fits[0]
        else:
            fits = [h for h in hdus if h.kind in self.kinds and (h.data_bytes or h.kind.endswith("Table"))]
            fits.sort(key=lambda h: not h.data_bytes)
            if not fits:
                raise HduError(f"No{self.kinds[0]}", path)
            found = fits[0]
        if found.kind not in self.kinds:
            raise HduError(f"NotA{self.kinds[0]}", found.kind)
        return found

    def asks(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"


class _Pieces(DataSourceReader):
    """Partitions of one chosen HDU of each file: ``cut`` says where, ``batches`` reads one."""

    def __init__(self, source: _Source):
        self.source = source

    def partitions(self):
        files = self.source.files
        if len(files) > PLANNED:
            return [Piece(path) for path in files]
        return [p for path in files for p in self.pieces(path)]

    def pieces(self, path: str) -> list[Piece]:
        h = whole(self.source.pick(path))
        n, step = self.cut(h)
        return [Piece(path, h, at, min(n, at + step)) for at in range(0, n, max(1, step))]

    def read(self, p: Piece | None) -> Iterator:
        """The rows of a piece; without any piece (no file has rows) Spark asks for those of None."""
        for piece in [] if p is None else [p] if p.hdu else self.pieces(p.path):
            yield from self.batches(piece)


CATALOG = "path string, hdu int, kind string, extname string, extver long, naxis int, axes array<long>, bitpix int, header_offset long, data_offset long, data_bytes long"
CARDS = "path string, hdu int, card_index int, keyword string, type string, b boolean, i long, r double, s string, re double, im double, comment string"


class CatalogSource(_Source):
    """A row for each HDU."""

    @classmethod
    def name(cls) -> str:
        return "hdu_catalog"

    def schema(self) -> str:
        return CATALOG

    def reader(self, schema) -> DataSourceReader:
        return _PerFile(self.files, self.rows)

    @staticmethod
    def rows(path: str) -> Iterator[tuple]:
        for h in hdus_of(path):
            axes = h.header.axes()
            yield path, h.index, h.kind, extname_of(h), h.header.integer("EXTVER"), len(axes), axes, h.header.integer("BITPIX"), h.header_offset, h.data_offset, h.data_bytes


class CardsSource(CatalogSource):
    """A row for each header card, in order."""

    @classmethod
    def name(cls) -> str:
        return "hdu_cards"

    def schema(self) -> str:
        return CARDS

    @staticmethod
    def rows(path: str) -> Iterator[tuple]:
        for h in hdus_of(path):
            for k, c in enumerate(h.header.cards):
                v = c.value
                kind = {bool: "logical", int: "integer", float: "real", str: "text", complex: "complex", ComplexInteger: "complex_integer", type(None): "commentary"}.get(type(v), "undefined")
                part = lambda t, v=v: v if type(v) is t else None
                yield path, h.index, k, c.keyword, kind, part(bool), part(int), part(float), part(str), v.real if isinstance(v, complex) else None, v.imag if isinstance(v, complex) else None, c.comment


class _PerFile(DataSourceReader):
    def __init__(self, files: list[str], rows):
        self.files, self.rows = files, rows

    def partitions(self):
        return [Piece(p) for p in self.files]

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from self.rows(partition.path)


class ImageSource(_Source):
    """Pixels: path, flat (first axis fastest), raw, the stored value, and with ``physical`` value. Compressed images give theirs by tile."""

    kinds = ("Image", "Primary", "CompressedImage")

    @classmethod
    def name(cls) -> str:
        return "hdu_image"

    def schema(self) -> str:
        h = self.pick(self.files[0])
        key = "ZBITPIX" if h.kind == "CompressedImage" else "BITPIX"
        kind = {8: "short", 16: "short", 32: "int", 64: "long", -32: "float", -64: "double"}[h.header.need(key)]
        return f"path string, flat long, raw {kind}" + (", value double" if self.asks("physical") else "")

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(self, int(self.options.get("rows", ROWS)), schema)


def physical_values(raw: np.ndarray, scale: float, zero: float, null: int | None) -> np.ndarray:
    """zero + scale * raw as doubles; the integer ``null`` gives NaN."""
    out = zero + scale * np.asarray(raw, dtype=np.float64)
    if null is not None and np.asarray(raw).dtype.kind in "iu":
        out[np.asarray(raw) == null] = np.nan
    return out


def tile_shapes(h: Hdu) -> tuple[list[int], list[int]]:
    axes = [h.header.need(f"ZNAXIS{i + 1}") for i in range(h.header.need("ZNAXIS"))]
    return axes, [max(1, h.header.integer(f"ZTILE{i + 1}", axes[i] if i == 0 else 1)) for i in range(len(axes))]


class _ImageReader(_Pieces):
    def __init__(self, source: ImageSource, rows: int, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        super().__init__(source)
        self.rows, self.arrow = rows, to_arrow_schema(schema)

    def cut(self, h: Hdu) -> tuple[int, int]:
        if h.kind == "CompressedImage":
            return h.header.need("NAXIS2"), max(1, self.rows >> 16)
        if h.header.integer("PCOUNT", 0) or h.header.integer("GCOUNT", 1) != 1:
            raise HduError("ImageHasGroups")
        return int(np.prod(h.header.axes(), dtype=object)) if h.header.axes() else 0, self.rows

    def batches(self, p: Piece) -> Iterator[pa.RecordBatch]:
        h = p.hdu.header
        scale, zero, blank = h.real("BSCALE", 1.0), h.real("BZERO", 0.0), h.integer("BLANK")
        for flat, raw in self.tiles(p) if p.hdu.kind == "CompressedImage" else [self.plain(p)]:
            arrays = [pa.repeat(pa.scalar(p.path), len(flat)), pa.array(flat), pa.array(raw).cast(self.arrow.field("raw").type)]
            if len(self.arrow) > 3:
                arrays.append(pa.array(physical_values(raw, scale, zero, blank)))
            yield pa.RecordBatch.from_arrays(arrays, schema=self.arrow)

    def plain(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        kind = np.dtype(BITPIX[p.hdu.header.need("BITPIX")])
        with open_file(p.path) as f:
            f.seek(p.hdu.data_offset + p.first * kind.itemsize)
            raw = np.frombuffer(f.read((p.last - p.first) * kind.itemsize), dtype=kind)
        return np.arange(p.first, p.last), raw.astype(kind.newbyteorder("="))

    def tiles(self, p: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = p.hdu.header
        axes, tile = tile_shapes(p.hdu)
        grid = [-(-a // t) for a, t in zip(axes, tile, strict=True)]
        table = read_rows(p.path, p.hdu, bin_columns(h), p.first, p.last)
        parameters = {h.text(f"ZNAME{i}"): h.get(f"ZVAL{i}") for i in range(1, 20) if h.text(f"ZNAME{i}")}
        bitpix = h.need("ZBITPIX")
        for k in range(p.last - p.first):
            number, at = p.first + k, p.first + k
            index = []
            for g in grid:
                at, i = divmod(at, g)
                index.append(i)
            low = [i * t for i, t in zip(index, tile, strict=True)]
            dims = [min(t, a - o) for t, a, o in zip(tile, axes, low, strict=True)]
            cell = {n: v[k] for n, v in table.items()}
            raw = decode_tile(cell, h.text("ZCMPTYPE") or "", bitpix, int(np.prod(dims)), dims, parameters)
            if bitpix < 0 and "ZSCALE" in cell and len(cell.get("COMPRESSED_DATA", [])):
                blank = cell["ZBLANK"][0] if "ZBLANK" in cell else h.integer("ZBLANK")
                raw = dequantize(raw, float(cell["ZSCALE"][0]), float(cell["ZZERO"][0]), h.text("ZQUANTIZ") or "NO_DITHER", number + h.integer("ZDITHER0", 1), blank).astype(np.float32 if bitpix == -32 else np.float64)
            stride, flat = 1, np.zeros(1, dtype=np.int64)
            for o, d, a in zip(low, dims, axes, strict=True):
                flat = (flat[None, :] + ((o + np.arange(d)) * stride)[:, None]).ravel()
                stride *= a
            yield flat, raw


def read_rows(path: str, h: Hdu, columns: list[TableColumn], first: int, last: int) -> dict[str, object]:
    """Columns of the rows first..last-1, each an array or a list of arrays (variable length); text as strings."""
    width = h.header.need("NAXIS1")
    heap = h.header.integer("THEAP", width * h.header.need("NAXIS2"))
    if heap < width * h.header.need("NAXIS2"):
        raise HduError("KeywordOutOfRange", "THEAP")
    out: dict[str, object] = {}
    with open_file(path) as f:
        f.seek(h.data_offset + first * width)
        rows = np.frombuffer(f.read((last - first) * width), dtype=np.uint8).reshape(-1, width)
        for c in columns:
            raw = np.ascontiguousarray(rows[:, c.offset : c.offset + c.width])
            if c.letter in "PQ":
                spans = raw.view(ELEMENTS[c.letter]).reshape(len(rows), -1) if c.repeat else np.zeros((len(rows), 2), dtype=np.int64)
                out[c.name] = [_heap(f, h, heap, int(n), int(at), c.element) for n, at in spans]
            else:
                out[c.name] = _cells(raw, c.letter, c.repeat)
    return out


def _heap(f, h: Hdu, heap: int, n: int, at: int, letter: str):
    size = -(-n // 8) if letter == "X" else n * np.dtype(ELEMENTS[letter]).itemsize
    if heap + at + size > h.data_bytes:
        raise HduError("UnexpectedEof", "heap")
    f.seek(h.data_offset + heap + at)
    return _cells(np.frombuffer(f.read(size), dtype=np.uint8)[None, :], letter, n)[0]


def _cells(raw: np.ndarray, letter: str, repeat: int):
    """Cells of one column: rows of bytes to rows of values."""
    n = len(raw)
    if letter == "A":
        return [bytes(r).split(b"\0")[0].decode("utf-8", "replace").rstrip(" ") for r in raw]
    if letter == "X":
        return np.unpackbits(raw, axis=1)[:, :repeat].astype(bool)
    if letter == "L":
        return [[True if b == 84 else False if b == 70 else None for b in r] for r in raw.tolist()]
    kind = np.dtype(ELEMENTS[letter])
    if not raw.size:
        return np.zeros((n, repeat), dtype=kind.newbyteorder("="))
    return raw.view(kind).astype(kind.newbyteorder("="))


_SPARK = {"L": T.BooleanType(), "X": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "A": T.StringType(), "E": T.FloatType(), "D": T.DoubleType()}


def _complex(single: bool) -> T.StructType:
    kind = T.FloatType() if single else T.DoubleType()
    return T.StructType([T.StructField("re", kind), T.StructField("im", kind)])


def spark_type(c: TableColumn) -> T.DataType:
    letter = c.element or c.letter
    kind = _complex(letter == "C") if letter in "CM" else _SPARK[letter]
    return kind if letter == "A" or (not c.element and c.repeat == 1 and letter != "X") else T.ArrayType(kind)


#: Fixed by the format: the zero that makes a column's integers unsigned (bytes: signed), by its letter.
_ZEROS = {"B": -128.0, "I": float(1 << 15), "J": float(1 << 31), "K": float(1 << 63)}
_EXACT = {"B": T.ShortType(), "I": T.IntegerType(), "J": T.LongType(), "K": T.DecimalType(20, 0)}


class _View:
    """How a column's stored values are to be shown: as stored, exact unsigned, or physical (doubles, NaN for nulls)."""

    def __init__(self, c: TableColumn, physical: bool, unsigned: bool, plain: bool):
        letter = c.element or c.letter
        self.column, self.plain = c, plain
        self.unsigned = unsigned and not plain and letter in _ZEROS and c.scale == 1.0 and c.zero == _ZEROS[letter] and c.null is None
        self.physical = physical and not self.unsigned and (letter in "IFED" if plain else letter in "BIJKEDCM")

    def type(self) -> T.DataType:
        c = self.column
        if self.plain:
            return T.StringType() if c.letter == "A" else T.DoubleType() if self.physical or c.letter != "I" else T.LongType()
        kind = spark_type(c)
        if not (self.unsigned or self.physical):
            return kind
        letter = c.element or c.letter
        one = _EXACT[letter] if self.unsigned else _complex(False) if letter in "CM" else T.DoubleType()
        return T.ArrayType(one) if isinstance(kind, T.ArrayType) else one

    def of(self, cells):
        """The column's cells, as stored, in this view."""
        if self.plain or not (self.unsigned or self.physical):
            return cells
        return self._values(cells) if isinstance(cells, np.ndarray) else [self._values(r) for r in cells]

    def _values(self, raw: np.ndarray) -> np.ndarray:
        c = self.column
        if self.physical:
            if raw.dtype.kind == "c":
                return (c.zero + c.scale * raw.real) + 1j * (c.zero + c.scale * raw.imag)
            return physical_values(raw, c.scale, c.zero, c.null)
        if (c.element or c.letter) == "K":
            return raw.astype(object) + (1 << 63)
        return raw.astype(np.int64) + int(c.zero)


class TableSource(_Source):
    """Rows of a binary, ASCII or compressed table; scales, units and nulls are in the fields' metadata.

    Values are as stored unless ``physical`` or ``unsigned`` is asked for. A null text, logical or array comes back as
    the file has it: empty, undefined, empty. Files of one load have their columns matched by name. With ``container`` a
    compressed table gives the rows of its tiles as stored.
    """

    kinds = ("BinTable", "AsciiTable", "CompressedTable", "CompressedImage")

    @classmethod
    def name(cls) -> str:
        return "hdu_table"

    def all_columns(self, h: Hdu) -> list[TableColumn]:
        if h.kind == "AsciiTable":
            return ascii_columns(h.header)
        return bin_columns(plain_header(h.header) if self.expands(h) else h.header)

    def expands(self, h: Hdu) -> bool:
        return h.kind == "CompressedTable" and not self.asks("container")

    def views(self, h: Hdu) -> list[_View]:
        found = self.all_columns(h)
        if "columns" in self.options:
            asked = [x.strip().lower() for x in self.options["columns"].split(",")]
            missing = set(asked) - {c.name.lower() for c in found}
            if missing:
                raise HduError("ColumnNotFound", ", ".join(sorted(missing)))
            found = [c for c in found if c.name.lower() in asked]
        return [_View(c, self.asks("physical"), self.asks("unsigned"), h.kind == "AsciiTable") for c in found]

    def schema(self) -> T.StructType:
        fields = []
        for v in self.views(self.pick(self.files[0])):
            c = v.column
            about = {"unit": c.unit, "tscal": c.scale, "tzero": c.zero, "tnull": c.null, "tdim": c.dims, "tform": c.form, "tdisp": c.display}
            fields.append(T.StructField(c.name, v.type(), True, {k: x for k, x in about.items() if x is not None}))
        return T.StructType(fields)

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self, int(self.options.get("rows", ROWS)), schema)


class _TableReader(_Pieces):
    def __init__(self, source: TableSource, rows: int, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        super().__init__(source)
        self.rows, self.spark, self.arrow = rows, schema, to_arrow_schema(schema)

    def cut(self, h: Hdu) -> tuple[int, int]:
        n = h.header.need("NAXIS2")
        return (n, max(1, self.rows // max(1, h.header.need("ZTILELEN")))) if self.source.expands(h) else (n, self.rows)

    def batches(self, p: Piece) -> Iterator[pa.RecordBatch]:
        """The schema's columns, which another file may have in another order."""
        own = {v.column.name.lower(): v for v in self.source.views(p.hdu)}
        views = []
        for f in self.spark.fields:
            v = own.get(f.name.lower())
            if v is None:
                raise HduError("ColumnNotFound", f"{f.name} in {p.path}")
            if v.type() != f.dataType:
                raise HduError("UnsupportedColumn", f"{f.name} is {v.type().simpleString()} in {p.path}, {f.dataType.simpleString()} in the first file")
            views.append(v)
        columns = [v.column for v in views]
        if p.hdu.kind == "AsciiTable":
            parts = [read_ascii(p.path, p.hdu, columns, p.first, p.last, any(v.physical for v in views))]
        elif self.source.expands(p.hdu):
            parts = read_tiles(p.path, p.hdu, columns, p.first, p.last)
        else:
            parts = [read_rows(p.path, p.hdu, columns, p.first, p.last)]
        for cells in parts:
            yield pa.RecordBatch.from_arrays([_arrow(v.of(cells[v.column.name]), v.column, self.arrow.field(i).type, v.plain) for i, v in enumerate(views)], schema=self.arrow)


def read_tiles(path: str, h: Hdu, columns: list[TableColumn], first: int, last: int) -> Iterator[dict[str, object]]:
    """The rows of the tiles first..last-1 of a compressed table, a tile at a time."""
    stored, table, n = bin_columns(h.header), bin_columns(plain_header(h.header)), h.header.need("ZNAXIS2")
    length, places = h.header.need("ZTILELEN"), [next(i for i, c in enumerate(table) if c.name == asked.name) for asked in columns]
    for t in range(first, last):
        found = read_rows(path, h, [stored[i] for i in places], t, t + 1)
        cells = {i: np.asarray(found[stored[i].name][0]).astype(np.uint8).tobytes() for i in places}
        rows = max(0, min(length, n - t * length))
        raw, at, out = expand_rows(cells, columns, places, h.header, rows), 0, {}
        for c in columns:
            out[c.name] = _cells(np.ascontiguousarray(raw[:, at : at + c.width]), c.letter, c.repeat)
            at += c.width
        yield out


def _arrow(cells, c: TableColumn, kind: pa.DataType, plain: bool) -> pa.Array:
    if plain or c.letter == "A":
        return pa.array(cells, kind)
    letter = c.element or c.letter
    if letter in "CM":
        cells = [[{"re": float(x.real), "im": float(x.imag)} for x in np.atleast_1d(r)] for r in cells]
    elif isinstance(cells, np.ndarray) and not pa.types.is_list(kind):
        one = cells[:, 0]
        return pa.array([Decimal(v) for v in one.tolist()], kind) if one.dtype == object else pa.array(one).cast(kind)
    elif letter != "A":
        cells = [[Decimal(v) if type(v) is int and pa.types.is_decimal(kind.value_type) else v for v in r] if pa.types.is_list(kind) else list(r) for r in cells]
    if not pa.types.is_list(kind) and letter != "A":
        cells = [r[0] for r in cells]
    return pa.array(cells, kind)


def fortran_real(text: str, decimals: int) -> float:
    """E or D exponents, a bare signed exponent, and an implied decimal point."""
    import re

    m = re.fullmatch(r"([+-]?)(\d*)(\.?)(\d*)(?:[EeDd]?([+-]?\d+))?", text.replace(" ", ""))
    if not m or not (m[2] or m[4]):
        raise HduError("InvalidValue", text)
    value = float(f"{m[1]}{m[2] or 0}.{m[4] or 0}") if m[3] else float(f"{m[1]}{m[2]}") / 10.0**decimals
    return value * 10.0 ** int(m[5] or 0)


def read_ascii(path: str, h: Hdu, columns: list[TableColumn], first: int, last: int, physical: bool = False) -> dict[str, list]:
    """Raw values, where a blank or null number is 0; or physical ones, where a null is NaN and a blank one 0."""
    width = h.header.need("NAXIS1")
    with open_file(path) as f:
        f.seek(h.data_offset + first * width)
        data = f.read((last - first) * width)
    out: dict[str, list] = {}
    for c in columns:
        fields = [data[at + c.offset : at + c.offset + c.repeat].decode("ascii") for at in range(0, len(data), width)]
        if c.letter == "A":
            out[c.name] = [x.rstrip(" ") for x in fields]
            continue
        if physical:
            null = None if c.null is None else c.null.strip()
            out[c.name] = [float("nan") if x.strip() == null else c.zero + c.scale * (fortran_real(x.strip(), c.decimals) if x.strip() else 0.0) for x in fields]
            continue
        blank = {"", (c.null or "").strip()}
        read = int if c.letter == "I" else lambda x, d=c.decimals: fortran_real(x, d)
        out[c.name] = [0 if x.strip() in blank else read(x.strip()) for x in fields]
    return out


class GroupsSource(_Source):
    """Random groups: group, params and data, in physical values."""

    kinds = ("RandomGroups",)

    @classmethod
    def name(cls) -> str:
        return "hdu_groups"

    def schema(self) -> str:
        return "path string, group long, param_names array<string>, params array<double>, data array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _GroupsReader(self, int(self.options.get("rows", 4096)))


class _GroupsReader(_Pieces):
    def __init__(self, source: GroupsSource, rows: int):
        super().__init__(source)
        self.rows = rows

    def cut(self, h: Hdu) -> tuple[int, int]:
        return h.header.integer("GCOUNT", 1), self.rows

    def batches(self, p: Piece) -> Iterator[tuple]:
        h = p.hdu.header
        kind, n_params = np.dtype(BITPIX[h.need("BITPIX")]), h.integer("PCOUNT", 0)
        n = int(np.prod(h.axes()[1:], dtype=np.int64)) if len(h.axes()) > 1 else 1
        names = [h.text(f"PTYPE{i + 1}", "") for i in range(n_params)]
        scale = np.array([h.real(f"PSCAL{i + 1}", 1.0) for i in range(n_params)])
        zero = np.array([h.real(f"PZERO{i + 1}", 0.0) for i in range(n_params)])
        with open_file(p.path) as f:
            f.seek(p.hdu.data_offset + p.first * (n_params + n) * kind.itemsize)
            raw = np.frombuffer(f.read((p.last - p.first) * (n_params + n) * kind.itemsize), dtype=kind).astype(np.float64).reshape(-1, n_params + n)
        for k, row in enumerate(raw):
            data = h.real("BZERO", 0.0) + h.real("BSCALE", 1.0) * row[n_params:]
            yield p.path, p.first + k, names, (zero + scale * row[:n_params]).tolist(), data.tolist()


class DataUnits(CatalogSource):
    """The bytes of all data units, without fill, in chunks: path, hdu, offset (within the unit) and bytes."""

    @classmethod
    def name(cls) -> str:
        return "hdu_data"

    def schema(self) -> str:
        return "path string, hdu int, offset long, bytes binary"

    @staticmethod
    def rows(path: str) -> Iterator[tuple]:
        with open_file(path) as f:
            for h in hdus_of(path):
                whole(h)
                for at in range(0, h.data_bytes, CHUNK):
                    f.seek(h.data_offset + at)
                    yield path, h.index, at, f.read(min(CHUNK, h.data_bytes - at))


class ChecksumSource(CatalogSource):
    """What each HDU's checksums say: path, hdu, data_sum, hdu_sum, datasum_ok and checksum_ok (null without the keyword).

    A sum adds up over chunks, so no unit is held whole.
    """

    @classmethod
    def name(cls) -> str:
        return "hdu_checksums"

    def schema(self) -> str:
        return "path string, hdu int, data_sum long, hdu_sum long, datasum_ok boolean, checksum_ok boolean"

    @staticmethod
    def rows(path: str) -> Iterator[tuple]:
        with open_file(path) as f:
            for h in hdus_of(path):
                whole(h)

                def total(begin: int, size: int, seed: int = 0) -> int:
                    for at in range(0, size, CHUNK):
                        f.seek(begin + at)
                        seed = ones_sum(f.read(min(CHUNK, size - at)), seed)
                    return seed

                data = total(h.data_offset, padded(h.data_bytes))
                both = total(h.header_offset, h.data_offset - h.header_offset, data)
                said = h.header.text("DATASUM")
                stated = int(said) if said is not None and said.strip().isdigit() and int(said) < 1 << 32 else None
                yield path, h.index, data, both, None if said is None else stated == data, None if h.header.text("CHECKSUM") is None else both == 0xFFFFFFFF


def image_hdus(catalog):
    """The rows of a catalog that hold an image."""
    return catalog.filter("kind in ('Image', 'CompressedImage') or kind = 'Primary' and naxis > 0")


def register(spark: SparkSession) -> None:
    """Make all sources known to the session."""
    for source in (CatalogSource, CardsSource, ImageSource, TableSource, GroupsSource, DataUnits, ChecksumSource):
        spark.dataSource.register(source)
