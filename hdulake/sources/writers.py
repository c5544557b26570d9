"""Writing files: images, binary, ASCII and compressed tables as HDUs, whole files, and the sinks.

``hdu_table_sink`` writes files of at most ``rows_per_file`` rows from each partition, so no task holds more;
``hdu_image_sink`` writes an image for each partition.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from hdulake.errors import HduError
from hdulake.functions.checksum import encode, ones_sum
from hdulake.sources.header import BLOCK, Card, Header
from hdulake.sources.layout import ELEMENTS

_BITPIX = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}
#: TFORM letters of Spark's types.
_LETTERS = {"boolean": "L", "short": "I", "byte": "I", "integer": "J", "long": "K", "float": "E", "double": "D", "string": "A", "binary": "B"}
#: Keywords of a column that its metadata may give.
_ABOUT = ("tunit", "tscal", "tzero", "tnull", "tdim", "tdisp")


def fill(data: bytes, byte: bytes = b"\0") -> bytes:
    return data + byte * (-len(data) % BLOCK)


def with_checksums(h: Header, data: bytes) -> bytes:
    """The rendered header with DATASUM and CHECKSUM."""
    h.set("DATASUM", str(ones_sum(data))).set("CHECKSUM", "0" * 16)
    return h.set("CHECKSUM", encode(ones_sum(h.render(), ones_sum(data)))).render()


def hdu_bytes(h: Header, data: bytes, checksums: bool = False, byte: bytes = b"\0", cards: list[Card] | None = None) -> bytes:
    """A header and its data unit, with further cards."""
    h.cards += cards or []
    data = fill(data, byte)
    return (with_checksums(h, data) if checksums else h.render()) + data


def primary() -> Header:
    return Header().set("SIMPLE", True).set("BITPIX", 8).set("NAXIS", 0).set("EXTEND", True)


def image_header(pixels: np.ndarray, scale: float = 1.0, zero: float = 0.0, blank: int | None = None, first: bool = True, name: str | None = None) -> Header:
    kind = pixels.dtype.str[1:]
    if kind not in _BITPIX:
        raise HduError("InvalidBitpix", kind)
    h = Header().set("SIMPLE", True) if first else Header().set("XTENSION", "IMAGE")
    h.set("BITPIX", _BITPIX[kind]).set("NAXIS", pixels.ndim)
    for i, n in enumerate(reversed(pixels.shape)):
        h.set(f"NAXIS{i + 1}", n)
    if not first:
        h.set("PCOUNT", 0).set("GCOUNT", 1)
    if (scale, zero) != (1.0, 0.0):
        h.set("BSCALE", float(scale)).set("BZERO", float(zero))
    if blank is not None and _BITPIX[kind] > 0:
        h.set("BLANK", blank)
    return h.set("EXTNAME", name) if name else h


def big_endian(values: np.ndarray) -> bytes:
    return values.astype(values.dtype.newbyteorder(">")).tobytes()


def image_bytes(pixels: np.ndarray, scale: float = 1.0, zero: float = 0.0, blank: int | None = None, first: bool = True, checksums: bool = False, name: str | None = None, cards: list[Card] | None = None) -> bytes:
    """One HDU; the array's last axis is the file's first."""
    return hdu_bytes(image_header(pixels, scale, zero, blank, first, name), big_endian(pixels), checksums, cards=cards)


@dataclass
class Column:
    """A column to be written: either ``fixed``, the rows' bytes, or ``cells`` with their counts (variable length)."""

    name: str
    letter: str
    repeat: int = 1
    fixed: np.ndarray | None = None
    cells: list[bytes] = field(default_factory=list)
    counts: np.ndarray | None = None
    wide: bool = False
    about: dict = field(default_factory=dict)

    @property
    def width(self) -> int:
        """Bytes of a fixed cell."""
        return -(-self.repeat // 8) if self.letter == "X" else self.repeat * np.dtype(ELEMENTS[self.letter]).itemsize

    @classmethod
    def variable(cls, name: str, letter: str, cells: list[bytes], counts=None, wide: bool = False, about: dict | None = None) -> Column:
        width = 1 if letter == "X" else np.dtype(ELEMENTS[letter]).itemsize
        return cls(name, letter, 1, None, cells, np.array([len(c) // width for c in cells] if counts is None else counts, dtype=np.int64), wide, about or {})


def bintable(columns: list[Column], n: int, name: str | None = None) -> tuple[Header, bytes]:
    """Header and data of a binary table. The heap lies row by row; places past 32 bits take the wide descriptors."""
    variable = [c for c in columns if c.fixed is None]
    sizes = np.array([[len(cell) for cell in c.cells] for c in variable], dtype=np.int64).reshape(len(variable), n).T
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape) if sizes.size else sizes
    heap = b"".join(cell for row in zip(*(c.cells for c in variable), strict=True) for cell in row) if variable else b""
    forms, blocks = [], []
    for c in columns:
        if c.fixed is not None:
            forms.append(f"{c.repeat}{c.letter}")
            blocks.append(c.fixed.reshape(n, c.width))
            continue
        k = next(i for i, v in enumerate(variable) if v is c)
        wide = c.wide or len(heap) >= 1 << 32
        forms.append(f"1{'Q' if wide else 'P'}{c.letter}({int(c.counts.max(initial=0))})")
        blocks.append(np.stack([c.counts, ends[:, k] - sizes[:, k]], axis=1).astype(">u8" if wide else ">u4").view(np.uint8))
    body = np.concatenate(blocks, axis=1) if blocks else np.zeros((n, 0), dtype=np.uint8)
    h = Header().set("XTENSION", "BINTABLE").set("BITPIX", 8).set("NAXIS", 2).set("NAXIS1", body.shape[1]).set("NAXIS2", n)
    h.set("PCOUNT", len(heap)).set("GCOUNT", 1).set("TFIELDS", len(forms))
    for i, (c, form) in enumerate(zip(columns, forms, strict=True), 1):
        h.set(f"TTYPE{i}", c.name).set(f"TFORM{i}", form)
        for key in _ABOUT:
            if c.about.get(key) is not None:
                h.set(f"{key.upper()}{i}", c.about[key])
    if name:
        h.set("EXTNAME", name)
    return h, body.tobytes() + heap


def _logical(v) -> int:
    return 0 if v is None else 84 if v else 70


def _array_bytes(f: T.StructField, letter: str, value: list) -> bytes:
    if letter == "L":
        return bytes(map(_logical, value))
    if letter in "CM":
        value = [complex(x["re"], x["im"]) for x in value]
    elif any(x is None for x in value):
        missing = float("nan") if letter in "ED" else (f.metadata or {}).get("tnull")
        if missing is None:
            raise HduError("InvalidValue", f"{f.name} has nulls and no tnull")
        value = [missing if x is None else x for x in value]
    return np.array(value, dtype=ELEMENTS[letter]).tobytes()


def column_of(f: T.StructField, values: list) -> Column:
    """A column of a Spark field's values.

    Scalars are fixed, arrays of variable length unless the field's metadata gives ``repeat`` (a fixed length) or
    ``bits`` (the same, of booleans as bits); strings are as wide as the longest, or cut and filled to ``width`` bytes.
    ``wide`` asks for 64-bit descriptors. A null is NaN, an undefined logical, an empty string or array, or ``tnull``.
    """
    about, n = f.metadata or {}, len(values)
    array = isinstance(f.dataType, T.ArrayType)
    kind = f.dataType.elementType if array else f.dataType
    if isinstance(kind, T.StructType) and kind.names == ["re", "im"]:
        letter = "C" if isinstance(kind[0].dataType, T.FloatType) else "M"
    else:
        letter = _LETTERS.get(kind.typeName())
    if letter is None or array and letter == "A" or array and isinstance(kind, T.BinaryType):
        raise HduError("UnsupportedColumn", f"{f.name} {f.dataType.simpleString()}")
    if isinstance(kind, T.BinaryType):
        return Column.variable(f.name, "B", [bytes(v or b"") for v in values], wide=bool(about.get("wide")), about=about)
    if letter == "A":
        raw = [(v or "").encode() for v in values]
        width = int(about.get("width") or max([1, *map(len, raw)]))
        return Column(f.name, "A", width, np.frombuffer(b"".join(r[:width].ljust(width) for r in raw), dtype=np.uint8).reshape(n, width), about=about)
    if not array:
        if letter not in "LCMED" and any(v is None for v in values) or letter in "CM":
            values = [{"re": float("nan"), "im": float("nan")} if letter in "CM" and v is None else v for v in values]
        return Column(f.name, letter, 1, np.frombuffer(_array_bytes(f, letter, values), dtype=np.uint8), about=about)
    fixed = about.get("bits") or about.get("repeat")
    if fixed is None:
        cells = [_array_bytes(f, letter, v or []) for v in values]
        return Column.variable(f.name, letter, cells, wide=bool(about.get("wide")), about=about)
    if any(v is None or len(v) != fixed for v in values):
        raise HduError("RowWidthMismatch", f.name)
    if about.get("bits"):
        return Column(f.name, "X", fixed, np.packbits(np.array(values, dtype=bool).reshape(n, fixed), axis=1), about=about)
    return Column(f.name, letter, fixed, np.frombuffer(b"".join(_array_bytes(f, letter, v) for v in values), dtype=np.uint8), about=about)


def table_bytes(schema: T.StructType, columns: list[list], checksums: bool = False, name: str | None = None, cards: list[Card] | None = None) -> bytes:
    """A binary table HDU of the columns' values."""
    n = len(columns[0]) if columns else 0
    h, data = bintable([column_of(f, v) for f, v in zip(schema.fields, columns, strict=True)], n, name)
    return hdu_bytes(h, data, checksums, cards=cards)


def ascii_bytes(schema: T.StructType, columns: list[list], checksums: bool = False, name: str | None = None, cards: list[Card] | None = None) -> bytes:
    """An ASCII table HDU: columns without gaps, text to the left, numbers to the right.

    The metadata of a field may give ``width`` and ``decimals``. What doesn't fit is a row of stars; a null or a number
    that isn't finite is the text ``tnull``, or blank.
    """
    h = Header().set("XTENSION", "TABLE").set("BITPIX", 8).set("NAXIS", 2)
    n, at, cells, about = len(columns[0]) if columns else 0, 0, [], Header()
    for i, (f, values) in enumerate(zip(schema.fields, columns, strict=True), 1):
        m = f.metadata or {}
        kind, null = f.dataType.typeName(), str(m.get("tnull") or "")
        if kind == "string":
            plain, form = [v if v is not None else null for v in values], "A{w}"
        elif kind in ("byte", "short", "integer", "long"):
            plain, form = [null if v is None else str(v) for v in values], "I{w}"
        elif kind in ("float", "double"):
            digits = int(m.get("decimals", 8 if kind == "float" else 16))
            plain, form = [null if v is None or v - v != 0 else f"{v:.{digits}E}" for v in values], ("E" if kind == "float" else "D") + f"{{w}}.{digits}"
            if kind == "double":
                plain = [p if p == null else p.replace("E", "D") for p in plain]
        else:
            raise HduError("UnsupportedColumn", f"{f.name} {f.dataType.simpleString()}")
        raw = [p.encode("ascii", "replace") for p in plain]
        width = int(m.get("width") or max([1, *map(len, raw)]))
        text = kind == "string"
        cells.append([r[:width].ljust(width) if text else b"*" * width if len(r) > width else r.rjust(width) for r in raw])
        about.set(f"TTYPE{i}", f.name).set(f"TFORM{i}", form.format(w=width)).set(f"TBCOL{i}", at + 1)
        for key in ("tunit", "tscal", "tzero", "tnull", "tdisp"):
            if m.get(key) is not None:
                about.set(f"{key.upper()}{i}", null if key == "tnull" else m[key])
        at += width
    h.set("NAXIS1", at).set("NAXIS2", n).set("PCOUNT", 0).set("GCOUNT", 1).set("TFIELDS", len(cells))
    h.cards += about.cards
    if name:
        h.set("EXTNAME", name)
    return hdu_bytes(h, b"".join(b"".join(row) for row in zip(*cells, strict=True)), checksums, b" ", cards)


class FileWriter:
    """HDUs one after the other into a binary file; a table that comes first gets a primary HDU without data."""

    def __init__(self, out, checksums: bool = False):
        self.out, self.checksums, self.begun = out, checksums, False

    def _extension(self) -> None:
        if not self.begun:
            self.out.write(hdu_bytes(primary(), b"", self.checksums))
            self.begun = True

    def image(self, pixels: np.ndarray, **options) -> FileWriter:
        self.out.write(image_bytes(pixels, first=not self.begun, checksums=self.checksums, **options))
        self.begun = True
        return self

    def table(self, schema: T.StructType, columns: list[list], **options) -> FileWriter:
        self._extension()
        self.out.write(table_bytes(schema, columns, self.checksums, **options))
        return self

    def ascii_table(self, schema: T.StructType, columns: list[list], **options) -> FileWriter:
        self._extension()
        self.out.write(ascii_bytes(schema, columns, self.checksums, **options))
        return self

    def compressed_image(self, pixels: np.ndarray, codec: str, **options) -> FileWriter:
        from hdulake.sources.tiles import compress_image

        self._extension()
        self.out.write(hdu_bytes(*compress_image(pixels, codec, **options), self.checksums))
        return self

    def compressed_table(self, schema: T.StructType, columns: list[list], codec: str = "GZIP_2", rows_per_tile: int = 4096, **options) -> FileWriter:
        from hdulake.sources.tiles import compress_table

        self._extension()
        n = len(columns[0]) if columns else 0
        self.out.write(hdu_bytes(*compress_table([column_of(f, v) for f, v in zip(schema.fields, columns, strict=True)], n, codec, rows_per_tile, **options), self.checksums))
        return self

    def raw(self, h: Header, data: bytes = b"", byte: bytes = b"\0") -> FileWriter:
        """A header and data unit as they are. The first is the primary one."""
        self.out.write(h.render() + fill(data, byte))
        self.begun = True
        return self


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class _FolderWriter(DataSourceArrowWriter):
    """Files under hidden names from the tasks; they get theirs when all have ended, and those before go on overwrite."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.folder, self.overwrite = schema, options["path"].removeprefix("file://"), overwrite
        self.options, self.job = options, uuid.uuid4().hex[:12]
        self.checksums = options.get("checksum") == "true"

    def _path(self, k: int) -> str:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        return f"{self.folder}/.part-{task.partitionId():05d}-{k:05d}-{self.job}-{task.attemptNumber()}"

    def commit(self, messages: list[Written | None]) -> None:
        old = glob.glob(f"{self.folder}/part-*.fits") if self.overwrite else []
        for k, path in enumerate(path for m in messages if m for path in m.paths):
            os.replace(path, f"{self.folder}/part-{k:05d}-{self.job}.fits")
        for path in old:
            os.remove(path)

    def abort(self, messages: list[Written | None]) -> None:
        for path in glob.glob(f"{self.folder}/.part-*-{self.job}-*"):
            os.remove(path)


class TableSink(DataSource):
    """``df.write.format("hdu_table_sink").save(folder)``.

    Options: checksum, extname, rows_per_file, ``ascii`` ("true") for ASCII tables, and codec for compressed ones.
    """

    @classmethod
    def name(cls) -> str:
        return "hdu_table_sink"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TableWriter(schema, dict(self.options), overwrite)


class _TableWriter(_FolderWriter):
    def write(self, batches: Iterator) -> Written:
        most, paths = int(self.options.get("rows_per_file", 1 << 18)), []
        waiting: list[pa.RecordBatch] = []

        def flush() -> None:
            columns = [[v for b in waiting for v in b.column(i).to_pylist()] for i in range(len(self.schema.fields))]
            paths.append(self._path(len(paths)))
            name = {"name": self.options["extname"]} if "extname" in self.options else {}
            with open(paths[-1], "wb") as f:
                out = FileWriter(f, self.checksums)
                if "codec" in self.options:
                    out.compressed_table(self.schema, columns, self.options["codec"], **name)
                elif self.options.get("ascii") == "true":
                    out.ascii_table(self.schema, columns, **name)
                else:
                    out.table(self.schema, columns, **name)
            waiting.clear()

        rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - rows)
                waiting.append(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                if rows == most:
                    flush()
                    rows = 0
        if waiting or not paths:
            flush()
        return Written(paths)


class ImageSink(DataSource):
    """``hdu_image_sink``: rows (flat, raw) are the pixels of images of the option ``axes``, "64,48" say, a file for each.

    A partition is one image, or the images that a column ``image`` tells apart, one after the other; all pixels of an image lie in
    one partition, together. Further options: scale, zero, blank, extname, checksum, and codec (with tile, "32,32" say).
    """

    @classmethod
    def name(cls) -> str:
        return "hdu_image_sink"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not {"flat", "raw"} <= set(schema.names):
            raise HduError("ColumnNotFound", "flat, raw")
        return _ImageWriter(schema, dict(self.options), overwrite)


class _ImageWriter(_FolderWriter):
    def write(self, batches: Iterator) -> Written:
        axes, paths = [int(x) for x in self.options["axes"].split(",")], []
        n, waiting, now = int(np.prod(axes)), [], None

        def flush() -> None:
            flat, raw = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            if len(flat) != n or not np.array_equal(np.sort(flat), np.arange(n)):
                raise HduError("DataSizeMismatch", f"{len(flat)} pixels for {axes}")
            pixels = np.empty(n, dtype=raw.dtype)
            pixels[flat] = raw
            paths.append(self._path(len(paths)))
            self._save(paths[-1], pixels.reshape(axes[::-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, raw = (batch.column(self.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("flat", "raw"))
            image = batch.column(self.schema.names.index("image")).to_numpy(zero_copy_only=False) if "image" in self.schema.names else np.zeros(len(flat))
            edges = [0, *(np.flatnonzero(image[1:] != image[:-1]) + 1).tolist(), len(flat)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if waiting and image[a] != now:
                    flush()
                now = image[a]
                waiting.append((flat[a:b], raw[a:b]))
        if waiting:
            flush()
        return Written(paths)

    def _save(self, path: str, pixels: np.ndarray) -> None:
        o = self.options
        about = {"scale": float(o.get("scale", 1)), "zero": float(o.get("zero", 0)), "blank": int(o["blank"]) if "blank" in o else None, "name": o.get("extname")}
        with open(path, "wb") as f:
            out = FileWriter(f, self.checksums)
            if "codec" in o:
                out.compressed_image(pixels, o["codec"], tile=[int(x) for x in o["tile"].split(",")] if "tile" in o else [], **about)
            else:
                out.image(pixels, **about)


def register(spark: SparkSession) -> None:
    for sink in (TableSink, ImageSink):
        spark.dataSource.register(sink)
