"""Stored values to physical ones, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the format: the zero that makes a signed type an unsigned one (or bytes signed), by stored type.
UNSIGNED_ZERO = {"short": 1 << 15, "int": 1 << 31, "long": 1 << 63, "byte": -128}


def physical(raw: Column, scale: float = 1.0, zero: float = 0.0, blank: int | None = None, as_null: bool = False) -> Column:
    """zero + scale * raw; the integer ``blank`` gives NaN, or null if asked for."""
    value = F.lit(float(zero)) + F.lit(float(scale)) * raw.cast("double")
    if blank is None:
        return value
    return F.when(raw == F.lit(blank), F.lit(None) if as_null else F.lit(float("nan"))).otherwise(value)


def physical_f32(raw: Column, *args, **options) -> Column:
    return physical(raw, *args, **options).cast("float")


def physical_array(raw: Column, scale: float = 1.0, zero: float = 0.0, blank: int | None = None) -> Column:
    return F.transform(raw, lambda x: physical(x, scale, zero, blank))


def physical_complex(raw: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    """Scale and zero apply to each component."""
    return F.struct(physical(raw["re"], scale, zero).alias("re"), physical(raw["im"], scale, zero).alias("im"))


def unsigned(raw: Column, stored: str) -> Column:
    """Exact unsigned values (signed ones of bytes); 64-bit ones as decimals."""
    if stored == "long":
        return raw.cast("decimal(20,0)") + F.lit(str(UNSIGNED_ZERO[stored])).cast("decimal(20,0)")
    return raw.cast("long" if stored == "int" else "int") + F.lit(UNSIGNED_ZERO[stored])


def stored_unsigned(value: Column, stored: str) -> Column:
    """The stored values of unsigned ones (of signed ones for bytes): what ``unsigned`` gives back."""
    wide = "decimal(20,0)" if stored == "long" else "long"
    return (value.cast(wide) - F.lit(str(UNSIGNED_ZERO[stored])).cast(wide)).cast("short" if stored == "byte" else stored)


def scaling_of(header) -> tuple[float, float, int | None]:
    """BSCALE, BZERO and BLANK of a header."""
    return header.real("BSCALE", 1.0), header.real("BZERO", 0.0), header.integer("BLANK")


#: Fixed by the format: the sample types of BITPIX, and those that the unsigned zero makes of them.
_SAMPLES = {8: ("u8", "i8"), 16: ("i16", "u16"), 32: ("i32", "u32"), 64: ("i64", "u64"), -32: ("f32", "f32"), -64: ("f64", "f64")}


def sample_type(bitpix: int, scale: float, zero: float) -> str:
    """The type of an image's samples: exact where scale and zero are those of a convention, else f64."""
    stored, shifted = _SAMPLES[bitpix]
    if (scale, zero) == (1.0, 0.0):
        return stored
    conventional = UNSIGNED_ZERO.get({8: "byte", 16: "short", 32: "int", 64: "long"}.get(bitpix, ""))
    return shifted if scale == 1.0 and zero == conventional else "f64"


def is_exact_unsigned(stored: str, scale: float, zero: float, blank: int | None) -> bool:
    return scale == 1 and blank is None and zero == UNSIGNED_ZERO.get(stored)


def axis_of(flat: Column, shape: list[int], axis: int) -> Column:
    """The 0-based place along an axis of a pixel's flat index (first axis fastest)."""
    stride = 1
    for n in shape[:axis]:
        stride *= n
    return F.pmod(F.floor(flat / F.lit(stride)), F.lit(shape[axis])).cast("long")


def logical(byte: Column) -> Column:
    return F.when(byte == 84, True).when(byte == 70, False)


def text(cell: Column) -> Column:
    return F.rtrim(F.substring_index(cell, "\0", 1))


def named_parameter(names: Column, values: Column, name: str) -> Column:
    """The sum over all parameters of that name; null if there is none."""
    own = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: p["n"] == F.lit(name))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, p: a + p["v"]))
