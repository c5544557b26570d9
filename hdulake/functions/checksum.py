"""The 32-bit ones'-complement checksum of data units, its text form, and its sum over a DataFrame of chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_M = 0xFFFFFFFF


def ones_sum(data: bytes, seed: int = 0) -> int:
    """Sum of big-endian words with end-around carry; a ragged end is filled with zeros."""
    total = seed + int(np.frombuffer(data + bytes(-len(data) % 4), dtype=">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & _M) + (total >> 32)
    return total


def encode(total: int, complement: bool = True) -> str:
    """Sixteen characters: each byte of the sum in four, no punctuation, rotated right by one."""
    value = _M - total if complement else total
    out = [0] * 16
    for i in range(4):
        byte = value >> 24 - 8 * i & 0xFF
        four = [byte // 4 + 48] * 4
        four[0] += byte % 4
        moved = True
        while moved:
            moved = False
            for j in (0, 2):
                while any(58 <= x <= 64 or 91 <= x <= 96 for x in four[j : j + 2]):
                    four[j] += 1
                    four[j + 1] -= 1
                    moved = True
        for j in range(4):
            out[4 * j + i] = four[j]
    return bytes(out[-1:] + out[:-1]).decode("ascii")


@F.pandas_udf(LongType())
def chunk_sum(chunk: pd.Series, offset: pd.Series) -> pd.Series:
    """A chunk's part of the sum; ``offset`` is the byte at which the chunk begins."""
    return pd.Series([ones_sum(bytes(int(o) % 4) + bytes(c)) for c, o in zip(chunk, offset, strict=True)], dtype="int64")


def fold(total: Column) -> Column:
    """The end-around carry of a sum of parts: a total that isn't zero folds to 1..2^32-1."""
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(F.pmod(total - 1, F.lit(_M)) + 1)
