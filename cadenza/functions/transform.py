"""The 8x8 block transform: quantisation tables, DCT and its inverse, colour, clipping."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The quantisation tables of annex K of the JPEG standard, by rows.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
# BT.601 weights, and the scales of the two colour differences.
KR, KG, KB = 0.299, 0.587, 0.114


def quant_scale(quality: Column) -> Column:
    return F.when(quality < 50, 5000.0 / quality).otherwise(200.0 - 2.0 * quality)


def quant_step(base: Column, quality: Column) -> Column:
    """A table entry at a quality from 1 to 100."""
    return F.least(F.greatest(F.floor((base * quant_scale(quality) + 50.0) / 100.0), F.lit(1)), F.lit(255)).cast("double")


def quant_table(quality: int, luma: bool = True) -> tuple[int, ...]:
    scale = 5000.0 / quality if quality < 50 else 200.0 - 2.0 * quality
    return tuple(int(min(255, max(1, (b * scale + 50.0) // 100.0))) for b in (LUMA if luma else CHROMA))


@cache
def basis() -> np.ndarray:
    """Row k of 64: the weights of the pixels in coefficient k, for the orthonormal DCT-II in two dimensions."""
    n = np.arange(8)
    one = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 16) * np.where(n == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))[:, None]
    return np.kron(one, one)


def _by_blocks(column: pa.Array, matrix: np.ndarray) -> pa.Array:
    """Each list of 64 times the matrix; null stays null."""
    valid = column.is_valid()
    rows = column.filter(valid) if column.null_count else column
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, 64) @ matrix
    out = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 64, pa.array(x.ravel()))
    if column.null_count:
        at = np.cumsum(valid.to_numpy(zero_copy_only=False)) - 1
        out = out.take(pa.array(at, mask=~valid.to_numpy(zero_copy_only=False)))
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def dct(block: pa.Array) -> pa.Array:
    """Coefficients of blocks of 64 doubles; one matrix product for each Arrow batch."""
    return _by_blocks(block, basis().T)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def idct(coefficients: pa.Array) -> pa.Array:
    return _by_blocks(coefficients, basis())


def by_columns(block: Column, inverse: bool = False) -> Column:
    """The transform as a Column expression, without Python: the same numbers as dct() and idct() up to rounding."""
    rows = basis() if not inverse else basis().T
    matrix = F.array(*(literal(r) for r in rows))
    return F.transform(matrix, lambda r: F.aggregate(F.zip_with(r, block, lambda w, v: w * v), F.lit(0.0), lambda s, x: s + x))


def transformed(block: Column, inverse: bool = False, native: bool = True) -> Column:
    """Coefficients of blocks, or blocks of coefficients: by Arrow and numpy (native), or as a Column expression."""
    return (idct if inverse else dct)(block) if native else by_columns(block, inverse)


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def quantise(coefficients: Column, table: Column) -> Column:
    """Halves go to the even neighbour; the result fits 16 bits."""
    return F.zip_with(coefficients, table, lambda c, q: F.least(F.greatest(F.rint(c / q), F.lit(-32767.0)), F.lit(32767.0)).cast("int"))


def dequantise(levels: Column, table: Column) -> Column:
    return F.zip_with(levels, table, lambda c, q: c * q)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ycbcr(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Signed luma and colour differences of a pixel, without offset."""
    y = KR * r + KG * g + KB * b
    return y, (b - y) * (0.5 / (1 - KB)), (r - y) * (0.5 / (1 - KR))


def bgr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    b = y + cb * ((1 - KB) / 0.5)
    r = y + cr * ((1 - KR) / 0.5)
    return b, (y - KR * r - KB * b) / KG, r
