"""Colours and 8 x 8 blocks as Column expressions on arrays of 64 values, in rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftcast.functions.transforms import apply_matrix

#: Orthonormal cosine basis: row u, place x.
BASIS = [[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
#: Quantiser step of each coefficient, wider for higher frequencies.
STEPS = [4.0 + u + v for v in range(8) for u in range(8)]
#: Places of the coefficients in zigzag order: by diagonals, their directions alternating.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def blocks(embeddings: DataFrame, offset: float = 0.0) -> DataFrame:
    """Vectors of 64 values as blocks: vec_id, label, block."""
    return embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 127 + F.lit(offset)).alias("block"))


#: Row v * 8 + u holds the two-dimensional basis picture of a coefficient.
PICTURES = [[BASIS[v][y] * BASIS[u][x] for y in range(8) for x in range(8)] for v in range(8) for u in range(8)]


def dct(df: DataFrame, block: str, out: str) -> DataFrame:
    """df with the two-dimensional cosine transform of a block."""
    return apply_matrix(df, block, np.array(PICTURES), out)


def idct(df: DataFrame, coefficients: str, out: str) -> DataFrame:
    """df with the block of a transform."""
    return apply_matrix(df, coefficients, np.array(PICTURES).T, out)


def quantise(values: Column | str, steps: list[float]) -> Column:
    """Levels: values over steps, half rounded up."""
    table = F.array(*[F.lit(s) for s in steps])
    return F.zip_with(values, table, lambda v, s: F.floor(v / s + 0.5))


def dequantise(levels: Column | str, steps: list[float]) -> Column:
    return F.zip_with(levels, F.array(*[F.lit(s) for s in steps]), lambda v, s: v * s)


def mean(values: Column | str) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def psnr(reference: Column | str, coded: Column | str, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio of two arrays in decibels; 99 if they are equal."""
    error = mean(F.zip_with(reference, coded, lambda a, b: (a - b) * (a - b)))
    return F.when(error == 0, 99.0).otherwise(10 * F.log10(F.lit(peak * peak) / error))


def prefix_sum(values: str, n: int) -> Column:
    """Sum of the first n values."""
    return F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, v: a + v)


def ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma and chroma of full range (fixed values: the weights of BT.601)."""
    return (0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b)
