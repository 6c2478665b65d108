"""Linear transforms of small blocks as matrices, applied to whole Arrow batches; JPEG's tables."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The luminance table of the JPEG standard's Annex K, by rows.
ANNEX_K = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99]
#: The lifting steps and the scale of the 9/7 wavelet.
LIFTING = (-1.586134342, -0.05298011854, 0.8829110762, 0.4435068522)
SCALE = 1.149604398


def quality_steps(quality: int, base: list[int] | None = None) -> list[int]:
    """Quantiser steps for a quality from 1 to 100: integer scaling of a table, 1 to 255."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (b * scale + 50) // 100)) for b in base or ANNEX_K]


def wavelet_matrix(n: int) -> np.ndarray:
    """One level of the 9/7 wavelet over n samples (even): the low band's rows, then the high band's.

    A lifting step adds to every second sample a multiple of its two neighbours; beyond the ends the samples
    are mirrored. Each step is a matrix, so a level is their product.
    """
    total = np.eye(n)
    for k, a in enumerate(LIFTING):
        step = np.eye(n)
        for i in range(1 - k % 2, n, 2):
            for j in (i - 1, i + 1):
                step[i, min(j, 2 * (n - 1) - j) if j >= 0 else -j] += a
        total = step @ total
    order = [*range(0, n, 2), *range(1, n, 2)]
    scale = np.diag([SCALE] * (n // 2) + [1 / SCALE] * (n // 2))
    return scale @ total[order]


@cache
def wavelet_2d(side: int = 8, levels: int = 3) -> np.ndarray:
    """Rows of coefficients over the samples of a square block by rows: each level splits the low quarter again."""
    total = np.eye(side * side)
    for level in range(levels):
        n = side >> level
        one = np.eye(side)
        one[:n, :n] = wavelet_matrix(n)
        part = np.kron(one, one)
        inside = [y * side + x for y in range(n) for x in range(n)]
        whole = np.eye(side * side)
        whole[np.ix_(inside, inside)] = part[np.ix_(inside, inside)]
        total = whole @ total
    return total


@cache
def haar_2d(side: int = 8, levels: int = 2) -> np.ndarray:
    """Rows of an orthonormal Haar basis over the samples of a square block: sums and differences of pairs, the low quarter again for each level."""
    one = np.eye(side)
    for level in range(levels):
        n = side >> level
        step = np.eye(side)
        step[:n, :n] = 0
        for k in range(n // 2):
            step[k, 2 * k:2 * k + 2] = 0.5**0.5
            step[n // 2 + k, 2 * k:2 * k + 2] = 0.5**0.5, -(0.5**0.5)
        one = step @ one
    return np.kron(one, one)


def apply_matrix(df: DataFrame, column: str, matrix: np.ndarray, out: str) -> DataFrame:
    """df with out, the product of a matrix and the array in a column; a batch is one matrix product.

    Arrays are of the matrix's width; null arrays give null. A column named out is replaced.
    """
    df = df.drop(out) if out != column else df
    at, rows = df.columns.index(column), len(matrix)
    names = [*df.columns, out] if out != column else df.columns
    flat = np.ascontiguousarray(matrix.T)

    def run(batches):
        for b in batches:
            col = b.column(at)
            known = col.is_valid().to_numpy(zero_copy_only=False)
            got = np.zeros((b.num_rows, rows))
            got[known] = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(flat)) @ flat
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * rows)
            new = pa.ListArray.from_arrays(offsets, pa.array(got.ravel()), mask=pa.array(~known) if not known.all() else None)
            yield pa.RecordBatch.from_arrays([*b.columns, new] if out != column else [new if k == at else c for k, c in enumerate(b.columns)], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out]
    schema = ", ".join([*fields, f"`{out}` array<double>"]) if out != column else ", ".join(
        f"`{f.name}` {'array<double>' if f.name == out else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)
