"""Colours and planes: error diffusion, principal axes of blocks, pictures seen at an angle set right."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of an error that the next sample and the three below it take, in sixteenths.
AHEAD, BELOW_LEFT, BELOW, BELOW_RIGHT = 7, 3, 5, 1


def dithered(df: DataFrame, key: str, column: str, palette: list[float], width: int) -> DataFrame:
    """key, codes: each sample's nearest palette value (ties: the first), after what its neighbours' errors have left it.

    A picture's samples depend on each other in order, so a batch goes through them once with all its pictures side by
    side; what is carried are two rows of errors for each. Errors that leave the picture are lost. Null pictures give null.
    """
    colours = np.array(palette)

    def run(batches):
        for b in batches:
            col = b.column(1)
            known = col.is_valid().to_numpy(zero_copy_only=False)
            v = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(known.sum()), -1)
            height = v.shape[1] // width if len(v) else 0
            codes = np.zeros((len(v), height * width), np.int32)
            below = np.zeros((len(v), width + 2))
            for y in range(height):
                row, below = below, np.zeros((len(v), width + 2))
                for x in range(width):
                    want = v[:, y * width + x] + row[:, x + 1]
                    code = np.abs(want[:, None] - colours).argmin(axis=1)
                    error = want - colours[code]
                    codes[:, y * width + x] = code
                    row[:, x + 2] += error * AHEAD / 16
                    below[:, x] += error * BELOW_LEFT / 16
                    below[:, x + 1] += error * BELOW / 16
                    below[:, x + 2] += error * BELOW_RIGHT / 16
            sizes = np.where(known, height * width, 0)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()), mask=pa.array(~known) if not known.all() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "codes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(column).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, codes array<int>")


def principal_axes(points: DataFrame, keys: list[str], columns: tuple[str, str, str], steps: int = 8) -> DataFrame:
    """keys, m0 to m2 (mean) and a0 to a2 (axis of greatest spread, of length 1) of each block of points.

    The covariance comes of grouped sums, the axis of a power iteration of a fixed number of steps from (1, 1, 1). Blocks
    without spread along it have the axis 0.
    """
    n = range(3)
    sums = [F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)]
    sums += [F.covar_pop(columns[i], columns[j]).alias(f"c{i}{j}") for i in n for j in n if i <= j]
    rows = points.groupBy(*keys).agg(*sums)
    cov = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")

    def step(axis: Column, _: Column) -> Column:
        out = [sum((cov(i, j) * axis[j] for j in n), F.lit(0.0)) for i in n]
        size = F.sqrt(sum((o * o for o in out), F.lit(0.0)))
        return F.array(*[F.when(size > 1e-9, o / size).otherwise(F.lit(0.0)) for o in out])

    rows = rows.withColumn("_axis", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*[F.lit(1.0)] * 3), step))
    return rows.select(*keys, "m0", "m1", "m2", *[F.col("_axis")[i].alias(f"a{i}") for i in n])


def gathered(pixels: DataFrame, key: str, side: int, homography: list[list[float]], background: float = 128.0) -> DataFrame:
    """key, y, x, v: pictures (key, y, x, v; side by side) set right: each sample of the plane takes the four around its place in the picture.

    homography maps (x, y, 1) of the plane to the picture. The samples' weights are a table of four rows a sample of the
    plane, side squared times four at most, which is broadcast; places outside the picture show the background.
    """
    h = homography
    target = pixels.sparkSession.range(side * side).select(F.floor(F.col("id") / side).alias("ty"), (F.col("id") % side).alias("tx"))
    at = lambda r: h[r][0] * F.col("tx") + h[r][1] * F.col("ty") + h[r][2]
    target = target.withColumn("w", at(2)).withColumn("sx", at(0) / F.col("w")).withColumn("sy", at(1) / F.col("w"))
    target = target.withColumn("fx", F.floor("sx")).withColumn("fy", F.floor("sy"))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    target = target.select("*", near.alias("d")).select("ty", "tx", (F.col("fy") + F.col("d.dy")).alias("y"), (F.col("fx") + F.col("d.dx")).alias("x"), (
        (1 - F.abs(F.col("sx") - F.col("fx") - F.col("d.dx"))) * (1 - F.abs(F.col("sy") - F.col("fy") - F.col("d.dy")))).alias("part"))
    inside = F.broadcast(target.filter(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1) & (F.col("part") > 0)))
    got = pixels.join(inside, ["y", "x"]).groupBy(key, "ty", "tx").agg((F.sum(F.col("v") * F.col("part")) + background * (1 - F.sum("part"))).alias("v"))
    return got.select(key, F.col("ty").alias("y"), F.col("tx").alias("x"), "v")
