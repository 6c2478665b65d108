"""Pictures as tables: samples in long form, shapes laid over each other, and scores of whole planes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.functions.transforms import LIFTING, SCALE


def samples(blocks: DataFrame, key: str, block: str, width: int) -> DataFrame:
    """key, y, x, v of every sample of blocks kept in rows."""
    return blocks.select(key, F.posexplode(block).alias("i", "v")).select(key, F.floor(F.col("i") / width).alias("y"), (F.col("i") % width).cast("long").alias("x"), "v")


def area_table(spark: SparkSession, n: int, m: int) -> DataFrame:
    """i, o, part: the share of sample i in box o when n samples become m boxes."""
    grid = spark.range(n).select(F.col("id").alias("i")).crossJoin(spark.range(m).select(F.col("id").alias("o")))
    part = F.least(F.col("i") + 1, (F.col("o") + 1) * n / m) - F.greatest(F.col("i"), F.col("o") * n / m)
    return grid.withColumn("part", part * m / n).filter("part > 1e-12")


def area_resize(pixels: DataFrame, key: str, n: int, m: int) -> DataFrame:
    """Box averages of square pictures: one join and sum per side with a table of m * (n / m + 2) weights."""
    w = F.broadcast(area_table(pixels.sparkSession, n, m))  # a few weights
    rows = pixels.join(w, pixels["x"] == w["i"]).groupBy(key, "y", F.col("o").alias("ox")).agg(F.sum(F.col("v") * F.col("part")).alias("v"))
    return rows.join(w, rows["y"] == w["i"]).groupBy(key, F.col("o").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("v") * F.col("part")).alias("v"))


def ancestors_fill(known: DataFrame, keys: list[str], width: int, levels: int = 3) -> DataFrame:
    """Every cell of a square grid with its own value or that of the nearest lattice ancestor: steps 1, 2, 4, ...

    known: keys, y, x, v of the received cells; only their pictures are filled.
    """
    spine = known.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))).withColumn(
        "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    steps = spine.withColumn("s", F.explode(F.array(*[F.lit(1 << k) for k in range(levels + 1)])))
    steps = steps.select(*keys, "y", "x", "s", (F.col("y") - F.col("y") % F.col("s")).alias("ay"), (F.col("x") - F.col("x") % F.col("s")).alias("ax"))
    have = known.select(*keys, F.col("y").alias("ay"), F.col("x").alias("ax"), "v")
    found = steps.join(have, [*keys, "ay", "ax"], "left")
    return found.groupBy(*keys, "y", "x").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("s"))).alias("v"))


def covered(shapes: DataFrame, size: int) -> DataFrame:
    """shapes with each pixel (y, x) that an ellipse covers: a shape is dealt to the pixels of its own bounding box, so the work is the shapes' area."""
    turned = shapes.withColumn("_cos", F.cos("angle")).withColumn("_sin", F.sin("angle"))  # once for a shape, not for each pixel
    half = lambda along, across: F.sqrt(F.pow(F.col("rx") * F.col(along), F.lit(2)) + F.pow(F.col("ry") * F.col(across), F.lit(2))) + 0.51
    turned = turned.withColumn("_w", half("_cos", "_sin")).withColumn("_h", half("_sin", "_cos"))

    def span(c: str, reach: str) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - F.col(reach))).cast("long"), F.least(F.lit(size - 1), F.ceil(F.col(c) + F.col(reach))).cast("long"))

    near = turned.filter((F.col("cx") + F.col("_w") >= 0) & (F.col("cy") + F.col("_h") >= 0) & (F.col("cx") - F.col("_w") < size) & (F.col("cy") - F.col("_h") < size))
    each = near.withColumn("y", F.explode(span("cy", "_h"))).withColumn("x", F.explode(span("cx", "_w")))
    dx, dy = F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")
    u, v = dx * F.col("_cos") + dy * F.col("_sin"), dy * F.col("_cos") - dx * F.col("_sin")
    inside = each.filter(u * u / (F.col("rx") * F.col("rx")) + v * v / (F.col("ry") * F.col("ry")) <= 1)
    return inside.drop("_cos", "_sin", "_w", "_h")


def render(shapes: DataFrame, key: str, size: int, background: float = 128.0) -> DataFrame:
    """key, y, x, v of pictures of ellipses laid over each other in the order of ord; each pixel folds what covers it in order."""
    layers = covered(shapes, size).groupBy(key, "y", "x").agg(F.array_sort(F.collect_list(F.struct("ord", "colour", "alpha"))).alias("l"))
    laid = F.aggregate("l", F.lit(background), lambda v, s: v * (1 - s["alpha"]) + s["colour"] * s["alpha"])
    return layers.select(key, "y", "x", laid.alias("v"))


def prefix_received(units: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Length of the unbroken run of sequence numbers from 0 that has arrived, per key."""
    rows = units.select(*keys, seq).distinct()
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(seq)) - 1
    return rows.withColumn("_rn", rn).groupBy(*keys).agg(F.count_if(F.col(seq) == F.col("_rn")).alias("prefix"))


def lifting(df: DataFrame, key: str, place: str, value: str, n: int) -> DataFrame:
    """One level of the 9/7 wavelet by four lifting steps, with mirrored ends; even places hold the low band.

    df holds places 0 to n - 1 (n even) of each key in long form; a step is a window of neighbours.
    """
    w = Window.partitionBy(key).orderBy(place)
    cur = df.select(key, place, F.col(value).alias("_v"))
    for parity, a in zip((1, 0, 1, 0), LIFTING):
        before, after = F.lag("_v").over(w), F.lead("_v").over(w)
        around = F.coalesce(before, after) + F.coalesce(after, before)
        cur = cur.select(key, place, F.when(F.col(place) % 2 == parity, F.col("_v") + a * around).otherwise(F.col("_v")).alias("_v"))
    scale = SCALE
    return cur.select(key, place, F.when(F.col(place) % 2 == 1, F.col("_v") / scale).otherwise(F.col("_v") * scale).alias(value))


def score_planes(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """id, ssim, msssim of pairs of planes (reference, coded: arrays in rows)."""
    def run(batches):
        import numpy as np

        from driftcast.functions.images import multi_scale, similarity

        for pdf in batches:
            shape = lambda a: np.asarray(a, float).reshape(height, width)
            each = [(shape(a), shape(b)) for a, b in zip(pdf["reference"], pdf["coded"])]
            yield pd.DataFrame({"id": pdf["id"], "ssim": [similarity(a, b)[0] for a, b in each], "msssim": [multi_scale(a, b) for a, b in each]})

    return pairs.select("id", "reference", "coded").mapInPandas(run, "id long, ssim double, msssim double")
