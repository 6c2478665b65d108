"""Grouped measures of evaluation reports: two-level means, curves over time, medians, envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcast.sources.tables import MARKS


def two_level_mean(df: DataFrame, group: list[str], image: str, t: str, value: str) -> DataFrame:
    """Mean over seeds per image and mark, then the plain mean over images; images that lack a mark are left out."""
    per = df.groupBy(*group, image, t).agg(F.avg(value).alias("m"))
    curves = per.groupBy(*group, image).agg(F.collect_list(F.struct(F.col(t), F.col("m"))).alias("c"))
    full = curves.filter(F.size("c") == len(MARKS)).select(*group, image, F.explode("c").alias("p"))
    return full.groupBy(*group, F.col(f"p.{t}").alias(t)).agg(F.avg("p.m").alias(value), F.count("*").alias("images"))


def log_auc(df: DataFrame, group: list[str], t: str, value: str) -> DataFrame:
    """Area under value over ln t by trapezes, divided by ln of the last mark; curves lacking a mark are left out."""
    at = [F.max(F.when(F.col(t) == m, F.col(value))).alias(f"v{m}") for m in MARKS]
    area = sum(((F.col(f"v{a}") + F.col(f"v{b}")) / 2 * math.log(b / a) for a, b in zip(MARKS, MARKS[1:])), F.lit(0.0))
    return df.groupBy(*group).agg(*at).select(*group, (area / math.log(MARKS[-1])).alias("auc")).filter("auc is not null")


def upper_percentile(x: str, p: float) -> Column:
    """Sorted value number floor(p * n), from 0, or the last.

    A discrete percentile a hair above p is that value. It counts equal values before the
    shuffle; the task of a group holds each of its distinct values once, which for measures of
    fine grain is about one a row, so groups are meant to be of a size that a task can hold.
    """
    return F.expr(f"percentile_disc({min(1.0, p + 1e-12)!r}D) within group (order by `{x}`)")


def upper_median(x: str) -> Column:
    """The middle value, the greater of two."""
    return upper_percentile(x, 0.5)


def entropy(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Shannon entropy of the values of each group, in bits."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    # Per group: log2(N) - sum(n log2 n) / N, so no window over the group is needed.
    return n.groupBy(*group).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2(F.col("n"))) / F.sum("n")).alias("entropy"),
                                 F.count("*").alias("symbols"), F.sum("n").alias("n"))


def envelope_crossing(df: DataFrame, group: list[str], x: str, y: str, level: float) -> DataFrame:
    """Least x at which the running maximum of y reaches level, interpolated over ln x; null if never.

    Points that do not rise above all before them are left out. The first point on the
    envelope at or above the level counts as it is if nothing comes before it.
    """
    order = Window.partitionBy(*group).orderBy(x, F.desc(y))
    above = F.max(y).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.filter(F.col(y).isNotNull()).withColumn("_top", above).filter(F.col("_top").isNull() | (F.col(y) > F.col("_top")))
    kept = kept.withColumn("_x", F.lag(x).over(order)).withColumn("_y", F.lag(y).over(order))
    part = F.try_divide(F.lit(level) - F.col("_y"), F.col(y) - F.col("_y"))
    at = F.when(F.col("_x").isNull(), F.col(x)).otherwise(F.exp(F.log("_x") + part * (F.log(x) - F.log("_x"))))
    return kept.groupBy(*group).agg(F.min(F.when((F.col(y) >= level) & (F.coalesce(F.col("_y"), F.lit(-math.inf)) < level), at)).alias("x"))


def reach(df: DataFrame, group: list[str], t: str, value: str, level: float) -> DataFrame:
    """Seconds at which a curve first reaches level, interpolated over ln t; the first mark if at once, null if never."""
    order = Window.partitionBy(*group).orderBy(t)
    prev_t, prev_v = F.lag(t).over(order), F.lag(value).over(order)
    rows = df.withColumn("_t", prev_t).withColumn("_v", prev_v)
    part = F.try_divide(F.lit(level) - F.col("_v"), F.col(value) - F.col("_v"))
    at = F.when(F.col("_t").isNull(), F.col(t).cast("double")).otherwise(F.col("_t") * F.pow(F.col(t) / F.col("_t"), part))
    first = F.min(F.when(F.col(value) >= level, F.struct(F.col(t).alias("t"), at.alias("at"))))
    return rows.groupBy(*group).agg(first.getField("at").alias("seconds"))


def share_ranks(df: DataFrame, group: list[str], gain: str, order: list, shares: tuple[float, ...]) -> DataFrame:
    """How many units, in order, hold each share of the group's total gain, and the share of the last tenth."""
    w = Window.partitionBy(*group).orderBy(*order)
    all_rows = Window.partitionBy(*group)
    rows = df.select("*", F.row_number().over(w).alias("_rn"), F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
                     F.sum(gain).over(all_rows).alias("_all"), F.count("*").over(all_rows).alias("_n"))
    aggs = [F.min(F.when(F.col("_run") >= s * F.col("_all") - 1e-9, F.col("_rn"))).cast("long").alias(f"units_{round(s * 100)}") for s in shares]
    tail = F.sum(F.when(F.col("_rn") > F.floor(F.col("_n") * 0.9), F.col(gain)).otherwise(0.0)) / F.max("_all")
    return rows.groupBy(*group).agg(*aggs, tail.alias("tail_share"))


def lloyd_step(points: DataFrame, centres: DataFrame, features: str) -> DataFrame:
    """Each point with its nearest centre (least squared distance, ties to the first). centres: cid, centre; a few dozen rows."""
    table = centres.agg(F.sort_array(F.collect_list(F.struct("cid", "centre"))).alias("cs"))
    near = F.transform("cs", lambda c: F.struct(
        F.round(F.aggregate(F.zip_with(F.col(features), c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), 9).alias("d"),
        c["cid"].alias("cid")))
    # One row of centres: its size is that of the palette, not of the data.
    return points.crossJoin(F.broadcast(table)).withColumn("_near", F.array_min(near)).drop("cs")
