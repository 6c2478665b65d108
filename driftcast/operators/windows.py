"""Runs, gaps, bursts, as-of fills and joins by time, as windows over keyed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, keys: list[str], time: str, out: str = "gap") -> DataFrame:
    """Time since the row before in the same key; null for the first."""
    return df.withColumn(out, F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Maximal runs of rows with flag: keys, run, length; the last run counts though nothing ends it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", flag).withColumn("_rn", F.row_number().over(w))
    inner = Window.partitionBy(*keys, "_f").orderBy(*order)
    marked = marked.withColumn("_island", F.col("_rn") - F.row_number().over(inner)).filter("_f")
    return marked.groupBy(*keys, "_island").agg(F.min("_rn").alias("first_row"), F.count("*").alias("length")).drop("_island")


def rising_edges(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Number of times that flag turns on, per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    on = df.withColumn("_f", flag).withColumn("_b", F.lag("_f", 1, False).over(w))
    return on.groupBy(*keys).agg(F.count_if(F.col("_f") & ~F.col("_b")).alias("episodes"))


def bursts(df: DataFrame, keys: list[str], time: str, limit: float) -> DataFrame:
    """df with burst: its number within the key; a gap over limit begins the next."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(w) > limit, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str, strict: bool = False) -> DataFrame:
    """left with the last value of right at or before (strict: before) its time, by key.

    Both sides are put in one order per key and the last value is carried on, so no row meets
    another by a range join.
    """
    side = F.lit(1 if strict else 0)
    a = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, time, F.col(value).alias("_value")).withColumn("_side", side)
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    mine = 0 if strict else 1
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(w)).filter(F.col("_side") == mine).drop("_side", "_value")


def next_within(left: DataFrame, right: DataFrame, keys: list[str], time: str, horizon: float, out: str) -> DataFrame:
    """left with the first time of right in [time, time + horizon) by key, null if none."""
    a = left.withColumn("_side", F.lit(0)).withColumn("_t", F.lit(None).cast("double"))
    b = right.select(*keys, time, F.col(time).cast("double").alias("_t")).withColumn("_side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn(out, F.first("_t", ignorenulls=True).over(w)).filter("_side = 0").drop("_side", "_t")
    return found.withColumn(out, F.when(F.col(out) < F.col(time) + horizon, F.col(out)))


def in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """points joined with the spans [start, end] that hold them, by key and by time buckets of a width.

    A span is in every bucket that it touches, so the join is one of equal keys.
    """
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_b", F.floor(F.col(time) / width)).join(cut, [*keys, "_b"]).filter(
        (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_b")


def counter_steps(df: DataFrame, keys: list[str], order: list[str], counter: str, modulus: int = 256) -> DataFrame:
    """Per key: steps of one, steps back and values skipped of a wrapping counter, repeats left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = df.withColumn("_p", F.lag(counter).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.col(counter)))
    d = F.pmod(F.col(counter) - F.lag(counter).over(w), F.lit(modulus))
    steps = changed.withColumn("_d", d)
    return steps.groupBy(*keys).agg(
        F.count_if(F.col("_d") == 1).alias("ok"), F.count_if(F.col("_d") > modulus / 2).alias("reordered"),
        F.coalesce(F.sum(F.when((F.col("_d") > 1) & (F.col("_d") <= modulus / 2), F.col("_d") - 1)), F.lit(0)).cast("long").alias("skipped"))


def last_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def replaced(base: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Rows of base whose key newer does not have, and all of newer."""
    return base.join(newer.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(newer)
