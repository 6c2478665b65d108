"""Tables by name, and the roles that the driver tables play for packet analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after joining at which quality is measured.
MARKS = (1, 2, 5, 10, 20, 40, 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mark(number: Column) -> Column:
    """The n-th time mark, from 1."""
    return F.element_at(F.array(*[F.lit(m) for m in MARKS]), number)


def millis(ts: str = "ts") -> Column:
    """Milliseconds since 1970 as a double, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) / 1000.0D")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of an evaluation: codec, policy, image, seed, t, metric, bpp from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("codec"), F.col("l_linestatus").alias("policy"), F.col("l_suppkey").alias("image"),
        F.col("l_orderkey").alias("seed"), mark(F.col("l_linenumber")).alias("t"), F.col("l_discount").alias("metric"),
        F.col("l_quantity").alias("bpp"), F.col("l_tax").alias("quality"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded frames from events: an epoch per user, torn frames are errors, empty ones sign-ups, local ones views."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("epoch"), F.col("event_id").alias("seq"), millis().alias("time_ms"), "value",
        (F.col("event_type") == "error").alias("torn"), (F.col("event_type") == "signup").alias("zero"),
        F.when(F.col("event_type") == "view", "local").otherwise("remote").alias("board"), F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
