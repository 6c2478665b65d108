"""Helpers that the training-data operators share: tables and edges to components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftcast.sources.shared import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, text: str, part_bytes: int = 128 << 20) -> int:
    """How many partitions of about part_bytes of text df fills; the session's number of shuffle partitions at least."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in order, halved until each has about limit bytes or one row."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), limit)
    yield from pieces(batch.slice(half), limit)


def map_batches(df: DataFrame, run: Callable, schema: str | T.StructType, limit: int = 4 << 20) -> DataFrame:
    """df.mapInArrow(run, schema), where run gets slices of about limit bytes, however long the texts are.

    What a worker copies out of Arrow and what it sends back at once is so bounded by limit or by its longest
    row. No setting of the session changes.
    """

    def sliced(batches):
        return run(part for b in batches for part in pieces(b, limit))

    return df.mapInArrow(sliced, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about rows rows of batches that are sorted by key, none of which parts a key; only a longer key makes a longer table."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks()
        held, size = rest.to_batches(), 0 if cut else size // 2
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (long, no nulls). Returns node, root: every node that occurs, and the
    smallest node that can be reached from it. Each step is a min() per node, which combines
    before the shuffle, and a join of edges with one row per node. Every round is written to
    the shared folder; the loop ends only when a round changes nothing, which takes about the
    logarithm of the longest path in rounds.
    """
    cur, mark = _digested(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        cur, now = _digested(step.filter("u <> v").distinct())
        if now == mark:
            break
        mark = now
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digested(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and the sum of their hashes, observed while they are written."""
    seen = Observation()
    total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), "links")
    return out, (seen.get["n"], seen.get["total"])
