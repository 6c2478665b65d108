"""The lossy channel: sampled snapshots, outages and what a receiver gets of a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.functions.bits import gauss, mulberry32

LATENCY = 0.115
#: Samplers with a fixed number of draws a step: first offset, then the step from its draws.
FIXED = {"bmfit": (0.14, 1, lambda u, v: 0.1 + 0.08 * u),
         "nominal10": (0.1, 2, lambda u, v: F.greatest(F.lit(0.08), 0.1 + 0.004 * gauss(u, v)))}
#: Samplers with hitches: first offset, least step, its range, chance of a hitch.
HITCHING = {"meas60": (0.0875, 0.07, 0.035, 0.001), "congested": (0.21, 0.12, 0.18, 0.02)}


def samples(spark: SparkSession, seeds: DataFrame, sampler: str, t_end: float) -> DataFrame:
    """seed, n, s: the snapshots of each seed up to t_end.

    Draws are known by their number, so steps of a fixed number of draws are a running sum.
    Where a hitch takes a further draw, each seed is walked in a recursive query.
    """
    if sampler in FIXED:
        first, draws, step = FIXED[sampler]
        most = int(t_end / 0.08) + 3
        rows = seeds.select("seed", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("n"))
        at = (F.col("n") - 1) * draws + 2
        move = F.when(F.col("n") == 0, mulberry32(F.col("seed"), F.lit(1)) * first).otherwise(
            step(mulberry32(F.col("seed"), at), mulberry32(F.col("seed"), at + 1)))
        w = Window.partitionBy("seed").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("tick", F.sum(move).over(w)).filter(F.col("tick") < t_end)
        shown = F.ceil(F.col("tick") * 60) / 60 if sampler == "nominal10" else F.col("tick")
        return rows.select("seed", "n", shown.alias("s"))
    first, least, span, chance = HITCHING[sampler]

    def walk(key, pdf):
        import pandas as pd

        rnd = draws_of(int(key[0]))
        t, out = rnd() * first, []
        while t < t_end:
            out.append(t)
            t += least + span * rnd()
            if rnd() < chance:
                t += 0.3 + 0.6 * rnd()
        return pd.DataFrame({"seed": key[0], "n": range(len(out)), "s": out})

    return seeds.groupBy("seed").applyInPandas(walk, "seed long, n int, s double")


def draws_of(seed: int):
    """The draws of functions.bits.mulberry32, one after another."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw


def outages(seeds: DataFrame, t_end: float, on: float = 30.0, off: float = 4.0) -> DataFrame:
    """seed, start, end of alternating exponential times on and off, beginning somewhere in an on time."""
    other = F.col("seed").bitwiseXOR(F.lit(0x5BD1E995).cast("long"))

    def expo(n: Column, mean: float) -> Column:
        return -F.log(mulberry32(other, n) + 1e-12) * mean

    rows = seeds.select("seed", F.explode(F.sequence(F.lit(0), F.lit(int(t_end) + 8))).alias("c"))
    lengths = rows.select("seed", "c", expo(F.col("c") * 2 + 3, off).alias("away"),
                          F.when(F.col("c") == 0, expo(F.lit(1), on) * mulberry32(other, F.lit(2))).otherwise(expo(F.col("c") * 2 + 2, on)).alias("up"))
    before = Window.partitionBy("seed").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("up") + F.col("away")).over(before), F.lit(0.0)) + F.col("up")
    return lengths.withColumn("start", start).filter(F.col("start") < t_end).select("seed", "start", (F.col("start") + F.col("away")).alias("end"))


def arrivals(snapshots: DataFrame, schedule: DataFrame, hold: float, join: float, t_max: float, outs: DataFrame | None = None) -> DataFrame:
    """seed, time, slot, unit: the first snapshot of each slot that a receiver joining at join gets.

    A slot is held for hold seconds; snapshots in an outage or outside [join, join + t_max] are
    lost; a slot that was delivered is not delivered again.
    """
    rows = snapshots.withColumn("slot", F.floor(F.col("s") / hold + 1e-9)).withColumn("time", F.col("s") + LATENCY - join)
    rows = rows.filter((F.col("s") >= join) & (F.col("time") <= t_max))
    if outs is not None:
        cut = outs.withColumn("_b", F.explode(F.sequence(F.floor("start"), F.floor("end")))).select("seed", "_b", "start", "end")
        rows = rows.withColumn("_b", F.floor("s"))
        hit = (rows["seed"] == cut["seed"]) & (rows["_b"] == cut["_b"]) & (cut["start"] <= rows["s"]) & (rows["s"] < cut["end"])
        rows = rows.join(cut, hit, "left_anti")
    first = rows.groupBy("seed", "slot").agg(F.min("time").alias("time"))
    return first.join(schedule, "slot").select("seed", "time", "slot", "unit")


def completion(got: DataFrame, n_units: int, shares: tuple[float, ...]) -> DataFrame:
    """seed and, for each share, the time by which that share of the units has arrived (null if it never has)."""
    first = got.groupBy("seed", "unit").agg(F.min("time").alias("time"))
    rn = F.row_number().over(Window.partitionBy("seed").orderBy("time", "unit"))
    ranked = first.withColumn("rn", rn)
    aggs = [F.min(F.when(F.col("rn") == -int(-n_units * s // 1), F.col("time"))).alias(f"t{round(s * 100)}") for s in shares]
    return ranked.groupBy("seed").agg(*aggs)
