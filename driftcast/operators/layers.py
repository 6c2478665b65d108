"""Layers of pictures: stacks of shapes, states of receivers, quality layers, streams with residuals, bits within a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from driftcast.functions import transforms as T
from driftcast.operators.pictures import covered  # noqa: F401


def stack_scan(at: np.ndarray, colour: pa.Array, alpha: pa.Array, background: float) -> list[pa.Array]:
    """before, after and passed of the layers of whole stacks, one after another; at: a layer's place in its stack, from 1.

    All stacks take a step at once, so there are as many steps as the deepest has layers. What a null colour or opacity tells is null.
    """
    c, a = (x.to_numpy(zero_copy_only=False) for x in (colour, alpha))
    no_a = alpha.is_null().to_numpy(zero_copy_only=False)
    no = no_a | colour.is_null().to_numpy(zero_copy_only=False)
    n = len(at)
    before, after, passed = np.full(n, float(background)), np.zeros(n), np.ones(n)
    lost = [np.zeros(n, bool) for _ in range(3)]
    ends = np.append(np.flatnonzero(at == 1)[1:], n)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # 1 for the last layer of a stack

    def steps(place: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(place, kind="stable")
        return iter(np.split(order, np.flatnonzero(np.diff(place[order])) + 1)[1:])

    for k in steps(at):
        j = k - 1
        before[k] = before[j] * (1 - a[j]) + c[j] * a[j]
        lost[0][k] = lost[0][j] | no[j]
    for k in steps(left):
        j = k + 1
        after[k], passed[k] = after[j] + passed[j] * c[j] * a[j], passed[j] * (1 - a[j])
        lost[1][k], lost[2][k] = lost[1][j] | no[j], lost[2][j] | no_a[j]
    return [pa.array(x, mask=m) for x, m in zip((before, after, passed), lost)]


def suffixes(cover: DataFrame, keys: list[str], order: str, colour: str, alpha: str, background: float = 128.0) -> DataFrame:
    """keys, order, before, after, passed, without of each shape that covers a pixel (keys).

    Laying shapes over each other is a product of pairs (light, share that passes), which is associative: so one scan
    forward gives the light before every shape and one backward what the shapes after it add (after) and let
    through (passed). The pixel without the shape is before * passed + after; opaque shapes need no division.
    Pixels are shuffled and sorted by Spark; a batch of whole ones is scanned at once. One pixel's shapes are gathered.
    """
    c, a = F.col(colour).cast("double").alias("_c"), F.col(alpha).cast("double").alias("_a")
    rows = cover.select(*keys, order, c, a).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "_c", "_a")))
    names, told = [*keys, order], ["before", "after", "passed"]
    schema = D.StructType([rows.schema[k] for k in names] + [D.StructField(k, D.DoubleType()) for k in told])

    def scanned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            one = t.to_batches()[0]
            found = stack_scan(one["_at"].to_numpy(), one["_c"], one["_a"], background)
            yield pa.RecordBatch.from_arrays([*(one[k] for k in names), *found], names=[*names, *told])

    def run(batches):
        held = []
        for b in batches:
            starts = np.flatnonzero(b["_at"].to_numpy() == 1)
            if len(starts):  # the last pixel may go on in the next batch
                cut = int(starts[-1])
                yield from scanned([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from scanned(held)

    got = rows.mapInArrow(run, schema).filter(F.col(order).isNotNull())
    return got.select(*names, *told, (F.col("before") * F.col("passed") + F.col("after")).alias("without"))


def states_at_marks(first: DataFrame, keys: list[str], unit: str, time: str, marks: tuple[float, ...]) -> DataFrame:
    """keys, mark, got, state: how many units each receiver holds at each mark, and a hash of their set.

    first: the first arrival of each unit. The hash is a sum of the units' hashes, so it needs no order and no
    gathered set, and partial sums combine before the shuffle. Units without a time never arrive.
    """
    h = F.shiftright(F.xxhash64(F.col(unit)), 8)
    held = [F.struct(F.lit(m).alias("mark"), F.count_if(F.col(time) <= m).alias("got"), F.coalesce(F.sum(F.when(F.col(time) <= m, h)), F.lit(0)).alias("state")) for m in marks]
    return first.groupBy(*keys).agg(F.array(*held).alias("_m")).select(*keys, F.inline("_m"))


def scored_states(states: DataFrame, first: DataFrame, picture: list[str], keys: list[str], unit: str, time: str, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """states with what score gives for their picture and state, computed once for each that is distinct.

    score gets the distinct (picture, state) and the units (picture, state, unit) that each holds, and returns a row for each
    of the first. The units are those of one receiver in the state; no other receiver's are read again.
    """
    one = states.groupBy(*picture, "state", "got").agg(F.min(F.struct(*keys, "mark")).alias("_one"))
    units = one.select(*picture, "state", *[F.col(f"_one.{k}").alias(f"_{k}") for k in keys], F.col("_one.mark").alias("_mark"))
    mine = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(unit).alias("unit"), F.col(time).alias("_t"))
    held = units.join(mine, [f"_{k}" for k in keys]).filter("_t <= _mark").select(*picture, "state", "unit")
    return states.join(score(one.select(*picture, "state"), held), [*picture, "state"])


def layers(df: DataFrame, column: str, steps: tuple[float, ...], offset: Callable[[Column], Column]) -> DataFrame:
    """df without the column, with layer, levels and rest: each layer codes what lower layers have left of the coefficients.

    A level is the coefficient over the layer's step, rounded towards zero after the offset of its place; rest is what it
    leaves. The steps are columns of their own, as each layer reads the one before at every place.
    """
    rows = df.withColumnRenamed(column, "_rest")
    keep = [c for c in rows.columns if c != "_rest"]

    def coded(rows: DataFrame, k: int, step: float) -> DataFrame:
        left = f"_rest{k - 1}" if k else "_rest"
        rows = rows.withColumn(f"_level{k}", F.transform(left, lambda c, i: (F.signum(c) * F.floor(F.abs(c) / step + offset(i))).cast("long")))
        return rows.withColumn(f"_rest{k}", F.zip_with(left, f"_level{k}", lambda c, v: c - v * step))

    for k, step in enumerate(steps):
        rows = coded(rows, k, step)
    each = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(f"_level{k}").alias("levels"), F.col(f"_rest{k}").alias("rest")) for k in range(len(steps))])
    return rows.select(*keep, F.inline(each))


def concealed_once(column: str, side: int) -> Column:
    """A square of cells by rows, in which each unknown (null) cell takes the mean of its known neighbours of eight; none leaves it unknown.

    The column must not be an expression: its cells are read at every place.
    """
    def cell(x: Column, i: Column) -> Column:
        total, n = F.lit(0.0), F.lit(0)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    inside = (F.floor(i / side) + dy).between(0, side - 1) & (i % side + dx).between(0, side - 1)
                    v = F.when(inside, F.get(F.col(column), i + dy * side + dx))
                    total, n = total + F.coalesce(v, F.lit(0.0)), n + F.when(v.isNotNull(), 1).otherwise(0)
        return F.coalesce(x, F.when(n > 0, total / n))

    return F.transform(column, cell)


def base_and_residual(df: DataFrame, column: str, base_step: float, step: float, key: str = "vec_id", side: int = 8) -> DataFrame:
    """key, kind, unit, place, gain, error: units of a coarse stream (0) and of a residual stream (1), merged by what they take off the squared error.

    The base is the mean of each quarter of the picture (values about 0); its gain, of one sample a quarter, is scaled to the
    quarter's samples. The residual is the picture minus the rendered base in an orthonormal Haar basis. Its coarse
    coefficients are what the base's rounding left, too small to be coded, so units are orthogonal and gains add up:
    no prefix of the merged stream has a larger error than a shorter one. error is that of the prefix. Ties: base first, then by unit.
    """
    half, area = side // 2, (side // 2) ** 2
    if half * base_step >= step:
        raise ValueError("the base must be fine enough for its rounding not to be coded again")
    quarter = lambda i: (F.floor(i / (side * half)) * 2 + F.floor(i % side / half)).cast("int")
    rows = df.select(key, F.col(column).alias("_v"))
    mean = lambda q: F.aggregate(F.filter("_v", lambda x, i: quarter(i) == q), F.lit(0.0), lambda s, x: s + x) / area
    rows = rows.withColumn("_mean", F.array(*[mean(q) for q in range(4)])).withColumn("_coded", F.transform("_mean", lambda m: F.floor(m / base_step + 0.5) * base_step))
    rows = rows.withColumn("_energy", F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("_left", F.transform("_v", lambda x, i: x - F.get("_coded", quarter(i))))
    rows = T.apply_matrix(rows, "_left", T.haar_2d(side, 2), "_c")
    unit = lambda kind, i, gain: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("unit"), F.round(gain, 5).alias("gain"))
    base = F.zip_with("_mean", "_coded", lambda m, c: F.struct(m.alias("m"), c.alias("c")))
    base = F.transform(base, lambda z, q: F.when(z["c"] != 0, unit(0, q, area * (z["m"] * z["m"] - (z["m"] - z["c"]) * (z["m"] - z["c"])))))
    level = lambda c: F.signum(c) * F.floor(F.abs(c) / step + 0.5) * step
    rest = F.transform("_c", lambda c, i: F.when(F.abs(c) >= step / 2, unit(1, i, c * c - (c - level(c)) * (c - level(c)))))
    units = rows.select(key, "_energy", F.explode(F.filter(F.concat(base, rest), lambda u: u.isNotNull())).alias("u")).select(key, "_energy", "u.*")
    order = Window.partitionBy(key).orderBy(F.desc("gain"), "kind", "unit")  # the units of one picture
    spent = F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return units.select(key, "kind", "unit", F.row_number().over(order).cast("long").alias("place"), "gain", F.round(F.col("_energy") - spent, 3).alias("error"))


def within_budget(df: DataFrame, key: str, modes: str, budget: float, parts: int = 16) -> DataFrame:
    """key, mode, bits, error: for each row the mode of least error plus price times bits, at the least price that keeps the mean bits within a budget.

    modes: array of (mode, bits, error). Each row's useful modes are the lower hull of error over bits; the slope of a
    step is the price at which it pays. Steps are counted into classes of slopes (parts for each factor e), not sorted:
    classes are taken from the dearest while their bits fit. If not even the least modes fit, those are taken.
    """
    kind = "struct<slope:double,bits:bigint,mode:int,error:double,more:bigint>"
    least = F.array_min(F.transform(modes, lambda m: F.struct(m["bits"].alias("bits"), m["error"].alias("error"), m["mode"].alias("mode"))))
    start = F.struct(F.lit(None).cast("double").alias("slope"), least["bits"].alias("bits"), least["mode"].alias("mode"), least["error"].alias("error"), F.lit(None).cast("bigint").alias("more")).cast(kind)

    def step(hull: Column, _: Column) -> Column:
        cur = F.element_at(hull, -1)
        better = F.filter(modes, lambda m: (m["bits"] > cur["bits"]) & (m["error"] < cur["error"]))
        dealt = F.transform(better, lambda m: F.struct(((cur["error"] - m["error"]) / (m["bits"] - cur["bits"])).alias("slope"), m["bits"].alias("bits"), m["mode"].alias("mode"),
                                                       m["error"].alias("error"), (m["bits"] - cur["bits"]).alias("more")).cast(kind))
        return F.when(F.size(better) > 0, F.concat(hull, F.array(F.array_max(dealt)))).otherwise(hull)

    rows = df.select(key, F.aggregate(F.col(modes), F.array(start), step).alias("_hull"))
    group = lambda slope: F.floor(F.log(slope) * parts)
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("_hull")[0]["bits"]).alias("bits")).first()
    steps = rows.select(F.explode("_hull").alias("s")).filter("s.slope is not null").groupBy(group(F.col("s.slope")).alias("b")).agg(F.sum("s.more").alias("more"))
    used, cut = total["bits"] or 0, None
    for r in sorted(steps.collect(), key=lambda r: -r["b"]):  # a row for each class of slopes: some thousands at most
        used += r["more"]
        if used > budget * total["n"]:
            break
        cut = r["b"]
    taken = F.filter("_hull", lambda s: s["slope"].isNull() | ((group(s["slope"]) >= cut) if cut is not None else F.lit(False)))
    best = rows.select(key, F.element_at(taken, -1).alias("b"))
    return best.select(key, F.col("b.mode").alias("mode"), F.col("b.bits").alias("bits"), F.col("b.error").alias("error"))
