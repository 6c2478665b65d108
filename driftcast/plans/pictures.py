"""Pictures, codecs of blocks and planes, and summaries of evaluation drivers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K
from driftcast.functions.images import homography
from driftcast.functions.transforms import wavelet_matrix
from driftcast.operators import pictures as P
from driftcast.operators.aggregates import reach
from driftcast.operators.windows import last_wins
from driftcast.plans.registry import query
from driftcast.plans.reports import R
from driftcast.sources.tables import results, table

#: Samples of the vectors as 8 x 8 pictures of 0 to 255, in SQL.
PX = """p AS (SELECT vec_id, label, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 127 + 128 AS v FROM embeddings))"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.samples(K.blocks(table(spark, sf_dir, "embeddings"), 128.0), "vec_id", "block", 8)


@query("MTH-03", sql=f"WITH {PX} SELECT vec_id, y - 2 AS y, x - 1 AS x, round(v, 9) AS v FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of each picture."""
    return _pixels(spark, sf_dir).filter("y between 2 and 5 and x between 1 and 4").select("vec_id", (F.col("y") - 2).alias("y"), (F.col("x") - 1).alias("x"), F.round("v", 9).alias("v"))


@query("MTH-04", sql=f"""WITH {PX}, w AS (SELECT i, o, (least(i + 1, (o + 1) * 8 / 3.0::DOUBLE) - greatest(i, o * 8 / 3.0::DOUBLE)) * 3 / 8 AS part FROM range(8) a(i), range(3) b(o)),
k AS (SELECT * FROM w WHERE part > 1e-12) SELECT vec_id, b.o AS y, a.o AS x, round(sum(v * a.part * b.part), 6) AS v FROM p JOIN k a ON a.i = p.x JOIN k b ON b.i = p.y GROUP BY ALL""")
def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 x 8 averaged down to 3 x 3."""
    got = P.area_resize(_pixels(spark, sf_dir), "vec_id", 8, 3)
    return got.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query("COD-01", sql=f"""WITH {PX}, h AS (SELECT vec_id, y, x, v FROM p WHERE (y % 4 = 0 AND x % 4 = 0) OR (vec_id + 3 * y + 5 * x) % 7 < 3),
s AS (SELECT DISTINCT vec_id, a.y, b.x FROM h, range(8) a(y), range(8) b(x)), f AS (SELECT s.vec_id, s.y, s.x, st, h.v FROM s CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS st)
LEFT JOIN h ON h.vec_id = s.vec_id AND h.y = s.y - s.y % st AND h.x = s.x - s.x % st) SELECT vec_id, y, x, round(arg_min(v, st) FILTER (v IS NOT NULL), 9) AS v FROM f GROUP BY ALL""")
def lattice_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing samples take the value of the nearest received lattice ancestor."""
    known = _pixels(spark, sf_dir).filter("(y % 4 = 0 and x % 4 = 0) or (vec_id + 3 * y + 5 * x) % 7 < 3")
    return P.ancestors_fill(known, ["vec_id"], 8).select("vec_id", "y", "x", F.round("v", 9).alias("v"))


@query("COD-03", sql=f"""WITH {PX}, a AS (SELECT vec_id, l, y // [8, 4, 2, 1][l + 1] AS ny, x // [8, 4, 2, 1][l + 1] AS nx, round(avg(v)) AS node FROM p CROSS JOIN range(4) r(l) GROUP BY ALL),
e AS (SELECT * FROM a WHERE (vec_id + l + ny + nx) % 3 <> 0 OR l = 0)
SELECT p.vec_id, y, x, arg_max(node, l) AS v FROM p JOIN e ON p.vec_id = e.vec_id AND y // [8, 4, 2, 1][l + 1] = ny AND x // [8, 4, 2, 1][l + 1] = nx GROUP BY ALL""")
def deepest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel takes the deepest explicit node of its quadtree."""
    p = _pixels(spark, sf_dir).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(3))))
    side = F.shiftright(F.lit(8), 0) / F.pow(F.lit(2), F.col("l"))
    p = p.withColumn("ny", F.floor(F.col("y") / side)).withColumn("nx", F.floor(F.col("x") / side))
    nodes = p.groupBy("vec_id", "l", "ny", "nx").agg(F.round(F.avg("v")).alias("node")).filter("(vec_id + l + ny + nx) % 3 <> 0 or l = 0")
    return p.join(nodes, ["vec_id", "l", "ny", "nx"]).groupBy("vec_id", "y", "x").agg(F.max_by("node", "l").alias("v"))


@query("COD-08", sql="""WITH d AS (SELECT DISTINCT l_suppkey AS stream, l_partkey % 40 AS seq FROM lineitem WHERE l_quantity > 30), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS rn FROM d)
SELECT stream, count(*) FILTER (seq = rn) AS prefix FROM r GROUP BY stream""")
def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chained segments can be decoded."""
    units = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_suppkey").alias("stream"), (F.col("l_partkey") % 40).alias("seq"))
    return P.prefix_received(units, ["stream"], "seq")


SHAPES = """s AS (SELECT p_partkey, p_brand AS picture, p_partkey AS ord, (p_partkey * 37 % 320) / 10.0::DOUBLE AS cx, (p_partkey * 91 % 320) / 10.0::DOUBLE AS cy, 1.0::DOUBLE + p_size % 7 AS rx, 1.5::DOUBLE + p_size % 4 AS ry,
 (p_partkey % 16) / 16.0::DOUBLE * pi() AS angle, (p_partkey * 13 % 256)::DOUBLE AS colour, 0.5::DOUBLE AS alpha FROM part)"""


@query("COD-09", "COD-20", "JOI-17", "MTH-18", sql=f"""WITH {SHAPES}, c AS (SELECT picture, ord, colour, alpha, y, x, (x + 0.5 - cx) * cos(angle) + (y + 0.5 - cy) * sin(angle) AS u, (y + 0.5 - cy) * cos(angle) - (x + 0.5 - cx) * sin(angle) AS v, rx, ry
FROM s, range(32) a(y), range(32) b(x)), k AS (SELECT picture, y, x, list(colour ORDER BY ord) AS cs FROM c WHERE u * u / (rx * rx) + v * v / (ry * ry) <= 1 GROUP BY ALL)
SELECT picture, y, x, round(list_reduce(list_concat([128.0::DOUBLE], cs), lambda a, b: a * 0.5 + b * 0.5), 6) AS v FROM k""")
def render_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses of each picture laid over each other."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("picture"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") * 37 % 320 / 10).alias("cx"), (F.col("p_partkey") * 91 % 320 / 10).alias("cy"),
        (F.lit(1.0) + F.col("p_size") % 7).alias("rx"), (F.lit(1.5) + F.col("p_size") % 4).alias("ry"), (F.col("p_partkey") % 16 / 16 * F.pi()).alias("angle"),
        (F.col("p_partkey") * 13 % 256).cast("double").alias("colour"), F.lit(0.5).alias("alpha"))
    return P.render(p, "picture", 32).select("picture", "y", "x", F.round("v", 6).alias("v"))


@query("AGG-34", sql="""SELECT p_brand, count(*) FILTER (greatest(p_size + 1, 10) / least(p_size + 1.0::DOUBLE, 10) < 1.1) AS round_ones, count(*) FILTER (p_size + 1 < 4) AS tiny, list_sort(list(p_size))[least(count(*), floor(count(*) * 0.1)::BIGINT + 1)] AS d10 FROM part GROUP BY 1""")
def shape_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly circular and tiny shapes, and the first decile of radii."""
    from driftcast.operators.aggregates import upper_percentile

    a, b = F.col("p_size") + 1, F.lit(10)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.greatest(a, b) / F.least(a, b) < 1.1).alias("round_ones"), F.count_if(a < 4).alias("tiny"), upper_percentile("p_size", 0.1).cast("int").alias("d10"))


@query("AGG-22", "RQC-03", sql=f"""WITH {PX}, m AS (SELECT vec_id, avg(v) AS m, min(v) AS lo, max(v) AS hi FROM p GROUP BY vec_id), q AS (SELECT p.vec_id, v, floor((v - lo) / (hi - lo) * 3 + 0.5) / 3 AS t FROM p JOIN m USING (vec_id)),
s AS (SELECT vec_id, sum((1 - t) * (1 - t)) AS aa, sum(t * (1 - t)) AS ab, sum(t * t) AS bb, sum(v * (1 - t)) AS av, sum(v * t) AS bv FROM q GROUP BY vec_id)
SELECT vec_id, round((av * bb - bv * ab) / (aa * bb - ab * ab), 5) AS low, round((bv * aa - av * ab) / (aa * bb - ab * ab), 5) AS high FROM s""")
def endpoint_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares endpoints of each block, whose samples lie at thirds between them."""
    p = _pixels(spark, sf_dir)
    ends = p.groupBy("vec_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 3 + 0.5) / 3
    q = p.join(ends, "vec_id").select("vec_id", "v", t.alias("t"), (1 - t).alias("r"))
    s = q.groupBy("vec_id").agg(*[F.sum(F.expr(e)).alias(n) for n, e in {"aa": "r * r", "ab": "t * r", "bb": "t * t", "av": "v * r", "bv": "v * t"}.items()])
    det = F.expr("aa * bb - ab * ab")
    return s.select("vec_id", F.round(F.expr("av * bb - bv * ab") / det, 5).alias("low"), F.round(F.expr("bv * aa - av * ab") / det, 5).alias("high"))


@query("RQC-01", "MTH-12", sql=f"""WITH {PX}, q AS (SELECT vec_id, bits, v, floor(greatest(0, least(255, v)) / 255 * ((1 << bits) - 1) + 0.5) * 255 / ((1 << bits) - 1) AS r FROM p CROSS JOIN (SELECT unnest([4, 5, 8])::INTEGER AS bits))
SELECT vec_id, bits, (64 * bits)::INTEGER AS total_bits, round(avg((v - r) * (v - r)), 6) AS mse,
round((2 * avg(v) * avg(r) + 6.5025) / (avg(v) * avg(v) + avg(r) * avg(r) + 6.5025) * (2 * covar_pop(v, r) + 58.5225) / (var_pop(v) + var_pop(r) + 58.5225), 6) AS ssim FROM q GROUP BY ALL""")
def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, error and single-window similarity of plainly quantised pictures."""
    q = _pixels(spark, sf_dir).withColumn("bits", F.explode(F.array(*[F.lit(b) for b in (4, 5, 8)])))
    top = F.expr("shiftleft(1, bits) - 1")
    q = q.withColumn("r", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v"))) / 255 * top + 0.5) * 255 / top)
    m, n = F.avg("v"), F.avg("r")
    ssim = (2 * m * n + 6.5025) / (m * m + n * n + 6.5025) * (2 * F.covar_pop("v", "r") + 58.5225) / (F.var_pop("v") + F.var_pop("r") + 58.5225)
    return q.groupBy("vec_id", "bits").agg(F.round(F.avg((F.col("v") - F.col("r")) ** 2), 6).alias("mse"), F.round(ssim, 6).alias("ssim")).withColumn("total_bits", F.col("bits") * 64)


def _lifting_sql() -> str:
    """The wavelet of 64 samples as place, sample, weight: even places hold the low band."""
    m = wavelet_matrix(64)
    return ", ".join(f"({2 * r if r < 32 else 2 * (r - 32) + 1}, {j}, {float(m[r, j])!r}::DOUBLE)" for r in range(64) for j in range(64) if abs(m[r, j]) > 1e-15)


@query("MTH-09", "COD-06", sql=f"""WITH m(i, j, c) AS (VALUES {_lifting_sql()}), p AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE * 127 AS x FROM embeddings),
w AS (SELECT vec_id, i, sum(c * x) AS v FROM p JOIN m USING (j) GROUP BY ALL)
SELECT vec_id, i::INTEGER AS i, round(v, 6) AS v, (sign(v) * floor(abs(v) / 4 + CASE WHEN i % 2 = 0 THEN 0.5 ELSE 0.33 END))::BIGINT AS level FROM w""")
def wavelet_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the wavelet of each vector, quantised with a dead zone."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", (F.col("v").cast("double") * 127).alias("v"))
    c = P.lifting(x, "vec_id", "i", "v", 64)
    return c.select("vec_id", "i", F.round("v", 6).alias("v"), (F.signum("v") * F.floor(F.abs(F.col("v")) / 4 + F.when(F.col("i") % 2 == 0, 0.5).otherwise(0.33))).cast("long").alias("level"))


@query("AGG-25", sql="""WITH RECURSIVE n AS (SELECT label, round(x * 16)::INTEGER AS s, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
h AS (SELECT label, list_sort(list(n)) AS l, (CASE WHEN count(*) = 1 THEN sum(n) ELSE 0 END)::BIGINT AS total, count(*) AS symbols FROM n GROUP BY label UNION ALL
 SELECT label, list_sort(list_append(l[3:], l[1] + l[2])), total + l[1] + l[2], symbols FROM h WHERE len(l) > 1)
SELECT label, total AS bits, 12 * symbols AS table_bits FROM h WHERE len(l) = 1""")
def huffman_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each group's symbols in a Huffman code, and of the code's table."""
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq
        import itertools

        tick = itertools.count()
        heap = [(n, next(tick)) for n in pdf["n"]]
        total = 0 if len(heap) > 1 else int(pdf["n"].sum())
        heapq.heapify(heap)
        while len(heap) > 1:  # each merge adds a bit to all symbols below it
            n = heapq.heappop(heap)[0] + heapq.heappop(heap)[0]
            total += n
            heapq.heappush(heap, (n, next(tick)))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "bits": [int(total)], "table_bits": [12 * len(pdf)]})

    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    n = x.groupBy("label", F.round(F.col("x").cast("double") * 16).cast("int").alias("s")).agg(F.count("*").alias("n"))  # a row per symbol, not per sample
    return n.groupBy("label").applyInPandas(build, "label int, bits long, table_bits long")


@query("MTH-22", "RQC-05")
def predicted_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of pictures by the median edge predictor, and the bits that they take."""
    def run(batches):
        import numpy as np

        from driftcast.functions.images import predict_residuals

        for pdf in batches:
            pdf["levels"] = [predict_residuals(np.asarray(b, float).reshape(8, 8), 6.0).ravel().tolist() for b in pdf["block"]]
            yield pdf[["vec_id", "levels"]]

    got = K.blocks(table(spark, sf_dir, "embeddings"), 128.0).select("vec_id", "block").mapInPandas(run, "vec_id long, levels array<long>")
    each = got.select("vec_id", F.explode("levels").alias("r"))
    return each.groupBy("vec_id").agg(F.sum(B.exp_golomb_length(B.fold(F.col("r")), 1)).alias("bits"), F.count_if(F.col("r") == 0).alias("zeros"))


@query("MTH-10", "MTH-13", "MTH-14", "RQC-09")
def picture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a drawn picture of 192 x 192 at several quantiser steps."""
    n = 192
    x, y = F.col("i") % n, F.floor(F.col("i") / n)
    disc = (x - n / 2) ** 2 + (y - n / 3) ** 2 < n * n / 16
    value = 0.299 * F.when(disc, 230.0).otherwise(x * 255 / n) + 0.587 * F.when(disc, 40.0).otherwise(y * 255 / n) + 0.114 * 90
    grid = spark.range(n * n).select(F.col("id").alias("i")).select("i", value.alias("v"))
    steps = grid.withColumn("id", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 8, 32, 96)])))
    steps = steps.withColumn("c", F.floor(F.col("v") / F.col("id") + 0.5) * F.col("id").cast("double"))
    planes = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "v", "c"))).alias("p")).select("id", F.col("p.v").alias("reference"), F.col("p.c").alias("coded"))
    native = planes.select("id", F.round(K.psnr("reference", "coded"), 6).alias("psnr"))
    return P.score_planes(planes, n, n).join(native, "id").select(F.col("id").alias("step"), "psnr", F.round("ssim", 6).alias("ssim"), F.round("msssim", 6).alias("msssim"))


#: Corners of a board, and where they are seen.
_BOARD = ([(0, 0), (1, 0), (1, 1), (0, 1)], [(10, 12), (205, 30), (190, 170), (22, 150)])


def _projected_sql() -> str:
    h = homography(*_BOARD)
    at = lambda r: f"{float(h[r, 0])!r}::DOUBLE * u + {float(h[r, 1])!r}::DOUBLE * v + {float(h[r, 2])!r}::DOUBLE"
    return f"SELECT p_partkey, round(({at(0)}) / ({at(2)}), 6) AS x, round(({at(1)}) / ({at(2)}), 6) AS y FROM (SELECT p_partkey, p_partkey % 97 / 97.0::DOUBLE AS u, p_size / 51.0::DOUBLE AS v FROM part)"


@query("MTH-15", sql=_projected_sql())
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a board seen at an angle, mapped to its plane: the map is solved once, points stay in Spark."""
    h = homography(*_BOARD)
    u, v = F.col("p_partkey") % 97 / 97, F.col("p_size") / 51
    w = float(h[2, 0]) * u + float(h[2, 1]) * v + float(h[2, 2])
    at = lambda r: F.round((float(h[r, 0]) * u + float(h[r, 1]) * v + float(h[r, 2])) / w, 6)
    return table(spark, sf_dir, "part").select("p_partkey", at(0).alias("x"), at(1).alias("y"))


@query("MTH-20", "SRT-08", sql="""WITH e AS (SELECT l_suppkey AS stream, l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w AS hi, sum(l_quantity) OVER w - l_quantity AS lo, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS tot
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), d AS (SELECT unnest([0.1, 0.35, 0.8])::DOUBLE AS u)
SELECT stream, u, l_orderkey, l_linenumber FROM e JOIN d ON u * tot >= lo AND u * tot < hi""")
def weighted_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows picked in proportion to their error, by draws on the running sum."""
    w = Window.partitionBy("stream").orderBy("l_orderkey", "l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "stream")
    e = e.select("stream", "l_orderkey", "l_linenumber", "l_quantity", F.sum("l_quantity").over(w).alias("hi"), F.sum("l_quantity").over(Window.partitionBy("stream")).alias("tot"))
    e = e.withColumn("u", F.explode(F.array(*[F.lit(u) for u in (0.1, 0.35, 0.8)])))
    return e.filter("u * tot >= hi - l_quantity and u * tot < hi").select("stream", "u", "l_orderkey", "l_linenumber")


#: A common multiple of all pool sizes: means of up to 50 gains are whole multiples of its inverse.
_COMMON = math.lcm(*range(1, 51))


@query("MTH-23", sql=f"""WITH c AS (SELECT l_suppkey AS stream, l_quantity::INTEGER AS packet, sum(round(l_discount * 100)::BIGINT)::BIGINT AS s, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT stream, packet, (20000 * s + n) // (2 * n) AS gain FROM c), n AS (SELECT *, row_number() OVER w AS k, sum(gain) OVER w AS run FROM g WINDOW w AS (PARTITION BY stream ORDER BY packet)),
p AS (SELECT a.stream, a.k AS lo, b.k AS hi, (b.run - a.run + a.gain)::HUGEINT * ({_COMMON}::HUGEINT // (b.k - a.k + 1)) AS m FROM n a JOIN n b ON a.stream = b.stream AND a.k <= b.k),
t AS (SELECT n.stream, n.k, lo, max(m) AS m FROM n JOIN p ON n.stream = p.stream AND lo <= n.k AND hi >= n.k GROUP BY ALL)
SELECT n.stream, packet, gain / 1000000.0::DOUBLE AS gain, ((2 * min(m) + {_COMMON}::HUGEINT) // (2 * {_COMMON}::HUGEINT))::BIGINT / 1000000.0::DOUBLE AS pooled FROM t JOIN n ON n.stream = t.stream AND n.k = t.k GROUP BY ALL""")
def pooled_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gains of a stream's packets, neighbours pooled until they never rise, in whole millionths throughout.

    Halves round up once, at the end; pools are compared by cross multiplication, so no sum depends on an order.
    """
    import pandas as pd

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("packet")
        pools: list[tuple[int, int]] = []
        for g in pdf["gain"].tolist():
            total, size = g, 1
            while pools and total * pools[-1][1] > pools[-1][0] * size:
                t, n = pools.pop()
                total, size = total + t, size + n
            pools.append((total, size))
        pdf["pooled"] = [(2 * t + n) // (2 * n) for t, n in pools for _ in range(n)]
        return pdf

    cents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stream"), F.col("l_quantity").cast("int").alias("packet")).agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"), F.count("*").alias("n"))  # 50 packets a stream
    g = cents.select("stream", "packet", F.expr("(20000 * s + n) div (2 * n)").alias("gain"))
    got = g.groupBy("stream").applyInPandas(pool, "stream long, packet int, gain long, pooled long")
    return got.select("stream", "packet", (F.col("gain") / 1000000).alias("gain"), (F.col("pooled") / 1000000).alias("pooled"))


@query("CHN-09", "EVL-21")
def bursty_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of a channel that changes between a good and a bad state, per seed: a fold over draws known by number."""
    steps = F.sequence(F.lit(0), F.lit(1999))
    first = F.struct(F.lit(0).alias("bad"), F.lit(0).alias("lost"))

    def step(s, k):
        turn, drop = B.mulberry32(F.col("seed"), k * 2 + 1), B.mulberry32(F.col("seed"), k * 2 + 2)
        bad = F.when(s["bad"] == 1, F.when(turn < 0.3, 0).otherwise(1)).otherwise(F.when(turn < 0.05, 1).otherwise(0))
        return F.struct(bad.alias("bad"), (s["lost"] + F.when(drop < F.when(bad == 1, 0.8).otherwise(0.01), 1).otherwise(0)).alias("lost"))

    seeds = spark.range(1, 17).select(F.col("id").alias("seed"))
    return seeds.select("seed", (F.aggregate(steps, first, step)["lost"] / 2000).alias("loss"))


@query("EVL-02", sql=f"WITH {R} SELECT codec AS variant, policy AS joined, t, round(avg(metric), 6) AS q, count(DISTINCT image) AS images FROM r GROUP BY ALL")
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality per variant, kind of join and mark."""
    return results(spark, sf_dir).groupBy(F.col("codec").alias("variant"), F.col("policy").alias("joined"), "t").agg(F.round(F.avg("metric"), 6).alias("q"), F.count_distinct("image").alias("images"))


@query("EVL-04", "EVL-05", sql=f"""WITH {R}, d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY image, codec, t ORDER BY seed DESC, metric DESC, quality DESC, bpp DESC, policy) = 1),
a AS (SELECT codec, t, round(avg(metric), 6) AS all_rows FROM r GROUP BY ALL) SELECT d.codec, d.t, round(avg(metric), 6) AS last_rows, max(all_rows) AS all_rows FROM d JOIN a ON a.codec = d.codec AND a.t = d.t GROUP BY ALL""")
def appended_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the last appended row of each key, and over all rows."""
    r = results(spark, sf_dir)
    last = last_wins(r, ["image", "codec", "t"], [F.desc("seed"), F.desc("metric"), F.desc("quality"), F.desc("bpp"), "policy"]).groupBy("codec", "t").agg(F.round(F.avg("metric"), 6).alias("last_rows"))
    return last.join(r.groupBy("codec", "t").agg(F.round(F.avg("metric"), 6).alias("all_rows")), ["codec", "t"])


@query("EVL-06", sql=f"""WITH {R}, m AS (SELECT image || '-' || codec || '-n' || policy AS name, t, round(sum(metric), 6) AS v FROM r GROUP BY ALL), x AS (SELECT *, max(v) OVER (PARTITION BY name ORDER BY t) AS run FROM m),
l AS (SELECT *, lag(t) OVER w AS pt, lag(run) OVER w AS pv FROM x WINDOW w AS (PARTITION BY name ORDER BY t)),
h AS (SELECT name, min(CASE WHEN pt IS NULL THEN t ELSE pt * pow(t / pt, (1.0 - pv) / (run - pv)) END) AS secs FROM l WHERE run >= 1.0 AND (pv IS NULL OR pv < 1.0) GROUP BY name)
SELECT regexp_extract(name, '^(\\d+)-(\\w+)-n(\\w+)$', 2) AS variant, regexp_extract(name, '^(\\d+)-(\\w+)-n(\\w+)$', 3) AS n, count(secs) AS reached, round(avg(secs), 6) AS seconds FROM (SELECT DISTINCT name FROM m) LEFT JOIN h USING (name) GROUP BY ALL""")
def reach_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to a level, for the parts of a label."""
    m = results(spark, sf_dir).groupBy(F.concat(F.col("image").cast("string"), F.lit("-"), "codec", F.lit("-n"), "policy").alias("name"), "t").agg(F.round(F.sum("metric"), 6).alias("v"))
    run = F.max("v").over(Window.partitionBy("name").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    got = reach(m.withColumn("run", run), ["name"], "t", "run", 1.0)
    part = lambda k: F.regexp_extract("name", r"^(\d+)-(\w+)-n(\w+)$", k)
    return got.groupBy(part(2).alias("variant"), part(3).alias("n")).agg(F.count("seconds").alias("reached"), F.round(F.avg("seconds"), 6).alias("seconds"))


@query("EVL-12", "EVL-13", sql="""SELECT l_suppkey AS picture, min(l_linenumber) FILTER (l_discount >= 0.08) AS fewest, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS readable, round(avg(l_quantity), 6) AS received FROM lineitem GROUP BY 1""")
def readable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest packets at which a picture could be read, and how often it could."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("picture")).agg(
        F.min(F.when(F.col("l_discount") >= 0.08, F.col("l_linenumber"))).alias("fewest"), F.round(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)), 6).alias("readable"), F.round(F.avg("l_quantity"), 6).alias("received"))


@query("SET-03", sql=f"""WITH {R}, a AS (SELECT image, codec, t AS mark, list_sort(list(DISTINCT seed % 16)) AS state FROM r GROUP BY ALL), d AS (SELECT DISTINCT state FROM a), q AS (SELECT state, list_sum(list_transform(state, lambda s: s * s))::BIGINT AS score FROM d)
SELECT image, codec, mark, sha1(array_to_string(a.state, ',')) AS state, score FROM a JOIN q ON a.state = q.state""")
def memoised_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A costly score computed once for each distinct state and joined back."""
    a = results(spark, sf_dir).groupBy("image", "codec", F.col("t").alias("mark")).agg(F.sort_array(F.collect_set(F.col("seed") % 16)).alias("units"))
    a = a.withColumn("state", F.sha1(F.array_join(F.transform("units", lambda u: u.cast("string")), ",")))
    once = a.select("state", "units").dropDuplicates(["state"]).select("state", F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + u * u).alias("score"))
    return a.join(once, "state").select("image", "codec", "mark", "state", "score")


@query("SRT-01", sql="""WITH u AS (SELECT 0 AS kind, s_suppkey AS unit, s_acctbal AS gain FROM supplier UNION ALL SELECT 1, c_custkey, 3 * c_acctbal FROM customer)
SELECT kind, unit, row_number() OVER (PARTITION BY unit % 10 ORDER BY gain DESC, kind, unit) AS place FROM u""")
def merged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of units merged by gain; residuals count threefold."""
    a = table(spark, sf_dir, "supplier").select(F.lit(0).alias("kind"), F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("gain"))
    b = table(spark, sf_dir, "customer").select(F.lit(1).alias("kind"), F.col("c_custkey").alias("unit"), (3 * F.col("c_acctbal")).alias("gain"))
    place = F.row_number().over(Window.partitionBy(F.col("unit") % 10).orderBy(F.desc("gain"), "kind", "unit"))
    return a.unionByName(b).select("kind", "unit", place.cast("long").alias("place"))


@query("WIN-20")
def adaptive_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each vector's levels in a Rice code whose order follows the levels before."""
    start = F.struct(F.lit(4).cast("long").alias("a"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("bits"))

    def step(s, u):
        k = F.size(F.filter(F.sequence(F.lit(0), F.lit(14)), lambda j: s["n"] * F.pow(F.lit(2), j) < s["a"]))
        bits = s["bits"] + F.floor(u / F.pow(F.lit(2), k)) + 1 + k
        a, n = s["a"] + u, s["n"] + 1
        half = n >= 64
        return F.struct(F.when(half, F.floor(a / 2)).otherwise(a).alias("a"), F.when(half, F.floor(n / 2)).otherwise(n).alias("n"), bits.alias("bits"))

    u = F.transform("embedding", lambda x: B.fold(F.round(x.cast("double") * 32).cast("long")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(u, start, step)["bits"].alias("bits"))


@query("SET-08", sql=f"""WITH RECURSIVE {PX}, b AS (SELECT vec_id, y, x, y * 8 + x AS i FROM p WHERE v > 140),
r AS (SELECT vec_id, i, i AS j FROM b UNION SELECT r.vec_id, r.i, n.i FROM r JOIN b o ON o.vec_id = r.vec_id AND o.i = r.j JOIN b n ON n.vec_id = o.vec_id AND abs(n.y - o.y) <= 1 AND abs(n.x - o.x) <= 1),
l AS (SELECT vec_id, i, min(j) AS part FROM r GROUP BY ALL) SELECT vec_id, part::INTEGER AS part, count(*) AS size, min(i % 8)::INTEGER AS x0, max(i % 8)::INTEGER AS x1, min(i // 8) AS y0, max(i // 8) AS y1 FROM l GROUP BY vec_id, part""")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected bright parts of each picture, with their sizes and boxes."""
    def run(batches):
        import numpy as np
        import pandas as pd

        from driftcast.functions.images import components

        for pdf in batches:
            labels = [components(np.asarray(b, float).reshape(8, 8) > 140).ravel() for b in pdf["block"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "labels": [x.tolist() for x in labels]})

    got = K.blocks(table(spark, sf_dir, "embeddings"), 128.0).select("vec_id", "block").mapInPandas(run, "vec_id long, labels array<int>")
    each = got.select("vec_id", F.posexplode("labels").alias("i", "part")).filter("part >= 0").withColumn("y", F.floor(F.col("i") / 8)).withColumn("x", F.col("i") % 8)
    return each.groupBy("vec_id", "part").agg(F.count("*").alias("size"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
