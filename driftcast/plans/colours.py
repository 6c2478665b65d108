"""Pictures set right, dithered to a palette, and blocks of colours along their principal axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.functions import blocks as K
from driftcast.functions.images import homography
from driftcast.operators import colours as C
from driftcast.plans.pictures import PX, _pixels
from driftcast.plans.registry import query
from driftcast.sources.tables import table

#: Corners of the plane and where they are seen, in samples.
_SEEN = homography([(0, 0), (7, 0), (7, 7), (0, 7)], [(0.6, 0.2), (6.5, 0.9), (6.1, 6.7), (-0.4, 6.2)]).tolist()


def _rectified_sql() -> str:
    at = lambda r: f"({_SEEN[r][0]!r}::DOUBLE * tx + {_SEEN[r][1]!r}::DOUBLE * ty + {_SEEN[r][2]!r}::DOUBLE)"
    return f"""WITH {PX}, t AS (SELECT ty, tx, {at(0)} / {at(2)} AS sx, {at(1)} / {at(2)} AS sy FROM range(8) a(ty), range(8) b(tx)),
n AS (SELECT ty, tx, floor(sy)::BIGINT + dy AS y, floor(sx)::BIGINT + dx AS x, (1 - abs(sx - floor(sx) - dx)) * (1 - abs(sy - floor(sy) - dy)) AS part FROM t, range(2) c(dy), range(2) d(dx))
SELECT vec_id, ty AS y, tx AS x, round(sum(v * part) + 128 * (1 - sum(part)), 6) AS v FROM p JOIN n ON n.y = p.y AND n.x = p.x AND part > 0 GROUP BY vec_id, ty, tx"""


@query("MTH-15", sql=_rectified_sql())
def rectified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures seen at an angle, set right by a gather of four samples for each sample of the plane."""
    got = C.gathered(_pixels(spark, sf_dir).select("vec_id", "y", "x", "v"), "vec_id", 8, _SEEN)
    return got.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


PALETTE = [0.0, 85.0, 170.0, 255.0]
_NEAR = "list_position(list_transform([0.0, 85.0, 170.0, 255.0], lambda c: abs({0} - c)), list_min(list_transform([0.0, 85.0, 170.0, 255.0], lambda c: abs({0} - c)))) - 1"


@query("RQC-04", "MTH-22", sql=f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 127 + 128) AS v FROM embeddings),
d AS (SELECT vec_id, v, 0 AS i, list_transform(range(64), lambda k: 0.0::DOUBLE) AS e, []::BIGINT[] AS codes FROM v UNION ALL
 SELECT vec_id, v, i + 1, list_transform(e, lambda x, k: x + r * CASE k - 1 - i WHEN 1 THEN CASE WHEN i % 8 < 7 THEN 7 ELSE 0 END WHEN 7 THEN CASE WHEN i % 8 > 0 THEN 3 ELSE 0 END WHEN 8 THEN 5 WHEN 9 THEN CASE WHEN i % 8 < 7 THEN 1 ELSE 0 END ELSE 0 END / 16), list_append(codes, code)
 FROM (SELECT *, w - code * 85.0::DOUBLE AS r FROM (SELECT *, ({_NEAR.format('w')})::BIGINT AS code FROM (SELECT *, v[i + 1] + e[i + 1] AS w FROM d WHERE i < 64))))
SELECT vec_id, list_sum(list_transform(codes, lambda c, k: c * k))::BIGINT AS checksum, list_sum(codes)::BIGINT AS level, round(abs(list_sum(list_transform(codes, lambda c: c * 85.0::DOUBLE)) - list_sum(v)) / 64, 6) AS shift FROM d WHERE i = 64""")
def dithered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in four greys with error diffusion: their codes, and how far their mean is off."""
    rows = K.blocks(table(spark, sf_dir, "embeddings"), 128.0).select("vec_id", "block")
    got = C.dithered(rows, "vec_id", "block", PALETTE, 8).join(rows, "vec_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    checksum = F.aggregate(F.transform("codes", lambda c, k: (c * (k + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    level = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("vec_id", checksum.alias("checksum"), level.alias("level"), F.round(F.abs(total(F.transform("codes", lambda c: c * 85.0)) - total("block")) / 64, 6).alias("shift"))


def _axis_sql() -> str:
    row = lambda i: " + ".join(f"c{min(i, j)}{max(i, j)} * a{j}" for j in range(3))
    steps = [f"""s{k + 1} AS (SELECT * EXCLUDE (a0, a1, a2, o0, o1, o2), {', '.join(f'CASE WHEN sqrt(o0 * o0 + o1 * o1 + o2 * o2) > 1e-9 THEN o{i} / sqrt(o0 * o0 + o1 * o1 + o2 * o2) ELSE 0 END AS a{i}' for i in range(3))}
 FROM (SELECT *, {', '.join(f'{row(i)} AS o{i}' for i in range(3))} FROM s{k}))""" for k in range(8)]
    return f"""WITH p AS (SELECT vec_id, i // 32 * 2 + i % 8 // 4 AS block, e[i + 1]::DOUBLE * 127 + 128 AS r, e[64 - i]::DOUBLE * 127 + 128 AS g, e[(i * 9) % 64 + 1]::DOUBLE * 127 + 128 AS b FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings)),
s0 AS (SELECT vec_id, block, avg(r) AS m0, avg(g) AS m1, avg(b) AS m2, covar_pop(r, r) AS c00, covar_pop(r, g) AS c01, covar_pop(r, b) AS c02, covar_pop(g, g) AS c11, covar_pop(g, b) AS c12, covar_pop(b, b) AS c22, 1.0::DOUBLE AS a0, 1.0::DOUBLE AS a1, 1.0::DOUBLE AS a2 FROM p GROUP BY ALL),
{', '.join(steps)}, t AS (SELECT p.vec_id, p.block, r, g, b, m0, m1, m2, a0, a1, a2, (r - m0) * a0 + (g - m1) * a1 + (b - m2) * a2 AS t FROM p JOIN s8 s ON s.vec_id = p.vec_id AND s.block = p.block),
e AS (SELECT *, min(t) OVER w AS lo, max(t) OVER w AS hi FROM t WINDOW w AS (PARTITION BY vec_id, block)), q AS (SELECT *, CASE WHEN hi > lo THEN lo + floor((t - lo) / (hi - lo) * 3 + 0.5) * (hi - lo) / 3 ELSE 0 END AS u FROM e)
SELECT vec_id, block::INTEGER AS block, round(max(hi - lo), 5) AS spread, round(sqrt(avg(pow(r - m0 - u * a0, 2) + pow(g - m1 - u * a1, 2) + pow(b - m2 - u * a2, 2)) / 3), 5) AS error FROM q GROUP BY vec_id, block"""


@query("RQC-03", "AGG-22", sql=_axis_sql())
def axis_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 colours as two ends of their principal axis and two bits a sample: length of the axis, and the error."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda k: F.element_at("e", k.cast("int")).cast("double") * 127 + 128
    block = (F.floor(F.col("i") / 32) * 2 + F.floor(F.col("i") % 8 / 4)).cast("int")
    p = e.select("vec_id", block.alias("block"), at(F.col("i") + 1).alias("r"), at(64 - F.col("i")).alias("g"), at(F.col("i") * 9 % 64 + 1).alias("b"))
    own = p.groupBy("vec_id", "block").agg(F.collect_list(F.struct("r", "g", "b")).alias("all"))  # sixteen colours
    rows = own.join(C.principal_axes(p, ["vec_id", "block"], ("r", "g", "b")), ["vec_id", "block"])
    off = lambda z: [z[c] - F.col(f"m{k}") for k, c in enumerate("rgb")]
    rows = rows.withColumn("t", F.transform("all", lambda z: sum((d * F.col(f"a{k}") for k, d in enumerate(off(z))), F.lit(0.0))))
    rows = rows.withColumn("lo", F.array_min("t")).withColumn("hi", F.array_max("t"))
    u = F.transform("t", lambda t: F.when(F.col("hi") > F.col("lo"), F.col("lo") + F.floor((t - F.col("lo")) / (F.col("hi") - F.col("lo")) * 3 + 0.5) * (F.col("hi") - F.col("lo")) / 3).otherwise(0.0))
    rows = rows.withColumn("u", u)
    square = F.zip_with("all", "u", lambda z, u: sum(((d - u * F.col(f"a{k}")) * (d - u * F.col(f"a{k}")) for k, d in enumerate(off(z))), F.lit(0.0)))
    error = F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / 16 / 3)
    return rows.select("vec_id", "block", F.round(F.col("hi") - F.col("lo"), 5).alias("spread"), F.round(error, 5).alias("error"))
