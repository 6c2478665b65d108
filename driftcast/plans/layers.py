"""Codes in layers and chunks: canonical codes, suffixes of shapes, states at marks, quality layers, residual streams, rate allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K
from driftcast.functions import transforms as T
from driftcast.operators import canonical as C
from driftcast.operators import layers as L
from driftcast.plans.codings import _FOLD, LEVELS, _golomb, _levels, _rows_sql
from driftcast.plans.pictures import SHAPES
from driftcast.plans.registry import query
from driftcast.sources.tables import table

#: Blocks of a picture.
PICTURE = 64
_ZIG = f"[{', '.join(map(str, K.ZIGZAG))}]"
#: Symbols of the levels at quality 50 and their codes: zg (vec_id, pos, v), nz (run, size), dc (own, more), ln (kind, symbol, length).
CODES = LEVELS + f""", zg AS MATERIALIZED (SELECT vec_id, list_position({_ZIG}, i) - 1 AS pos, level AS v FROM l WHERE quality = 50),
nz AS MATERIALIZED (SELECT vec_id, pos, v, pos - coalesce(lag(pos) OVER (PARTITION BY vec_id ORDER BY pos), 0) - 1 AS run, length(bin(abs(v))) AS size FROM zg WHERE pos > 0 AND v <> 0),
dc AS MATERIALIZED (SELECT vec_id, v AS own, v - coalesce(lag(v) OVER (PARTITION BY vec_id // {PICTURE} ORDER BY vec_id), 0) AS more FROM zg WHERE pos = 0),
en AS MATERIALIZED (SELECT vec_id FROM dc WHERE vec_id NOT IN (SELECT vec_id FROM nz WHERE pos = 63)),
fq AS (SELECT 'rest' AS kind, run % 16 * 16 + size AS symbol, count(*) AS n FROM nz GROUP BY ALL UNION ALL SELECT 'rest', 240, sum(run // 16) FROM nz UNION ALL SELECT 'rest', 0, count(*) FROM en
 UNION ALL SELECT 'first', CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END, count(*) FROM (SELECT own AS v FROM dc UNION ALL SELECT more FROM dc) GROUP BY ALL),
wt AS (SELECT kind, symbol, greatest(n, (sum(n) OVER (PARTITION BY kind) + {C.LIGHTEST - 1}) // {C.LIGHTEST})::BIGINT AS w FROM fq WHERE n > 0),
hf AS (SELECT kind, list_sort(list({{'w': w, 's': [symbol::BIGINT]}})) AS nodes, []::BIGINT[] AS merged FROM wt GROUP BY kind
 UNION ALL SELECT kind, list_sort(list_append(nodes[3:], {{'w': nodes[1].w + nodes[2].w, 's': list_concat(nodes[1].s, nodes[2].s)}})), list_concat(nodes[1].s, nodes[2].s) FROM hf WHERE len(nodes) > 1),
ln AS MATERIALIZED (SELECT wt.kind, wt.symbol::BIGINT AS symbol, greatest(1, count(m.symbol))::BIGINT AS length FROM wt LEFT JOIN (SELECT kind, unnest(merged) AS symbol FROM hf) m ON m.kind = wt.kind AND m.symbol = wt.symbol GROUP BY ALL)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """picture, block, levels in scan order, first, before (the first level of the block before), tokens, ended."""
    rows = _levels(spark, sf_dir, (50,))
    zig = F.transform(F.array(*[F.lit(i + 1) for i in K.ZIGZAG]), lambda i: F.element_at("levels", i))
    rows = rows.select(F.floor(F.col("vec_id") / PICTURE).alias("picture"), F.col("vec_id").alias("block"), zig.alias("z"))
    return C.with_symbols(rows.withColumn("first", F.get("z", F.lit(0))), "z")


def _tables(spark: SparkSession, rows: DataFrame) -> tuple[C.CodeTable, C.CodeTable]:
    """Codes of first levels, whose sizes are counted both as differences and alone, and of the rest."""
    from pyspark.sql import Window

    w = Window.partitionBy("picture").orderBy("block")  # the 64 blocks of a picture
    steps = rows.select("first", (F.col("first") - F.coalesce(F.lag("first").over(w), F.lit(0))).alias("more"))
    sizes = steps.select(F.explode(F.array(C.size_of(F.col("first")), C.size_of(F.col("more")))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    return C.CodeTable.fit(sizes), C.CodeTable.fit(C.symbol_counts(rows))


@query("COD-18", sql=f"""WITH RECURSIVE {CODES} SELECT kind, symbol, length,
(coalesce(sum(1::BIGINT << (16 - length)) OVER (PARTITION BY kind ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (16 - length))::BIGINT AS code FROM ln""")
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes of at most 16 bits for the symbols of transformed blocks, from their frequencies."""
    first, rest = _tables(spark, _symbols(spark, sf_dir))
    return first.frame(spark, "first").unionByName(rest.frame(spark, "rest"))


@query("COD-18", "JOI-14", sql=f"""WITH RECURSIVE {CODES},
rs AS (SELECT vec_id, sum(size + run // 16 * coalesce((SELECT length FROM ln WHERE kind = 'rest' AND symbol = 240), 0) + ln.length) AS bits FROM nz JOIN ln ON kind = 'rest' AND symbol = run % 16 * 16 + size GROUP BY vec_id),
bl AS MATERIALIZED (SELECT dc.vec_id // {PICTURE} AS picture, dc.vec_id AS block, row_number() OVER (PARTITION BY dc.vec_id // {PICTURE} ORDER BY dc.vec_id) AS n,
 coalesce(rs.bits, 0) + CASE WHEN en.vec_id IS NULL THEN 0 ELSE (SELECT length FROM ln WHERE kind = 'rest' AND symbol = 0) END AS bits, a.symbol + a.length AS own, b.symbol + b.length AS more
 FROM dc LEFT JOIN rs ON rs.vec_id = dc.vec_id LEFT JOIN en ON en.vec_id = dc.vec_id
 JOIN ln a ON a.kind = 'first' AND a.symbol = CASE WHEN own = 0 THEN 0 ELSE length(bin(abs(own))) END JOIN ln b ON b.kind = 'first' AND b.symbol = CASE WHEN more = 0 THEN 0 ELSE length(bin(abs(more))) END),
ch AS (SELECT picture, n, block, 0 AS chunk, bits + own AS used FROM bl WHERE n = 1 UNION ALL
 SELECT bl.picture, bl.n, bl.block, CASE WHEN ch.used + bl.bits + more <= 840 THEN ch.chunk ELSE ch.chunk + 1 END, CASE WHEN ch.used + bl.bits + more <= 840 THEN ch.used + bl.bits + more ELSE bl.bits + own END
 FROM ch JOIN bl ON bl.picture = ch.picture AND bl.n = ch.n + 1)
SELECT picture, chunk::INTEGER AS chunk, min(block)::INTEGER AS first, count(*)::INTEGER AS blocks, max(used)::INTEGER AS bits FROM ch GROUP BY picture, chunk""")
def coded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 64 blocks in chunks of 840 bits, each of which can be read alone: its first block and how full it is."""
    rows = _symbols(spark, sf_dir)
    first, rest = _tables(spark, rows)
    got = C.chunks(rows, "picture", "block", "first", first, rest)
    return got.select("picture", "chunk", "first", "blocks", F.length("payload").alias("bits"))


_STACK = SHAPES.replace("p_brand AS picture", "p_partkey // 64 AS picture").replace("0.5::DOUBLE AS alpha", "[0.25, 0.5, 0.75, 1.0][p_partkey % 4 + 1]::DOUBLE AS alpha")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of pictures of 64, of four opacities."""
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 64).alias("picture"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") * 37 % 320 / 10).alias("cx"), (F.col("p_partkey") * 91 % 320 / 10).alias("cy"),
        (F.lit(1.0) + F.col("p_size") % 7).alias("rx"), (F.lit(1.5) + F.col("p_size") % 4).alias("ry"), (F.col("p_partkey") % 16 / 16 * F.pi()).alias("angle"),
        (F.col("p_partkey") * 13 % 256).cast("double").alias("colour"), F.element_at(F.array(*[F.lit(a) for a in (0.25, 0.5, 0.75, 1.0)]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("alpha"))


@query("MTH-21", "COD-10", sql=f"""WITH {_STACK}, c AS (SELECT picture, ord, colour, alpha, y, x, (x + 0.5 - cx) * cos(angle) + (y + 0.5 - cy) * sin(angle) AS u, (y + 0.5 - cy) * cos(angle) - (x + 0.5 - cx) * sin(angle) AS v, rx, ry
FROM s, range(32) a(y), range(32) b(x)), k AS (SELECT picture, y, x, list({{'o': ord, 'c': colour, 'a': alpha}} ORDER BY ord) AS cs FROM c WHERE u * u / (rx * rx) + v * v / (ry * ry) <= 1 GROUP BY ALL),
e AS (SELECT picture, cs, unnest(range(1, len(cs) + 1)) AS i FROM k),
r AS (SELECT picture, cs[i].o AS ord, list_reduce(list_concat([1.0::DOUBLE], list_transform(cs[i + 1:], lambda z: 1 - z.a)), lambda a, b: a * b) AS passed,
 list_reduce(list_concat([{{'o': 0::BIGINT, 'c': 128.0::DOUBLE, 'a': 1.0::DOUBLE}}], list_concat(cs[:i - 1], cs[i + 1:])), lambda a, b: {{'o': 0::BIGINT, 'c': a.c * (1 - b.a) + b.c * b.a, 'a': 1.0::DOUBLE}}).c AS without,
 list_reduce(list_concat([{{'o': 0::BIGINT, 'c': 128.0::DOUBLE, 'a': 1.0::DOUBLE}}], cs[:i - 1]), lambda a, b: {{'o': 0::BIGINT, 'c': a.c * (1 - b.a) + b.c * b.a, 'a': 1.0::DOUBLE}}).c AS before FROM e)
SELECT picture, ord, count(*) AS pixels, round(sum(passed), 5) AS passed, round(sum(before), 4) AS before, round(sum(without), 4) AS without FROM r GROUP BY ALL""")
def suffix_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shape of a stack: its pixels, what later shapes let through, and the light before it and without it."""
    p = _shapes(spark, sf_dir)
    rows = L.suffixes(L.covered(p, 32), ["picture", "y", "x"], "ord", "colour", "alpha")
    return rows.groupBy("picture", "ord").agg(F.count("*").alias("pixels"), F.round(F.sum("passed"), 5).alias("passed"), F.round(F.sum("before"), 4).alias("before"), F.round(F.sum("without"), 4).alias("without"))


#: Shapes of a rate point, and bits of a picture's head and of a shape.
POINTS, HEAD_BITS, SHAPE_BITS = (4, 16, 48), 16, 59


@query("EVL-23", sql=f"""WITH {_STACK}, c AS (SELECT picture, ord, colour, alpha, y, x, (x + 0.5 - cx) * cos(angle) + (y + 0.5 - cy) * sin(angle) AS u, (y + 0.5 - cy) * cos(angle) - (x + 0.5 - cx) * sin(angle) AS v, rx, ry
FROM s, range(32) a(y), range(32) b(x)), k AS (SELECT picture, y, x, list({{'o': ord, 'c': colour, 'a': alpha}} ORDER BY ord) AS cs FROM c WHERE u * u / (rx * rx) + v * v / (ry * ry) <= 1 GROUP BY ALL),
n AS (SELECT unnest({list(POINTS)})::INTEGER AS shapes),
r AS (SELECT picture, shapes, list_reduce(list_concat([{{'o': 0::BIGINT, 'c': 128.0::DOUBLE, 'a': 1.0::DOUBLE}}], list_filter(cs, lambda z: z.o % 64 < shapes)), lambda a, b: {{'o': 0::BIGINT, 'c': a.c * (1 - b.a) + b.c * b.a, 'a': 1.0::DOUBLE}}).c AS part,
 list_reduce(list_concat([{{'o': 0::BIGINT, 'c': 128.0::DOUBLE, 'a': 1.0::DOUBLE}}], cs), lambda a, b: {{'o': 0::BIGINT, 'c': a.c * (1 - b.a) + b.c * b.a, 'a': 1.0::DOUBLE}}).c AS whole FROM k, n)
SELECT picture, shapes, ({HEAD_BITS} + {SHAPE_BITS} * shapes)::INTEGER AS bits, round(sum(pow(part - whole, 2)) / 1024, 4) AS error FROM r GROUP BY picture, shapes""")
def shape_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate points of pictures of shapes: bits of the first shapes, and how far their render is from that of all."""
    rows = L.covered(_shapes(spark, sf_dir), 32).groupBy("picture", "y", "x").agg(F.array_sort(F.collect_list(F.struct("ord", "colour", "alpha"))).alias("s"))
    laid = lambda s: F.aggregate(s, F.lit(128.0), lambda v, z: v * (1 - z["alpha"]) + z["colour"] * z["alpha"])
    point = lambda n: F.struct(F.lit(n).alias("shapes"), laid(F.filter("s", lambda z: z["ord"] % 64 < n)).alias("some"))
    each = rows.select("picture", laid("s").alias("whole"), F.inline(F.array(*[point(n) for n in POINTS])))
    error = F.round(F.sum((F.col("some") - F.col("whole")) * (F.col("some") - F.col("whole"))) / 1024, 4)
    return each.groupBy("picture", "shapes").agg(error.alias("error")).select("picture", "shapes", (HEAD_BITS + SHAPE_BITS * F.col("shapes")).alias("bits"), "error")


MARKS = (1, 2, 5, 10, 20, 40, 60)


@query("CHN-13", "SET-03", sql=f"""WITH a AS (SELECT user_id AS receiver, event_id % 16 AS unit, epoch_us(ts) / 43200000000.0::DOUBLE AS t FROM events), j AS (SELECT receiver, min(t) AS start FROM a GROUP BY 1),
f AS (SELECT a.receiver, unit, min(t - start) AS t FROM a JOIN j ON j.receiver = a.receiver GROUP BY ALL), m AS (SELECT unnest({list(MARKS)})::INTEGER AS mark),
e AS (SELECT vec_id, i % 16 AS unit, sum(pow(v * 127, 2)) AS energy FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL),
g AS (SELECT j.receiver, mark, e.unit, energy, t <= mark AS got FROM j CROSS JOIN m JOIN e ON e.vec_id = j.receiver % 50 LEFT JOIN f ON f.receiver = j.receiver AND f.unit = e.unit)
SELECT g.receiver, g.mark, count(*) FILTER (got) AS got, round(CASE WHEN count(*) FILTER (got) = 16 THEN 99 ELSE 10 * log10(65025 * 64 / sum(energy) FILTER (got IS NULL OR NOT got)) END, 6) AS psnr FROM g JOIN j ON j.receiver = g.receiver GROUP BY ALL""")
def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each receiver has of its picture at each mark, and the picture's score, measured once for each distinct state."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("receiver"), (F.col("event_id") % 16).alias("unit"),
                                             (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 43200000000).alias("t"))
    start = a.groupBy("receiver").agg(F.min("t").alias("start"))
    first = a.groupBy("receiver", "unit").agg(F.min("t").alias("t")).join(start, "receiver").select("receiver", "unit", (F.col("t") - F.col("start")).alias("t"))
    states = L.states_at_marks(first, ["receiver"], "unit", "t", MARKS).withColumn("picture", F.col("receiver") % 50)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("picture"), F.posexplode("embedding").alias("i", "v"))
    energy = e.groupBy("picture", (F.col("i") % 16).cast("long").alias("unit")).agg(F.sum(F.pow(F.col("v").cast("double") * 127, F.lit(2))).alias("energy"))

    def score(distinct: DataFrame, held: DataFrame) -> DataFrame:
        """Units that a state lacks stay grey: their energy is the error."""
        each = distinct.join(energy, "picture").join(held.withColumn("has", F.lit(1)), ["picture", "state", "unit"], "left")
        gone = F.sum(F.when(F.col("has").isNull(), F.col("energy")))
        return each.groupBy("picture", "state").agg(F.round(F.coalesce(10 * F.log10(F.lit(65025 * 64) / gone), F.lit(99.0)), 6).alias("psnr"))

    got = L.scored_states(states, first, ["picture"], ["receiver"], "unit", "t", score)
    return got.select("receiver", "mark", "got", "psnr")


LAYER_STEPS = (24.0, 8.0, 3.0)


@query("COD-07", sql=f"""WITH RECURSIVE m(i, j, c) AS (VALUES {_rows_sql(T.wavelet_2d(8, 3))}), p AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE * 127 AS v FROM embeddings),
w AS (SELECT vec_id, i, sum(c * v) AS c FROM p JOIN m USING (j) GROUP BY ALL),
y AS (SELECT vec_id, i, 0 AS layer, (sign(c) * floor(abs(c) / 24 + CASE WHEN i % 8 < 2 AND i < 16 THEN 0.5 ELSE 0.33 END))::BIGINT AS level, c AS rest, 24.0::DOUBLE AS step FROM w UNION ALL
 SELECT vec_id, i, layer + 1, (sign(rest - level * step) * floor(abs(rest - level * step) / [24.0, 8.0, 3.0][layer + 2]::DOUBLE + CASE WHEN i % 8 < 2 AND i < 16 THEN 0.5 ELSE 0.33 END))::BIGINT, rest - level * step, [24.0, 8.0, 3.0][layer + 2]::DOUBLE FROM y WHERE layer < 2)
SELECT vec_id, layer::INTEGER AS layer, count(*) FILTER (level <> 0) AS nonzero, sum({_golomb(_FOLD.format('level'), 0)})::BIGINT AS bits, round(sum(pow(rest - level * step, 2)), 4) AS error FROM y GROUP BY vec_id, layer""")
def layered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality layers of the wavelet's coefficients: each codes what the layers below have left."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 127).alias("block"))
    rows = T.apply_matrix(rows, "block", T.wavelet_2d(8, 3), "c").select("vec_id", "c")
    got = L.layers(rows, "c", LAYER_STEPS, lambda i: F.when((i % 8 < 2) & (i < 16), 0.5).otherwise(0.33))
    fold = lambda f: F.aggregate("levels", F.lit(0).cast("long"), lambda s, v: s + f(v))
    error = F.aggregate("rest", F.lit(0.0), lambda s, v: s + v * v)
    return got.select("vec_id", "layer", F.size(F.filter("levels", lambda v: v != 0)).cast("long").alias("nonzero"), fold(lambda v: B.exp_golomb_length(B.fold(v))).alias("bits"), F.round(error, 4).alias("error"))


def _concealed_sql() -> str:
    steps = ["c0 AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, CASE WHEN (vec_id * 31 + i * 17) % 13 < 2 THEN round(v * 127) END AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"]
    for k in range(4):
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT a.vec_id, a.i, a.y, a.x, coalesce(any_value(a.v), avg(b.v)) AS v FROM c{k} a LEFT JOIN c{k} b ON b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.i <> a.i AND b.v IS NOT NULL GROUP BY a.vec_id, a.i, a.y, a.x)""")
    each = " UNION ALL ".join(f"SELECT vec_id, {k}::INTEGER AS passes, count(v) AS known, round(sum(v), 6) AS total FROM c{k} GROUP BY vec_id" for k in range(5))
    return f"WITH {', '.join(steps)} {each}"


@query("COD-07", sql=_concealed_sql())
def concealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse values that did not arrive take the mean of their known neighbours, in up to four passes."""
    cell = lambda x, i: F.when((F.col("vec_id") * 31 + i * 17) % 13 < 2, F.round(x.cast("double") * 127))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", cell).alias("c0"))
    for k in range(4):
        rows = rows.withColumn(f"c{k + 1}", L.concealed_once(f"c{k}", 8))
    each = F.array(*[F.struct(F.lit(k).alias("passes"), F.filter(f"c{k}", lambda v: v.isNotNull()).alias("v")) for k in range(5)])
    got = rows.select("vec_id", F.inline(each))
    total = F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda s, v: s + v))
    return got.select("vec_id", "passes", F.size("v").cast("long").alias("known"), F.round(total, 6).alias("total"))


_HAAR = T.haar_2d(8, 2)


@query("COD-11", "COD-12", "COD-17", "SRT-01", sql=f"""WITH p AS (SELECT vec_id, i, i // 32 * 2 + i % 8 // 4 AS q, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 127 AS v FROM embeddings)),
b AS (SELECT vec_id, q, avg(v) AS mean, floor(avg(v) / 2 + 0.5) * 2 AS coded FROM p GROUP BY ALL),
m(j, i, c) AS (VALUES {_rows_sql(_HAAR)}), r AS (SELECT p.vec_id, p.i, v - coded AS v FROM p JOIN b ON b.vec_id = p.vec_id AND b.q = p.q),
w AS (SELECT vec_id, j, sum(c * v) AS c FROM r JOIN m USING (i) GROUP BY ALL),
u AS (SELECT vec_id, 0 AS kind, q AS unit, 16 * (mean * mean - pow(mean - coded, 2)) AS gain FROM b WHERE coded <> 0
 UNION ALL SELECT vec_id, 1, j, c * c - pow(c - sign(c) * floor(abs(c) / 12 + 0.5) * 12, 2) FROM w WHERE abs(c) >= 6),
g AS (SELECT vec_id, kind, unit, round(gain, 5) AS gain FROM u), e AS (SELECT vec_id, sum(v * v) AS energy FROM p GROUP BY 1)
SELECT g.vec_id, kind::INTEGER AS kind, unit::INTEGER AS unit, row_number() OVER w AS place, gain, round(energy - sum(gain) OVER w, 3) AS error FROM g JOIN e ON e.vec_id = g.vec_id
WINDOW w AS (PARTITION BY g.vec_id ORDER BY gain DESC, kind, unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def base_residual_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of coarse means and one of what rendering them leaves, merged by gain: the error that every prefix has."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 127).alias("v"))
    return L.base_and_residual(rows, "v", base_step=2.0, step=12.0).select("vec_id", "kind", "unit", "place", "gain", "error")


#: Bits that a block may have on average.
BUDGET = 90


@query("COD-14", sql=f"""WITH RECURSIVE {LEVELS}, o AS (SELECT l.vec_id, 1 + list_position([25, 50, 90], l.quality) AS mode, sum({_golomb(_FOLD.format('level'), 0)})::BIGINT AS bits, round(sum(pow(f.c - level * step, 2)), 3) AS error
 FROM l JOIN f ON f.vec_id = l.vec_id AND f.i = l.i JOIN k ON k.quality = l.quality AND k.i = l.i GROUP BY ALL),
x AS (SELECT vec_id, avg(v) AS mean, sum(v * v) AS energy FROM p GROUP BY 1), z AS MATERIALIZED (SELECT * FROM o UNION ALL SELECT vec_id, 0, 1, round(energy, 3) FROM x UNION ALL SELECT vec_id, 1, 10, round(energy - 64 * mean * mean + 64 * pow(mean - floor(mean + 0.5), 2), 3) FROM x),
h AS (SELECT vec_id, mode, bits, error, NULL::DOUBLE AS slope FROM z WHERE mode = 0 UNION ALL
 SELECT vec_id, t.mode, t.bits, t.error, t.slope FROM (SELECT h.vec_id, z.mode, z.bits, z.error, (h.error - z.error) / (z.bits - h.bits) AS slope, row_number() OVER (PARTITION BY h.vec_id ORDER BY (h.error - z.error) / (z.bits - h.bits) DESC, z.bits DESC, z.mode DESC) AS r
  FROM h JOIN z ON z.vec_id = h.vec_id AND z.bits > h.bits AND z.error < h.error) t WHERE r = 1),
s AS MATERIALIZED (SELECT *, bits - lag(bits) OVER (PARTITION BY vec_id ORDER BY bits) AS more, floor(ln(slope) * 16)::BIGINT AS b FROM h),
t AS (SELECT b, sum(sum(more)) OVER (ORDER BY b DESC) + (SELECT sum(bits) FROM z WHERE mode = 0) AS used FROM s WHERE slope IS NOT NULL GROUP BY b),
c AS (SELECT coalesce(min(b), 1000000) AS b FROM t WHERE used <= {BUDGET} * (SELECT count(*) FROM x)), y AS (SELECT s.* FROM s, c WHERE slope IS NULL OR s.b >= c.b)
SELECT vec_id, arg_max(mode, bits)::INTEGER AS mode, max(bits)::BIGINT AS bits, arg_max(error, bits) AS error FROM y GROUP BY vec_id""")
def mode_by_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each block, of nothing, a mean and three qualities, that one price of bits over all blocks chooses within a budget."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 127 * 8).alias("block"))
    rows = K.dct(rows, "block", "c").select("vec_id", "block", "c")
    fold = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    mean = F.aggregate("block", F.lit(0.0), lambda s, v: s + v) / 64
    rows = rows.withColumn("mean", mean).withColumn("energy", fold("block", lambda v: v * v))
    mode = lambda m, bits, error: F.struct(F.lit(m).alias("mode"), bits.cast("long").alias("bits"), F.round(error, 3).alias("error"))
    modes = [mode(0, F.lit(1), F.col("energy")), mode(1, F.lit(10), F.col("energy") - 64 * F.col("mean") * F.col("mean") + 64 * F.pow(F.col("mean") - F.floor(F.col("mean") + 0.5), F.lit(2)))]
    for k, q in enumerate((25, 50, 90)):
        steps = [float(s) for s in T.quality_steps(q)]
        rows = rows.withColumn(f"l{k}", K.quantise("c", steps)).withColumn(f"e{k}", F.zip_with("c", K.dequantise(f"l{k}", steps), lambda a, b: a - b))
        bits = F.aggregate(f"l{k}", F.lit(0).cast("long"), lambda s, v: s + B.exp_golomb_length(B.fold(v)))
        modes.append(mode(k + 2, bits, fold(f"e{k}", lambda v: v * v)))
    return L.within_budget(rows.select("vec_id", F.array(*modes).alias("modes")), "vec_id", "modes", BUDGET)
