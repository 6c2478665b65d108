"""Codes of transformed blocks: quality tables, run packets, wavelets, chroma planes, palettes, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K
from driftcast.functions import transforms as T
from driftcast.operators import runs
from driftcast.operators.aggregates import lloyd_step
from driftcast.plans.registry import query
from driftcast.sources import logs
from driftcast.sources.shared import shared_dir, written
from driftcast.sources.tables import sightings, table

QUALITIES = (25, 50, 90)
#: Coefficients of the blocks, in SQL: vec_id, i (row * 8 + column), c.
DCT = """p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 127 * 8 AS v FROM embeddings),
w AS (SELECT u, x, (CASE WHEN u = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END) * cos((2 * x + 1) * u * pi() / 16) AS c FROM range(8) a(u), range(8) b(x)),
r AS (SELECT vec_id, i // 8 AS y, u, sum(v * c) AS s FROM p JOIN w ON x = i % 8 GROUP BY ALL),
f AS (SELECT vec_id, w.u * 8 + r.u AS i, sum(s * c) AS c FROM r JOIN w ON x = y GROUP BY vec_id, w.u, r.u)"""
_TABLE = f"[{', '.join(map(str, T.ANNEX_K))}]"
#: Levels at each quality, by the integer rule: vec_id, quality, i, level.
LEVELS = DCT + f""", k AS (SELECT q AS quality, i, least(255, greatest(1, ({_TABLE}[i + 1] * (CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END) + 50) // 100)) AS step
 FROM (SELECT unnest([25, 50, 90])::INTEGER AS q), range(64) n(i)), l AS (SELECT vec_id, quality, f.i, floor(c / step + 0.5)::BIGINT AS level FROM f JOIN k ON f.i = k.i)"""
_FOLD = "(CASE WHEN {0} > 0 THEN 2 * ({0}) - 1 ELSE -2 * ({0}) END)"


def _golomb(v: str, k: int) -> str:
    return f"(2 * length(bin(({v}) + {1 << k})) - 1 - {k})"


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 127 * 8).alias("block"))
    return K.dct(blocks, "block", "c").select("vec_id", "c")


def _levels(spark: SparkSession, sf_dir: str, qualities: tuple[int, ...]) -> DataFrame:
    """vec_id, quality, levels (64, by rows)."""
    rows = _coefficients(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(q).alias("quality"), K.quantise("c", [float(s) for s in T.quality_steps(q)]).alias("levels")) for q in qualities])
    return rows.select("vec_id", F.explode(each).alias("e")).select("vec_id", "e.*")


@query("MTH-06", "RQC-06", sql=f"""WITH {LEVELS} SELECT vec_id, quality, count(*) FILTER (level <> 0) AS nonzero, sum(abs(level))::BIGINT AS magnitude,
sum({_golomb(_FOLD.format('level'), 0)})::BIGINT AS bits FROM l GROUP BY vec_id, quality""")
def annex_k_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of transformed blocks at three qualities of the standard's table: levels other than 0 and bits of their codes."""
    rows = _levels(spark, sf_dir, QUALITIES)
    fold = lambda f: F.aggregate("levels", F.lit(0).cast("long"), lambda s, v: s + f(v))
    return rows.select("vec_id", "quality", F.size(F.filter("levels", lambda v: v != 0)).cast("long").alias("nonzero"), fold(F.abs).alias("magnitude"),
                       fold(lambda v: B.exp_golomb_length(B.fold(v))).alias("bits"))


_ZIGZAG = f"[{', '.join(map(str, K.ZIGZAG))}]"
_LAY = runs.RunLayout()
_GROUP = "(CASE WHEN pos < 4 THEN 0 WHEN pos < 20 THEN 1 ELSE 2 END)"
#: Header bits of a packet that begins at a position, and how far the position is from where it counts.
_HEAD = f"(2 + [{', '.join(str(_LAY.index_bits(g)) for g in range(3))}][{_GROUP} + 1])"
_GAP = "(CASE WHEN pos < 4 THEN 0 WHEN pos < 20 THEN (pos - 4) % 2 ELSE (pos - 20) % 4 END)"


def _symbol(run: str, before: str) -> str:
    dense, sparse = _golomb(_FOLD.format(f"(v - {before})"), 2), f"{_golomb(run, 1)} + {_golomb(_FOLD.format('v'), 1)}"
    return f"(CASE WHEN pos < 4 THEN {dense} ELSE {sparse} END)"


@query("COD-05", "COD-13", sql=f"""WITH RECURSIVE {LEVELS}, z AS (SELECT vec_id, list_position({_ZIGZAG}, i) - 1 AS pos, level AS v FROM l WHERE quality = 50),
s AS (SELECT vec_id, pos, v, row_number() OVER w AS n, coalesce(lag(pos) OVER w, -1) + 1 AS nxt, coalesce(lag(v) OVER w, 0) AS last FROM z WHERE pos < 4 OR v <> 0 WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
c AS (SELECT vec_id, n, pos, {_symbol('pos - nxt', 'last')} AS more, {_HEAD} + {_symbol(_GAP, '0')} AS own FROM s),
t AS (SELECT vec_id, n, pos, 0 AS packet, own AS used FROM c WHERE n = 1 UNION ALL
 SELECT c.vec_id, c.n, c.pos, CASE WHEN t.used + more <= 64 THEN t.packet ELSE t.packet + 1 END, CASE WHEN t.used + more <= 64 THEN t.used + more ELSE own END FROM t JOIN c ON c.vec_id = t.vec_id AND c.n = t.n + 1)
SELECT vec_id, packet::INTEGER AS packet, min(pos)::INTEGER AS first, count(*)::INTEGER AS symbols, max(used)::INTEGER AS bits FROM t GROUP BY vec_id, packet""")
def packet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-contained packets of at most 64 bits of the levels at quality 50, in zigzag order."""
    rows = _levels(spark, sf_dir, (50,))
    zig = F.transform(F.array(*[F.lit(i + 1) for i in K.ZIGZAG]), lambda i: F.element_at("levels", i))
    got = runs.packets(rows.select("vec_id", zig.alias("z")), "vec_id", "z", 64)
    return got.select("vec_id", "packet", "first", "symbols", F.length("payload").alias("bits"))


def _rows_sql(matrix) -> str:
    return ", ".join(f"({i}, {j}, {float(matrix[i, j])!r}::DOUBLE)" for i in range(len(matrix)) for j in range(matrix.shape[1]) if abs(matrix[i, j]) > 1e-15)


@query("MTH-08", "MTH-09", "RQC-07", sql=f"""WITH m(i, j, c) AS (VALUES {_rows_sql(T.wavelet_2d(8, 3))}), p AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE * 127 AS v FROM embeddings),
w AS (SELECT vec_id, i, sum(c * v) AS c FROM p JOIN m USING (j) GROUP BY ALL), q AS (SELECT vec_id, i, (sign(c) * floor(abs(c) / 6))::BIGINT AS level FROM w)
SELECT vec_id, count(*) FILTER (level <> 0) AS nonzero, sum(abs(level))::BIGINT AS magnitude, sum({_golomb(_FOLD.format('level'), 0)})::BIGINT AS bits,
 sum(abs(level)) FILTER (i % 8 < 2 AND i < 16)::BIGINT AS low FROM q GROUP BY vec_id""")
def wavelet_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of the two-dimensional 9/7 wavelet with a dead zone: code totals, and what the low corner holds."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 127).alias("block"))
    rows = T.apply_matrix(rows, "block", T.wavelet_2d(8, 3), "c").select("vec_id", F.transform("c", lambda c: (F.signum(c) * F.floor(F.abs(c) / 6)).cast("long")).alias("q"))
    fold = lambda f: F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + f(v))
    low = sum((F.abs(F.element_at("q", y * 8 + x + 1)) for y in range(2) for x in range(2)), F.lit(0).cast("long"))
    return rows.select("vec_id", F.size(F.filter("q", lambda v: v != 0)).cast("long").alias("nonzero"), fold(F.abs).alias("magnitude"),
                       fold(lambda v: B.exp_golomb_length(B.fold(v))).alias("bits"), low.alias("low"))


@query("RQC-02", "MTH-01", sql="""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1]::DOUBLE * 127 + 128 AS r, e[64 - i]::DOUBLE * 127 + 128 AS g, e[(i * 9) % 64 + 1]::DOUBLE * 127 + 128 AS b
 FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings)), c AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS l, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b AS cb, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b AS cr FROM p),
h AS (SELECT vec_id, y // 2 AS hy, x // 2 AS hx, avg(cb) AS cb, avg(cr) AS cr FROM c GROUP BY ALL),
d AS (SELECT c.vec_id, r, g, b, floor(greatest(0, least(255, l)) + 0.5) AS l, floor(greatest(0, least(255, h.cb)) / 255 * 31 + 0.5) * 255 / 31 - 128 AS cb, floor(greatest(0, least(255, h.cr)) / 255 * 31 + 0.5) * 255 / 31 - 128 AS cr
 FROM c JOIN h ON c.vec_id = h.vec_id AND y // 2 = hy AND x // 2 = hx)
SELECT vec_id, (64 * 8 + 2 * 16 * 5)::INTEGER AS bits, round(sqrt(avg(pow(l + 1.402 * cr - r, 2) + pow(l - 0.344136 * cb - 0.714136 * cr - g, 2) + pow(l + 1.772 * cb - b, 2)) / 3), 6) AS error FROM d GROUP BY vec_id""")
def chroma_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pictures with luma at 8 bits and chroma at half the resolution and 5 bits: size and error."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda k: F.element_at("e", k.cast("int")).cast("double") * 127 + 128
    p = e.select("vec_id", F.floor(F.col("i") / 16).alias("hy"), F.floor(F.col("i") % 8 / 2).alias("hx"), at(F.col("i") + 1).alias("r"), at(64 - F.col("i")).alias("g"), at(F.col("i") * 9 % 64 + 1).alias("b"))
    l, cb, cr = K.ycc(F.col("r"), F.col("g"), F.col("b"))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    pixel = F.struct("r", "g", "b", F.floor(clamp(l) + 0.5).alias("l"))
    half = p.groupBy("vec_id", "hy", "hx").agg(F.avg(cb).alias("cb"), F.avg(cr).alias("cr"), F.collect_list(pixel).alias("four"))  # four pixels
    level = lambda v: F.floor(clamp(v) / 255 * 31 + 0.5) * 255 / 31 - 128
    d = half.select("vec_id", level(F.col("cb")).alias("cb"), level(F.col("cr")).alias("cr"), F.inline("four"))
    gone = [F.col("l") + 1.402 * F.col("cr") - F.col("r"), F.col("l") - 0.344136 * F.col("cb") - 0.714136 * F.col("cr") - F.col("g"), F.col("l") + 1.772 * F.col("cb") - F.col("b")]
    return d.groupBy("vec_id").agg(F.lit(64 * 8 + 2 * 16 * 5).alias("bits"), F.round(F.sqrt(F.avg(sum((x * x for x in gone), F.lit(0.0))) / 3), 6).alias("error"))


#: Opacities that a shape may have, and levels of its colour.
ALPHAS, COLOURS = (0.25, 0.5, 0.75, 1.0), 31


@query("MTH-19", sql="""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1]::DOUBLE * 127 + 128 AS t, 128 + 8.0::DOUBLE * (i % 8 - 3) AS c FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings)),
s(shape, cy, cx, ry, rx) AS (VALUES (0, 2, 2, 2, 3), (1, 5, 4, 3, 2), (2, 3, 6, 3, 1)),
g AS (SELECT vec_id, shape, count(*) AS n, sum(t - c) AS d, sum((t - c) * c) AS dc, sum(c) AS c, sum(c * c) AS cc FROM p JOIN s ON pow((x - cx) / rx::DOUBLE, 2) + pow((y - cy) / ry::DOUBLE, 2) <= 1 GROUP BY ALL),
o AS (SELECT *, unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha FROM g), q AS (SELECT *, floor(greatest(0, least(255, c / n + d / (alpha * n))) / 255 * 31 + 0.5)::BIGINT AS code FROM o),
e AS (SELECT *, round(-2 * alpha * (code * 255 / 31.0::DOUBLE * d - dc) + alpha * alpha * (n * pow(code * 255 / 31.0::DOUBLE, 2) - 2 * code * 255 / 31.0::DOUBLE * c + cc), 6) AS delta FROM q)
SELECT vec_id, shape, arg_min(alpha, (delta, alpha)) AS alpha, arg_min(code, (delta, alpha)) AS code, min(delta) AS delta FROM e GROUP BY vec_id, shape""")
def shape_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the squared error falls when a shape of the best colour and opacity is laid over, from sums over its pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "t"))
    p = e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), (F.col("t").cast("double") * 127 + 128).alias("t"), (128 + 8.0 * (F.col("i") % 8 - 3)).alias("c"))
    shapes = spark.createDataFrame([(0, 2, 2, 2, 3), (1, 5, 4, 3, 2), (2, 3, 6, 3, 1)], "shape int, cy int, cx int, ry int, rx int")  # three rows
    inside = F.pow((F.col("x") - F.col("cx")) / F.col("rx"), F.lit(2)) + F.pow((F.col("y") - F.col("cy")) / F.col("ry"), F.lit(2)) <= 1
    d = F.col("t") - F.col("c")
    sums = p.join(F.broadcast(shapes), inside).groupBy("vec_id", "shape").agg(
        F.count("*").alias("n"), F.sum(d).alias("d"), F.sum(d * F.col("c")).alias("dc"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("c"))

    def tried(a: float):
        code = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("c") / F.col("n") + F.col("d") / (a * F.col("n")))) / 255 * COLOURS + 0.5)
        v = code * 255 / COLOURS
        delta = -2 * a * (v * F.col("d") - F.col("dc")) + a * a * (F.col("n") * v * v - 2 * v * F.col("c") + F.col("cc"))
        return F.struct(F.round(delta, 6).alias("delta"), F.lit(a).alias("alpha"), code.alias("code"))

    return sums.select("vec_id", "shape", F.array_min(F.array(*[tried(a) for a in ALPHAS])).alias("b")).select("vec_id", "shape", "b.alpha", "b.code", "b.delta")


@query("MTH-18", sql="""WITH l AS (SELECT l_orderkey, count(*) AS shapes, sum(sign(l_discount - 0.05) * pow((l_discount - 0.05) * 20, 2) * l_quantity) AS light FROM lineitem GROUP BY 1)
SELECT l_orderkey, shapes, round(greatest(0, least(255, 128 + light)), 6) AS value FROM l""")
def additive_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light that shapes add or take, by a signed square law and their soft weights: a sum, so their order does not count."""
    d = F.col("l_discount") - 0.05
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("shapes"), F.sum(F.signum(d) * F.pow(d * 20, F.lit(2)) * F.col("l_quantity")).alias("light"))
    return rows.select("l_orderkey", "shapes", F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + F.col("light"))), 6).alias("value"))


_LINEAR = "(SELECT o, greatest(0, least(7, f + k)) AS i, sum(CASE WHEN k = 0 THEN 1 - (s - f) ELSE s - f END) AS part FROM (SELECT o, (o + 0.5) * 8 / 12.0::DOUBLE - 0.5 AS s, floor((o + 0.5) * 8 / 12.0::DOUBLE - 0.5)::BIGINT AS f FROM range(12) r(o)), range(2) t(k) GROUP BY ALL)"


@query("MTH-04", sql=f"""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1]::DOUBLE * 127 + 128 AS v FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings)), w AS {_LINEAR}
SELECT vec_id, b.o AS y, a.o AS x, round(sum(v * a.part * b.part), 6) AS v FROM p JOIN w a ON a.i = p.x JOIN w b ON b.i = p.y GROUP BY ALL""")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 x 8 enlarged to 12 x 12 between the centres of samples, clamped at the borders."""
    n, m = 8, 12
    at = (F.col("o") + 0.5) * n / m - 0.5
    w = spark.range(m).select(F.col("id").alias("o")).withColumn("s", at).withColumn("f", F.floor("s")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    part = F.when(F.col("k") == 0, 1 - (F.col("s") - F.col("f"))).otherwise(F.col("s") - F.col("f"))
    w = F.broadcast(w.groupBy("o", F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col("f") + F.col("k"))).alias("i")).agg(F.sum(part).alias("part")))  # two weights a sample
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "e"))
    p = p.select("vec_id", F.floor(F.col("j") / n).alias("y"), (F.col("j") % n).cast("long").alias("x"), (F.col("e").cast("double") * 127 + 128).alias("v"))
    wide = p.join(w, p["x"] == w["i"]).groupBy("vec_id", "y", F.col("o").alias("ox")).agg(F.sum(F.col("v") * F.col("part")).alias("v"))
    return wide.join(w, wide["y"] == w["i"]).groupBy("vec_id", F.col("o").alias("y"), F.col("ox").alias("x")).agg(F.round(F.sum(F.col("v") * F.col("part")), 6).alias("v"))


ROUNDS, CENTRES = 5, 8


def _kmeans_sql() -> str:
    steps = [f"c0 AS (SELECT vec_id AS cid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < {CENTRES})"]
    for k in range(ROUNDS):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT v.vec_id, cid, round(list_sum(list_transform(range(1, 65), lambda i: pow(v.embedding[i]::DOUBLE - c.e[i], 2))), 9) AS d FROM embeddings v, c{k} c) GROUP BY vec_id)""")
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT cid, list(m ORDER BY i) AS e FROM (SELECT a.cid, i, round(avg(v), 9) AS m FROM a{k} a JOIN (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) p USING (vec_id) GROUP BY ALL) GROUP BY cid)""")
    return f"WITH {', '.join(steps)} SELECT cid, count(*) AS members, round(sum(d), 6) AS error FROM a{ROUNDS - 1} GROUP BY cid"


@query("AGG-21", "RQC-08", sql=_kmeans_sql())
def trained_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code book by rounds of assignment and grouped means: members and error of each entry in the last round."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    centres = points.filter(F.col("vec_id") < CENTRES).select(F.col("vec_id").alias("cid"), F.col("x").alias("centre"))
    for k in range(ROUNDS):
        near = lloyd_step(points, centres, "x").select("x", F.col("_near.cid").alias("cid"), F.col("_near.d").alias("d"))
        if k == ROUNDS - 1:
            return near.groupBy("cid").agg(F.count("*").alias("members"), F.round(F.sum("d"), 6).alias("error"))
        means = near.select("cid", F.posexplode("x").alias("i", "v")).groupBy("cid", "i").agg(F.round(F.avg("v"), 9).alias("m"))
        centres = means.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
        centres = written(centres, "code-book")  # a row for each entry; cuts the lineage of the rounds
    raise AssertionError("no rounds")


@query("SRC-03", sql="""SELECT event_id::INTEGER AS seq, epoch_us(ts) / 1000.0::DOUBLE AS "sendStartMs" FROM events""")
def joined_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send logs of two sessions, each file with a time base of its own, read together on the wall clock."""
    s = sightings(spark, sf_dir)
    paths = []
    for kind, base in (("even", 0.0), ("odd", 5e5)):
        rows = s.filter(F.coalesce(F.pmod("epoch", F.lit(2)), F.lit(0)) == int(kind == "odd"))
        log = rows.select(F.col("seq").cast("int"), F.lit(1).alias("mode"), F.col("epoch").cast("int").alias("epoch"), F.lit(100).alias("holdMs"), (F.col("time_ms") - base).alias("sendStartMs"),
                          (F.col("time_ms") - base + 3).alias("sendEndMs"), F.col("time_ms").alias("unixMs"), F.lit(1).alias("bundle"), F.lit("asc").alias("order"), F.lit(0).alias("msgDelay"))
        paths.append(shared_dir(spark, f"log-{kind}"))
        log.write.option("header", True).csv(paths[-1])
    return logs.send_logs(spark, "+".join(paths)).select("seq", "sendStartMs")


@query("SRC-06", sql="SELECT o_custkey AS image, o_orderkey AS seed, o_totalprice AS q FROM orders")
def folder_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON files, each an array of rows with arrays of results, read and flattened."""
    path = shared_dir(spark, "results")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("image")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("q"))).alias("rows"))
    # Four files, each with one array over several lines.
    each = rows.groupBy(F.pmod("image", F.lit(4)).alias("file")).agg(F.collect_list(F.struct("image", "rows")).alias("all"))
    each.select("file", F.to_json("all", {"pretty": "true"}).alias("value")).write.partitionBy("file").text(path)
    return logs.json_folder(spark, f"{path}/file=*", "image long, rows array<struct<seed:long,q:double>>").select("image", F.inline("rows"))


@query("SRC-13", sql="SELECT l_returnflag AS label, l_linestatus AS name, count(*) AS n, 1::INTEGER AS made FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, l_linestatus, count(*), 0::INTEGER FROM lineitem GROUP BY ALL")
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are made once for each label and read from storage when asked for again."""
    folder, out = shared_dir(spark, "cache"), None
    rows = table(spark, sf_dir, "lineitem")
    for label in ("A", "N", "R", "A", "N", "R"):
        got, made = logs.cached(spark, folder, label, lambda x: rows.filter(F.col("l_returnflag") == x).groupBy(F.col("l_linestatus").alias("name")).agg(F.count("*").alias("n")))
        row = got.select(F.lit(label).alias("label"), "name", "n", F.lit(int(made)).alias("made"))
        out = row if out is None else out.unionByName(row)
    return out


_SCORE = "round(CASE WHEN avg(pow({0}, 2)) = 0 THEN 99 ELSE 10 * log10(65025 / avg(pow({0}, 2))) END, 6)"


@query("EVL-09", "EVL-11", sql=f"""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1]::DOUBLE * 127 + 128 AS v FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings)),
q AS (SELECT *, floor(v / step + 0.5) * step AS c FROM p, (SELECT unnest([2, 8, 32])::INTEGER AS step)),
h AS (SELECT vec_id, step, avg(v) - avg(c) AS d FROM q GROUP BY vec_id, step, y // 2, x // 2), s AS (SELECT vec_id, step, {_SCORE.format('d')} AS half FROM h GROUP BY ALL),
w AS (SELECT vec_id, step, {_SCORE.format('v - c')} AS whole, {_SCORE.format('CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6 THEN v - c END')} AS crop FROM q GROUP BY ALL)
SELECT w.vec_id, w.step, whole, crop, half FROM w JOIN s ON w.vec_id = s.vec_id AND w.step = s.step""")
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal-to-noise ratio of quantised pictures as a whole, in a fixed crop, and at half the scale."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    p = p.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), (F.col("e").cast("double") * 127 + 128).alias("v"), F.explode(F.array(*[F.lit(k) for k in (2, 8, 32)])).alias("step"))
    p = p.withColumn("d", F.col("v") - F.floor(F.col("v") / F.col("step") + 0.5) * F.col("step"))
    # Boxes of four first: their mean difference is the half scale's, and sums of squares go on to the whole and the crop.
    inside = F.col("y").between(2, 5) & F.col("x").between(1, 6)
    square = F.col("d") * F.col("d")
    box = p.groupBy("vec_id", "step", F.floor(F.col("y") / 2), F.floor(F.col("x") / 2)).agg(
        F.avg("d").alias("d"), F.sum(square).alias("all"), F.sum(F.when(inside, square)).alias("some"), F.count_if(inside).alias("n"))
    score = lambda e: F.round(F.when(e == 0, 99.0).otherwise(10 * F.log10(65025 / e)), 6)
    return box.groupBy("vec_id", "step").agg(score(F.sum("all") / 64).alias("whole"), score(F.sum("some") / F.sum("n")).alias("crop"), score(F.avg(F.col("d") * F.col("d"))).alias("half"))


@query("EVL-10", "EVL-17", sql="""WITH s AS (SELECT p_partkey, p_size::DOUBLE AS w, (1 + p_partkey % 40)::DOUBLE AS h FROM part WHERE p_size > 0),
f AS (SELECT *, least(512 / w, 512 / h) AS k FROM s WHERE abs(w / h - 1) >= 0.02), r AS (SELECT *, greatest(1, floor(w * k + 0.5))::BIGINT AS rw, greatest(1, floor(h * k + 0.5))::BIGINT AS rh FROM f)
SELECT p_partkey, (512 - rw) // 2 AS x0, (512 - rh) // 2 AS y0, rw, rh, round(1 - rw * rh / 262144.0::DOUBLE, 6) AS padded, round(greatest(w / h, h / w), 6) AS stretch FROM r""")
def letterbox_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pictures that are not square lie in a square canvas, what of it is padding, and how far stretching would distort them."""
    s = table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", F.col("p_size").cast("double").alias("w"), (1 + F.col("p_partkey") % 40).cast("double").alias("h"))
    s = s.filter(F.abs(F.col("w") / F.col("h") - 1) >= 0.02).withColumn("k", F.least(512 / F.col("w"), 512 / F.col("h")))
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.col("k") + 0.5))
    r = s.withColumn("rw", side("w")).withColumn("rh", side("h"))
    edge = lambda c: F.floor((512 - F.col(c)) / 2)
    return r.select("p_partkey", edge("rw").alias("x0"), edge("rh").alias("y0"), "rw", "rh", F.round(1 - F.col("rw") * F.col("rh") / 262144, 6).alias("padded"),
                    F.round(F.greatest(F.col("w") / F.col("h"), F.col("h") / F.col("w")), 6).alias("stretch"))


@query("EVL-17", sql="""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1]::DOUBLE * 127 + 128 AS v FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings)),
b AS (SELECT vec_id, y // 2 AS gy, x // 2 AS gx, floor(avg(v) + 0.5) AS m FROM p GROUP BY ALL)
SELECT p.vec_id, round(avg(m) - avg(v), 6) AS shift, round(CASE WHEN avg(pow(v - m, 2)) = 0 THEN 99 ELSE 10 * log10(65025 / avg(pow(v - m, 2))) END, 6) AS psnr
FROM p JOIN b ON p.vec_id = b.vec_id AND y // 2 = gy AND x // 2 = gx GROUP BY p.vec_id""")
def downscale_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far halving a picture by rounded boxes shifts its mean, and the error of the boxes against the samples."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    p = p.select("vec_id", F.floor(F.col("i") / 16).alias("by"), F.floor(F.col("i") % 8 / 2).alias("bx"), (F.col("e").cast("double") * 127 + 128).alias("v"))
    b = p.groupBy("vec_id", "by", "bx").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.collect_list("v").alias("four"))  # four samples
    m = F.floor(F.col("s") / 4 + 0.5)
    error = F.aggregate("four", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m")))
    b = b.withColumn("m", m).withColumn("error", error)
    mse = F.sum("error") / 64
    return b.groupBy("vec_id").agg(F.round(F.avg("m") - F.sum("s") / 64, 6).alias("shift"), F.round(F.when(mse == 0, 99.0).otherwise(10 * F.log10(65025 / mse)), 6).alias("psnr"))
