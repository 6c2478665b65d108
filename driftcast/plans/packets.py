"""Bits, layouts, schedules, channels, QR cells and 8 x 8 blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K
from driftcast.operators import channel as C
from driftcast.operators import layouts as L
from driftcast.operators import schedules as S
from driftcast.operators.aggregates import lloyd_step
from driftcast.plans.registry import query
from driftcast.sources.tables import table

_BIN = "lpad(bin(l_orderkey & 65535), 16, '0')"
_CRC = """list_reduce(list_concat([0], list_transform(range(1, 17), lambda i: substr(b, i, 1)::INTEGER)),
 lambda reg, bit: xor((reg << 1) & {mask}, CASE WHEN xor((reg >> {top}) & 1, bit) = 1 THEN {poly} ELSE 0 END))::INTEGER"""


@query("BIT-01", "BIT-02", "BIT-06", "BIT-20", sql=f"SELECT l_orderkey, l_linenumber, l_partkey, {_BIN} AS bits, rpad({_BIN}, 20, '0') AS padded, (CASE WHEN (l_partkey & 255) >= 128 THEN (l_partkey & 255) - 256 ELSE l_partkey & 255 END) AS signed FROM lineitem")
def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 16 bits, padded, and bytes as signed values; reading gives back what was written."""
    bits = B.to_bits(F.col("l_orderkey"), 16)
    low = B.from_bits(B.to_bits(F.col("l_partkey"), 8))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.alias("bits"), F.rpad(bits, 20, "0").alias("padded"), B.signed(low, 8).alias("signed"))


@query("BIT-03", "BIT-04", "BIT-05", sql="""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 41 - 20) AS v FROM lineitem), u AS (SELECT *, CASE WHEN v > 0 THEN 2 * v - 1 ELSE -2 * v END AS u FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, repeat('0', length(bin(u + 2)) - 2) || bin(u + 2) AS code, (2 * length(bin(u + 2)) - 2)::INTEGER AS n, v AS back FROM u""")
def exp_golomb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed values in exponential Golomb code of order 1, and back."""
    rows = table(spark, sf_dir, "lineitem").withColumn("u", B.fold(F.col("l_partkey") % 41 - 20)).withColumn("code", B.exp_golomb(F.col("u"), 1))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "code", B.exp_golomb_length(F.col("u"), 1).cast("int").alias("n"), B.unfold(B.exp_golomb_read(F.col("code"), 1)).alias("back"))


@query("BIT-07", "CHN-08", sql=f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_BIN} AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {_CRC.format(mask=15, top=3, poly=3)} AS crc4, {_CRC.format(mask=255, top=7, poly=7)} AS crc8 FROM x")
def crc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of 4 and 8 bits."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.crc(key, 16, 4).alias("crc4"), B.crc(key, 16, 8).alias("crc8"))


_M = lambda a, b: f"((({a})::HUGEINT * ({b})) & 4294967295)::BIGINT"


@query("BIT-08", "BIT-09", "CHN-07", sql=f"""WITH a AS (SELECT o_orderkey, (o_custkey + {_M('o_orderkey % 5 + 1', '1831565813')}) & 4294967295 AS a FROM orders),
t AS (SELECT *, {_M('xor(a, a >> 15)', 'a | 1')} AS t FROM a), u AS (SELECT *, xor(t, (t + {_M('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS u FROM t)
SELECT o_orderkey, xor(u, u >> 14) / 4294967296.0::DOUBLE AS draw, 20 + 60 * (xor(u, u >> 14) / 4294967296.0::DOUBLE) AS join_s, ({_M('o_orderkey', '1103515245')} + 12345) & 2147483647 AS lcg FROM u JOIN orders USING (o_orderkey)""")
def mulberry_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th draw of seeded generators without the draws before."""
    draw = B.mulberry32(F.col("o_custkey"), F.col("o_orderkey") % 5 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", draw.alias("draw"), (20 + 60 * draw).alias("join_s"), B.lcg(F.col("o_orderkey")).alias("lcg"))


def _draw_sql(seed: str, n: int) -> str:
    """A draw in SQL, as a chain of scalar subqueries."""
    a = f"(SELECT ({seed} + {_M(str(n), '1831565813')}) & 4294967295 AS a)"
    t = f"(SELECT a, {_M('xor(a, a >> 15)', 'a | 1')} AS t FROM {a})"
    u = f"(SELECT xor(t, (t + {_M('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS u FROM {t})"
    return f"(SELECT xor(u, u >> 14) / 4294967296.0::DOUBLE FROM {u})"


@query("BIT-10", sql=f"""WITH d AS (SELECT o_orderpriority, {_draw_sql('o_orderkey', 1)} AS u, {_draw_sql('o_orderkey', 2)} AS v FROM orders),
g AS (SELECT o_orderpriority, sqrt(-2 * ln(u + 1e-12::DOUBLE)) * cos(2 * pi() * v) AS g FROM d) SELECT o_orderpriority, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS sd FROM g GROUP BY 1""")
def gauss_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of normal draws per seed group."""
    g = B.gauss(B.mulberry32(F.col("o_orderkey"), F.lit(1)), B.mulberry32(F.col("o_orderkey"), F.lit(2)))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(g), 6).alias("mean"), F.round(F.stddev_pop(g), 6).alias("sd"))


@query("BIT-11", "BIT-18", sql="""SELECT l_orderkey, l_linenumber, l_partkey, ((l_orderkey + 37 * l_linenumber) & 255) AS byte,
substr(lpad(bin(l_orderkey & 65535), 16, '0'), 1, l_linenumber) || substr(lpad(bin(l_partkey & 65535), 16, '0'), l_linenumber + 1) AS spliced FROM lineitem""")
def torn_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test bytes, and packets of which only the first bits are new."""
    both = B.torn(B.to_bits(F.col("l_orderkey"), 16), B.to_bits(F.col("l_partkey"), 16), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.pattern_byte(F.col("l_orderkey"), F.col("l_linenumber")).alias("byte"), both.alias("spliced"))


@query("BIT-12", "BIT-19", sql="SELECT l_orderkey, l_linenumber, l_partkey, 8388608 + (((l_linenumber & 3)::BIGINT << 28) | (l_orderkey & 268435455)) AS carrier FROM lineitem")
def float_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag and payload in the bits of a float."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.carrier(F.col("l_linenumber"), F.col("l_orderkey")).alias("carrier"))


@query("BIT-13", sql="""SELECT p_partkey, ((floor((p_partkey % 256) * 31 / 255.0 + 0.5)::INTEGER << 11) | (floor((p_size * 5 % 256) * 63 / 255.0 + 0.5)::INTEGER << 5) | floor((p_partkey * 7 % 256) * 31 / 255.0 + 0.5)::INTEGER)::INTEGER AS code FROM part""")
def rgb565_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in 16 bits."""
    return table(spark, sf_dir, "part").select("p_partkey", B.rgb565(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256).alias("code"))


@query("BIT-17", sql="SELECT p_partkey, (1 + floor((greatest(-2.0, least(2.0, log2(p_size / (1.0::DOUBLE + p_partkey % 40)))) + 2) / 4 * 254 + 0.5))::INTEGER AS code FROM part WHERE p_size > 0")
def aspect_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for the ratio of width and height."""
    return table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", B.aspect_code(F.col("p_size"), F.lit(1.0) + F.col("p_partkey") % 40).alias("code"))


@query("AGG-23", sql="""WITH v AS (SELECT l_returnflag AS g, (CASE WHEN l_partkey % 61 - 30 > 0 THEN 2 * (l_partkey % 61 - 30) - 1 ELSE -2 * (l_partkey % 61 - 30) END) AS u FROM lineitem),
n AS (SELECT g, k, sum(2 * length(bin(u + (1 << k))) - 1 - k)::BIGINT AS bits FROM v, range(7) t(k) GROUP BY ALL)
SELECT g, arg_min(k, (bits, k))::INTEGER AS k, min(bits) AS bits FROM n GROUP BY g""")
def golomb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order whose codes are shortest in all, per group."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), B.fold(F.col("l_partkey") % 61 - 30).alias("u")).groupBy("g", "u").agg(F.count("*").alias("c"))
    n = v.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(7)]))).groupBy("g", "k").agg(F.sum(F.col("c") * B.exp_golomb_length(F.col("u"), F.col("k"))).alias("bits"))
    return n.groupBy("g").agg(F.min_by("k", F.struct("bits", "k")).alias("k"), F.min("bits").alias("bits"))


@query("AGG-24", "EVL-20", sql="""WITH m AS (SELECT label, list_sort(list(abs(round(x * 64)))) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label),
w AS (SELECT label, s, (ceil(log2(s[least(len(s), floor(0.999 * len(s))::BIGINT + 1)] + 1)) + 1)::INTEGER AS width FROM m)
SELECT label, width, len(list_filter(s, lambda v: v > (1 << (width - 1)) - 1))::BIGINT AS clipped FROM w""")
def coefficient_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that hold all but a thousandth of a group's coefficients, and how many are clipped."""
    from driftcast.operators.aggregates import upper_percentile

    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    x = x.withColumn("v", F.abs(F.round(F.col("x").cast("double") * 64)))
    w = x.groupBy("label").agg((F.ceil(F.log2(upper_percentile("v", 0.999) + 1)) + 1).cast("int").alias("width"))
    return x.join(w, "label").groupBy("label", "width").agg(F.count_if(F.col("v") > F.expr("shiftleft(1, width - 1)") - 1).alias("clipped"))


@query("BIT-14", "BIT-15", "BIT-16", "BIT-22", "EVL-14", sql=L.LAYOUT_SQL)
def layout_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, slots and spare bits of a packet layout for every number of bytes and of primitives."""
    return L.layouts(spark, bytes_from=6, bytes_to=32, primitives=(1000, 2000, 4000))


@query("BIT-21", "COD-15", "COD-16", sql="""WITH v AS (SELECT unnest([21, 25, 29, 37]) AS side), g AS (SELECT side, x, y FROM v, range(57) a(x), range(57) b(y) WHERE x < side AND y < side),
s AS (SELECT *, ((x < 8 AND y < 8) OR (x >= side - 8 AND y < 8) OR (x < 8 AND y >= side - 8)) AS skip FROM g)
SELECT side::INTEGER AS side, x::INTEGER AS x, y::INTEGER AS y, (row_number() OVER (PARTITION BY side ORDER BY y, x) - 1)::BIGINT AS cell FROM s WHERE NOT skip""")
def qr_cell_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of each QR cell that is sent: all but three corners of 8 x 8, by a closed form."""
    return L.qr_cells(spark, (21, 25, 29, 37))


def _slots(n: int) -> str:
    return f"WITH k AS (SELECT range AS slot FROM range({n}))"


def _carousel(k: str, n: int, base: int) -> str:
    return f"(CASE WHEN ({k}) % {n + 1} < {n} THEN ({k}) % {n + 1} ELSE (({k}) // {n + 1}) % {base} END)"


@query("SCH-01", "SCH-02", "SCH-04", "SCH-05", "JOI-09", sql=_slots(5000) + f""", j AS (SELECT slot, slot - slot // 4 AS j, slot // 4 AS b FROM k)
SELECT slot, {_carousel('slot', 50, 4)} AS carousel, slot % 50 AS plain, CASE WHEN slot % 4 = 3 THEN (slot // 4) % 6 ELSE {_carousel('slot - slot // 4', 50, 6)} END AS prio,
CASE WHEN slot % 4 = 3 THEN b % 8 WHEN j % 43 < 42 THEN 8 + j % 43 ELSE (j // 43) % 8 END AS dual,
CASE WHEN slot % 2 = 0 THEN {_carousel('slot // 2', 50, 1)} ELSE (CASE (slot // 2) % 4 WHEN 0 THEN (slot // 8) % 4 WHEN 1 THEN 4 + (slot // 8) % 8 WHEN 2 THEN 12 + (slot // 8) % 16 ELSE 28 + (slot // 8) % 22 END) END AS tier FROM k JOIN j USING (slot)""")
def plain_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic schedules of 50 units."""
    got = S.by_phases(S.slots(spark, 5000), {
        "carousel": S.carousel(50, 4), "plain": S.lap(0, 50), "prio": S.priority(50, 6, 4), "dual": S.dual(50, 8, 4), "tier": S.tiers(50)})
    return got.select("slot", "carousel", "plain", "prio", "dual", "tier")


SQRT = """WITH u AS (SELECT s_suppkey AS unit, sqrt(greatest(gain, (SELECT min(g) FROM (SELECT abs(s_acctbal) + 1 AS g FROM supplier) WHERE g > 0) * 1e-3)) AS f
 FROM (SELECT s_suppkey, abs(s_acctbal) + 1 AS gain FROM supplier)), p AS (SELECT unit, f / (SELECT sum(f) FROM u) AS p FROM u),
t AS (SELECT unit, (1 / p) * (n + 0.5) AS due FROM p, range(3000) r(n) WHERE n <= p * 2000 + 2), s AS (SELECT unit, row_number() OVER (ORDER BY due, unit) - 1 AS slot FROM t)"""


@query("SCH-03", "SRT-01", "SRT-07", "UDF-03", sql=SQRT + " SELECT slot, unit FROM s WHERE slot < 2000")
def square_root_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as often as the root of their gain asks for."""
    return S.square_root(_gains(spark, sf_dir), 2000)


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), (F.abs("s_acctbal") + 1).alias("gain"))


@query("SCH-06", "SCH-07", "SCH-08", "SCH-09", sql=SQRT + """, n AS (SELECT count(*) AS n FROM supplier), l AS (SELECT n + (n - 1) // 7 AS len FROM n)
SELECT k AS slot, CASE WHEN k < len THEN (CASE WHEN k % 8 = 7 THEN (SELECT unit FROM s WHERE s.slot = k // 8) ELSE k - k // 8 END) ELSE (SELECT unit FROM s WHERE s.slot = k - len) END AS unit FROM range(1000) r(k), l""")
def fast_first_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units once, a filler in every eighth slot, then the square-root rule."""
    n = table(spark, sf_dir, "supplier").count()
    return S.named(spark, "fast+sqrt/8", _gains(spark, sf_dir), n, 1000)


_DRAW = """WITH i AS (SELECT s.range AS seed, n.range AS n FROM range(1, 9) s, range(1, 700) n), a AS (SELECT *, (seed + ((n::HUGEINT * 1831565813) & 4294967295)::BIGINT) & 4294967295 AS a FROM i),
t AS (SELECT *, ((xor(a, a >> 15)::HUGEINT * (a | 1)) & 4294967295)::BIGINT AS t FROM a), u AS (SELECT *, xor(t, (t + ((xor(t, t >> 7)::HUGEINT * (t | 61)) & 4294967295)::BIGINT) & 4294967295) AS u FROM t),
d AS (SELECT seed, n, xor(u, u >> 14) / 4294967296.0::DOUBLE AS r FROM u), s AS (SELECT seed, sum(CASE WHEN n = 1 THEN 0.14 * r ELSE 0.1 + 0.08 * r END) OVER (PARTITION BY seed ORDER BY n) AS s FROM d),
g AS (SELECT seed, floor(s / 0.12 + 1e-9)::BIGINT AS slot, min(s + 0.115 - 5.0) AS time FROM s WHERE s >= 5 AND s + 0.115 - 5.0 <= 60 GROUP BY ALL)"""


@query("CHN-02", "CHN-06", "SRT-06", sql=_DRAW + " SELECT seed, slot, slot % 100 AS unit, round(time, 6) AS time FROM g")
def channel_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What eight receivers that join after five seconds get in a minute."""
    seeds = spark.range(1, 9).select(F.col("id").alias("seed"))
    sent = S.slots(spark, 700).select("slot", (F.col("slot") % 100).alias("unit"))
    got = C.arrivals(C.samples(spark, seeds, "bmfit", 65.0), sent, 0.12, 5.0, 60.0)
    return got.select("seed", "slot", "unit", F.round("time", 6).alias("time"))


@query("CHN-01", "CHN-03", "CHN-04", "CHN-05", "CHN-10", "EVL-03")
def channel_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of slots that receivers miss, by sampler and hold time."""
    seeds = spark.range(1, 9).select(F.col("id").alias("seed"))
    out = None
    for sampler, hold in (("bmfit", 0.12), ("bmfit", 0.14), ("bmfit", 0.16), ("bmfit", 0.2), ("meas60", 0.08), ("meas60", 0.1), ("congested", 0.1), ("nominal10", 0.1)):
        n = int(300 / hold)
        sent = S.slots(spark, n + 10).select("slot", F.col("slot").alias("unit"))
        got = C.arrivals(C.samples(spark, seeds, sampler, 300.0), sent, hold, 0.0, 300.0).groupBy("seed").agg(F.count("*").alias("got"))
        row = got.agg(F.round(1 - F.avg("got") / n, 4).alias("loss")).select(F.lit(sampler).alias("sampler"), F.lit(hold).alias("hold"), "loss")
        out = row if out is None else out.unionByName(row)
    return out


@query("CHN-05", "JOI-08", "EVL-16")
def completion_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until 90, 95 and 99 per cent and all of 100 units are there, with outages."""
    seeds = spark.range(1, 33).select(F.col("id").alias("seed"))
    sent = S.slots(spark, 3000).select("slot", (F.col("slot") % 100).alias("unit"))
    got = C.arrivals(C.samples(spark, seeds, "bmfit", 300.0), sent, 0.12, 0.0, 300.0, C.outages(seeds, 300.0))
    return C.completion(got, 100, (0.9, 0.95, 0.99, 1.0))


@query("MTH-05", "MTH-07", "COD-04", sql="""WITH p AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 127 AS v FROM embeddings),
w AS (SELECT u, x, (CASE WHEN u = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END) * cos((2 * x + 1) * u * pi() / 16) AS c FROM range(8) a(u), range(8) b(x)),
r AS (SELECT vec_id, i // 8 AS y, u, sum(v * c) AS s FROM p JOIN w ON x = i % 8 GROUP BY ALL), f AS (SELECT vec_id, w.u AS v, r.u AS u, sum(s * c) AS s FROM r JOIN w ON x = y GROUP BY vec_id, w.u, r.u)
SELECT vec_id, (v * 8 + u)::INTEGER AS position, floor(s / (4 + u + v) + 0.5)::BIGINT AS level FROM f""")
def dct8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformed and quantised blocks."""
    rows = K.dct(K.blocks(table(spark, sf_dir, "embeddings")), "block", "coefficients").withColumn("levels", K.quantise("coefficients", K.STEPS))
    return rows.select("vec_id", F.posexplode("levels").alias("position", "level"))


@query("MTH-11", "AGG-32", sql="""WITH q AS (SELECT vec_id, unnest([2, 8, 32])::INTEGER AS step FROM embeddings), e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 127 + 128 AS v FROM embeddings)
SELECT vec_id, step, round(avg(v), 6) AS mean, round(CASE WHEN avg(pow(floor(v / step + 0.5) * step - v, 2)) = 0 THEN 99 ELSE 10 * log10(65025 / avg(pow(floor(v / step + 0.5) * step - v, 2))) END, 6) AS psnr FROM q JOIN e USING (vec_id) GROUP BY ALL""")
def block_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and peak signal-to-noise ratio of blocks quantised at three steps."""
    rows = K.blocks(table(spark, sf_dir, "embeddings"), 128.0).withColumn("step", F.explode(F.array(*[F.lit(s) for s in (2, 8, 32)])))
    coded = F.transform("block", lambda v: F.floor(v / F.col("step") + 0.5) * F.col("step").cast("double"))
    return rows.select("vec_id", "step", F.round(K.mean("block"), 6).alias("mean"), F.round(K.psnr("block", coded), 6).alias("psnr"))


@query("JOI-15", "COD-02", sql="""WITH c AS (SELECT vec_id AS cid, embedding AS e FROM embeddings WHERE vec_id < 8),
d AS (SELECT v.vec_id, cid, round(list_sum(list_transform(range(1, 65), lambda i: pow(v.embedding[i]::DOUBLE - c.e[i]::DOUBLE, 2))), 9) AS d FROM embeddings v, c)
SELECT vec_id, arg_min(cid, (d, cid)) AS cid FROM d GROUP BY vec_id""")
def palette_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's nearest of eight palette entries: the assignment of one Lloyd step."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    got = lloyd_step(e, e.filter("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("x").alias("centre")), "x")
    return got.select("vec_id", F.col("_near.cid").alias("cid"))


@query("MTH-01", "MTH-02", "PRJ-10", sql="""WITH c AS (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS r, (p_size * 5 % 256)::DOUBLE AS g, (p_partkey * 7 % 256)::DOUBLE AS b FROM part)
SELECT p_partkey, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS y, round(128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 6) AS cb, round(128 + 0.5 * r - 0.418688 * g - 0.081312 * b, 6) AS cr, r > 1.5 * g AND b > 1.5 * g AS magenta FROM c""")
def colour_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma and chroma of colours, and a classifier by ratios."""
    r, g, b = (x.cast("double") for x in (F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256))
    y, cb, cr = K.ycc(r, g, b)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(y, 6).alias("y"), F.round(cb, 6).alias("cb"), F.round(cr, 6).alias("cr"), ((r > 1.5 * g) & (b > 1.5 * g)).alias("magenta"))


@query("WIN-14", sql="SELECT vec_id, round(list_sum(list_transform(embedding[9:24], lambda x: x::DOUBLE)), 6) AS span FROM embeddings")
def span_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of spans from prefix sums."""
    from driftcast.functions.blocks import prefix_sum

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", F.round(prefix_sum("x", 24) - prefix_sum("x", 8), 6).alias("span"))


@query("WIN-15", "WIN-16", "WIN-17", sql="""WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT vec_id, i, round(x * 12)::BIGINT AS v FROM p),
n AS (SELECT * FROM q WHERE v <> 0) SELECT vec_id, i::INTEGER AS i, v, (i - coalesce(lag(i) OVER w, -1) - 1)::INTEGER AS run, v - coalesce(lag(v) OVER w, 0) AS diff, (lead(i) OVER w)::INTEGER AS next_i FROM n WINDOW w AS (PARTITION BY vec_id ORDER BY i)""")
def run_level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of zeros and the levels after them, their differences, and where the next one is."""
    q = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double") * 12).cast("long").alias("v")).filter("v <> 0")
    w = Window.partitionBy("vec_id").orderBy("i")
    return q.select("vec_id", "i", "v", (F.col("i") - F.lag("i", 1, -1).over(w) - 1).alias("run"), (F.col("v") - F.lag("v", 1, 0).over(w)).alias("diff"), F.lead("i").over(w).alias("next_i"))


@query("WIN-19", "WIN-21", sql="""WITH r AS (SELECT l_suppkey AS stream, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS gain, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n,
avg(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS recent FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey))
SELECT stream, l_orderkey, l_linenumber, l_partkey, rn, round(recent, 6) AS recent FROM r WHERE rn <= greatest(1, floor(0.05 * n + 0.5))""")
def prefix_by_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twentieth of each stream's units, with the mean gain of the last 20."""
    w = Window.partitionBy("stream").orderBy(F.desc("gain"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("gain"))
    rows = rows.select("*", F.row_number().over(w).cast("long").alias("rn"), F.count("*").over(Window.partitionBy("stream")).alias("n"), F.avg("gain").over(w.rowsBetween(-19, 0)).alias("recent"))
    return rows.filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.05 + 0.5))).select("stream", "l_orderkey", "l_linenumber", "l_partkey", "rn", F.round("recent", 6).alias("recent"))


@query("JOI-13", sql="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey < 3 THEN 0 ELSE 1 + (l_partkey - 3) // 4 END AS unit, CASE WHEN l_partkey < 3 THEN 16 + l_partkey * 58 ELSE ((l_partkey - 3) % 4) * 58 END AS bit FROM lineitem")
def primitive_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit and bit at which a primitive is sent."""
    unit, bit = L.address(F.col("l_partkey"), 3, 4, 58)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", unit.alias("unit"), bit.alias("bit"))


@query("JOI-14", sql="""WITH c AS (SELECT o_orderkey AS first, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey AS block, first AS chunk FROM orders JOIN c ON o_orderkey >= first AND (nxt IS NULL OR o_orderkey < nxt) WHERE o_orderkey - first < 5""")
def block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that holds a block: the last that begins at or before it, if it is long enough."""
    from driftcast.operators.windows import as_of

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"), F.floor(F.col("o_orderkey") / 100_000).alias("band"))
    chunks = o.filter("block % 7 = 0").select("band", "block", F.col("block").alias("first"))
    got = as_of(o, chunks, ["band"], "block", "first", "chunk")
    # A chunk that begins in the band before still holds blocks at the start of this one.
    edge = got.filter("chunk is null").select("block", (F.col("block") - F.col("block") % 7).alias("chunk"))
    return got.filter("chunk is not null").select("block", "chunk").unionByName(edge).filter(F.col("block") - F.col("chunk") < 5)


@query("JOI-16", "JOI-17", sql="""WITH b AS (SELECT p_partkey AS id, (p_partkey * 37 % 97) AS x, p_partkey AS y, 1 + p_size % 9 AS r FROM part)
SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND abs(a.x - b.x) <= a.r + b.r AND abs(a.y - b.y) <= a.r + b.r""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes that overlap, found over cells of a grid instead of all pairs."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 97).alias("x"), F.col("p_partkey").alias("y"), (1 + F.col("p_size") % 9).alias("r"))
    return L.overlaps(p)


@query("MTH-17", "MTH-18", sql="""SELECT p_partkey, round(greatest(0.5, 256 * pow((p_size % 16 + 1) / 16.0::DOUBLE, 2)), 6) AS radius, round((1 - 0.4) * p_retailprice + 0.4 * p_size, 6) AS blended FROM part""")
def shape_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius of a code and a colour laid over another."""
    radius = F.greatest(F.lit(0.5), 256 * F.pow((F.col("p_size") % 16 + 1) / 16, F.lit(2.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(radius, 6).alias("radius"), F.round((1 - 0.4) * F.col("p_retailprice") + 0.4 * F.col("p_size"), 6).alias("blended"))
