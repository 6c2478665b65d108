"""Evaluation reports over result rows: means, areas, ranks, pivots, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.operators import aggregates as A
from driftcast.operators import windows as W
from driftcast.plans.registry import query
from driftcast.sources.tables import results, table

#: The role of lineitem as result rows, in SQL.
R = """r AS (SELECT l_returnflag AS codec, l_linestatus AS policy, l_suppkey AS image, l_orderkey AS seed,
      [1, 2, 5, 10, 20, 40, 60][l_linenumber] AS t, l_discount AS metric, l_quantity AS bpp, l_tax AS quality FROM lineitem)"""
MEANS = R + """,
m AS (SELECT codec, image, t, avg(metric) AS m FROM r GROUP BY ALL),
f AS (SELECT codec, image FROM m GROUP BY ALL HAVING count(*) = 7),
c AS (SELECT m.codec, m.t, avg(m.m) AS metric, count(*) AS images FROM m JOIN f ON m.codec = f.codec AND m.image = f.image GROUP BY ALL)"""
AUC = """sum((v + pv) / 2 * ln(t / pt)) / ln(60)"""


@query("AGG-01", sql=f"WITH {MEANS} SELECT codec, t, round(metric, 6) AS metric, images FROM c")
def seed_image_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over seeds, then over images that have all marks."""
    got = A.two_level_mean(results(spark, sf_dir), ["codec"], "image", "t", "metric")
    return got.select("codec", "t", F.round("metric", 6).alias("metric"), "images")


@query("AGG-01", "AGG-02", sql=f"""WITH {MEANS}, l AS (SELECT codec, t, metric AS v, lag(t) OVER w AS pt, lag(metric) OVER w AS pv
FROM c WINDOW w AS (PARTITION BY codec ORDER BY t)) SELECT codec, round({AUC}, 6) AS auc FROM l GROUP BY codec""")
def auc_by_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the mean curve over ln t."""
    means = A.two_level_mean(results(spark, sf_dir), ["codec"], "image", "t", "metric")
    return A.log_auc(means, ["codec"], "t", "metric").select("codec", F.round("auc", 6).alias("auc"))


TOPK = R + f""", m AS (SELECT policy, codec, image, t, avg(metric) AS m FROM r GROUP BY ALL),
l AS (SELECT *, lag(t) OVER w AS pt, lag(m) OVER w AS pv FROM m WINDOW w AS (PARTITION BY policy, codec, image ORDER BY t)),
a AS (SELECT policy, codec, image, round(sum((m + pv) / 2 * ln(t / pt)) / ln(60), 6) AS auc, count(*) AS marks FROM l GROUP BY ALL HAVING count(*) = 7)"""


@query("AGG-02", "AGG-03", "WIN-01", "WIN-18", "SRT-02", sql=f"""WITH {TOPK},
g AS (SELECT *, row_number() OVER (PARTITION BY policy, codec ORDER BY auc DESC, image) AS place FROM a),
n AS (SELECT policy, codec, count(*) AS images FROM a GROUP BY ALL)
SELECT g.policy, g.codec, image, auc, place, images < (SELECT max(images) FROM n) AS incomplete FROM g JOIN n USING (policy, codec) WHERE place <= 2""")
def auc_topk_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best images by area of every policy and codec, and whether their group lacks images."""
    means = results(spark, sf_dir).groupBy("policy", "codec", "image", "t").agg(F.avg("metric").alias("m"))
    areas = A.log_auc(means, ["policy", "codec", "image"], "t", "m").withColumn("auc", F.round("auc", 6))
    w = Window.partitionBy("policy", "codec").orderBy(F.desc("auc"), "image")
    top = areas.withColumn("place", F.row_number().over(w)).filter("place <= 2")
    size = areas.groupBy("policy", "codec").agg(F.count("*").alias("images"))
    size = size.crossJoin(F.broadcast(size.agg(F.max("images").alias("most"))))  # one row
    return top.join(size, ["policy", "codec"]).select("policy", "codec", "image", "auc", F.col("place").cast("long").alias("place"), (F.col("images") < F.col("most")).alias("incomplete"))


@query("PRJ-03", "PRJ-07", "AGG-05", "UDF-05", sql=f"""WITH {R} SELECT codec, round(avg(metric) FILTER (policy = 'O'), 6) AS late,
round(avg(metric) FILTER (policy = 'F'), 6) AS start, round(avg(metric) FILTER (t >= 20), 6) AS settled, round(avg(metric) FILTER (bpp < 10 AND t <= 5), 6) AS thin
FROM r GROUP BY codec""")
def scenario_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per named scenario; a row may be in several."""
    named = {"late": F.col("policy") == "O", "start": F.col("policy") == "F", "settled": F.col("t") >= 20, "thin": (F.col("bpp") < 10) & (F.col("t") <= 5)}
    return results(spark, sf_dir).groupBy("codec").agg(*[F.round(F.avg(F.when(p, F.col("metric"))), 6).alias(n) for n, p in named.items()])


@query("AGG-04", sql=f"""WITH {MEANS} SELECT codec, round(max(metric) FILTER (t = 5), 6) AS t5, round(max(metric) FILTER (t = 20), 6) AS t20,
round(max(metric) FILTER (t = 60), 6) AS t60 FROM c GROUP BY codec""")
def value_at_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean curve at 5, 20 and 60 seconds."""
    means = A.two_level_mean(results(spark, sf_dir), ["codec"], "image", "t", "metric")
    return means.groupBy("codec").agg(*[F.round(F.max(F.when(F.col("t") == m, F.col("metric"))), 6).alias(f"t{m}") for m in (5, 20, 60)])


@query("AGG-06", sql=f"WITH {R} SELECT image, t, round(sum(metric) / count(*), 6) AS q FROM r GROUP BY ALL")
def seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over seeds as a sum of shares."""
    return results(spark, sf_dir).groupBy("image", "t").agg(F.round(F.sum("metric") / F.count("*"), 6).alias("q"))


@query("AGG-07", sql="""WITH k AS (SELECT l_returnflag AS codec, p_type AS kind, CASE WHEN l_discount > 0.02 THEN l_discount END AS v
FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT codec, coalesce(kind, 'all') AS kind, round(exp(avg(ln(v))), 6) AS gmean, count(v) AS reached, count(*) AS n FROM k GROUP BY GROUPING SETS ((codec), (codec, kind))""")
def kind_rollup_gmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric mean of reached values per codec and kind, and over all kinds."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_returnflag").alias("codec"), F.col("p_type").alias("kind"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("v"))
    got = rows.groupingSets([["codec"], ["codec", "kind"]], "codec", "kind").agg(
        F.round(F.exp(F.avg(F.log("v"))), 6).alias("gmean"), F.count("v").alias("reached"), F.count("*").alias("n"))
    return got.select("codec", F.coalesce("kind", F.lit("all")).alias("kind"), "gmean", "reached", "n")


@query("AGG-10", "EVL-19", sql=f"WITH {R} SELECT codec, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS sd, round(stddev_pop(metric), 6) AS sd_pop, min(metric) AS low, max(metric) AS high FROM r GROUP BY codec")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviations and range per codec."""
    return results(spark, sf_dir).groupBy("codec").agg(
        F.round(F.avg("metric"), 6).alias("mean"), F.round(F.stddev_samp("metric"), 6).alias("sd"), F.round(F.stddev_pop("metric"), 6).alias("sd_pop"),
        F.min("metric").alias("low"), F.max("metric").alias("high"))


@query("AGG-27", sql="""WITH g AS (SELECT l_suppkey AS stream, l_extendedprice AS gain, row_number() OVER w AS rn, sum(l_extendedprice) OVER w AS run,
sum(l_extendedprice) OVER (PARTITION BY l_suppkey) AS tot, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT stream, min(rn) FILTER (run >= 0.5 * tot - 1e-9) AS units_50, min(rn) FILTER (run >= 0.8 * tot - 1e-9) AS units_80,
min(rn) FILTER (run >= 0.95 * tot - 1e-9) AS units_95, round(coalesce(sum(gain) FILTER (rn > floor(n * 0.9)), 0) / max(tot), 6) AS tail_share FROM g GROUP BY stream""")
def gain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that hold half, 80 and 95 per cent of a stream's gain."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "stream")
    got = A.share_ranks(rows, ["stream"], "l_extendedprice", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], (0.5, 0.8, 0.95))
    return got.withColumn("tail_share", F.round("tail_share", 6))


@query("AGG-28", "SRT-03", sql=f"""WITH {R}, m AS (SELECT image, t, round(sum(metric), 6) AS v FROM r GROUP BY ALL),
x AS (SELECT *, max(v) OVER (PARTITION BY image ORDER BY t) AS run FROM m),
l AS (SELECT *, lag(t) OVER w AS pt, lag(run) OVER w AS pv FROM x WINDOW w AS (PARTITION BY image ORDER BY t)),
h AS (SELECT image, t, CASE WHEN pt IS NULL THEN t ELSE pt * pow(t / pt, (4.4 - pv) / (run - pv)) END AS secs, row_number() OVER (PARTITION BY image ORDER BY t) AS rn FROM l WHERE run >= 4.4)
SELECT image, round(secs, 6) AS seconds FROM (SELECT DISTINCT image FROM m) LEFT JOIN (SELECT * FROM h WHERE rn = 1) USING (image)""")
def reach_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until each image's curve reaches a level, on the log scale of time."""
    sums = results(spark, sf_dir).groupBy("image", "t").agg(F.round(F.sum("metric"), 6).alias("v"))
    top = F.max("v").over(Window.partitionBy("image").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return A.reach(sums.withColumn("run", top), ["image"], "t", "run", 4.4).select("image", F.round("seconds", 6).alias("seconds"))


@query("AGG-29", sql="""WITH p AS (SELECT l_suppkey AS image, l_quantity AS bpp, round(max(l_discount + l_tax), 6) AS q FROM lineitem GROUP BY ALL),
e AS (SELECT *, max(q) OVER (PARTITION BY image ORDER BY bpp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p),
k AS (SELECT *, lag(bpp) OVER w AS pb, lag(q) OVER w AS pq FROM e WHERE top IS NULL OR q > top WINDOW w AS (PARTITION BY image ORDER BY bpp)),
h AS (SELECT image, min(CASE WHEN pb IS NULL THEN bpp ELSE exp(ln(pb) + (0.17 - pq) / (q - pq) * (ln(bpp) - ln(pb))) END) AS b FROM k WHERE q >= 0.17 AND (pq IS NULL OR pq < 0.17) GROUP BY image)
SELECT image, round(b, 6) AS min_bpp FROM (SELECT DISTINCT image FROM p) LEFT JOIN h USING (image)""")
def envelope_min_bpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least rate at which the rising envelope of quality reaches a level."""
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image"), F.col("l_quantity").alias("bpp")).agg(
        F.round(F.max(F.col("l_discount") + F.col("l_tax")), 6).alias("q"))
    return A.envelope_crossing(points, ["image"], "bpp", "q", 0.17).select("image", F.round("x", 6).alias("min_bpp"))


@query("AGG-30", sql="SELECT p_partkey, ceil(p_retailprice * 100 / 868)::BIGINT AS chunks, round(ceil(p_retailprice * 100 / 868) / (128 / 32.0 * 0.9) / 60, 6) AS seconds FROM part")
def transfer_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 868 bits and the seconds that 128 parameters at 60 frames a second take for them."""
    chunks = F.ceil(F.col("p_retailprice") * 100 / 868)
    return table(spark, sf_dir, "part").select("p_partkey", chunks.cast("long").alias("chunks"), F.round(chunks / (128 / 32 * 0.9) / 60, 6).alias("seconds"))


@query("WIN-02", sql=f"WITH {R}, m AS (SELECT codec, policy, t, round(avg(metric), 6) AS q FROM r GROUP BY ALL) SELECT codec, policy, t, q, q = max(q) OVER (PARTITION BY codec, t) AS best FROM m")
def best_of_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table, with the best of each row marked."""
    cells = results(spark, sf_dir).groupBy("codec", "policy", "t").agg(F.round(F.avg("metric"), 6).alias("q"))
    return cells.withColumn("best", F.col("q") == F.max("q").over(Window.partitionBy("codec", "t")))


@query("SRT-04", sql="""SELECT l_suppkey AS image, arg_max(l_orderkey * 10 + l_linenumber, (l_tax, -l_quantity, -l_orderkey, -l_linenumber, -l_partkey)) AS pick
FROM lineitem WHERE l_quantity <= 1.02 * 20 GROUP BY 1""")
def best_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of best quality within 1.02 of a rate, per image."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity <= 1.02 * 20")
    order = F.struct("l_tax", -F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("image")).agg(F.max_by(F.col("l_orderkey") * 10 + F.col("l_linenumber"), order).alias("pick"))


@query("PRJ-01", "PRJ-08", sql="SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus::VARCHAR = 'F' AND o_custkey::VARCHAR = '7' AND regexp_matches(o_orderpriority, '^[1-3]') AND NOT regexp_matches(o_orderpriority, 'HIGH')")
def string_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional equality filters compared as strings, and patterns that keep and drop."""
    rows = table(spark, sf_dir, "orders")
    for name, want in {"o_orderstatus": "F", "o_custkey": "7", "o_clerk": None}.items():
        if want is not None:
            rows = rows.filter(F.col(name).cast("string") == want)
    return rows.filter(F.col("o_orderpriority").rlike("^[1-3]") & ~F.col("o_orderpriority").rlike("HIGH")).select("o_orderkey", "o_orderpriority")


@query("PRJ-02", sql="SELECT CASE WHEN p_name LIKE 'red%' THEN 'photo' WHEN p_name LIKE 'small%' THEN 'illust' ELSE 'screenshot' END AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by the beginning of a name."""
    c = F.when(F.startswith("p_name", F.lit("red")), "photo").when(F.startswith("p_name", F.lit("small")), "illust").otherwise("screenshot")
    return table(spark, sf_dir, "part").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("PRJ-12", "PRJ-13", "UDF-04", sql="""WITH c AS (SELECT DISTINCT p_brand AS cfg FROM part), i AS (SELECT n_name AS image FROM nation), b AS (SELECT unnest([32, 64, 128, 256])::INTEGER AS budget)
SELECT cfg, image, budget, (CASE WHEN cfg = 'Brand#1' THEN 0 ELSE 1 END)::INTEGER AS turn FROM c, i, b""")
def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration with every image and budget; costly ones first. Three lists of settings, not of data."""
    cfg = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cfg")).distinct()
    budgets = F.explode(F.array(*[F.lit(b) for b in (32, 64, 128, 256)])).alias("budget")
    grid = cfg.crossJoin(table(spark, sf_dir, "nation").select(F.col("n_name").alias("image"))).select("*", budgets)
    return grid.withColumn("turn", F.when(F.col("cfg") == "Brand#1", 0).otherwise(1)).orderBy("turn", "cfg", "image", "budget")


@query("PRJ-11", sql="SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * l_discount * 1000 + 0.5) / 1000 AS psnr FROM lineitem")
def written_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure rounded as it is written: half goes up."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.floor(F.col("l_extendedprice") * F.col("l_discount") * 1000 + 0.5) / 1000).alias("psnr"))


@query("SRC-05", "SET-06", sql="SELECT o_orderkey, o_orderpriority, 'old' AS origin FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 490000) UNION ALL SELECT o_orderkey, o_orderpriority, 'new' FROM orders WHERE o_totalprice > 490000")
def override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a later file replace all rows of their codec."""
    rows = table(spark, sf_dir, "orders")
    new = rows.filter("o_totalprice > 490000").select("o_orderkey", "o_orderpriority", F.lit("new").alias("origin"))
    return W.replaced(rows.select("o_orderkey", "o_orderpriority", F.lit("old").alias("origin")), new, "o_orderpriority")


@query("SNK-02", "SET-05", sql="SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    return W.last_wins(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


@query("SRT-05", sql="""WITH d AS (SELECT o_custkey, lower(o_orderpriority) AS k, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, k, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))::INTEGER AS place FROM d QUALIFY place <= 3""")
def newest_bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first without repeats, three at most, keys without regard to case."""
    rows = table(spark, sf_dir, "orders").withColumn("k", F.lower("o_orderpriority"))
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    once = W.last_wins(rows, ["o_custkey", "k"], newest)
    return once.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*newest))).filter("place <= 3").select("o_custkey", "k", "o_orderkey", "place")


@query("SET-02", sql="SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order in which they were first seen."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id")).orderBy("first_id")


@query("SET-04", sql="SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def never_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that no row has."""
    got = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(got.distinct())


@query("SET-07", sql="SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def seen_on_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of both sides."""
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")))


@query("JOI-11", sql="SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of a row's configuration; a missing one is an error when the row is read."""
    got = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    found = F.when(F.col("c_custkey").isNull(), F.raise_error(F.concat(F.lit("no configuration for "), F.col("o_custkey").cast("string")))).otherwise(F.col("c_mktsegment"))
    return got.select("o_orderkey", found.alias("c_mktsegment"))


@query("JOI-12", sql="SELECT p_partkey, coalesce(n_name, 'NATION_0') AS layout, n_name IS NULL AS unknown FROM part LEFT JOIN nation ON p_size = n_nationkey")
def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup with a default and a flag for unknown formats."""
    got = table(spark, sf_dir, "part").join(table(spark, sf_dir, "nation"), F.col("p_size") == F.col("n_nationkey"), "left")
    return got.select("p_partkey", F.coalesce("n_name", F.lit("NATION_0")).alias("layout"), F.col("n_name").isNull().alias("unknown"))


@query("PRJ-09", sql="SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND nullif(c_mktsegment, 'MACHINERY') IS NOT NULL")
def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with parameters and without a problem."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0 and nullif(c_mktsegment, 'MACHINERY') is not null").select("c_custkey")


#: Character references in addresses, the ampersand's last so that nothing is decoded twice.
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#38;", "&"), ("&amp;", "&")]


def _decoded_sql(expr: str) -> str:
    for name, char in _REFERENCES:
        expr = f"replace({expr}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


#: Every page with a picture before its own: by address, quoted or not, with references, and as data.
_WITH_PICTURE = """(SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN '<img alt=x src="https://pics.example/a?b=1&amp;c=&quot;d&quot;&#38;e=2">' WHEN 1 THEN '<IMG src=data:image/png;base64,QUJD>'
 WHEN 2 THEN '<img src="ftp://no.example/x"><img src=''http://pics.example/&lt;n&gt;''>' ELSE '' END || html AS page FROM pages)"""


@query("PRJ-14", sql=f"""SELECT page_id, nullif({_decoded_sql("regexp_extract(page, '(?i)<img[^>]*?[[:space:]]src[[:space:]]*=[[:space:]]*[\"'']?((?:https?://|data:image)[^\"''[:space:]>]*)', 1)")}, '') AS image_url FROM {_WITH_PICTURE}""")
def first_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address of the first picture of a page with one of http(s) or data, its character references decoded."""
    kind = F.col("page_id") % 4
    extra = (F.when(kind == 0, '<img alt=x src="https://pics.example/a?b=1&amp;c=&quot;d&quot;&#38;e=2">').when(kind == 1, "<IMG src=data:image/png;base64,QUJD>")
             .when(kind == 2, """<img src="ftp://no.example/x"><img src='http://pics.example/&lt;n&gt;'>""").otherwise(""))
    found = F.regexp_extract(F.concat(extra, F.col("html")), r"""(?i)<img[^>]*?\ssrc\s*=\s*["']?((?:https?://|data:image)[^"'\s>]*)""", 1)
    for name, char in _REFERENCES:
        found = F.replace(found, F.lit(name), F.lit(char))
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(found, F.lit("")).alias("image_url"))


@query("PRJ-15", sql=r"""WITH l AS (SELECT page_id, list_filter(list_transform(string_split(url || chr(10) || ' x', chr(10)), lambda s: trim(s)), lambda s: s <> '')[1] AS line FROM pages)
SELECT page_id, CASE WHEN regexp_matches(line, '^https?://') THEN line END AS url FROM l""")
def url_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that is not empty, if it is a web address."""
    lines = F.filter(F.transform(F.split(F.concat("url", F.lit("\n x")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    line = F.try_element_at(lines, F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.when(line.rlike("^https?://"), line).alias("url"))


@query("PRJ-16", sql="""SELECT page_id, CASE page_id % 4 WHEN 0 THEN octet_length(url::BLOB) WHEN 1 THEN octet_length(url::BLOB) END AS n_bytes FROM pages""")
def data_uri_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a data address; one that is not base64, or is broken, gives null."""
    body = F.base64(F.col("url").cast("binary"))
    uri = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("data:image/png;base64,"), body)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("data:;charset=x;base64,"), body))
           .when(F.col("page_id") % 4 == 2, F.concat(F.lit("data:text/plain,"), body)).otherwise(F.concat(F.lit("data:image/png;base64,*"), body)))
    found = F.when(uri.rlike("^data:[^,]*;base64,"), F.try_to_binary(F.regexp_replace(F.substring_index(uri, ",", -1), r"\s", ""), F.lit("base64")))
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(found).cast("long").alias("n_bytes"))


@query("PRJ-17", sql="SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 38) || '…' END AS label FROM documents")
def short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of over 40 characters shortened for display."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length("text") <= 40, F.col("text")).otherwise(F.concat(F.substring("text", 1, 38), F.lit("…"))).alias("label"))
