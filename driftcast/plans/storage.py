"""Round trips through files, datagrams and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K
from driftcast.operators import codecs as C
from driftcast.operators import datagrams as D
from driftcast.plans.registry import query
from driftcast.sources import logs
from driftcast.sources.shared import shared_dir
from driftcast.sources.tables import table


@query("SRC-01", "SRC-02", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV with a header and read with a schema."""
    path = shared_dir(spark, "csv")
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return logs.csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SRC-04", "SNK-01", sql="SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 'inf'::DOUBLE END AS gain FROM customer")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended as JSON lines; an infinite gain is null in the file."""
    path = shared_dir(spark, "json")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("gain"))
    logs.append(rows.filter("c_custkey % 2 = 0"), path)
    logs.append(rows.filter("c_custkey % 2 = 1"), path)
    return logs.json_rows(spark, path, "c_custkey long, c_name string, gain double").withColumn("gain", logs.infinite())


@query("SRC-07", "SRC-08", sql="SELECT vec_id, list_sum(list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 127 + 128.5)))))::BIGINT AS total FROM embeddings")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as PNG and read again."""
    rows = K.blocks(table(spark, sf_dir, "embeddings"), 128.0)
    grey = rows.select("vec_id", F.transform("block", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int")).alias("grey"))
    back = D.png_round_trip(grey, "vec_id", "grey", 8)
    return back.select("vec_id", F.aggregate("samples", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("SNK-05", "SRC-11", "BIT-23", sql="SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: i * floor(embedding[i]::DOUBLE * 1000)))::BIGINT AS checksum, (16 + 64 * (4 + 24 + 4 + 4))::INTEGER AS n_bytes FROM embeddings")
def message_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in a bundle of messages, parsed again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("v"))
    sent = D.bundles(rows, "vec_id", "v")
    got = D.messages(sent, "vec_id").withColumn("k", F.regexp_extract("address", r"p(\d+)$", 1).cast("long") + 1)
    sums = got.groupBy("vec_id").agg(F.sum(F.col("k") * F.col("value")).alias("checksum"))
    return sums.join(sent.select("vec_id", F.octet_length("data").alias("n_bytes")), "vec_id")


@query("SNK-06", sql="""WITH s AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, floor(list_reduce(list_concat([0.0::DOUBLE], q), lambda s, x: CASE WHEN s = 0 OR s % 1000 + x > 60 THEN (floor(s / 1000) + 1) * 1000 + x ELSE s + x END) / 1000)::INTEGER AS datagrams FROM s""")
def datagram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams of at most 60 that an order's groups fill."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("q"))
    return rows.select("l_orderkey", D.datagram_count(F.col("q.l_quantity"), 60).alias("datagrams"))


@query("UDF-01", "UDF-02", "COD-04", "RQC-01", sql="""WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 127 + 128 AS v FROM embeddings),
w AS (SELECT u, x, (CASE WHEN u = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END) * cos((2 * x + 1) * u * pi() / 16) AS c FROM range(8) a(u), range(8) b(x)),
r AS (SELECT vec_id, i // 8 AS y, u, sum((v - 128) * c) AS s FROM p JOIN w ON x = i % 8 GROUP BY ALL), f AS (SELECT vec_id, w.u AS cv, r.u AS cu, sum(s * c) AS s FROM r JOIN w ON x = y GROUP BY vec_id, w.u, r.u),
q AS (SELECT vec_id, cv, cu, greatest(-127, least(127, floor(s / (4 + cu + cv) + 0.5))) * (4 + cu + cv) AS s FROM f),
b AS (SELECT vec_id, cv, x, sum(s * c) AS s FROM q JOIN w ON u = cu GROUP BY ALL), d AS (SELECT vec_id, w.x AS y, b.x AS x, sum(s * c) + 128 AS r FROM b JOIN w ON u = cv GROUP BY vec_id, w.x, b.x),
e AS (SELECT 'dct' AS codec, p.vec_id, avg(pow(v - r, 2)) AS mse, 512 AS bits FROM p JOIN d ON d.vec_id = p.vec_id AND d.y = i // 8 AND d.x = i % 8 GROUP BY p.vec_id UNION ALL
 SELECT 'raw' || k, vec_id, avg(pow(v - (greatest(0, least((1 << k) - 1, floor(v / 256 * (1 << k)))) + 0.5) * (256.0::DOUBLE / (1 << k)), 2)), 64 * k FROM p, (SELECT unnest([4, 5, 8])::INTEGER AS k) GROUP BY k, vec_id)
SELECT codec, round(avg(bits), 3) AS bits, round(avg(CASE WHEN mse = 0 THEN 99 ELSE 10 * log10(65025 / mse) END), 4) AS psnr FROM e GROUP BY codec""")
def codec_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits and quality of each registered codec."""
    return C.rate_quality(K.blocks(table(spark, sf_dir, "embeddings"), 128.0))


@query("CHN-08")
def codec_under_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of two codecs when a third of the units is lost and others come twice."""
    blocks, out = K.blocks(table(spark, sf_dir, "embeddings"), 128.0), None
    for name in ("raw5", "dct"):
        units = C.CODECS[name].encode(blocks)
        draw = B.mulberry32(F.col("vec_id") * 8 + F.col("unit"), F.lit(1))
        got = units.withColumn("r", draw).filter("r > 0.33 or unit = 0")
        got = got.unionByName(got.filter("r > 0.8"))
        back = C.CODECS[name].decode(C.held(got, F.col("r"))).withColumnRenamed("block", "coded")
        row = blocks.join(back, "vec_id").groupBy(F.lit(name).alias("codec")).agg(F.round(F.avg(K.psnr("block", "coded")), 4).alias("psnr"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("MTH-16", sql="""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 127 + 128 AS v FROM embeddings)),
c AS (SELECT vec_id, a.k AS cy, b.k AS cx FROM embeddings, (SELECT unnest([1, 4, 6]) AS k) a, (SELECT unnest([1, 4, 6]) AS k) b)
SELECT c.vec_id, cy::BIGINT AS cy, cx::BIGINT AS cx, avg(v) > 128 AS bit FROM c JOIN p ON c.vec_id = p.vec_id AND abs(y - cy) <= 1 AND abs(x - cx) <= 1 GROUP BY ALL""")
def cell_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of board cells: whether the mean of 3 x 3 samples is bright."""
    from driftcast.operators.pictures import samples

    near = [(c, s) for c in (1, 4, 6) for s in range(c - 1, c + 2)]
    cells = spark.createDataFrame(near, "c long, s long")  # nine rows
    p = samples(K.blocks(table(spark, sf_dir, "embeddings"), 128.0), "vec_id", "block", 8)
    p = p.join(F.broadcast(cells.select(F.col("c").alias("cy"), F.col("s").alias("y"))), "y").join(F.broadcast(cells.select(F.col("c").alias("cx"), F.col("s").alias("x"))), "x")
    return p.groupBy("vec_id", "cy", "cx").agg((F.avg("v") > 128).alias("bit"))


@query("SNK-03", sql="SELECT l_returnflag AS codec, l_linestatus AS policy, count(*) AS n FROM lineitem GROUP BY ALL")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small aggregate as a table in Markdown, read again."""
    path = f"{shared_dir(spark, 'report')}/report.md"
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("codec"), F.col("l_linestatus").alias("policy")).agg(F.count("*").alias("n"))
    logs.write_text("# Rows by codec and policy\n\n" + logs.markdown(rows.orderBy("codec", "policy")) + "\n", path)
    cells = logs.markdown_rows(spark, path)
    return cells.select(F.col("cells")[0].alias("codec"), F.col("cells")[1].alias("policy"), F.col("cells")[2].cast("long").alias("n"))


@query("SNK-04", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def history_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file that a newer one takes the place of: the ten dearest orders, after those of one day."""
    path = f"{shared_dir(spark, 'history')}/history.json"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    logs.replace_history(rows.limit(3), path)
    logs.replace_history(rows.limit(10), path)
    return logs.json_folder(spark, path, "o_orderkey long, o_totalprice double")
