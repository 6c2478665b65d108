"""Sessions of receivers over event time, and captured datagrams as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.operators import datagrams as D
from driftcast.plans.registry import query
from driftcast.sources.datagrams import Datagrams, write_captures
from driftcast.sources.shared import shared_dir
from driftcast.sources.tables import table
from driftcast.streaming import timers

#: Milliseconds between redraws, and without a frame until a receiver is gone.
INTERVAL, GAP = 6 * 3600 * 1000, 8 * 3600 * 1000


@query("STR-12", "STR-05", "STR-14", sql=f"""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id AS receiver, CAST(props::JSON->>'k' AS BIGINT) AS unit, epoch_us(ts) // 1000 AS t FROM events),
f AS (SELECT receiver, min(t) AS t FROM s GROUP BY receiver, unit), n AS MATERIALIZED (SELECT receiver, t, row_number() OVER (PARTITION BY receiver ORDER BY t) AS n FROM f),
r AS (SELECT receiver, n, t AS shown, true AS own FROM n WHERE n = 1 UNION ALL
 SELECT n.receiver, n.n, CASE WHEN n.t <= shown THEN shown ELSE greatest(n.t, shown + {INTERVAL}) END, n.t > shown FROM r JOIN n ON n.receiver = r.receiver AND n.n = r.n + 1),
g AS (SELECT receiver, t, lag(t) OVER w AS b, lead(t) OVER w AS a FROM s WINDOW w AS (PARTITION BY receiver ORDER BY t))
SELECT receiver, 'redraw' AS kind, shown AS at, (SELECT count(*) FROM n WHERE n.receiver = r.receiver AND n.t <= shown) AS units FROM r WHERE own
UNION ALL SELECT receiver, 'present', t, NULL FROM g WHERE b IS NULL OR t - b > {GAP} UNION ALL SELECT receiver, 'lapsed', t + {GAP}, NULL FROM g WHERE a IS NULL OR a - t > {GAP}""")
def timed_redraws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When receivers redraw, at most once an interval and only if they have something new, and when they come and go."""
    e = table(spark, sf_dir, "events")
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000")
    frames = e.select(F.col("user_id").alias("receiver"), F.get_json_object("props", "$.k").cast("long").alias("unit"), ms.alias("time"))
    return timers.redraws(frames, INTERVAL).unionByName(timers.presence(frames, GAP))


@query("SRC-11", "UDF-07", sql="SELECT l_orderkey AS board, count(*) AS messages, sum((l_partkey % 1000) * (1 + l_linenumber))::BIGINT AS checksum, max(l_suppkey)::DOUBLE AS last FROM lineitem GROUP BY 1")
def datagram_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams of control messages that were captured to files, read as a table by a data source of their own."""
    folder = shared_dir(spark, "captures")
    spark.dataSource.register(Datagrams)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("time"), (F.col("l_partkey") % 1000).alias("v"), "l_linenumber")
    sent = D.addressed(rows, ["time"], F.concat(F.lit("/board/"), "l_orderkey", F.lit("/"), "l_linenumber"), "v")
    write_captures(sent, folder).collect()  # a row for each file
    got = spark.read.format("datagrams").load(folder)
    part = lambda k: F.element_at(F.split("address", "/"), k).cast("long")
    return got.groupBy(part(3).alias("board")).agg(F.count("*").alias("messages"), F.sum(F.col("value") * (1 + part(4))).alias("checksum"), F.max("time").alias("last"))
