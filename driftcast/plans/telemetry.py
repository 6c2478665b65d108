"""Analysis of send and receive logs over events: loss, gaps, latency, runs, as-of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.operators import aggregates as A
from driftcast.operators import windows as W
from driftcast.plans.registry import query
from driftcast.sources.tables import sightings, table

#: The role of events as sightings, in SQL.
S = """s AS (SELECT user_id AS epoch, event_id AS seq, epoch_us(ts) / 1000.0::DOUBLE AS time_ms, value, event_type = 'error' AS torn, event_type = 'signup' AS zero,
      CASE WHEN event_type = 'view' THEN 'local' ELSE 'remote' END AS board, event_type AS kind, (props->>'$.k')::INTEGER AS k FROM events)"""
MIN = 60_000.0


@query("AGG-08", "AGG-09", sql=f"""WITH {S} SELECT epoch, list_sort(list(value))[count(*) // 2 + 1] AS median,
list_sort(list(value))[least(count(*), floor(count(*) * 0.9)::BIGINT + 1)] AS p90 FROM s GROUP BY epoch""")
def seen_median_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and 90th percentile by position."""
    return sightings(spark, sf_dir).groupBy("epoch").agg(A.upper_median("value").alias("median"), A.upper_percentile("value", 0.9).alias("p90"))


@query("WIN-03", "AGG-12", sql=f"""WITH {S}, g AS (SELECT time_ms - lag(time_ms) OVER (PARTITION BY epoch ORDER BY time_ms) AS gap FROM s)
SELECT floor(gap / {MIN} + 0.5)::BIGINT AS minutes, count(*) AS n FROM g WHERE gap < 200 * {MIN} GROUP BY 1""")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of times between sightings of an epoch, long ones left out."""
    g = W.gaps(sightings(spark, sf_dir), ["epoch"], "time_ms").filter(F.col("gap") < 200 * MIN)
    return g.groupBy(F.floor(F.col("gap") / MIN + 0.5).alias("minutes")).agg(F.count("*").alias("n"))


@query("AGG-11", sql=f"""WITH {S}, g AS (SELECT epoch, time_ms - lag(time_ms) OVER (PARTITION BY epoch ORDER BY time_ms) AS gap FROM s)
SELECT epoch, count(*) FILTER (abs(gap - 6000000) >= 3000000) AS odd, round(avg(gap), 3) AS mean, min(gap) AS low, max(gap) AS high FROM g WHERE gap IS NOT NULL GROUP BY epoch""")
def interval_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals far from the wanted one, with mean and range."""
    g = W.gaps(sightings(spark, sf_dir), ["epoch"], "time_ms").filter("gap is not null")
    return g.groupBy("epoch").agg(F.count_if(F.abs(F.col("gap") - 6_000_000) >= 3_000_000).alias("odd"), F.round(F.avg("gap"), 3).alias("mean"), F.min("gap").alias("low"), F.max("gap").alias("high"))


RUNS = S + """, m AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY time_ms, seq) AS rn, row_number() OVER (PARTITION BY epoch, torn ORDER BY time_ms, seq) AS rt FROM s)"""


@query("WIN-04", sql=f"WITH {RUNS} SELECT epoch, min(rn) AS first_row, count(*) AS length FROM m WHERE torn GROUP BY epoch, rn - rt")
def torn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of torn frames."""
    return W.runs(sightings(spark, sf_dir), ["epoch"], ["time_ms", "seq"], F.col("torn")).select("epoch", F.col("first_row").cast("long").alias("first_row"), "length")


@query("WIN-05", sql=f"""WITH {S}, l AS (SELECT *, coalesce(lag(torn) OVER (PARTITION BY epoch ORDER BY time_ms, seq), false) AS b FROM s)
SELECT epoch, count(*) FILTER (torn AND NOT b) AS episodes FROM l GROUP BY epoch""")
def torn_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often torn frames set in."""
    return W.rising_edges(sightings(spark, sf_dir), ["epoch"], ["time_ms", "seq"], F.col("torn"))


@query("WIN-06", "WIN-07", "JOI-07", sql=f"""WITH {S}, b AS (SELECT epoch, floor(time_ms / {20 * MIN})::BIGINT AS f, max(seq) FILTER (board = 'remote') AS remote FROM s GROUP BY ALL),
x AS (SELECT epoch, min(f) AS f0, max(f) AS f1 FROM b GROUP BY epoch),
p AS (SELECT epoch, unnest(range(f0, f1 + 1)) AS f FROM x), j AS (SELECT p.epoch, p.f, remote FROM p LEFT JOIN b ON p.epoch = b.epoch AND p.f = b.f),
g AS (SELECT *, f - row_number() OVER (PARTITION BY epoch, remote IS NULL ORDER BY f) AS island, last_value(remote IGNORE NULLS) OVER (PARTITION BY epoch ORDER BY f) AS before,
      max(f) FILTER (remote IS NOT NULL) OVER (PARTITION BY epoch) AS lastf FROM j)
SELECT epoch, min(f) AS gap_start, count(*) AS frames, min(before) AS last_seen FROM g WHERE remote IS NULL AND f < lastf GROUP BY epoch, island HAVING count(*) >= 20""")
def visibility_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 20 frames or more without a remote sighting that a visible frame ends, with the last one before."""
    frame = F.floor(F.col("time_ms") / (20 * MIN)).alias("f")
    b = sightings(spark, sf_dir).groupBy("epoch", frame).agg(F.max(F.when(F.col("board") == "remote", F.col("seq"))).alias("remote"))
    # Only frames with a remote sighting are ordered; a gap's length is arithmetic, so its cost does not follow time.
    seen = b.withColumn("a", F.min("f").over(Window.partitionBy("epoch"))).filter("remote is not null")
    w = Window.partitionBy("epoch").orderBy("f")
    seen = seen.withColumn("gap_start", F.coalesce(F.lag("f").over(w) + 1, "a")).withColumn("last_seen", F.lag("remote").over(w))
    return seen.withColumn("frames", F.col("f") - F.col("gap_start")).filter("frames >= 20").select("epoch", "gap_start", "frames", "last_seen")


@query("JOI-01", "AGG-18", "PRJ-05", sql=f"""WITH {S}, f AS (SELECT epoch, k, min(time_ms) AS seen FROM s WHERE NOT torn AND NOT zero AND board = 'remote' GROUP BY ALL),
t AS (SELECT epoch, k, min(time_ms) AS sent FROM s WHERE board = 'local' GROUP BY ALL), o AS (SELECT f.epoch, seen - sent AS d FROM f JOIN t ON f.epoch = t.epoch AND f.k = t.k)
SELECT epoch, list_sort(list(d))[count(*) // 2 + 1] AS clock_offset, count(*) AS n FROM o GROUP BY epoch""")
def clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time from a packet's sending to its first good sighting."""
    s = sightings(spark, sf_dir)
    seen = s.filter("not torn and not zero and board = 'remote'").groupBy("epoch", "k").agg(F.min("time_ms").alias("seen"))
    sent = s.filter("board = 'local'").groupBy("epoch", "k").agg(F.min("time_ms").alias("sent"))
    o = seen.join(sent, ["epoch", "k"]).withColumn("d", F.col("seen") - F.col("sent"))
    return o.groupBy("epoch").agg(A.upper_median("d").alias("clock_offset"), F.count("*").alias("n"))


@query("JOI-02", "PRJ-06", sql="""WITH o AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_orderpriority) AS last FROM orders), c AS (SELECT * FROM o WHERE o_orderdate <= last - INTERVAL 30 DAY),
k AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3)
SELECT o_orderpriority AS epoch, count(*) AS core, round(avg(CASE WHEN l_orderkey IS NULL THEN 1.0 ELSE 0.0 END), 6) AS loss FROM c LEFT JOIN k ON o_orderkey = l_orderkey GROUP BY 1""")
def loss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sends, but for the last of an epoch, that were never sighted."""
    o = table(spark, sf_dir, "orders")
    ends = o.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("last"))  # one row per epoch
    core = o.join(ends, "o_orderpriority").filter(F.col("o_orderdate") <= F.col("last") - F.expr("interval 30 days"))
    seen = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("hit")).distinct()
    got = core.join(seen, "o_orderkey", "left")
    return got.groupBy(F.col("o_orderpriority").alias("epoch")).agg(F.count("*").alias("core"), F.round(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)), 6).alias("loss"))


@query("JOI-03", sql=f"""WITH {S}, v AS (SELECT epoch, k, min(time_ms) AS t FROM s WHERE kind = 'view' GROUP BY ALL), c AS (SELECT epoch, k, min(time_ms) AS t FROM s WHERE kind = 'click' GROUP BY ALL)
SELECT epoch, k, c.t - v.t AS latency FROM v JOIN c USING (epoch, k)""")
def latency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between the first sightings of a packet on two boards."""
    s = sightings(spark, sf_dir)
    one = s.filter("kind = 'view'").groupBy("epoch", "k").agg(F.min("time_ms").alias("a"))
    two = s.filter("kind = 'click'").groupBy("epoch", "k").agg(F.min("time_ms").alias("b"))
    return one.join(two, ["epoch", "k"]).select("epoch", "k", (F.col("b") - F.col("a")).alias("latency"))


@query("JOI-04", sql=f"""WITH {S}, e AS (SELECT epoch, min(time_ms) AS a, min(time_ms) + {600 * MIN} AS z FROM s WHERE kind = 'purchase' GROUP BY epoch)
SELECT e.epoch, count(*) AS frames, count(*) FILTER (torn) AS torn FROM e JOIN s ON s.epoch = e.epoch AND time_ms BETWEEN a AND z GROUP BY e.epoch""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in the time span of an epoch's run."""
    s = sightings(spark, sf_dir)
    spans = s.filter("kind = 'purchase'").groupBy("epoch").agg(F.min("time_ms").alias("a"), (F.min("time_ms") + 600 * MIN).alias("z"))
    got = W.in_intervals(s, spans, ["epoch"], "time_ms", "a", "z", 600 * MIN)
    return got.groupBy("epoch").agg(F.count("*").alias("frames"), F.count_if("torn").alias("torn"))


@query("JOI-05", "WIN-13", sql=f"""WITH {S} SELECT seq, last_value(CASE WHEN board = 'local' THEN seq END IGNORE NULLS) OVER (PARTITION BY epoch ORDER BY time_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_local FROM s""")
def asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last local packet at each frame."""
    s = sightings(spark, sf_dir)
    sent = s.filter("board = 'local'").select("epoch", "time_ms", F.col("seq").alias("packet"))
    return W.as_of(s, sent, ["epoch"], "time_ms", "packet", "last_local").select("seq", "last_local")


@query("JOI-06", "WIN-08", sql=f"""WITH {S} SELECT a.seq, min(b.time_ms) AS caught FROM (SELECT * FROM s WHERE kind = 'error') a LEFT JOIN (SELECT * FROM s WHERE kind = 'click') b
ON a.epoch = b.epoch AND b.time_ms >= a.time_ms AND b.time_ms < a.time_ms + {300 * MIN} GROUP BY a.seq""")
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first good frame within a horizon after each fault."""
    s = sightings(spark, sf_dir)
    got = W.next_within(s.filter("kind = 'error'"), s.filter("kind = 'click'").select("epoch", "time_ms"), ["epoch"], "time_ms", 300 * MIN, "caught")
    return got.select("seq", "caught")


@query("WIN-09", sql=f"""WITH {S} SELECT a.seq, count(*) FILTER (b.zero) AS zeros, count(*) FILTER (NOT b.zero AND b.torn) AS torn FROM (SELECT * FROM s WHERE kind = 'purchase') a
JOIN s b ON a.epoch = b.epoch AND b.time_ms >= a.time_ms AND b.time_ms <= a.time_ms + {300 * MIN} GROUP BY a.seq""")
def after_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and torn frames in the span after each return; empty goes first."""
    s = sightings(spark, sf_dir)
    spans = s.filter("kind = 'purchase'").select("epoch", F.col("seq").alias("at"), F.col("time_ms").alias("a"), (F.col("time_ms") + 300 * MIN).alias("z"))
    got = W.in_intervals(s, spans, ["epoch"], "time_ms", "a", "z", 300 * MIN)
    return got.groupBy(F.col("at").alias("seq")).agg(F.count_if("zero").alias("zeros"), F.count_if(F.expr("not zero and torn")).alias("torn"))


@query("JOI-08", sql=f"""WITH {S} SELECT seq FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.epoch = s.epoch AND o.kind = 'error' AND s.time_ms > o.time_ms AND s.time_ms <= o.time_ms + {60 * MIN})""")
def outside_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no outage holds; an hour after a fault is one."""
    s = sightings(spark, sf_dir)
    faults = s.filter("kind = 'error'").select("epoch", "time_ms", F.col("time_ms").alias("fault"))
    got = W.as_of(s, faults, ["epoch"], "time_ms", "fault", "fault", strict=True)
    return got.filter(F.col("fault").isNull() | (F.col("time_ms") > F.col("fault") + 60 * MIN)).select("seq")


@query("WIN-10", sql=f"""WITH {S}, p AS (SELECT *, lag(k) OVER w AS b FROM s WINDOW w AS (PARTITION BY epoch ORDER BY time_ms, seq)), c AS (SELECT * FROM p WHERE b IS NULL OR b <> k),
d AS (SELECT epoch, (k - lag(k) OVER (PARTITION BY epoch ORDER BY time_ms, seq) + 256) % 256 AS d FROM c)
SELECT epoch, count(*) FILTER (d = 1) AS ok, count(*) FILTER (d > 128) AS reordered, coalesce(sum(d - 1) FILTER (d > 1 AND d <= 128), 0)::BIGINT AS skipped FROM d GROUP BY epoch""")
def counter_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skips and steps back of a counter of 8 bits."""
    return W.counter_steps(sightings(spark, sf_dir), ["epoch"], ["time_ms", "seq"], "k")


@query("WIN-11", sql=f"""WITH {S}, g AS (SELECT *, CASE WHEN time_ms - lag(time_ms) OVER (PARTITION BY epoch ORDER BY time_ms) > {60 * MIN} THEN 1 ELSE 0 END AS n FROM s),
b AS (SELECT *, sum(n) OVER (PARTITION BY epoch ORDER BY time_ms) AS burst FROM g) SELECT epoch, burst::BIGINT AS burst, count(*) AS n, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM b GROUP BY ALL""")
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of messages that a pause parts."""
    return W.bursts(sightings(spark, sf_dir), ["epoch"], "time_ms", 60 * MIN).groupBy("epoch", "burst").agg(
        F.count("*").alias("n"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


@query("WIN-12", sql=f"""WITH {S}, l AS (SELECT *, lag(k) OVER (PARTITION BY epoch, kind ORDER BY time_ms, seq) AS b FROM s)
SELECT seq, CASE WHEN b IS NULL THEN 'new' ELSE 'changed' END AS news FROM l WHERE b IS NULL OR b <> k""")
def port_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements that are new or differ from the one before."""
    b = F.lag("k").over(Window.partitionBy("epoch", "kind").orderBy("time_ms", "seq"))
    rows = sightings(spark, sf_dir).withColumn("b", b).filter("b is null or b <> k")
    return rows.select("seq", F.when(F.col("b").isNull(), "new").otherwise("changed").alias("news"))


@query("AGG-17", sql=f"""WITH {S}, l AS (SELECT *, lag(k) OVER (PARTITION BY epoch ORDER BY time_ms, seq) AS b FROM s)
SELECT epoch, count(*) FILTER (b IS NOT NULL AND k <> 0 AND k > b) AS increased, count(*) FILTER (b IS NOT NULL AND k <> 0 AND k <= b) AS stopped, count(*) FILTER (b IS NOT NULL AND k = 0) AS zero FROM l GROUP BY epoch""")
def loop_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a frame counter moves."""
    rows = sightings(spark, sf_dir).withColumn("b", F.lag("k").over(Window.partitionBy("epoch").orderBy("time_ms", "seq")))
    return rows.groupBy("epoch").agg(F.count_if(F.expr("b is not null and k <> 0 and k > b")).alias("increased"),
                                     F.count_if(F.expr("b is not null and k <> 0 and k <= b")).alias("stopped"), F.count_if(F.expr("b is not null and k = 0")).alias("zero"))


@query("AGG-13", "AGG-14", sql=f"""WITH {S}, h AS (SELECT epoch, k, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT epoch, sum(n) AS t, count(*) AS symbols FROM h GROUP BY epoch)
SELECT h.epoch, round(-sum(n / t * log2(n / t)), 6) AS entropy, max(symbols) AS symbols, sum(n)::BIGINT AS n FROM h JOIN t ON h.epoch = t.epoch GROUP BY h.epoch""")
def field_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a field's values."""
    return A.entropy(sightings(spark, sf_dir), ["epoch"], "k").withColumn("entropy", F.round("entropy", 6))


@query("AGG-15", sql=f"""WITH {S}, d AS (SELECT epoch, (k - first_value(k) OVER (PARTITION BY epoch ORDER BY time_ms, seq) + 128) % 128 AS v FROM s),
h AS (SELECT epoch, v, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT epoch, sum(n) AS t FROM h GROUP BY epoch)
SELECT h.epoch, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM h JOIN t ON h.epoch = t.epoch GROUP BY h.epoch""")
def delta_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the differences to an epoch's first value."""
    first = F.first("k").over(Window.partitionBy("epoch").orderBy("time_ms", "seq"))
    rows = sightings(spark, sf_dir).withColumn("v", F.pmod(F.col("k") - first, F.lit(128)))
    return A.entropy(rows, ["epoch"], "v").select("epoch", F.round("entropy", 6).alias("entropy"))


@query("AGG-16", "SET-03", sql=f"WITH {S} SELECT epoch, count(DISTINCT k) AS units, sha1(string_agg(DISTINCT k::VARCHAR, ',' ORDER BY k::VARCHAR)) AS state FROM s WHERE NOT torn GROUP BY epoch")
def clean_set_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct units received and a key of their set."""
    return sightings(spark, sf_dir).filter("not torn").groupBy("epoch").agg(
        F.count_distinct("k").alias("units"), F.sha1(F.array_join(F.array_sort(F.collect_set(F.col("k").cast("string"))), ",")).alias("state"))


@query("AGG-19", "EVL-22", sql=f"WITH {S} SELECT epoch, round(count(*) FILTER (torn)::DOUBLE / nullif(count(*) FILTER (zero), 0), 6) AS torn_per_zero, round(count(*) FILTER (torn)::DOUBLE / count(*), 6) AS share FROM s GROUP BY epoch")
def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios that are null without a divisor."""
    return sightings(spark, sf_dir).groupBy("epoch").agg(
        F.round(F.try_divide(F.count_if("torn"), F.count_if("zero")), 6).alias("torn_per_zero"), F.round(F.try_divide(F.count_if("torn"), F.count("*")), 6).alias("share"))


@query("AGG-20", sql=f"WITH {S}, c AS (SELECT epoch, k, count(*) AS n FROM s GROUP BY ALL) SELECT epoch, arg_max(k, (n, -k)) AS mode FROM c GROUP BY epoch")
def region_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, the lowest of equals."""
    c = sightings(spark, sf_dir).groupBy("epoch", "k").agg(F.count("*").alias("n"))
    return c.groupBy("epoch").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("mode"))


@query("AGG-26", "STR-09", sql=f"""WITH {S}, f AS (SELECT epoch, k, min(time_ms) AS t FROM s WHERE NOT torn AND NOT zero GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY t, k) AS rn FROM f)
SELECT epoch, min(t) FILTER (rn = 25) AS t50, min(t) FILTER (rn = 45) AS t90 FROM r GROUP BY epoch""")
def units_complete_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When half and nine tenths of 50 units had been seen."""
    first = sightings(spark, sf_dir).filter("not torn and not zero").groupBy("epoch", "k").agg(F.min("time_ms").alias("t"))
    r = first.withColumn("rn", F.row_number().over(Window.partitionBy("epoch").orderBy("t", "k")))
    return r.groupBy("epoch").agg(F.min(F.when(F.col("rn") == 25, F.col("t"))).alias("t50"), F.min(F.when(F.col("rn") == 45, F.col("t"))).alias("t90"))


@query("AGG-31", "STR-08", sql=f"""WITH {S} SELECT epoch, count(*) AS frames, count(*) FILTER (NOT torn AND NOT zero) AS taken, count(*) FILTER (torn) AS rejected, min(time_ms) AS first_ms, max(value) AS longest FROM s GROUP BY epoch""")
def probe_control_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control words of a receiver's session."""
    return sightings(spark, sf_dir).groupBy("epoch").agg(F.count("*").alias("frames"), F.count_if(F.expr("not torn and not zero")).alias("taken"),
                                                         F.count_if("torn").alias("rejected"), F.min("time_ms").alias("first_ms"), F.max("value").alias("longest"))


@query("AGG-33", "CHN-12", sql=f"""WITH {S}, x AS (SELECT max(time_ms) AS z FROM s), l AS (SELECT epoch, k, arg_max(torn, (time_ms, seq)) AS torn FROM s, x WHERE time_ms <= z - {1000 * MIN} GROUP BY ALL)
SELECT epoch, count(*) FILTER (torn) AS broken, count(*) AS held FROM l GROUP BY epoch""")
def broken_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose last value at a mark was torn."""
    s = sightings(spark, sf_dir)
    end = s.agg(F.max("time_ms").alias("z"))  # one row
    held = s.crossJoin(F.broadcast(end)).filter(F.col("time_ms") <= F.col("z") - 1000 * MIN)
    last = held.groupBy("epoch", "k").agg(F.max_by("torn", F.struct("time_ms", "seq")).alias("torn"))
    return last.groupBy("epoch").agg(F.count_if("torn").alias("broken"), F.count("*").alias("held"))


@query("JOI-10", sql=f"WITH {S} SELECT seq, n_nationkey AS unit FROM s LEFT JOIN nation ON n_nationkey = k")
def packet_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expected packet a sighting is, if any."""
    return sightings(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"), "left").select("seq", F.col("n_nationkey").alias("unit"))


@query("SET-01", "PRJ-04", sql=f"WITH {S} SELECT seq, time_ms FROM s WHERE board = 'local' UNION ALL SELECT seq, time_ms + 1000 FROM s WHERE board = 'remote' AND NOT zero")
def log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of both boards on one clock; remote frames that are empty are not visible."""
    s = sightings(spark, sf_dir)
    return s.filter("board = 'local'").select("seq", "time_ms").unionByName(s.filter("board = 'remote' and not zero").select("seq", (F.col("time_ms") + 1000).alias("time_ms")))


RECEIVER = f"""WITH {S}, n AS (SELECT *, (CASE WHEN zero THEN 0 ELSE 1 + k % 3 END) AS session FROM s),
f AS (SELECT *, sum(CASE WHEN session <> b THEN 1 ELSE 0 END) OVER (PARTITION BY epoch ORDER BY time_ms, seq) AS part FROM
     (SELECT *, lag(session, 1, 0) OVER (PARTITION BY epoch ORDER BY time_ms, seq) AS b FROM n WHERE session <> 0)),
z AS (SELECT epoch, max(part) AS part FROM f GROUP BY epoch)"""


@query("STR-01", "STR-03", "STR-06", "STR-11", sql=RECEIVER + """ SELECT f.epoch, max(f.session) AS session, count(DISTINCT k) AS units, max(seq) AS last_seq FROM f JOIN z ON f.epoch = z.epoch AND f.part = z.part GROUP BY f.epoch""")
def receiver_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a receiver holds at the end: a new session clears it, empty frames are ignored."""
    from driftcast.streaming.receiver import final_state

    return final_state(sightings(spark, sf_dir))


@query("STR-02", sql=f"WITH {S}, l AS (SELECT *, lag(k) OVER (PARTITION BY epoch ORDER BY time_ms, seq) AS b FROM s) SELECT seq, k FROM l WHERE b = k")
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets taken because the frame before showed the same."""
    rows = sightings(spark, sf_dir).withColumn("b", F.lag("k").over(Window.partitionBy("epoch").orderBy("time_ms", "seq")))
    return rows.filter("b = k").select("seq", "k")


@query("STR-04", sql=f"WITH {S}, l AS (SELECT *, lag(value) OVER (PARTITION BY epoch, k ORDER BY time_ms, seq) AS b FROM s WHERE NOT zero) SELECT epoch, count(*) FILTER (b IS NULL OR b <> value) AS redraws FROM l GROUP BY epoch")
def redraws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a packet changes what is stored for its unit."""
    rows = sightings(spark, sf_dir).filter("not zero").withColumn("b", F.lag("value").over(Window.partitionBy("epoch", "k").orderBy("time_ms", "seq")))
    return rows.groupBy("epoch").agg(F.count_if(F.expr("b is null or b <> value")).alias("redraws"))


@query("STR-07", sql="""SELECT l_orderkey AS frame, CASE WHEN max(l_linenumber) = 0 THEN 0 WHEN count(DISTINCT l_linestatus) = 1 AND max(l_quantity) <= 48 THEN 1 ELSE 2 END::INTEGER AS status FROM lineitem GROUP BY 1""")
def torn_group_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of parameters are taken (1) only if they share one tag and are in range; idle is 0, torn 2."""
    status = F.when(F.max("l_linenumber") == 0, 0).when((F.count_distinct("l_linestatus") == 1) & (F.max("l_quantity") <= 48), 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(status.alias("status"))


@query("STR-12", sql=f"""WITH {S}, f AS (SELECT epoch, k, min(time_ms) AS t FROM s GROUP BY ALL), b AS (SELECT epoch, floor(t / {600 * MIN})::BIGINT AS slot, count(*) AS n FROM f GROUP BY ALL)
SELECT epoch, slot, (sum(n) OVER (PARTITION BY epoch ORDER BY slot))::BIGINT AS units FROM b""")
def progressive_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units known at the end of each time slot in which their number changed."""
    first = sightings(spark, sf_dir).groupBy("epoch", "k").agg(F.min("time_ms").alias("t"))
    b = first.groupBy("epoch", F.floor(F.col("t") / (600 * MIN)).alias("slot")).agg(F.count("*").alias("n"))
    return b.select("epoch", "slot", F.sum("n").over(Window.partitionBy("epoch").orderBy("slot")).alias("units"))


@query("CHN-11", sql=f"""WITH {S}, l AS (SELECT epoch, k, arg_max(zero, (time_ms, seq)) AS zero FROM s GROUP BY ALL) SELECT epoch, count(*) FILTER (zero) AS blanked FROM l GROUP BY epoch""")
def zero_packet_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that an empty packet has overwritten for good."""
    last = sightings(spark, sf_dir).groupBy("epoch", "k").agg(F.max_by("zero", F.struct("time_ms", "seq")).alias("zero"))
    return last.groupBy("epoch").agg(F.count_if("zero").alias("blanked"))
