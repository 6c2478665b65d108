"""Timed redraws and presence as a stream against their batch twin, and captured datagrams as a table and a stream."""

import random

from pyspark.sql import functions as F

from driftcast.operators import datagrams as D
from driftcast.sources.datagrams import Datagrams, write_captures
from driftcast.streaming import timers

SCHEMA = "receiver long, unit long, time long"


def plain(rows, interval, gap):
    out = []
    for who in sorted({r[0] for r in rows}):
        first = {}
        for _, u, t in sorted((r for r in rows if r[0] == who), key=lambda r: r[2]):
            first.setdefault(u, t)
        shown = None
        for t in sorted(first.values()):
            if shown is None or t > shown:
                shown = t if shown is None or t >= shown + interval else shown + interval
                out.append((who, "redraw", shown, sum(f <= shown for f in first.values())))
        times, last = sorted({r[2] for r in rows if r[0] == who}), None
        for t in times:
            if last is not None and t - last > gap:
                out.append((who, "lapsed", last + gap, None))
                last = None
            if last is None:
                out.append((who, "present", t, None))
            last = t
        out.append((who, "lapsed", last + gap, None))
    return sorted(out, key=str)


def test_batch_twin_against_plain_loops(spark):
    r = random.Random(1)
    rows = [(w, r.randrange(12), r.randrange(0, 60_000, 7)) for w in range(4) for _ in range(60)] + [(9, 0, 5), (9, 0, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = timers.redraws(df, 500).unionByName(timers.presence(df, 2000)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 500, 2000)
    assert timers.redraws(df.limit(0), 500).count() == timers.presence(df.limit(0), 500).count() == 0


def test_stream_equals_its_twin_with_late_rows(spark, tmp_path):
    """Three batches, rows of which come out of order within the delay; a last frame far ahead lets everything settle."""
    r = random.Random(2)
    rows = sorted(((w, r.randrange(15), r.randrange(1000, 90_000)) for w in range(3) for _ in range(50)), key=lambda x: x[2] + r.randrange(9000))
    parts = [rows[:60], rows[60:110], rows[110:], [(99, 0, 10**7)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = []
    frames = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = timers.stream(frames, 500, 2000).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
    q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(200)
    assert sorted((x for x in got if x[0] != 99), key=str) == plain(rows, 500, 2000)
    assert len(got) == len(set(got))


def test_captures_as_table_and_stream(spark, tmp_path):
    spark.dataSource.register(Datagrams)
    folder = f"file://{tmp_path}/captures"

    def send(ids, name):
        rows = spark.createDataFrame([(k, k / 2, k * 3) for k in ids], "id long, time double, v long").coalesce(1)
        sent = D.addressed(rows, ["time"], F.concat(F.lit("/p/"), "id"), "v").unionByName(spark.createDataFrame([(1.0, b"no bundle"), (None, b"x"), (2.0, None)], "time double, data binary")).coalesce(1)
        assert write_captures(sent, f"{folder}-{name}").first()["datagrams"] == len(ids) + 1
        (tmp_path / "captures").mkdir(exist_ok=True)
        (tmp_path / f"captures-{name}" / "000000.capture").rename(tmp_path / "captures" / f"{name}.capture")

    want = lambda ids: sorted((k / 2, f"/p/{k}", k * 3) for k in ids)
    assert spark.read.format("datagrams").load(f"{folder}-none").count() == 0
    send(range(5), "a")
    send(range(5, 9), "b")
    got = spark.read.format("datagrams").load(folder)
    assert got.schema.names == ["file", "place", "time", "address", "value"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == want(range(9))
    seen = []

    def run():
        q = spark.readStream.format("datagrams").load(folder).writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r)[2:] for r in df.collect()))
        q = q.option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert sorted(seen) == want(range(9))
    send(range(9, 12), "c")
    run()  # a restart neither loses nor repeats
    assert sorted(seen) == want(range(12))
    (tmp_path / "captures" / "d.capture").write_bytes((tmp_path / "captures" / "a.capture").read_bytes()[:70])  # cut short
    assert spark.read.format("datagrams").load(folder).count() == 13
