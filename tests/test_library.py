"""Golden values and plain loops against the operators."""

import heapq
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K
from driftcast.operators import channel as C
from driftcast.operators import layouts as L
from driftcast.operators import schedules as S
from driftcast.operators import windows as W
from driftcast.streaming import receiver as R


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [r[f"c{i}"] for i in range(len(cols))]


def loop_mulberry(seed, n):
    draw = C.draws_of(seed)
    return [draw() for _ in range(n)][-1]


def test_draws_equal_a_loop(spark):
    seeds = [0, 1, 12345, 2**31, 2**32 - 1]
    rows = spark.createDataFrame([(s, n) for s in seeds for n in (1, 2, 50, 1000)], "s long, n long")
    for r in rows.select("s", "n", B.mulberry32(F.col("s"), F.col("n")).alias("r")).collect():
        assert r["r"] == loop_mulberry(r["s"], r["n"])


def test_bits(spark):
    code, back, neg, crc8 = one(spark, B.exp_golomb(F.lit(5), 0), B.exp_golomb_read(F.lit("00110111"), 0), B.signed(F.lit(255), 8), B.crc(F.lit(0b10100101), 8, 8))
    assert (code, back, neg) == ("00110", 5, -1)
    reg = 0
    for bit in "10100101":
        reg = (reg << 1 & 255) ^ (7 if (reg >> 7) ^ int(bit) else 0)
    assert crc8 == reg
    values = spark.range(-40, 40).select("id", B.unfold(B.exp_golomb_read(B.exp_golomb(B.fold(F.col("id")), 2), 2)).alias("back"))
    assert values.filter("id <> back").count() == 0
    assert one(spark, B.torn(F.lit("11111111"), F.lit("00000000"), F.lit(3)), B.to_bits(F.lit(5), 4)) == ["11100000", "0101"]


@pytest.mark.parametrize("w,h,code", [(1, 1, 128), (16, 9, 181), (3, 2, 165), (9, 16, 75)])
def test_aspect_codes(spark, w, h, code):
    c, r = one(spark, B.aspect_code(F.lit(w), F.lit(h)), B.aspect_ratio(F.lit(code)))
    assert c == code and r == pytest.approx(w / h, rel=0.01)


@pytest.mark.parametrize("prims,size,want", [(4000, 32, (10, 4, 3, 1001)), (4000, 25, (11, 3, 2, 1334)), (4000, 18, (11, 2, 1, 2001)),
                                              (4000, 10, (12, 1, 0, 4001)), (2000, 17, (10, 2, 1, 1001)), (1000, 32, (8, 4, 3, 251))])
def test_layouts(spark, prims, size, want):
    r = L.layouts(spark, size, size, (prims,)).first()
    assert (r["u"], r["k"], r["k0"], r["units"]) == want


def test_small_packets_have_no_layout(spark):
    assert L.layouts(spark, 1, 7, (1000,)).count() == 0


def test_qr_cells(spark):
    for r in L.qr_cells(spark, (21, 33)).groupBy("side").agg(F.count("*").alias("n"), F.max("cell").alias("last"), F.count_distinct("cell").alias("d")).collect():
        assert r["n"] == r["d"] == r["last"] + 1 == r["side"] ** 2 - 192


def heap_schedule(gains, n):
    f = [math.sqrt(g) for g in gains]
    stride = [1 / (x / sum(f)) for x in f]
    heap = [(s / 2, i) for i, s in enumerate(stride)]
    heapq.heapify(heap)
    out = []
    for _ in range(n):
        due, i = heapq.heappop(heap)
        out.append(i)
        heapq.heappush(heap, (due + stride[i], i))
    return out


def test_square_root_rule_equals_a_heap(spark):
    rnd = random.Random(1)
    gains = [rnd.random() * 10 + 0.1 for _ in range(37)]
    df = spark.createDataFrame(list(enumerate(gains)), "unit long, gain double")
    got = [r["unit"] for r in S.square_root(df, 800).orderBy("slot").collect()]
    assert sum(a != b for a, b in zip(got, heap_schedule(gains, 800))) == 0


def test_missing_gains_go_first(spark):
    got = S.square_root(spark.createDataFrame([(0, None), (1, 4.0), (2, 1.0)], "unit long, gain double"), 60).groupBy("unit").count()
    n = {r["unit"]: r["count"] for r in got.collect()}
    assert n[0] > n[1] > n[2]


def test_first_pass(spark):
    gains = spark.createDataFrame([(i, 1.0 + i) for i in range(100)], "unit long, gain double")
    got = [r["unit"] for r in S.named(spark, "fast+sqrt/8", gains, 100, 300).orderBy("slot").collect()]
    plain = [u for k, u in enumerate(got[:S.first_pass_length(100, 8)]) if k % 8 != 7]
    assert plain == list(range(100)) and len(got) == 300
    assert [r["unit"] for r in S.named(spark, "fast", gains, 100, 50).orderBy("slot").collect()] == list(range(50))
    for bad in ("slow", "fast+sqrt/1", "fast+base/8", "fast+"):
        with pytest.raises(ValueError):
            S.named(spark, bad, gains, 100, 50)


def test_arrivals_equal_a_loop(spark):
    seeds = spark.range(1, 5).select(F.col("id").alias("seed"))
    snaps = C.samples(spark, seeds, "meas60", 40.0)
    outs = C.outages(seeds, 40.0, on=5.0, off=2.0)
    got = C.arrivals(snaps, S.slots(spark, 500).select("slot", F.col("slot").alias("unit")), 0.1, 3.0, 30.0, outs)
    found = {(r["seed"], r["slot"]): r["time"] for r in got.collect()}
    want, away = {}, [(r["seed"], r["start"], r["end"]) for r in outs.collect()]
    for r in sorted(snaps.collect(), key=lambda r: (r["seed"], r["s"])):
        time = r["s"] + C.LATENCY - 3.0
        if r["s"] >= 3.0 and time <= 30.0 and not any(s == r["seed"] and a <= r["s"] < b for s, a, b in away):
            want.setdefault((r["seed"], math.floor(r["s"] / 0.1 + 1e-9)), time)
    assert found == want and len(want) > 500


def test_receivers_stream_like_their_twin(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(e, i, float(i), rnd.random() < 0.1, rnd.randrange(9)) for i in range(300) for e in (1, 2)]
    schema = "epoch long, seq long, time_ms double, zero boolean, k int"
    for part in range(3):  # each file is a batch
        spark.createDataFrame([r for r in rows if r[1] // 100 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    got: dict[int, tuple] = {}

    def take(df, _):
        got.update({r["epoch"]: (r["session"], r["units"], r["last_seq"]) for r in df.collect()})

    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = R.stream(frames).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["epoch"]: (r["session"], r["units"], r["last_seq"]) for r in R.final_state(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_streaming_windows_equal_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") % 5).alias("user_id"), F.col("id").cast("double").alias("value"),
                                   F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*600) as timestamp_ntz)").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for twin in (R.window_counts, R.burst_windows):
        q = twin(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName(twin.__name__)
        q = q.option("checkpointLocation", f"{tmp_path}/{twin.__name__}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        closed = {tuple(r) for r in spark.table(twin.__name__).collect()}
        assert closed <= {tuple(r) for r in twin(rows).collect()}


def test_transform_and_back(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([([rnd.uniform(-50, 50) for _ in range(64)],)], "block array<double>")
    r = K.idct(K.dct(df, "block", "c"), "c", "b").select("block", "c", "b", K.psnr("block", "block").alias("same")).first()
    assert r["b"] == pytest.approx(r["block"]) and sum(x * x for x in r["c"]) == pytest.approx(sum(x * x for x in r["block"])) and r["same"] == 99.0
    assert K.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2] and sorted(K.ZIGZAG) == list(range(64))


def test_adaptive_lengths_and_components(spark):
    import numpy as np

    from driftcast.functions.images import components, homography, multi_scale, resize
    from driftcast.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(20).collect()}
    got = {r["vec_id"]: r["bits"] for r in QUERIES["adaptive_code_lengths"](spark, sf).collect()}
    for i, v in vectors.items():
        a, n, bits = 4, 1, 0
        for x in v:
            q = int(math.floor(abs(x) * 32 + 0.5)) * (1 if x > 0 else -1)
            u = 2 * q - 1 if q > 0 else -2 * q
            k = 0
            while (n << k) < a and k < 15:
                k += 1
            bits += (u >> k) + 1 + k
            a, n = a + u, n + 1
            if n >= 64:
                a, n = a >> 1, n >> 1
        assert got[i] == bits
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert components(mask).tolist() == [[0, -1, -1, 3], [-1, 0, -1, 3], [-1] * 4, [12, 12, -1, 15]]
    plane = np.add.outer(np.arange(192.0), np.arange(192.0)) / 2
    assert multi_scale(plane, plane) == pytest.approx(1) and multi_scale(plane, np.floor(plane / 32) * 32) < 0.98 and math.isnan(multi_scale(plane[:100], plane[:100]))
    assert resize(plane, 64, 48).mean() == pytest.approx(plane.mean()) and resize(plane, 200, 192).shape == (200, 192)
    h = homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(10, 12), (205, 30), (190, 170), (22, 150)])
    at = h @ [1, 1, 1]
    assert at[:2] / at[2] == pytest.approx([190, 170]) and homography([(0, 0)] * 4, [(0, 0)] * 4) is None


def test_windows_on_edges(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, True), (1, 3.0, False), (1, 4.0, True), (2, 1.0, False)], "e int, t double, f boolean")
    assert sorted((r["e"], r["first_row"], r["length"]) for r in W.runs(df, ["e"], ["t"], F.col("f")).collect()) == [(1, 1, 2), (1, 4, 1)]
    assert {r["e"]: r["episodes"] for r in W.rising_edges(df, ["e"], ["t"], F.col("f")).collect()} == {1: 2, 2: 0}
    spans = spark.createDataFrame([(1, 1.5, 3.0)], "e int, a double, z double")
    assert W.in_intervals(df, spans, ["e"], "t", "a", "z", 0.7).count() == 2
    assert W.runs(df.limit(0), ["e"], ["t"], F.col("f")).count() == 0


def test_log_readers(spark, tmp_path):
    from driftcast.sources import logs

    (tmp_path / "run.csv").write_text("# session 3 k 128 rate 60\nsend,tStartMs,tEndMs,datagrams,bytes,firstChunk\n0,1.5,2.5,3,400,0\n")
    (tmp_path / "none.csv").write_text("send,tStartMs,tEndMs,datagrams,bytes,firstChunk\n")
    assert logs.csv(spark, f"{tmp_path}/run.csv", logs.LOCAL_RUN).first()["tEndMs"] == 2.5
    assert logs.csv(spark, f"{tmp_path}/none.csv", logs.LOCAL_RUN).count() == 0
    assert {(r["key"], r["value"]) for r in logs.run_parameters(spark, f"{tmp_path}/run.csv").collect()} == {("session", "3"), ("k", "128"), ("rate", "60")}
    rows = spark.createDataFrame([(1, "a", 1.0, 0), (1, "a", 2.0, 1)], "id int, v string, gain double, batch int")
    logs.append(rows.filter("batch = 0"), f"{tmp_path}/out")
    logs.append(rows.filter("batch = 1"), f"{tmp_path}/out")
    assert logs.latest(logs.json_rows(spark, f"{tmp_path}/out", "id int, v string, gain double, batch int"), ["id"]).first()["gain"] == 2.0
    assert logs.markdown(pd_frame(spark)) == "| a | b |\n| --- | --- |\n| 1 | - |"
    with pytest.raises(ValueError):
        logs.markdown(spark.range(20), limit=10)


def pd_frame(spark):
    return spark.createDataFrame(pd.DataFrame({"a": [1]})).withColumn("b", F.lit(None))
