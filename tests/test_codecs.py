"""Codecs and byte formats: units in any order and number give one picture; what is written is read."""

import random

import pytest
from pyspark.sql import functions as F

from driftcast.functions import blocks as K
from driftcast.operators import codecs as C
from driftcast.operators import datagrams as D


@pytest.fixture(scope="module")
def blocks(spark):
    rnd = random.Random(1)
    rows = [(i, 0, [float(min(255, max(0, 128 + 60 * ((k % 8) - 3) / 4 + rnd.uniform(-20, 20)))) for k in range(64)]) for i in range(6)]
    return spark.createDataFrame(rows, "vec_id long, label int, block array<double>").cache()


@pytest.mark.parametrize("name", sorted(C.CODECS))
def test_order_and_repeats_do_not_matter(name, blocks, spark):
    units = C.CODECS[name].encode(blocks).select("vec_id", "unit", "payload").collect()
    once = C.CODECS[name].decode(spark.createDataFrame(units))
    rnd = random.Random(2)
    mixed = units + rnd.sample(units, len(units) // 2)
    rnd.shuffle(mixed)
    again = C.CODECS[name].decode(C.held(spark.createDataFrame([(*u, k) for k, u in enumerate(mixed)], "vec_id long, unit int, payload string, at int"), F.col("at")))
    a, b = ({r["vec_id"]: r["block"] for r in d.collect()} for d in (once, again))
    assert a == b and len(a) == 6


def test_quality_rises_with_rate(blocks):
    got = {r["codec"]: r for r in C.rate_quality(blocks).collect()}
    assert got["raw4"]["psnr"] < got["raw5"]["psnr"] < got["raw8"]["psnr"] and got["raw4"]["bits"] == 256 and got["dct"]["psnr"] > 30


def test_missing_rows_take_the_nearest(blocks, spark):
    units = C.CODECS["raw8"].encode(blocks.limit(1)).filter("unit in (2, 5)").select("vec_id", "unit", "payload")
    got = C.CODECS["raw8"].decode(units).first()["block"]
    rows = [got[8 * y:8 * y + 8] for y in range(8)]
    assert rows[0] == rows[1] == rows[2] == rows[3] == rows[4] and rows[5] == rows[6] == rows[7] != rows[2]


def test_messages_and_pictures():
    sent = [("/remote/parameters/p0", 5), ("/a", -7)]
    data = D.bundle(sent)
    assert D.parse(data) == sent and len(data) % 4 == 0 and D.parse(data[:-3]) == sent[:1] and D.parse(b"nonsense") == []
    rows = [[random.Random(y * 9 + x).randrange(256) for x in range(7)] for y in range(5)]
    assert D.png_samples(D.png(rows)) == rows and D.png_samples(b"GIF89a") is None


def test_datagrams(spark):
    sizes = [[50, 20, 30, 10], [], [99], [60, 1]]
    df = spark.createDataFrame([(s,) for s in sizes], "s array<int>")
    assert [r[0] for r in df.select(D.datagram_count(F.col("s"), 60)).collect()] == [2, 0, 1, 2]
    assert K.BASIS[0][0] == pytest.approx(0.35355339)
