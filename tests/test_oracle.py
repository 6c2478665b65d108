"""Every query with SQL gives DuckDB's rows on the smallest tables; the few others give the same rows again."""

import math
import os

import duckdb
import pytest

from driftcast.plans import COVERS, QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v + 0.0 if v else 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(name, spark, duck):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    kinds = {c[0]: str(c[1]) for c in got.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    cols = sorted(kinds)
    place = [[c[0] for c in got.description].index(c) for c in cols]
    want = sorted(tuple(plain(r[p]) for p in place) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


#: Queries whose rows come of seeded draws in loops or of kernels over whole pictures; plain loops test their parts elsewhere.
WITHOUT_SQL = ["adaptive_code_lengths", "bursty_loss", "channel_loss", "codec_under_loss", "completion_times", "picture_scores", "predicted_residuals"]


def test_only_these_have_no_sql():
    assert sorted(set(QUERIES) - set(SQL)) == WITHOUT_SQL


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_the_others_give_the_same_rows_again(name, spark):
    rows = [sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def test_losses_are_near_the_model(spark):
    got = {(r["sampler"], r["hold"]): r["loss"] for r in QUERIES["channel_loss"](spark, SF).collect()}
    for key, want in {("bmfit", 0.12): 0.16, ("bmfit", 0.14): 0.07, ("bmfit", 0.16): 0.02, ("bmfit", 0.2): 0.0, ("meas60", 0.08): 0.108, ("meas60", 0.1): 0.01, ("congested", 0.1): 0.56}.items():
        assert abs(got[key] - want) < 0.02, key


def test_predicted_residuals_against_a_plain_loop(spark):
    got = {r["vec_id"]: (r["bits"], r["zeros"]) for r in QUERIES["predicted_residuals"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/embeddings.parquet").limit(20).collect():
        known, bits, zeros = [[0.0] * 8 for _ in range(8)], 0, 0
        for y in range(8):
            for x in range(8):
                v = float(row["embedding"][y * 8 + x]) * 127 + 128
                west = known[y][x - 1] if x else (known[y - 1][x] if y else 128.0)
                north = known[y - 1][x] if y else west
                both = known[y - 1][x - 1] if x and y else west
                guess = sorted([west, north, west + north - both])[1] if not (both >= max(west, north) or both <= min(west, north)) else min(west, north) if both >= max(west, north) else max(west, north)
                level = math.floor((v - guess) / 6 + 0.5)
                known[y][x] = min(255.0, max(0.0, guess + 6 * level))
                u = 2 * level - 1 if level > 0 else -2 * level
                bits += 2 * (u + 2).bit_length() - 2
                zeros += level == 0
        assert got[row["vec_id"]] == (bits, zeros)


def test_scores_fall_with_the_step(spark):
    rows = {r["step"]: r for r in QUERIES["picture_scores"](spark, SF).collect()}
    for name in ("psnr", "ssim", "msssim"):
        values = [rows[k][name] for k in (1, 8, 32, 96)]
        assert values == sorted(values, reverse=True)
    assert rows[1]["ssim"] > 0.99


def test_ids_are_covered():
    ids = [i for each in COVERS.values() for i in each]
    assert len(set(ids)) > 180 and all(len(i) == 6 and i[3] == "-" for i in ids)
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())
