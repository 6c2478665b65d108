"""Canonical codes, chunks, stacks of shapes, states at marks, quality layers, residual streams and budgets against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftcast.functions import transforms as T
from driftcast.operators import canonical as C
from driftcast.operators import layers as L
from driftcast.operators import pictures as P


def test_codes_are_prefix_free_canonical_and_short():
    r = random.Random(2)
    for counts in ({5: 3}, {1: 1, 2: 1}, {k: 2**k for k in range(40)}, {k: r.randrange(1, 10**6) for k in range(256)}, {k: [1, 10**12][k == 7] for k in range(200)}):
        codes = C.CodeTable.of_counts(counts).codes
        assert set(codes) == set(counts) and max(map(len, codes.values())) <= 16
        order = sorted(codes, key=lambda s: (len(codes[s]), s))
        values = [int(codes[s].ljust(16, "0"), 2) for s in order]
        assert values == sorted(values) and len(set(values)) == len(values)
        assert not any(codes[b].startswith(codes[a]) for a in order for b in order if a != b)
        if len(counts) > 1:
            assert sum(2.0 ** -len(c) for c in codes.values()) == 1
    lengths = {s: len(c) for s, c in C.CodeTable.of_counts({0: 5, 1: 9, 2: 12, 3: 13, 4: 16, 5: 45}).codes.items()}
    assert lengths == {0: 4, 1: 4, 2: 3, 3: 3, 4: 3, 5: 1}


def test_chunks_read_alone_give_the_levels_back(spark):
    r = random.Random(3)
    data = [(k // 9, k, [r.randint(-300, 300)] + [r.choice([0] * r.choice([1, 5, 40]) + [1, -1, 7, -120]) for _ in range(63)]) for k in range(60)]
    data += [(90, 900, [0] * 64), (90, 901, [5] + [0] * 62 + [1]), (91, 910, [-1] + [0] * 63)]
    rows = C.with_symbols(spark.createDataFrame(data, "picture long, block int, z array<long>").withColumn("first", F.get("z", F.lit(0))), "z").cache()
    rest = C.CodeTable.fit(C.symbol_counts(rows))
    steps = C.CodeTable.of_counts({k: 20 - k for k in range(12)})
    for cap, most in ((840, 255), (10_000, 4)):
        got = C.chunks(rows, "picture", "block", "first", steps, rest, cap, most).cache()
        chunks = got.collect()
        assert all(len(c["payload"]) <= cap and c["blocks"] <= most for c in chunks)
        back = {(x["picture"], x["block"]): x["levels"] for x in C.read_chunks(got.orderBy(F.rand(1)), "picture", steps, rest).collect()}
        assert back == {(p, b): z for p, b, z in data}
        alone = C.read_chunks(got.filter("chunk = 1"), "picture", steps, rest).collect()
        assert alone and all(back[x["picture"], x["block"]] == x["levels"] for x in alone)
    with pytest.raises(Exception, match="does not fit"):
        C.chunks(rows, "picture", "block", "first", steps, rest, 20).collect()
    assert C.chunks(rows.limit(0), "picture", "block", "first", steps, rest).count() == 0


def test_without_a_shape_is_the_render_without_it(spark):
    r = random.Random(6)
    shapes = [(k % 2, k, r.uniform(0, 12), r.uniform(0, 12), r.uniform(1, 6), r.uniform(1, 6), r.uniform(0, 3), r.uniform(0, 255), r.choice([0.0, 0.3, 0.9, 1.0])) for k in range(24)]
    df = spark.createDataFrame(shapes, "picture int, ord int, cx double, cy double, rx double, ry double, angle double, colour double, alpha double")
    got = {(x["picture"], x["ord"], x["y"], x["x"]): x for x in L.suffixes(L.covered(df, 12), ["picture", "y", "x"], "ord", "colour", "alpha").collect()}
    full = {(x["picture"], x["y"], x["x"]): x["v"] for x in P.render(df, "picture", 12).collect()}
    colours = {s[1]: (s[7], s[8]) for s in shapes}
    for (p, o, y, x), row in got.items():
        c, a = colours[o]
        assert math.isclose((row["before"] * (1 - a) + c * a) * row["passed"] + row["after"], full[p, y, x], abs_tol=1e-9)
    for gone in (0, 5, 11, 22):
        left = {(x["picture"], x["y"], x["x"]): x["v"] for x in P.render(df.filter(f"ord <> {gone}"), "picture", 12).collect()}
        for (p, o, y, x), row in got.items():
            if o == gone:
                assert math.isclose(row["without"], left.get((p, y, x), 128.0), abs_tol=1e-9)


def test_stacks_are_scanned_at_once_across_batches(spark):
    """Stacks of all depths, longer than a batch, with nulls, against a loop; one step for all stacks of a batch."""
    r = random.Random(8)
    rows = [(k, o, r.uniform(0, 255) if o % 11 else None if k == 3 else 7.0, r.choice([0.0, 0.25, 1.0]) if o % 13 else None if k == 4 else 0.5) for k in range(40) for o in range(r.choice([1, 2, 3, 60]))] + [(None, 2, 9.0, 0.5), (None, 1, 5.0, 1.0), (2, None, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k int, o int, c double, a double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x["k"], x["o"]): x for x in L.suffixes(df, ["k"], "o", "c", "a").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) - 1 and (2, None) not in got
    over = lambda v, s: None if v is None or s[2] is None or s[3] is None else v * (1 - s[3]) + s[2] * s[3]
    for key in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0))
        for i, s in enumerate(mine):
            light, after, passed = 128.0, 0.0, 1.0
            for z in mine[:i]:
                light = over(light, z)
            for z in reversed(mine[i + 1:]):
                after = None if after is None or passed is None or z[2] is None or z[3] is None else after + passed * z[2] * z[3]
                passed = None if passed is None or z[3] is None else passed * (1 - z[3])
            if s[1] is not None:
                x = got[key, s[1]]
                without = None if None in (light, after, passed) else light * passed + after
                assert (x["before"], x["after"], x["passed"], x["without"]) == (light, after, passed, without)
    at = np.concatenate([np.arange(1, 4), np.arange(1, 2), np.arange(1, 3)])
    alpha, colour = pa.array([0.5] * 6), pa.array([10.0, 20.0, 30.0, 40.0, 50.0, 60.0])
    assert [x.to_pylist() for x in L.stack_scan(at, colour, alpha, 0.0)] == [[0, 5, 12.5, 0, 0, 25], [20, 15, 0, 0, 30, 0], [0.25, 0.5, 1, 1, 0.5, 1]]
    assert L.suffixes(df.limit(0), ["k"], "o", "c", "a").collect() == []


def test_boxes_of_turned_ellipses_lose_no_pixel(spark):
    r = random.Random(10)
    shapes = [(k, r.uniform(-9, 21), r.uniform(-9, 21), r.uniform(0.1, 9), r.uniform(0.1, 9), r.choice([0.0, math.pi / 2, r.uniform(-4, 4)])) for k in range(150)] + [(900, 6.5, 6.5, 3.0, 1.0, 0.0)]
    df = spark.createDataFrame(shapes, "ord int, cx double, cy double, rx double, ry double, angle double")
    got = P.covered(df, 12)
    assert got.columns == [*df.columns, "y", "x"]
    want = set()
    for o, cx, cy, rx, ry, t in shapes:
        for y in range(12):
            for x in range(12):
                u, v = (x + 0.5 - cx) * math.cos(t) + (y + 0.5 - cy) * math.sin(t), (y + 0.5 - cy) * math.cos(t) - (x + 0.5 - cx) * math.sin(t)
                if u * u / (rx * rx) + v * v / (ry * ry) <= 1:
                    want.add((o, y, x))
    rows = [(x["ord"], x["y"], x["x"]) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {(900, 6, 3), (900, 6, 9)} <= want


def test_states_are_scored_once_and_right(spark):
    r = random.Random(4)
    arrivals = [(w, u, r.choice([0.5, 1.0, 2.5, 7.0, 30.0])) for w in range(30) for u in r.sample(range(4), r.randrange(0, 5))] + [(99, 1, None)]
    first = spark.createDataFrame(arrivals, "w int, unit long, t double")
    states = L.states_at_marks(first, ["w"], "unit", "t", (1, 2, 10)).withColumn("picture", F.col("w") % 3)
    calls = []

    def score(distinct, held):
        calls.append(distinct.count())
        each = held.groupBy("picture", "state").agg(F.sum("unit").alias("s"))
        return distinct.join(each, ["picture", "state"], "left").select("picture", "state", F.coalesce("s", F.lit(0)).alias("s"))

    got = {(x["w"], x["mark"]): (x["got"], x["s"]) for x in L.scored_states(states, first, ["picture"], ["w"], "unit", "t", score).collect()}
    want = {}
    for w in {a[0] for a in arrivals}:
        for m in (1, 2, 10):
            held = {u for v, u, t in arrivals if v == w and t is not None and t <= m}
            want[w, m] = (len(held), sum(held))
    distinct = {(w % 3, frozenset(u for v, u, t in arrivals if v == w and t is not None and t <= m)) for w, m in want}
    assert got == want and calls == [len(distinct)]


def test_layers_leave_less_and_less(spark):
    r = np.random.default_rng(1)
    data = [(k, r.normal(0, 60, 64).tolist()) for k in range(10)]
    got = L.layers(spark.createDataFrame(data, "id long, c array<double>"), "c", (24.0, 8.0, 3.0), lambda i: F.lit(0.5)).collect()
    for k, c in data:
        rows = sorted((x for x in got if x["id"] == k), key=lambda x: x["layer"])
        told = np.zeros(64)
        for x, step in zip(rows, (24.0, 8.0, 3.0)):
            told += np.array(x["levels"]) * step
            assert np.allclose(np.array(c) - told, x["rest"]) and np.abs(x["rest"]).max() <= step / 2 + 1e-9


def test_unknown_cells_take_the_mean_of_known_neighbours(spark):
    r = random.Random(7)
    data = [(k, [r.choice([None, None, None, float(r.randrange(9))]) for _ in range(25)]) for k in range(8)] + [(8, [None] * 25), (9, [1.0] + [None] * 24)]
    got = {x["id"]: x["d"] for x in spark.createDataFrame(data, "id int, c array<double>").withColumn("d", L.concealed_once("c", 5)).collect()}
    for k, c in data:
        for i in range(25):
            near = [c[y * 5 + x] for y in range(max(0, i // 5 - 1), min(5, i // 5 + 2)) for x in range(max(0, i % 5 - 1), min(5, i % 5 + 2)) if (y, x) != divmod(i, 5) and c[y * 5 + x] is not None]
            assert got[k][i] == c[i] if c[i] is not None else (got[k][i] is None if not near else math.isclose(got[k][i], sum(near) / len(near)))


def test_no_prefix_of_the_merged_streams_is_worse(spark):
    """The stated error of every prefix is that of the picture which its units make."""
    r = np.random.default_rng(2)
    data = [(k, (r.normal(0, 30, (2, 2)).repeat(4, 0).repeat(4, 1) + r.normal(0, 12, (8, 8))).ravel().tolist()) for k in range(12)]
    got = L.base_and_residual(spark.createDataFrame(data, "vec_id long, v array<double>"), "v", 2.0, 12.0).collect()
    haar = T.haar_2d(8, 2)
    assert np.allclose(haar @ haar.T, np.eye(64))
    for k, v in data:
        v = np.array(v)
        square = v.reshape(2, 4, 2, 4).mean(axis=(1, 3))
        coded = np.floor(square / 2 + 0.5) * 2
        c = haar @ (v - coded.repeat(4, 0).repeat(4, 1).ravel())
        base, rest, before = np.zeros((2, 2)), np.zeros(64), v @ v
        for x in sorted((x for x in got if x["vec_id"] == k), key=lambda x: x["place"]):
            if x["kind"] == 0:
                base.ravel()[x["unit"]] = coded.ravel()[x["unit"]]
            else:
                rest[x["unit"]] = np.sign(c[x["unit"]]) * np.floor(abs(c[x["unit"]]) / 12 + 0.5) * 12
            now = v - base.repeat(4, 0).repeat(4, 1).ravel() - haar.T @ rest
            assert math.isclose(now @ now, x["error"], abs_tol=0.01) and x["error"] <= before + 1e-6
            before = x["error"]
    with pytest.raises(ValueError):
        L.base_and_residual(spark.createDataFrame(data, "vec_id long, v array<double>"), "v", 8.0, 12.0)


def test_modes_keep_to_the_budget_and_pay_their_price(spark):
    r = random.Random(9)
    data = [(k, [(0, 1, 1000.0)] + [(m, r.randrange(2, 300), round(r.uniform(0, 1100), 3)) for m in range(1, 6)]) for k in range(300)]
    df = spark.createDataFrame(data, "id long, modes array<struct<mode:int,bits:bigint,error:double>>")
    errors = []
    for budget in (0.5, 1, 20, 60, 150, 10**6):
        got = {x["id"]: x for x in L.within_budget(df, "id", "modes", budget).collect()}
        assert len(got) == 300 and sum(x["bits"] for x in got.values()) <= max(1, budget) * 300
        assert all((x["mode"], x["bits"], x["error"]) in modes for x, modes in ((got[k], m) for k, m in data))
        errors.append(sum(x["error"] for x in got.values()))
        if budget == 10**6:
            assert all(got[k]["error"] == min(e for _, _, e in m) for k, m in data)
    assert errors == sorted(errors, reverse=True) and errors[0] == errors[1] == 300 * 1000.0
    assert L.within_budget(df.limit(0), "id", "modes", 5).collect() == []
