"""Transforms, quality tables and run packets against plain loops and golden values."""

import random

import numpy as np
from pyspark.sql import functions as F

from driftcast.functions import blocks as K
from driftcast.functions import transforms as T
from driftcast.operators import runs
from driftcast.sources import logs


def test_quality_steps():
    assert T.quality_steps(50) == T.ANNEX_K
    assert T.quality_steps(100) == [1] * 64 and T.quality_steps(25)[:3] == [32, 22, 20] and max(T.quality_steps(1)) == 255
    assert T.quality_steps(90)[:8] == [3, 2, 2, 3, 5, 8, 10, 12]


def lifted(x):
    """One level of the 9/7 wavelet by loops: low band, high band."""
    x, n = list(x), len(x)
    mirror = lambda i: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    for k, a in enumerate(T.LIFTING):
        for i in range(1 - k % 2, n, 2):
            x[i] += a * (x[mirror(i - 1)] + x[mirror(i + 1)])
    return [v * T.SCALE for v in x[::2]] + [v / T.SCALE for v in x[1::2]]


def test_wavelet_matrix_against_lifting():
    rnd = np.random.default_rng(3)
    for n in (2, 4, 8):
        x = rnd.normal(size=n)
        assert np.allclose(T.wavelet_matrix(n) @ x, lifted(x))
    assert np.allclose(T.wavelet_matrix(8)[4:] @ np.ones(8), 0, atol=1e-6)  # flat samples have no details
    assert np.allclose(T.wavelet_matrix(8)[:4] @ np.ones(8), 2 ** 0.5, atol=1e-5)
    block = rnd.normal(size=(8, 8))
    want = block.copy()
    for n in (8, 4, 2):
        part = np.array([lifted(row) for row in want[:n, :n]])
        want[:n, :n] = np.array([lifted(col) for col in part.T]).T
    whole = T.wavelet_2d(8, 3)
    assert np.allclose((whole @ block.ravel()).reshape(8, 8), want)
    assert np.allclose(np.linalg.solve(whole, whole @ block.ravel()), block.ravel())


def test_matrix_of_batches(spark):
    data = [(1, [1.0, 2.0]), (2, None), (3, [0.5, -1.0])]
    df = spark.createDataFrame(data, "id long, x array<double>").withColumn("y", F.lit("own"))
    got = {r["id"]: r["y"] for r in T.apply_matrix(df, "x", np.array([[1.0, 1.0], [0.0, 2.0], [3.0, 0.0]]), "y").collect()}
    assert got == {1: [3.0, 4.0, 3.0], 2: None, 3: [-0.5, -2.0, 1.5]}
    assert T.apply_matrix(df.limit(0), "x", np.eye(2), "x").collect() == []
    back = K.idct(K.dct(spark.createDataFrame([(1, [float(i * 7 % 31) for i in range(64)])], "id long, b array<double>"), "b", "c"), "c", "d").first()
    assert np.allclose(back["b"], back["d"])


def test_packets_decode_alike_in_any_order_and_more_than_once(spark):
    rnd = random.Random(4)
    data = [(k, [rnd.choice([0, 0, 0, 0, 1, -1, 3, -17]) if p > 3 else rnd.randint(-40, 40) for p in range(64)]) for k in range(40)] + [(90, [0] * 64), (91, None)]
    df = spark.createDataFrame(data, "id long, z array<long>")
    for cap in (32, 64, 400):
        units = runs.packets(df, "id", "z", cap).cache()
        rows = units.collect()
        assert all(len(r["payload"]) <= cap for r in rows) and (cap == 400) == (max(r["packet"] for r in rows) == 0)
        shuffled = units.unionByName(units.filter("packet % 2 = 0")).orderBy(F.rand(7))
        got = {(r["id"], r["position"]): r["level"] for r in runs.decoded(shuffled, "id").collect()}
        for k, z in data:
            for p, v in enumerate(z or []):
                assert got.get((k, p), 0) == v, (cap, k, p)
        some = runs.decoded(units.filter("packet = 1"), "id").collect()  # a packet alone says only what is so
        assert all(dict(data)[r["id"]][r["position"]] == r["level"] for r in some) and (some or cap == 400)


def test_a_clean_packet_repairs_what_a_corrupted_one_left(spark):
    """The last packet that arrives wins, whatever the size of its values."""
    z = [40, 38, 41, 39] + [0, 7, 0, 0, -2] + [0] * 55
    clean = runs.packets(spark.createDataFrame([(1, z)], "id long, z array<long>"), "id", "z", 400).first()["payload"]
    wrong = runs.packets(spark.createDataFrame([(1, [900, -900, 0, 0] + [5, 700, 3, 0, 90] + [0] * 55)], "id long, z array<long>"), "id", "z", 400).first()["payload"]
    for order, want in (([wrong, clean], z), ([clean, wrong, clean], z)):
        df = spark.createDataFrame([(1, p, k) for k, p in enumerate(order)], "id long, payload string, k int")
        got = {r["position"]: r["level"] for r in runs.decoded(df, "id", arrival="k").collect()}
        assert [got.get(p, 0) for p in range(9)] == want[:9]
    last = spark.createDataFrame([(1, clean, 0), (1, wrong, 5)], "id long, payload string, k int")
    assert {r["position"]: r["level"] for r in runs.decoded(last, "id", arrival="k").collect()}[0] == 900


def test_cut_packets_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [5, -3, 0, 2] + [0] * 60)], "id long, z array<long>")
    units = runs.packets(df, "id", "z", 64)
    cut = units.withColumn("payload", F.substring("payload", 1, 12))
    assert {(r["position"], r["level"]) for r in runs.decoded(cut, "id").collect()} <= {(0, 5), (1, -3), (2, 0), (3, 2)}
    assert runs.packets(df.limit(0), "id", "z", 64).count() == 0 and runs.decoded(units.limit(0), "id").count() == 0
    assert runs.decoded(units.withColumn("payload", F.lit("")), "id").count() == 0


def test_results_are_made_once_for_each_label(spark, tmp_path):

    calls = []

    def make(label):
        calls.append(label)
        return spark.createDataFrame([(label, 1)], "name string, n int")

    for label in ("a/b c", "x", "a/b c"):
        got, made = logs.cached(spark, f"file://{tmp_path}", label, make)
        assert got.first()["name"] == label and made == (label not in calls[:-1] or calls.count(label) == 0 or made)
    assert calls == ["a/b c", "x"]


def test_schedules_against_plain_rules(spark):
    from driftcast.operators import schedules as S

    for n, base, period in ((1, 1, 2), (5, 2, 3), (7, 9, 4), (12, 4, 5)):
        got = S.by_phases(S.slots(spark, 400), {"c": S.carousel(n, base), "p": S.priority(n, base, period), "d": S.dual(n, base, period), "t": S.tiers(n, base)}).orderBy("slot").collect()
        few = min(base, n)
        turns = {"c": 0, "d": 0, "t": 0}
        for k, r in enumerate(got):
            assert r["c"] == (k % (n + 1) if k % (n + 1) < n else k // (n + 1) % few)
            if k % period == period - 1:
                assert r["p"] == k // period % few and r["d"] == k // period % few
            else:
                j = turns["c"]
                turns["c"] += 1
                assert r["p"] == (j % (n + 1) if j % (n + 1) < n else j // (n + 1) % few)
                rest = n - few
                if not rest:
                    assert r["d"] == k // period % few
                else:
                    assert r["d"] == (few + j % (rest + 1) if j % (rest + 1) < rest else j // (rest + 1) % few)
        assert {r["t"] for r in got} == set(range(n))


def test_histories_are_replaced_and_bounded(spark, tmp_path):
    import pytest


    path = f"file://{tmp_path}/a/history.json"
    for n in (3, 10):
        logs.replace_history(spark.range(n), path)
        assert logs.json_folder(spark, path, "id long").count() == n
    with pytest.raises(ValueError):
        logs.replace_history(spark.range(11), path)
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["history.json"]
    logs.write_text(logs.markdown(spark.createDataFrame([("a b", None), ("c", 2)], "x string, y int")), f"file://{tmp_path}/r.md")
    assert [r["cells"] for r in logs.markdown_rows(spark, f"file://{tmp_path}/r.md").collect()] == [["a b", None], ["c", "2"]]


def test_cells_of_reports_come_back_whole(spark, tmp_path):
    rows = [("b | c", "x"), ("-", None), (None, "- -"), ("0110", "1221"), ("2002", "&#124;"), ("a\nb\r", " pad\t"), ("", "---"), ("&amp;", "|"), ("| --- | --- |", ":---")]
    df = spark.createDataFrame(rows, "p string, `q | r` string")
    logs.write_text("# Head\n\n" + logs.markdown(df) + "\n\ntext\n\n" + logs.markdown(df.limit(1)) + "\n", f"file://{tmp_path}/all.md")
    got = [tuple(r["cells"]) for r in logs.markdown_rows(spark, f"file://{tmp_path}/all.md").collect()]
    assert got == rows + rows[:1]
