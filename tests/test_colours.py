"""Error diffusion, principal axes and pictures set right against plain loops."""

import numpy as np

from driftcast.functions.images import homography
from driftcast.operators import colours as C


def test_dithering_carries_errors_and_keeps_means(spark):
    r = np.random.default_rng(3)
    data = [(k, (r.uniform(20, 230) + r.normal(0, 9, 48)).tolist()) for k in range(20)] + [(90, None), (91, [42.5] * 48)]
    palette = [0.0, 85.0, 170.0, 255.0]
    got = {x["id"]: x["codes"] for x in C.dithered(spark.createDataFrame(data, "id long, v array<double>").repartition(3), "id", "v", palette, 8).collect()}
    assert got[90] is None
    off = []
    for k, v in data:
        if v is None:
            continue
        left, want = {}, []
        for i in range(48):
            y, x = divmod(i, 8)
            w = v[i] + left.get((y, x), 0.0)
            code = min(range(4), key=lambda c: (abs(w - palette[c]), c))
            want.append(code)
            for dy, dx, part in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                left[y + dy, x + dx] = left.get((y + dy, x + dx), 0.0) + (w - palette[code]) * part / 16
        assert got[k] == want
        nearest = [palette[min(range(4), key=lambda c: abs(x - palette[c]))] for x in v]
        off.append((abs(sum(palette[c] for c in want) - sum(v)) / 48, abs(sum(nearest) - sum(v)) / 48))
    assert sum(a for a, _ in off) < sum(b for _, b in off) / 3
    assert C.dithered(spark.createDataFrame(data, "id long, v array<double>").limit(0), "id", "v", palette, 8).count() == 0


def test_principal_axes_are_the_largest_eigenvectors(spark):
    r = np.random.default_rng(4)
    data = []
    for k in range(15):
        axis = r.normal(size=3)
        data += [(k, *(100 + t * 40 * axis + r.normal(0, 2, 3)).tolist()) for t in r.normal(size=16)]
    data += [(90, 5.0, 6.0, 7.0)] * 4
    got = {x["b"]: x for x in C.principal_axes(spark.createDataFrame(data, "b int, x double, y double, z double"), ["b"], ("x", "y", "z"), 12).collect()}
    for k in range(15):
        p = np.array([d[1:] for d in data if d[0] == k])
        want = np.linalg.eigh(np.cov(p.T, bias=True))[1][:, -1]
        axis = np.array([got[k][f"a{i}"] for i in range(3)])
        assert abs(abs(axis @ want) - 1) < 1e-3 and np.allclose([got[k][f"m{i}"] for i in range(3)], p.mean(axis=0))
    assert [got[90][f"a{i}"] for i in range(3)] == [0.0, 0.0, 0.0]


def test_pictures_set_right(spark):
    h = homography([(0, 0), (5, 0), (5, 5), (0, 5)], [(0.5, 0.1), (4.8, 0.4), (4.1, 5.6), (-0.7, 4.2)])
    picture = np.random.default_rng(1).uniform(0, 255, (6, 6))
    df = spark.createDataFrame([(1, y, x, float(picture[y, x])) for y in range(6) for x in range(6)], "id int, y long, x long, v double")
    got = {(r["y"], r["x"]): r["v"] for r in C.gathered(df, "id", 6, h.tolist()).collect()}
    for ty in range(6):
        for tx in range(6):
            u = h @ [tx, ty, 1]
            sx, sy = u[0] / u[2], u[1] / u[2]
            want = 0.0
            for y in (int(np.floor(sy)), int(np.floor(sy)) + 1):
                for x in (int(np.floor(sx)), int(np.floor(sx)) + 1):
                    want += (1 - abs(sx - x)) * (1 - abs(sy - y)) * (picture[y, x] if 0 <= y < 6 and 0 <= x < 6 else 128.0)
            assert abs(got.get((ty, tx), 128.0) - want) < 1e-6
    same = {(r["y"], r["x"]): r["v"] for r in C.gathered(df, "id", 6, np.eye(3).tolist()).collect()}
    assert all(abs(same[y, x] - picture[y, x]) < 1e-9 for y in range(6) for x in range(6))
