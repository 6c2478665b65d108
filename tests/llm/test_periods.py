"""Runs of periods against plain loops, and over odd, empty and clashing input."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcast.llm import periods

from .conftest import rows


def plain_runs(w, shortest=6, times=4):
    """By definition: for every period, maximal stretches; a stretch counts for its smallest period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k - i + q >= max(shortest, times * q):
                found.setdefault((i, k - i + q), q)
            i = k
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def drawn(r):
    out = []
    while len(out) < r.randrange(1, 120):
        unit = [r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(1, 12))]
        out += (unit * 12)[: r.randrange(1, len(unit) * r.choice([1, 4, 5, 9]) + 1)]
    return out


@pytest.mark.parametrize("steps", [10, 1e-9, 1e9])
def test_runs_against_the_definition(monkeypatch, steps):
    """With pair differences alone, with transforms alone, and with the weighing of both."""
    monkeypatch.setattr(periods, "PAIRS_PER_STEP", steps)
    r = random.Random(3)
    texts = [drawn(r) for _ in range(300)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 40, list("ab") * 20, (["a"] * 30 + ["b"]) * 5, (list("aab") * 4 + list("c")) * 6]
    known = {w: k for k, w in enumerate("abcdefgh")}
    sizes = np.array([len(t) for t in texts])
    codes = np.array([known[w] for t in texts for w in t])
    counts, base = periods.lag_matches(codes, sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    for k, t in enumerate(texts):
        want = [sum(t[i] == t[i + q] for i in range(len(t) - q)) for q in range(1, len(t) // 4 + 1)]
        assert counts[base[k]:base[k + 1]].tolist()[1:] == want
        assert periods.find_runs(codes[first[k]:first[k + 1]], counts[base[k]:base[k + 1]]) == plain_runs(t), t


def test_long_runs_of_long_texts_take_little_time():
    began = time.time()
    for codes, want in (
        (np.zeros(200_000, np.int64), [(0, 200_000, 1)]),
        (np.arange(200_000) % 40_000, [(0, 200_000, 40_000)]),
        (np.concatenate((np.arange(100_000) % 7, 10 + np.arange(100_000) % 11)), [(0, 100_000, 7), (100_000, 100_000, 11)]),
        (np.arange(300_000), []),
    ):
        counts, _ = periods.lag_matches(codes, np.array([len(codes)]))
        assert periods.find_runs(codes, counts) == want
    assert time.time() - began < 60


def test_rows_against_plain_loops(spark):
    r = random.Random(8)
    data = [(i, r.choice([" ", "  ", "\n", "\x0b "]).join(drawn(r)) + r.choice(["", " ", " ünï   x"])) for i in range(150)] + [(7, None), (None, "a " * 50), (10**12, "b a " * 9), (-4, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, periods.digest(periods.runs(periods.made_periodic(df))).collect()), key=str)
    assert got == sorted((plain_row(*d) for d in data), key=str)
    assert sum(x[1] > 0 for x in got) > 50


def test_odd_rows_clashing_names_and_empty_table(docs, clashing, empty):
    want = sorted(str(plain_row(x[0], x[1])) for x in rows() if x[0] != 6)  # the loops take too long for the long text
    for df in (docs, clashing.withColumn("starts", F.lit(1)).withColumn("g", F.lit(2)).withColumn("words", F.lit("x"))):
        got = periods.digest(periods.runs(periods.made_periodic(df))).collect()
        assert len(got) == len(rows()) and sorted(str(tuple(x)) for x in got if x["doc_id"] != 6) == want
    assert periods.digest(periods.runs(periods.made_periodic(empty))).collect() == []
