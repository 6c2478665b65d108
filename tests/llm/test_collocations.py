"""Collocations against plain loops, and over odd, empty and clashing input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftcast.llm import collocations

from .conftest import rows


def plain(data, longest=3, least=10, share=50, top=2000):
    """data: (lang, text). The same rows by dictionaries of tuples."""
    counts = {}
    for lang, text in data:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for g, f in own.items() if len(g) == 1)
        good = {g: f for g, f in own.items() if len(g) > 1 and f >= least}
        best = []
        for g, a in good.items():
            inside = [f for h, f in good.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * f >= share * a for f in inside):
                continue
            score, _, left, right = min((1000000 * a * a // (own[g[:c]] * own[g[c:]]), c, own[g[:c]], own[g[c:]]) for c in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def spark_rows(df, **kw):
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


def drawn(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "New", "York", "ab", "é", " ", "ünï", "a\x0bb", "x" * 50, "\U0001f600"]
    def text():
        return "".join(r.choice(words[:r.randrange(2, len(words))]) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?"]) for _ in range(r.randrange(0, 80)))
    return [(r.choice(["en", "de", None, "und", "a\nb", ""]), r.choice([text(), text(), None, "", "New York. New York."])) for _ in range(n)]


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (4, 3, 7), (2, 1, 50)])
def test_against_plain_loops(spark, longest, least, top):
    data = drawn(longest, 120)
    df = spark.createDataFrame(data, "lang string, text string").repartition(3)
    assert spark_rows(df, longest=longest, least=least, top=top) == plain(data, longest, least, 50, top)


def test_many_buckets_and_small_chunks_give_the_same(spark, monkeypatch):
    data = drawn(9, 200)
    df = spark.createDataFrame(data, "lang string, text string").repartition(5)
    assert spark_rows(df, bucket_bytes=500, fewest_buckets=1) == plain(data)
    small = collocations.dealt_grams(collocations.pieces(df), 3, 7, chunk_bytes=100)
    got = {(r["lang"], r["gram"]): r["f"] for r in collocations.counted(small, 7, 10, memory="64MB").collect() if r["gram"] is not None}
    sliced = collocations.counted(small, 7, 10, slice_bytes=200).collect()  # each bucket in many slices, of which one is in memory
    assert {(r["lang"], r["gram"]): r["f"] for r in sliced if r["gram"] is not None} == got and len([r for r in sliced if r["gram"] is not None]) == len(got)
    total = lambda rows: sum(r["f"] for r in rows if r["gram"] is None)
    assert total(sliced) == total(collocations.counted(small, 7, 10).collect())
    whole = collocations.dealt_grams(collocations.pieces(df), 3, 1)
    assert got and got == {(r["lang"], r["gram"]): r["f"] for r in collocations.counted(whole, 1, 10).collect() if r["gram"] is not None}


def test_products_pass_64_bits(spark):
    """Four million copies of a piece are one row of a multiplicity; a third of all pieces is one phrase."""
    copies = spark.range(0, 4_000_000, 1, 4).select(F.lit("en").alias("lang"), F.lit("hot pair").alias("text"))
    other = spark.range(0, 2000).select(F.lit("en").alias("lang"), F.concat(F.lit("hot other w"), F.col("id") % 50).alias("text"))
    got = {r["phrase"]: r for r in collocations.collocations(copies.unionByName(other)).collect()}
    a, left = 4_000_000, 4_002_000
    assert (got["hot pair"]["a"], got["hot pair"]["l"], got["hot pair"]["r"]) == (a, left, a)
    assert got["hot pair"]["score"] == 1000000 * a * a // (left * a) and got["hot pair"]["n"] == 2 * a + 3 * 2000
    assert 1000000 * a * a > 2**63 and len(got) == 52


def test_odd_rows_clashing_names_and_empty_table(docs, clashing, empty):
    want = plain([(r[2], r[1]) for r in rows()], least=2)
    assert spark_rows(docs, least=2) == want
    assert spark_rows(clashing.withColumn("piece", F.lit("x")).withColumn("gram", F.lit(1)).withColumn("m", F.lit(2)), least=2) == want
    assert spark_rows(empty) == []
