"""Runs of words that repeat with a period: matches counted for every lag, by FFT for frequent words and by pair differences for rare ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcast.llm.common import map_batches

#: A run has this many words and this many periods at least.
SHORTEST, TIMES = 6, 4
#: Pair differences of a word cost about as much as an FFT of N points where pairs are N log2 N divided by this.
PAIRS_PER_STEP = 10
_FIELDS = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"


def needed(lag: np.ndarray | int, shortest: int = SHORTEST, times: int = TIMES):
    """Matches in a row at a lag that make a run of that period."""
    return np.maximum((times - 1) * lag, shortest - lag)


def _heavy_counts(codes: np.ndarray, words: np.ndarray, lags: int) -> np.ndarray:
    """Matches of some words at lags 0 to lags: their summed power spectra, transformed back, are exact whole numbers after rounding."""
    size = 1 << int(len(codes) + lags).bit_length()
    power = np.zeros(size // 2 + 1)
    for w in words:
        f = np.fft.rfft(codes == w, size)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def lag_matches(codes: np.ndarray, sizes: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Per text (sizes words each of the concatenated codes) the number of places i whose word recurs at i + lag, for lags 0 to size // times.

    Returns the counts of all texts one after another and where each text's begin. Words of which pairs would be more
    work than a transform go by FFT, the others by the differences of their places, of which the first too far ends a place's search.
    """
    n, limit = len(codes), sizes // times
    base = np.concatenate(([0], np.cumsum(limit + 1)))
    counts = np.zeros(int(base[-1]), np.int64)
    if not n:
        return counts, base
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (int(codes.max()) + 1) + codes
    place = np.argsort(key, kind="stable")
    key = key[place]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    often = np.diff(cuts)
    spread = np.maximum(2, sizes + limit)
    work = (spread * np.log2(spread) / PAIRS_PER_STEP)[text[place[cuts[:-1]]]]
    heavy = often * (often - 1) / 2 > work
    first = np.concatenate(([0], np.cumsum(sizes)))
    heads = place[cuts[:-1]][heavy]
    for t in np.unique(text[heads]):
        own = codes[first[t]:first[t + 1]]
        counts[base[t]:base[t + 1]] += _heavy_counts(own, codes[heads[text[heads] == t]], int(limit[t]))
    last = np.repeat(cuts[1:], often) - 1  # the last of a word's places
    at = np.flatnonzero(~np.repeat(heavy, often))
    ahead, held, size = 1, [], 0
    while len(at):
        at = at[at + ahead <= last[at]]
        gap = place[at + ahead] - place[at]
        of = text[place[at]]
        near = gap <= limit[of]
        at = at[near]
        held.append((base[of] + gap)[near])
        size += len(at)
        ahead += 1
        if size > 1 << 20 or not len(at):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
    return counts, base


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of true values of least or more."""
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], (ends - starts)[long]


def scan(codes: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, matches) of every island of least or more matches in a row at a lag.

    Every quarter of a lag one place is looked at; an island shows in as many of them as fit least, and only such
    stretches are compared word by word.
    """
    step = max(1, lag // 4)
    left, right = codes[:-lag], codes[lag:]
    if step == 1:
        yield from zip(*(x.tolist() for x in _islands(left == right, least)))
        return
    marks, many = _islands(left[::step] == right[::step], least // step)
    for m, k in zip(marks.tolist(), many.tolist()):
        lo, hi = max(0, (m - 1) * step + 1), min(len(left), (m + k) * step)
        for s, found in zip(*(x.tolist() for x in _islands(left[lo:hi] == right[lo:hi], least))):
            yield lo + s, found


def find_runs(codes: np.ndarray, matches: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run, by start, then period.

    A run of period d explains length - m matches at every multiple m of d; lags whose other matches are too few are
    not scanned. A stretch that was found at a smaller lag has that smaller period.
    """
    lags = np.arange(len(matches))
    need = needed(lags, shortest, times)
    left, found = matches, {}
    for q in np.flatnonzero((matches >= need) & (lags > 0)).tolist():
        if left[q] < need[q]:
            continue
        for start, same in scan(codes, q, int(need[q])):
            stretch = (start, same + q)
            if stretch in found:
                continue
            found[stretch] = q
            more = np.arange(2 * q, min(len(matches) - 1, stretch[1] - 1) + 1, q)
            if len(more):
                if left is matches:
                    left = matches.copy()
                left[more] -= stretch[1] - more
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, starts, lengths, periods and collapsed (UTF-8) of every whole text.

    Words are what ASCII white space parts. A run is a stretch of words of smallest period q and of max(shortest, times q)
    words or more that no neighbouring word extends; runs come by start, then period. collapsed are the words that lie in no
    run after its first period, joined by one space. A null text has no words, an empty list of runs and an empty collapsed
    text. Rows depend on themselves alone: repeated rows and null ids stay, other columns play no part, nothing is
    shuffled. The work for n words is about n to the power 1.5 at most for counting lags, and one look at n / q places for each lag q that is scanned.
    """

    def run(batches):
        for b in batches:
            parts = [t.split() if t else [] for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = pa.array([w for p in parts for w in p], pa.large_binary()).dictionary_encode()
            codes = flat.indices.to_numpy().astype(np.int64)
            counts, base = lag_matches(codes, sizes, times)
            lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
            hopeful = np.unique(np.searchsorted(base, np.flatnonzero((counts >= needed(lags, shortest, times)) & (lags > 0)), "right") - 1)
            first = np.concatenate(([0], np.cumsum(sizes)))
            found = {int(t): find_runs(codes[first[t]:first[t + 1]], counts[base[t]:base[t + 1]], shortest, times) for t in hopeful}
            collapsed = []
            for k, words in enumerate(parts):
                if own := found.get(k):
                    stay = np.ones(len(words), bool)
                    for s, n, q in own:
                        stay[s + q:s + n] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                collapsed.append(b" ".join(words))
            lists = [pa.array([[r[c] for r in found.get(k, ())] for k in range(len(parts))], pa.list_(pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), *lists, pa.array(collapsed, pa.binary())],
                                             names=["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"])

    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_batches(own, run, _FIELDS)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without runs) and hashes of all runs and of the collapsed text."""
    each = F.arrays_zip("starts", "lengths", "periods")
    lines = F.array_join(F.transform(each, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("starts", "lengths", "periods")])), "\n")
    best = F.array_min(F.transform(each, lambda r: F.struct((-r["lengths"]).alias("n"), r["starts"].alias("s"), r["periods"].alias("q"))))
    some = F.size("starts") > 0
    rows = found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), best.alias("b"), F.when(some, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).alias("lines"), "collapsed")
    return rows.select("doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.n")).alias("length"), F.col("b.q").alias("period"), F.expr("(1000 * -b.n) div b.q").alias("exponent_milli"),
                       F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def made_periodic(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where one in ten documents repeats a stretch of its words to its end.

    h is the crc32 of the id in decimals and g = h div 10; if h mod 10 is 0, each word i of n from a = g mod n on becomes
    word a + (i - a) mod p with p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("changed", F.coalesce(F.col("h") % 10 == 0, F.lit(False)))
    rows = rows.withColumn("words", F.when(F.col("changed"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("changed") & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


#: The digest of op11 in DuckDB's SQL, which has no crc32 of its own.
SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda v, x: xor(xor(v, x) >> 1, 3988292384 * (xor(v, x) & 1)))) AS h FROM documents),
g AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM t),
w AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM g),
u AS MATERIALIZED (SELECT r, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
m AS MATERIALIZED (SELECT x.r, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
e AS (SELECT r, q FROM m GROUP BY r, q HAVING count(*) >= greatest(3 * q, 6 - q)),
k AS (SELECT m.r, m.q, i, i - row_number() OVER (PARTITION BY m.r, m.q ORDER BY i) AS island FROM m JOIN e ON e.r = m.r AND e.q = m.q),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY r, q, island HAVING count(*) >= greatest(3 * q, 6 - q)),
p AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, arg_min({'s': start, 'n': length, 'q': period}, [-length, start, period]) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM p GROUP BY r),
d AS (SELECT r, list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM p GROUP BY r),
c AS (SELECT w.r, doc_id, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i - 1)) END AS stay FROM w LEFT JOIN d ON d.r = w.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(stay, ' ')) AS collapsed_sha256 FROM c LEFT JOIN b ON b.r = c.r"""
