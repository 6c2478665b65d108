"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftcast.llm.common import map_batches, written

_WORDS = re.compile(r"[^\W\d_]+")
BLOCK = 128


def terms(text: str | None) -> Counter:
    """How often each lower-cased run of letters occurs in the whole text."""
    return Counter(_WORDS.findall(text.lower())) if text else Counter()


@dataclass
class Examples:
    """Inverted index of labelled examples in blocks, and what turns a vote into a score.

    Entries lie by term and block: entries of term t are first[t] to first[t + 1], each with its
    block, the largest weight in it, and where its postings begin; a posting has a place in the
    block and a weight. An example's weights have length 1.
    """

    vocabulary: dict[str, int]
    weigh: np.ndarray
    first: np.ndarray
    block: np.ndarray
    top: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    k: int
    base: float
    places: np.ndarray
    rates: np.ndarray

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index in a text and their TF-IDF weights, of length 1 together."""
        at = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts))
        known = at >= 0
        at, n = at[known], np.fromiter(counts.values(), np.int64, len(counts))[known]
        if not len(at):
            return at, np.zeros(0)
        w = (1 + np.log(n)) * self.weigh[at]
        return at, w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosines above 0 (ties: the earlier), and the cosines.

        A block's cosines are bounded by the text's weights times the largest weights of its terms.
        Blocks are read in falling order of their bounds, a few at a time, until the next bound is
        below the k-th cosine so far, so the result is exact.
        """
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        entry, of = _ranges(self.first[at], self.first[at + 1])
        if not len(entry):
            return best_i, best_s
        w, block = weights[of], self.block[entry]
        bound = np.bincount(block, w * self.top[entry])
        blocks = np.argsort(-bound, kind="stable")
        rank = np.empty(len(bound), np.int64)
        rank[blocks] = np.arange(len(bound))
        by_rank = np.argsort(rank[block], kind="stable")
        entry, w = entry[by_rank], w[by_rank]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(block, minlength=len(bound))[blocks])))
        done, step = 0, 2
        while done < len(blocks):
            least = max(1e-12, best_s[-1] - 1e-9 if len(best_s) == self.k else 0)
            more = int((bound[blocks[done:done + step]] >= least).sum())  # bounds fall
            if not more:
                break
            mine, some = entry[cuts[done]:cuts[done + more]], w[cuts[done]:cuts[done + more]]
            post, of = _ranges(self.begin[mine], self.begin[mine + 1])
            sums = np.bincount((rank[self.block[mine]] - done)[of] * BLOCK + self.place[post], some[of] * self.weight[post], more * BLOCK)
            near = np.flatnonzero(sums >= least)
            i = blocks[done + near // BLOCK] * BLOCK + near % BLOCK
            i, s = np.concatenate([best_i, i[i != skip]]), np.concatenate([best_s, sums[near][i != skip]])
            order = np.lexsort((i, -np.round(s, 9)))[: self.k]
            best_i, best_s = i[order], s[order]
            done, step = done + more, step * 4
        return best_i, best_s

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic among the neighbours, each weighing 1 / (0.05 + distance)."""
        if not len(near):
            return 0.0
        w = 1 / (1.05 - np.minimum(cosine, 1.0))
        return float((w * self.toxic[near]).sum() / w.sum())

    def score(self, counts: Counter, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        near, cosine = self.nearest(*self.vector(counts), skip)
        return float(np.interp(self.vote(near, cosine), self.places, self.rates)) if len(self.places) else self.base, near, cosine


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and which range each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (lo - np.cumsum(size) + size)[of], of


def association(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G statistic of each term's occurrence in a of n1 and b of n0 examples against the class."""
    total, out = n1 + n0, np.zeros(len(a))
    for have, n, seen in ((a, n1, a + b), (n1 - a, n1, total - a - b), (b, n0, a + b), (n0 - b, n0, total - a - b)):
        ok = have > 0
        out[ok] += 2 * have[ok] * np.log(have[ok] * total / (n * seen[ok]))
    return np.maximum(out, 0)


def _index(texts: list[Counter], toxic: np.ndarray, ids: np.ndarray, share: float, k: int, half: float = 25.0) -> Examples:
    """Index of all terms of all examples, and the calibration of votes.

    A term weighs its inverse document frequency times the square of g / (g + half), where g is the G statistic
    of its occurrence against the class (and of a thousandth, which is a millionth, at least, so that no term is without
    weight): terms that tell the classes apart lead the cosine, and texts that have none of them
    are still near those that they share words with. So the cosine is not that of plain TF-IDF. Equal cosines go to the
    example that comes first in the index; texts of any length are scored whole. share is the share of toxic rows among all
    labelled rows. Examples lie in the order of their heaviest terms, so that blocks differ.
    """
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    words = sorted(set().union(*texts)) if texts else []
    vocabulary = {w: t for t, w in enumerate(words)}
    seen = np.zeros((2, len(words)))
    for c, y in zip(texts, toxic):
        seen[y, [vocabulary[w] for w in c]] += 1
    g = association(seen[1], seen[0], n1, n0) if n1 and n0 else np.full(len(words), half)
    weigh = np.log((1 + n1 + n0) / np.maximum(1, seen.sum(0))) * np.maximum(g / (g + half), 1e-3) ** 2
    none = np.zeros(0)
    model = Examples(vocabulary, weigh, *[none] * 6, ids, toxic.astype(float), k, share, none, none)
    each = [model.vector(c) for c in texts]
    lead = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in each]
    order = np.lexsort((ids, lead)) if len(texts) else np.zeros(0, np.int64)
    model.ids, model.toxic = ids[order], model.toxic[order]
    each = [each[i] for i in order]
    term = np.concatenate([at for at, _ in each]) if each else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(each)), [len(at) for at, _ in each])
    weight = np.concatenate([w for _, w in each]) if each else none
    by = np.lexsort((of, term))
    term, of, model.weight = term[by], of[by], weight[by]
    model.place = of % BLOCK
    key = term * (len(each) // BLOCK + 1) + of // BLOCK
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    model.begin = np.concatenate((starts, [len(key)]))
    model.block = (of // BLOCK)[starts]
    model.top = np.maximum.reduceat(model.weight, starts) if len(starts) else none
    model.first = np.searchsorted(term[starts], np.arange(len(words) + 1))
    if n1 and n0:  # calibration: the vote of the others for each example, weighted to the true share
        raw = np.array([model.vote(*model.nearest(at, w, skip=i)) for i, (at, w) in enumerate(each)])
        model.places, model.rates = isotonic(raw, model.toxic, np.where(model.toxic == 1, share / n1, (1 - share) / n0))
    return model


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the rising curve of y over x that pooling neighbours out of order gives."""
    pools: list[list[float]] = []  # weighted sum, weight, first and last place
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i] * y[i], weight[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return np.array([p for q in pools for p in q[2:]]), np.array([q[0] / q[1] for q in pools for _ in range(2)])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1000, max_bytes: int = 16 << 20, k: int = 15) -> Examples:
    """Examples from a bounded sample of labelled rows: of each class per_class texts and max_bytes of text.

    documents: doc_id, text; labels: doc_id, toxic, both already without held-out rows. The sample
    takes whole texts, those with the smallest hashes of their ids, until either bound is reached;
    the share of toxic rows is counted over all labelled rows. Null labels and texts teach
    nothing; without both classes every score is the share of toxic rows (0 without labels).
    """
    known = labels.select("doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    span = 1 << 40
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("example")), F.lit(span))
    bars = {y: min(span, span * 2 * per_class // max(1, n) + 1) for y, n in sizes.items()}
    bar = F.when(F.col("toxic") == 1, F.lit(bars.get(1, 0))).otherwise(F.lit(bars.get(0, 0)))
    few = known.withColumn("h", h).filter(F.col("h") < bar)  # about 2 * per_class ids of each class, as a text may be missing
    few = F.broadcast(written(few, "label-sample"))
    first = Window.partitionBy("toxic").orderBy("h", "doc_id")
    rows = few.join(documents.select("doc_id", "text").filter("text is not null"), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    rows = rows.withColumn("n", F.row_number().over(first)).withColumn("bytes", F.sum(F.octet_length("text")).over(first))
    rows = rows.filter(f"n <= {per_class} and (n = 1 or bytes <= {max_bytes})").select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return _index([terms(r["text"]) for r in rows], np.array([int(r["toxic"]) for r in rows], int), np.array([r["doc_id"] for r in rows], np.int64), share, k)


def score(df: DataFrame, model: Examples, text: str = "text", threshold: float = 0.7, evidence: int = 3) -> DataFrame:
    """df with score, predicted and evidence (doc_id and cosine of the nearest examples).

    The whole text is scored. Texts without a term of any example, empty and null texts get
    the rate of a vote of 0. The index is bounded by fit()'s parameters, which
    is why it may be sent to all executors. Columns with these names are replaced.
    """
    df = df.drop("score", "predicted", "evidence")
    at = df.columns.index(text)
    send = df.sparkSession.sparkContext.broadcast(model)
    names = [*df.columns, "score", "predicted", "evidence"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches):
        m = send.value
        for b in batches:
            got = [m.score(terms(t)) for t in b.column(at).to_pylist()]
            why = [[{"doc_id": int(m.ids[i]), "cosine": float(c)} for i, c in zip(near[:evidence], cos[:evidence])] for _, near, cos in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= threshold) for g in got], pa.int32()), pa.array(why, kind)],
                names=names)

    return map_batches(df, run, f"{fields}, score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double>>")
