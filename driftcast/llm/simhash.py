"""SimHash near-duplicates: exact links within a Hamming radius by tiled comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcast.llm.common import components, map_batches, whole_groups, written

RADIUS = 2
SEED = 42
#: A pair within the radius agrees on one of RADIUS + 1 bands of the 64 bits: (shift, width).
BANDS = ((0, 22), (22, 21), (43, 21))


def simhash(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingle hashes have it.

    A-Z are lower-cased, words are runs outside ASCII white space, shingles are XXH64 of words
    joined by spaces, repeats included; fewer words than a shingle make one, none makes 0.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    stops = ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])), np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def wide_simhash(hashes: np.ndarray, words: int = 4) -> np.ndarray:
    """SimHash of 64 * words bits of 64-bit hashes, as words numbers: each has the bits of the hashes mixed anew."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        sums = np.zeros(64, np.int64)
        for at in range(0, len(x), 65536):
            part = (x ^ (x >> np.uint64(31)))[at:at + 65536]
            sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(sums * 2 > len(x), bitorder="little").view(np.uint64)[0]
    return out


def radius_of(similarity: float, bits: int, slack: float = 4.0) -> int:
    """Differing bits that two sets of a Jaccard similarity have at most, but for slack standard deviations.

    The sets' cosine is 2 s / (1 + s) at least, and a bit differs with the angle over pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(src, run, "doc_id long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, strip: int = 1 << 21):
    """Index pairs (i in left, j in right) whose fingerprints differ in at most radius bits."""
    step = max(1, strip // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        near = np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= radius
        i, j = np.nonzero(near)
        yield rows[i], right[j]


def group_links(fp: np.ndarray, key: np.ndarray, side: np.ndarray, radius: int):
    """Spanning links of every group of equal keys (sorted by key).

    side: 0 and 1 mark the two tiles of a tile pair, 2 one tile compared with itself. A group's
    population counts are sorted into tiles, pairs of which beyond the radius are skipped. What
    leaves a group is a star per component, never all its pairs.
    """
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cuts)
    pops = np.bitwise_count(fp).astype(np.int16)
    out_a, out_b = [], []
    small = (sizes <= 32)
    # Small groups of one tile: compare every row with its d-th follower, all groups at once.
    group = np.repeat(np.arange(len(sizes)), sizes)
    ok = small[group] & (side == 2)
    for d in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero(ok[:-d] & (group[d:] == group[:-d]))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        out_a.append(i)
        out_b.append(i + d)
    for g in np.flatnonzero(~small | (side[cuts[:-1]] != 2)):
        rows = np.arange(cuts[g], cuts[g + 1])
        root = rows - rows[0]
        pairs = []
        if side[rows[0]] == 2 and (side[rows] == 2).all():
            tiles = [(p, rows[pops[rows] == p]) for p in np.unique(pops[rows])]
            pairs = [(x, y) for k, (p, x) in enumerate(tiles) for q, y in tiles[k:] if q - p <= radius]
        else:
            pairs = [(rows[side[rows] == 0], rows[side[rows] == 1])]
        for x, y in pairs:
            for i, j in tile_links(fp, x, y, radius):
                differ = root[i - rows[0]] != root[j - rows[0]]
                if differ.any():
                    a, b = root[i[differ] - rows[0]], root[j[differ] - rows[0]]
                    root = _roots(len(rows), a, b)[root]
        far = np.flatnonzero(root != np.arange(len(rows)))
        out_a.append(rows[far])
        out_b.append(rows[root[far]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if len(a) > len(fp):
        root = _roots(len(fp), a, b)
        a = np.flatnonzero(root != np.arange(len(fp)))
        b = root[a]
    return a, b


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = 1024) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most radius bits.

    nodes: id, fp; fp distinct. Two fingerprints within the radius share a band of bits, so a
    band and its value make a bucket and only equal buckets meet. Buckets of more than tile rows
    are cut into tiles by population count (and by a hash, where one count has more than tile
    rows); each pair of tiles whose counts differ by no more than the radius is a task of its
    own, so no bucket has to fit one task. Inside, numpy exclusive-or and bit counts compare
    all pairs. Every link of the radius is kept or implied by a chain of links.
    """
    if radius > RADIUS:
        raise ValueError("more bands are needed beyond a radius of 2")
    band = F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.expr(f"shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L").alias("value"))
        for i, (s, w) in enumerate(BANDS)]))
    rows = nodes.select("id", "fp", F.expr("cast(bit_count(fp) as int)").alias("pop"), band.alias("b")).select("id", "fp", "pop", "b.*")
    per_tile = rows.groupBy("band", "value", "pop").count()
    hot = per_tile.groupBy("band", "value").agg(
        F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("count") / tile).cast("int")))).alias("chunks"))
    hot = hot.filter(F.col("n") > tile).drop("n")  # a map of at most 65 counts
    # A large bucket's one row is repeated for each salt, so that its nodes meet it in as many places.
    salts = 16
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(hot, ["band", "value", "salt"], "left")
    one = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("c"), F.lit(-1).alias("q"), F.lit(0).alias("d"), F.lit(2).alias("side")))
    many = F.expr(f"""
        flatten(transform(filter(map_keys(chunks), q -> abs(q - pop) <= {radius}), q ->
          transform(sequence(0, chunks[q] - 1), d -> case
            when q = pop and d = pmod(xxhash64(fp), chunks[pop]) then named_struct('p', pop, 'c', d, 'q', pop, 'd', d, 'side', 2)
            when (pop < q) or (pop = q and pmod(xxhash64(fp), chunks[pop]) < d)
              then named_struct('p', pop, 'c', cast(pmod(xxhash64(fp), chunks[pop]) as int), 'q', q, 'd', d, 'side', 0)
            else named_struct('p', q, 'c', d, 'q', pop, 'd', cast(pmod(xxhash64(fp), chunks[pop]) as int), 'side', 1) end)))""")
    dealt = marked.withColumn("t", F.explode(F.when(F.col("chunks").isNull(), one).otherwise(many)))
    key = F.xxhash64("band", "value", "t.p", "t.c", "t.q", "t.d").alias("key")  # a clash only adds comparisons
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(key, "id", "fp", F.col("t.side").alias("side")).repartition(n, "key").sortWithinPartitions("key")

    def run(batches):
        for t in whole_groups(batches, "key"):
            yield from emit(t)

    def emit(t):
        ids, fp = t["id"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        key, side = t["key"].to_numpy(), t["side"].to_numpy()
        order = np.lexsort((side, key))
        ids, fp, key, side = ids[order], fp[order], key[order], side[order]
        a, b = group_links(fp, key, side, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with equal
    fingerprints are one node, so thousands of copies make no links among themselves. A row
    whose doc_id is null belongs to its fingerprint's component but represents none (null if no
    other row has the fingerprint). Repeated rows are kept.
    """
    fps = written(fingerprints(df, doc_id, text), "fingerprints")
    nodes = written(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = components(links(nodes))
    labelled = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(labelled, "fp", "left").select("doc_id", "fp", "component_id")
