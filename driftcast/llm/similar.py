"""Groups of texts of similar five-word shingle sets by SimHash: tiles of exclusive-or and bit counts, confirmed by exact Jaccard.

The general form of the SimHash operator, for a similarity instead of a few bits: as there, bands of the SimHash's bits make the buckets in
which texts meet, tiles of a bucket are compared by exclusive-or and bit counts within a radius, and nothing else brings two texts together.
At Jaccard 0.8 about a seventh of the bits differ, so bands are short and many."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcast.llm.common import components, map_batches, whole_groups, written
from driftcast.llm.simhash import radius_of, wide_simhash

WORDS, LEAST, SEED = 5, 0.8, 42
#: 64-bit words of a SimHash.
WIDE = 4
#: Share of pairs of the least similarity that no band may bring together, by calculation; nodes that share a bucket by chance, at most about.
LOST, CROWD = 1e-4, 1024
#: Standard deviations of differing bits beyond the mean that are still compared: the bits of sets of four or five shingles differ more than those of large ones.
SLACK = 6.0


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of words of the whole text; fewer words than a run make one, none makes none.

    Words are as in simhash: runs outside ASCII white space, A-Z lower-cased.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    flat = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())), np.uint64, len(starts)))


def band_width(nodes: int, least: int = 8) -> int:
    """Bits of a band, so that about CROWD of so many nodes agree on them by chance; short tables have least."""
    return max(least, math.ceil(math.log2(max(1, nodes) / CROWD)))


def band_count(width: int, similarity: float = LEAST, lost: float = LOST) -> int:
    """Bands of width bits, on one of which all but a share lost of the pairs of a similarity agree."""
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** width
    return math.ceil(math.log(lost) / math.log1p(-agree))


def band_keys(fp: np.ndarray, width: int, bands: int) -> np.ndarray:
    """The band's number and its bits as one key, for each row of fp (WIDE words) and each band.

    The first bands are neighbouring bits; when no bits are left, the bits are shuffled by a seed and cut into bands again.
    """
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8 * WIDE), axis=1, bitorder="little").astype(np.int64)
    draw, order, each = np.random.default_rng(SEED), np.arange(64 * WIDE), 64 * WIDE // width
    out = np.empty((len(fp), bands), np.int64)
    for k in range(bands):
        if k and k % each == 0:
            order = draw.permutation(64 * WIDE)
        some = order[k % each * width:(k % each + 1) * width]
        out[:, k] = (k << width) + bits[:, some] @ (1 << np.arange(width))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash (null for a null text), node (hash of the shingle set), size of the set and its SimHash fp of every row."""

    def run(batches):
        for b in batches:
            ids, hashes, nodes, sizes, fps = b.column(0), b.column(1), [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(wide_simhash(found, WIDE).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "size", "fp"])

    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("text_hash"), F.col(text).alias("text"))
    return map_batches(src, run, "doc_id long, text_hash long, node long, size long, fp array<long>")


def _sets(df: DataFrame, text: str) -> DataFrame:
    """node and shingles (the hashes as bytes) of every row's text."""

    def run(batches):
        for b in batches:
            found = [shingles(t) for t in b.column(0).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "shingles"])

    return map_batches(df.select(F.col(text).alias("text")), run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard of least or more."""

    def run(batches):
        for b in batches:
            got = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(*(b.column(k).to_pylist() for k in (2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(got, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")).hint("merge") for k in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return map_batches(both, run, "a long, b long")


def near_to(fp: np.ndarray, root: np.ndarray, size: np.ndarray, radius: int, least: float, strip: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strips of index pairs i < j of nodes (columns of fp) within the radius whose roots differ and whose sizes allow least."""
    n = fp.shape[1]
    step = max(1, strip // max(1, n))
    for at in range(0, n - 1, step):
        rows = slice(at, min(n - 1, at + step))
        # All words but the last for every pair (at most 192 bits), the rest for those that are still within the radius.
        gap = sum(np.bitwise_count(word[rows, None] ^ word[None, at:]) for word in fp[:3])
        i, j = np.nonzero(gap <= radius)
        more = j > i
        i, j = i[more], j[more]
        bits = gap[i, j].astype(np.int64)
        i, j = i + at, j + at
        for word in fp[3:]:
            bits += np.bitwise_count(word[i] ^ word[j])
        near = (bits <= radius) & (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
        yield i[near], j[near]


def similar_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: float, columns: int = 2048) -> np.ndarray:
    """Which pairs of sets have a Jaccard of least or more, exactly.

    Many pairs of few sets are counted at once: for one strip of distinct hashes after another a matrix of
    which set has which is multiplied with itself.
    """
    if len(i) < 2 * len(sets):
        return np.fromiter((jaccard(sets[x], sets[y]) >= least for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
    size = np.array([len(x) for x in sets])
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(place, kind="stable")
    place, owner = place[by], owner[by]
    both = np.zeros(len(i), np.int64)
    for lo in range(0, len(names), columns):
        a, b = np.searchsorted(place, [lo, lo + columns])
        has = np.zeros((len(sets), min(columns, len(names) - lo)), np.float32)
        has[owner[a:b], place[a:b] - lo] = 1
        has = has[:, has.sum(axis=0) > 1]  # a hash that one set has is in no intersection
        if has.shape[1]:
            both += (has @ has.T)[i, j].astype(np.int64)
    return both / np.maximum(1, size[i] + size[j] - both) >= least


def bands(nodes: DataFrame, width: int, count: int) -> DataFrame:
    """key, node, size, f0 to f3 of nodes (node, size, fp), for each of count bands of the SimHash's bits."""

    def run(batches):
        for b in batches:
            fp = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], axis=1).view(np.uint64)
            keys = band_keys(fp, width, count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, count), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *b.columns], names=["keys", *b.schema.names])

    words = [F.col("fp")[k].alias(f"f{k}") for k in range(WIDE)]
    rows = map_batches(nodes.filter("size > 0").select("node", F.col("size").cast("int").alias("size"), *words), run, f"keys array<long>, node long, size int, {', '.join(f'f{k} long' for k in range(WIDE))}")
    return rows.select(F.explode("keys").alias("key"), "node", "size", *[f"f{k}" for k in range(WIDE)])


def tiles(nodes: DataFrame, least: float = LEAST, tile: int = 2048) -> DataFrame:
    """group, node, size, f0 to f3 of nodes (node, size, fp), for each group that a node is dealt to: the nodes that share a band's bits.

    Buckets of more than tile nodes are cut into chunks by a hash, and each pair of chunks is a group of its own, so no bucket
    has to fit one task. The list of those buckets has a row for each tile nodes at least.
    """
    spark, salts = nodes.sparkSession, 16
    n = nodes.count()
    width = band_width(n)
    count = band_count(width, least)
    rows = bands(nodes, width, count)
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).withColumn("m", F.ceil(F.col("n") / tile).cast("int")), "large-buckets")
    more = large.agg(F.coalesce(F.sum(F.col("n") * (F.col("m") - 1)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n * count + more) // 500_000))
    large = large.select("key", "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(large, ["key", "salt"], "left")
    mine = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("m")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.xxhash64("key", F.least(mine, o), F.greatest(mine, o)))
    groups = F.explode(F.when(F.col("m").isNull(), F.array(F.xxhash64("key"))).otherwise(each))
    return rows.select(groups.alias("group"), "node", "size", *[f"f{k}" for k in range(WIDE)]).repartition(parts, "group").sortWithinPartitions("group")


def with_near(dealt: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of tiles (sorted by group) whose node is near another of its group that has another root: a candidate for a link.

    Without a column root every node is one of its own.
    """
    radius, rooted = radius_of(least, 64 * WIDE, SLACK), "root" in dealt.columns

    def run(batches):
        for t in whole_groups(batches, "group", 50_000):
            group, root, size = (t[c].to_numpy() for c in ("group", "root" if rooted else "node", "size"))
            fp = np.stack([t[f"f{k}"].to_numpy().view(np.uint64) for k in range(WIDE)])
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist()
            some = np.zeros(len(group), bool)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                for i, j in near_to(fp[:, lo:hi], root[lo:hi], size[lo:hi], radius, least):
                    some[lo + i] = some[lo + j] = True
            yield from t.filter(pa.array(some)).combine_chunks().to_batches()

    return map_batches(dealt, run, dealt.schema)


def tile_links(dealt: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) between nodes of different roots, from rows of tiles with the nodes' shingles (bytes).

    Every near pair of a group is tested exactly, in its task; a link that earlier ones of the group imply stays behind, so fewer links than nodes leave it.
    """
    radius = radius_of(least, 64 * WIDE, SLACK)

    def of_group(t: pa.Table) -> pa.RecordBatch | None:
        node, root, size = (t[c].to_numpy() for c in ("node", "root", "size"))
        fp = np.stack([t[f"f{k}"].to_numpy().view(np.uint64) for k in range(WIDE)])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
        root = np.unique(root, return_inverse=True)[1]
        out: list[np.ndarray] = []
        for i, j in near_to(fp, root.copy(), size, radius, least):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            good = similar_pairs(sets, i, j, least)
            for x, y in zip(i[good].tolist(), j[good].tolist()):
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    out.append((min(node[x], node[y]), max(node[x], node[y])))
        return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"]) if out else None

    def run(batches):
        for t in whole_groups(batches, "group", 256):
            group = t["group"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                found = of_group(t.slice(lo, hi - lo))
                if found is not None:
                    yield found

    return map_batches(dealt.repartition("group").sortWithinPartitions("group"), run, "a long, b long")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, text_hash and group of every row: linked are texts whose five-word Jaccard is least or more.

    Rows of one shingle set are one node, so copies make no pairs among themselves. Nodes that agree on a band of their
    SimHash's bits meet in a bucket, whose tiles are compared by exclusive-or and bit counts; nodes within the radius of
    another stay. A tile's are compared first with its smallest; where nodes of a tile are then in several groups, those near
    one of another group get their shingle sets, and every near pair is tested exactly in the tile. So every pair
    that shares a bucket and is within the radius is linked if it is similar; LOST bounds the pairs that share none. Texts
    without words are one group. Pairs make no rows, however many are near.
    """
    rows = written(signatures(df, doc_id, text), "signatures")
    radius = radius_of(least, 64 * WIDE, SLACK)
    nodes = written(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp")), "nodes")
    shared = written(with_near(tiles(nodes, least), least), "near-nodes")
    words = [f"f{k}" for k in range(WIDE)]
    low = shared.groupBy("group").agg(F.min_by(F.struct("node", "size", *words), "node").alias("low"))
    met = shared.join(low.hint("merge"), "group").filter(F.col("node") != F.col("low.node"))
    alike = F.least("size", "low.size") >= F.greatest("size", "low.size") * F.lit(least - 1e-9)
    gap = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"low.{f}"))) for f in words), F.lit(0))
    first = met.filter(alike & (gap <= radius)).select(F.greatest("node", "low.node").alias("b"), F.least("node", "low.node").alias("a"))
    first = written(first.distinct(), "near-pairs")
    ids = rows.groupBy("node").agg(F.min(F.struct(F.col("text_hash").alias("h"), F.col("doc_id").alias("d"))).alias("one"))
    own = df.select(F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_id"), F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("_hash"))

    def sets(pairs: DataFrame) -> DataFrame:
        """Shingle sets of the nodes of pairs, from the one row that stands for each."""
        some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = ids.join(some.hint("merge"), "node").select("one.h", "one.d")
        texts = own.join(texts.hint("merge"), F.col("_hash").eqNullSafe(F.col("h")) & F.col("_id").eqNullSafe(F.col("d")))
        return written(_sets(texts, "_text").dropDuplicates(["node"]), "shingles")

    links = written(confirmed(first, sets(first), least), "near-links")
    part = written(components(links), "near-parts")
    label = shared.join(part.hint("merge"), "node", "left").select("group", "node", "size", *words, F.coalesce("root", "node").alias("root"))
    mixed = label.groupBy("group").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("group")
    apart = label.join(mixed.hint("merge"), "group").repartition("group").sortWithinPartitions("group")
    found = written(with_near(apart, least), "near-found")
    if found.take(1):
        more = tile_links(found.join(sets(found.select(F.col("node").alias("a"), F.col("node").alias("b"))).hint("merge"), "node"), least)
        part = components(links.unionByName(written(more.distinct(), "more-links")))
    return rows.select("doc_id", "text_hash", "node").join(part.hint("merge"), "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("group"))
