"""Line deduplication: sharded minimal perfect hashes over the hashes of all distinct lines."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcast.llm.common import map_batches, shared_dir, written

MIN_CHARS = 10
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LAST = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class LineIndex:
    """A minimal perfect hash with arrays of 32-bit fingerprints, owners and counts (up to 255) in its order.

    A level is a bit per place, about two places a key. Keys alone at their place stay, the
    others go on to the next level. A key's slot is the number of bits before its own.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, count: np.ndarray) -> LineIndex:
        left = np.arange(len(h1))
        sizes, levels, place, bits = [], [], np.zeros(len(h1), np.int64), 0
        with np.errstate(over="ignore"):
            while len(left) and len(sizes) < 48:
                m = max(64, -(-2 * len(left) // 64) * 64)
                at = cls._at(h1[left], h2[left], len(sizes), m)
                alone = np.bincount(at, minlength=m) == 1
                levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
                mine = alone[at]
                place[left[mine]] = bits + at[mine]
                sizes.append(m)
                bits += m
                left = left[~mine]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        # Keys that no level parts (equal in all 48) follow in a short list of their own.
        placed = np.setdiff1d(np.arange(len(h1)), left)
        order = np.concatenate([placed[np.argsort(place[placed])], left])
        return cls(dict(sizes=np.array(sizes, np.int64), words=words, ranks=ranks.astype(np.uint32),
                        left1=h1[left], left2=h2[left], print=(h2[order] >> np.uint64(32)).astype(np.uint32), owner=owner[order],
                        count=np.minimum(count[order], 255).astype(np.uint8)))

    @staticmethod
    def _at(h1: np.ndarray, h2: np.ndarray, level: int, m: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        return (_mix(_mix(h1 ^ salt) + h2) % np.uint64(m)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and count of each key; the count is 0 where the fingerprint says that it is not in the index."""
        slot = np.full(len(h1), -1, np.int64)
        left, base = np.arange(len(h1)), 0
        with np.errstate(over="ignore"):
            for k, m in enumerate(self.sizes):
                at = base + self._at(h1[left], h2[left], k, int(m))
                word, bit = at >> 6, (at & 63).astype(np.uint64)
                hit = (self.words[word] >> bit) & np.uint64(1) == 1
                low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
                slot[left[hit]] = (self.ranks[word].astype(np.int64) + np.bitwise_count(low))[hit]
                left, base = left[~hit], base + int(m)
        first = len(self.print) - len(self.left1)
        for j in range(len(self.left1)):
            slot[left[(h1[left] == self.left1[j]) & (h2[left] == self.left2[j])]] = first + j
        known = slot >= 0
        known[known] = self.print[slot[known]] == (h2[known] >> np.uint64(32)).astype(np.uint32)
        owner, count = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.uint8)
        owner[known], count[known] = self.owner[slot[known]], self.count[slot[known]]
        return owner, count

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineIndex:
        with np.load(io.BytesIO(data)) as z:
            return cls({k: z[k] for k in z.files})


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """d, t, line, h1, h2: two hashes of the key of every line whose key has min_chars code points or more.

    The second starts from another seed, so keys that the first confuses are not confused by it too. d is the doc_id (null: the last), t a hash of the text, as rows may share an id, and line counts from 0.
    """
    key = F.translate(F.btrim(F.col("line_text"), F.lit(SPACE)), _UPPER, _LOWER)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text).alias("t"),
                       F.posexplode(F.split(F.col(text), "\n")).alias("line", "line_text"))
    rows = rows.select("d", "t", "line", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select("d", "t", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def build_index(lines: DataFrame, folder: str, shards: int) -> None:
    """Writes the index of all distinct lines, a file for each shard.

    Lines of one key meet in a min and a count, which combine before the shuffle, so a line that a
    third of all documents have is no hot key. A shard is built by one task, which writes one
    file: first under its attempt's name, so a task that runs again leaves the same file.
    """

    def save(t: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        shard = t["shard"][0].as_py()
        h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        data = LineIndex.build(h1, h2, t["owner"].to_numpy(), t["n"].to_numpy()).dump()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        mine, name = f"{base}/.{shard}-{TaskContext.get().taskAttemptId()}", f"{base}/{shard}.npz"
        with fs.open_output_stream(mine) as out:
            out.write(data)
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            fs.delete_file(name)
        fs.move(mine, name)
        return pa.table({"shard": [shard], "keys": [len(h1)]})

    found = lines.groupBy("h1", "h2").agg(F.min("d").alias("owner"), F.count("*").alias("n"))
    found = found.withColumn("shard", F.pmod("h1", F.lit(shards)))
    found.groupBy("shard").applyInArrow(save, "shard long, keys long").agg(F.sum("keys")).collect()


def probe(lines: DataFrame, folder: str, shards: int, parts: int) -> DataFrame:
    """d, t, line of every line that goes: its key has more than one line, and a smaller document has it.

    Hashes are dealt by ranges of shard and of a hash of their place, so every task gets as many,
    however often one line occurs, and reads the few shards of its range one after another.
    """

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        held, index = None, None
        for b in batches:
            d, shard = b.column(0).to_numpy(), b.column(5).to_numpy()
            h1, h2 = (b.column(k).to_numpy().view(np.uint64) for k in (3, 4))
            gone = np.zeros(len(d), bool)
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(d) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held != shard[lo]:
                    with fs.open_input_stream(f"{base}/{shard[lo]}.npz") as src:
                        held, index = shard[lo], LineIndex.load(src.read())
                owner, count = index.find(h1[lo:hi], h2[lo:hi])
                gone[lo:hi] = (count > 1) & (owner != d[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(3)], names=["d", "t", "line"]).filter(pa.array(gone))

    dealt = lines.select("d", "t", "line", "h1", "h2", F.pmod("h1", F.lit(shards)).alias("shard"))
    dealt = dealt.repartitionByRange(parts, "shard", F.xxhash64("d", "t", "line")).sortWithinPartitions("shard")
    return map_batches(dealt, run, "d long, t long, line int")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, shard_keys: int = 1 << 19) -> DataFrame:
    """docs with new columns kept_text, n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of
    min_chars code points or more that two documents or more have lose all their lines but in
    the smallest doc_id. The hashes of lines, with their places, probe the index of all distinct
    lines where its shards are (a shard has about shard_keys lines at most); only the places of
    lines that go travel back, to meet their documents by id. A null or empty text is one empty
    line; lines of any number and length count whole. Rows that share a doc_id are one document;
    a null doc_id comes after all others. Columns of these names are replaced, others stay.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    spark = docs.sparkSession
    lines = written(line_hashes(docs, doc_id, text, min_chars), "lines")
    n = lines.count()
    shards, folder = n // shard_keys + 1, shared_dir(spark, "line-index")
    build_index(lines, folder, shards)
    gone = probe(lines, folder, shards, max(n >> 20, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    gone = gone.groupBy("d", "t").agg(F.collect_set("line").alias("gone"))  # at most the lines of one document
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("_d"), F.xxhash64(text).alias("_t"), F.struct(*docs.columns).alias("_row"))
    rows = own.join(gone.hint("merge"), (F.col("_d") == F.col("d")) & (F.col("_t") == F.col("t")), "left").select("_row.*", F.col("gone").alias("_gone"))
    at = docs.columns.index(text)
    names = [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in batches:
            texts = pc.fill_null(b.column(at), "")
            n_lines = pc.add(pc.cast(pc.count_substring(texts, "\n"), pa.int64()), 1)
            drops = b.column(b.num_columns - 1)
            some = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
            kept = []
            for t, lines_gone in zip(texts.take(pa.array(some)).to_pylist(), drops.take(pa.array(some)).to_pylist()):
                each = t.split("\n")
                stay = np.ones(len(each), bool)
                stay[lines_gone] = False
                kept.append("\n".join([each[k] for k in np.flatnonzero(stay)]))
            mask = np.zeros(b.num_rows, bool)
            mask[some] = True
            new = pc.replace_with_mask(texts, pa.array(mask), pa.array(kept, texts.type))
            n_gone = pc.cast(pc.fill_null(pc.list_value_length(drops), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new, n_lines, n_gone], names=names)

    return map_batches(rows, run, f"{fields}, kept_text string, n_lines long, n_dropped long")
