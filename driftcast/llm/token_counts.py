"""Token counts: pieces counted once per distinct pre-token, joined to the frequencies of documents, without ids."""

from __future__ import annotations

import pickle
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcast.llm.common import map_batches, partitions, written

LIMIT = 4096


def pre_tokens(text: str) -> list[str]:
    """Pieces of the text that no token of the vocabulary crosses, in a form that encodes alone.

    Tokens hold the mark of a space only at their start, and no token holds a line end. So a
    pre-token is a run of spaces with the word after it, or a line end with the word after it;
    the text starts as if after one space. In the list a word stands for itself after one
    space, more spaces are written before it but for one, and " " * k alone is a run of k + 1
    spaces ("" is one space).
    """
    parts = text.replace("▁", " ").replace("\n", " \n").split(" ")
    if "" not in parts:
        return parts
    out, gap = [], 0
    for w in parts:
        if not w:
            gap += 1
        elif w[0] == "\n" and gap:
            out += [" " * (gap - 1), w]
            gap = 0
        else:
            out.append(" " * gap + w)
            gap = 0
    if gap:
        out.append(" " * (gap - 1))
    return out


#: Strings on which counts by pre-tokens are tried before a model is used so.
_PROBES = ["", " ", "a", "  a", "a  ", "a b", "a\nb", "\n", " \n ", "\n\n a", "▁a", "a▁▁b", "É ü ß", "1 22  333\n\t x", "<s> a </s>", "漢字 a", "\0 a"]


class PieceCounts(dict):
    """Number of pieces by pre-token, each given to the tokenizer once.

    Splitting presumes that no piece of the vocabulary has the mark of a space but at its start,
    or a line end, and that a text begins as if after a space. Both are checked when a model is
    loaded; for one that is otherwise a whole text is one pre-token.
    """

    def __init__(self, processor):
        super().__init__()
        self.processor, self.whole = processor, False
        pieces = map(processor.id_to_piece, range(processor.get_piece_size()))
        self.whole = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or any(self.count(t) != len(processor.encode(t)) for t in _PROBES)
        self.clear()

    @classmethod
    def load(cls, model_file: str) -> PieceCounts:
        import sentencepiece

        return cls(sentencepiece.SentencePieceProcessor(model_file=model_file))

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return [text] if self.whole else pre_tokens(text)

    def learn(self, tokens: list[str]) -> None:
        new = list({t for t in tokens if t not in self})
        for t, ids in zip(new, self.processor.encode(new, num_threads=1)):
            # "" is one space; after a line end the mark of a space that the tokenizer puts first is not part of it.
            self[t] = 1 if not t else len(ids) - (not self.whole and t[0] == "\n")

    def count(self, text: str) -> int:
        tokens = self.split(text)
        self.learn(tokens)
        return sum(map(self.__getitem__, tokens))


def _packed(*parts) -> bytes:
    return zstandard.compress(pickle.dumps(parts, protocol=5), 1)


def _unpacked(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _planes(places: np.ndarray) -> np.ndarray:
    """Differences of places as four planes of bytes, which compress far better than the numbers."""
    return np.diff(places, prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T.copy()


def _places(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view(np.int32).ravel(), dtype=np.int64)


def frequencies(src: DataFrame, model_file: str, buckets: int) -> DataFrame:
    """unit, bucket, data: the pre-tokens of documents (doc_id, text), in units of some megabytes of text.

    A unit has a row for each bucket (a hash of the pre-token) with its distinct pre-tokens, and
    one of bucket -1 with the documents: ids, bytes, and for each the places of its distinct
    pre-tokens in the unit and their frequencies.
    """

    def run(batches):
        from pyspark import TaskContext

        tool, base = PieceCounts.load(model_file), TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            lists = [tool.split(t) for t in texts]
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
            coded = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            n = max(1, len(distinct))
            bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in distinct), np.int64, len(distinct))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(distinct), np.int64)
            place[order] = np.arange(len(distinct))
            pair, freq = np.unique(doc * n + place[coded.indices.to_numpy()], return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(texts) + 1) * n)
            sizes = np.array([len(t.encode()) for t in texts], np.int64)
            rows = [(-1, _packed(b.column(0).to_pylist(), sizes, bounds, _planes(pair % n), freq.astype(np.int32)))]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            rows += [(int(bucket[order[lo]]), _packed([distinct[i] for i in order[lo:hi]])) for lo, hi in pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["unit", "bucket", "data"])

    return map_batches(src, run, "unit long, bucket long, data binary", 8 << 20)


def piece_counts(tokens: DataFrame, model_file: str, parts: int) -> DataFrame:
    """unit, bucket, data: the pieces of each pre-token of the rows of tokens, in their order.

    All rows of a bucket meet in one task, which counts each of the bucket's distinct pre-tokens once.
    A pre-token of any frequency comes once a unit, so no bucket is hot.
    """

    def run(batches):
        counts, held = PieceCounts.load(model_file), None
        for b in batches:
            out = []
            for bucket, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if bucket != held:
                    counts.clear()
                    held = bucket
                (found,) = _unpacked(data)
                counts.learn(found)
                out.append(_packed(np.fromiter(map(counts.__getitem__, found), np.uint32, len(found))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["unit", "bucket", "data"])

    return map_batches(tokens.repartition(parts, "bucket").sortWithinPartitions("bucket"), run, "unit long, bucket long, data binary")


def count_tokens(df: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    Pieces are counted once for each distinct pre-token of the table, where its bucket is, and
    joined to the frequencies of the documents by unit; the sum of frequency times pieces is a
    document's number of tokens, so no ids are made. What is shuffled are the distinct
    pre-tokens of each unit and the packed frequencies, both smaller than the text. model_file
    must be readable on the executors. Null and empty texts have 0 bytes and tokens; a text of
    any length is whole in one unit; repeated rows are counted each.
    """
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions(src, "text", 256 << 20)
    buckets = max(2 * n, partitions(src, "text", bucket_bytes))
    units = written(frequencies(src, model_file, buckets), "pre-tokens")
    counted = piece_counts(units.filter("bucket >= 0"), model_file, n)

    def summed(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["bucket"].to_pylist(), t["data"].to_pylist()))
        ids, sizes, bounds, planes, freq = _unpacked(rows[0][1])
        pieces = np.concatenate([np.zeros(0, np.int64), *(_unpacked(data)[0] for _, data in rows[1:])]).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(pieces[_places(planes)] * freq)))[bounds]
        n_tokens = np.diff(sums)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes), "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)})

    both = units.filter("bucket < 0").unionByName(counted)
    return both.groupBy("unit").applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
