"""Token ids in Arrow files of fixed-size lists: equal-length sequences with masks."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.llm.common import map_batches, partitions, shared_dir, written

END_ID = 2
SEQUENCE = 2048
#: Sequences of a record batch, which is the unit that a reader maps at once.
BATCH = 64


#: Words of lower-case Latin letters, and how a byte-level vocabulary writes their bytes: those
#: below 0xA1 and 0xAD that are not printable ASCII follow in order from U+0100 on.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_OTHER = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_BYTE = {b: chr(b) for b in range(256)} | {b: chr(0x100 + k) for k, b in enumerate(_OTHER)}
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}


#: Texts on which ids by words are tried before a tokenizer is used so.
_PROBES = ["", " ", "The cat SAT on the mat", "a.b, c;d:e! f?g", "don't x's", "  two  blanks ", "line\nend\n\n", "\ttab\x0b", "É ü ÑAndÚ ß", "漢字 kana", "1 22 333 a1b2", "x_y-z (q) [r]", "naïve café.",
           "<|x|> a", "\u200b \u00a0 \u3000", "İstanbul ǅ ﬁ", "end.", "...", "a\0b", "🙂 ok"]


def by_words(tokenizer) -> bool:
    """Whether no token of the vocabulary can cross what texts are split at: a space within, or a letter and the mark after it."""
    space, crossing = _BYTE[0x20], re.compile("[a-z][.,;:!?]")
    return not any(space in t[1:] or " " in t.strip() or crossing.search(t) for t in tokenizer.get_vocab(with_added_tokens=False))


class WordEncoder:
    """Token ids of whole texts, through ids remembered for single words.

    The tokenizer lower-cases, and white space or the end of a run of letters is a boundary that
    no token crosses, so the ids of a text are those of its words one after another. Arrow
    splits a batch into words and numbers the distinct ones; only words not seen before are
    encoded. All are forgotten when they pass max_chars. Texts with the beginning of a special
    token, whose case matters, are encoded whole. What this presumes of a tokenizer is checked when it is
    loaded, by its vocabulary and by texts; all texts of one that is otherwise are encoded whole.
    """

    def __init__(self, tokenizer, max_chars: int = 3 << 20):
        self.tokenizer, self.max_chars, self.whole = tokenizer, max_chars, False
        self.forget()
        self.whole = not by_words(tokenizer) or any(self.encode(pa.array([t]))[0].tolist() != tokenizer.encode(t, add_special_tokens=False).ids for t in _PROBES)
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.chars = 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return self._flat(got)

    @staticmethod
    def _flat(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; plain lower-case Latin ones need no normalising and go to the model at once."""
        plain, tokenize = _PLAIN.fullmatch, self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(w.translate(_BYTES))] if plain(w) else None for w in words]
        rest = [k for k, g in enumerate(got) if g is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False)):
            got[k] = e.ids
        return self._flat(got)

    def _places(self, words: list[str]) -> np.ndarray:
        if self.chars > self.max_chars:
            self.forget()
        index = self.index
        place = np.fromiter(map(index.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [words[k] for k in missing]
            place[missing] = np.arange(len(index), len(index) + len(new))
            index.update(zip(new, place[missing].tolist()))
            ids, sizes = self._word_ids(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, ids])
            self.chars += sum(map(len, new))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each (null: empty)."""
        texts = pc.fill_null(texts, "")
        if self.whole:
            return self._ids(texts.to_pylist())
        marked = pc.match_substring(texts, "<|")
        special = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        plain = pc.ascii_lower(texts.filter(pc.invert(marked)))
        plain = pc.replace_substring_regex(plain, "([a-z])([.,;:!?])", r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        place = self._places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[place] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.zeros(len(texts), np.int64)
        counts[~marked.to_numpy(zero_copy_only=False)] = pc.list_value_length(split).to_numpy()
        bounds = np.concatenate(([0], ends))[np.cumsum(np.concatenate(([0], counts)))]
        per_text = np.diff(bounds)
        if len(special):
            whole, n = self._ids(texts.take(pa.array(special)).to_pylist())
            ids = np.insert(ids, np.repeat(bounds[special], n), whole)
            per_text[special] = n
        return ids, per_text


#: Encoders by tokenizer file, which tasks of one worker process share one after another.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    """The encoder of this process for a tokenizer file."""
    from tokenizers import Tokenizer

    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordEncoder(Tokenizer.from_file(tokenizer_path))
    return _ENCODERS[tokenizer_path]


def slices(texts: pa.Array, limit: int = 1 << 20):
    """Slices of texts with about limit bytes each; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit)))
        yield texts.slice(start, end - start)
        start = end


def schema(sequence: int, kind: pa.DataType) -> pa.Schema:
    """Equal-length ids of a kind of unsigned integer, and masks (true: an id, false: filling)."""
    return pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Writes a stream of ids as record batches of fixed-size lists."""

    def __init__(self, sink, sequence: int = SEQUENCE, batch: int = BATCH, kind: pa.DataType = pa.uint32()):
        self.schema, self.sequence, self.step = schema(sequence, kind), sequence, sequence * batch
        self.kind = np.dtype(kind.to_pandas_dtype())
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray):
        self.held.append(ids.astype(self.kind, casting="same_kind"))
        self.size += len(ids)
        if self.size >= self.step:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.step * self.step
            for at in range(0, whole, self.step):
                self._batch(flat[at:at + self.step], self.step)
            self.held, self.size = [flat[whole:].copy()], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int):
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)],
            schema=self.schema))

    def close(self):
        flat = np.concatenate([*self.held, np.zeros(0, self.kind)])
        if len(flat):
            full = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.kind)
            full[:len(flat)] = flat
            self._batch(full, len(flat))
        self.file.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text",
          end_id: int = END_ID, sequence: int = SEQUENCE, parts: int | None = None) -> DataFrame:
    """Writes the ids of docs to files in folder, in ascending doc_id order over all files.

    Documents are dealt by ranges of doc_id; each task encodes its range and writes one Arrow
    file, first under a name of its own attempt, then under its final one, so a task that runs
    again leaves the same file. Ids take
    16 bits where the vocabulary fits them. Null text is empty; every document ends with end_id. Returns the
    index: file, part, place (order in the file), doc_id, n_tokens, offset (ids before it in
    its file) with one row per document. Null ids come first, repeated ids keep their rows,
    ordered by a hash of
    their text.
    """
    n = parts or partitions(docs, text)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    src = src.select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}.arrow"
        mine = f"{base}/.part-{part:06d}-{task.taskAttemptId()}"
        words = encoder(tokenizer_path)
        kind = pa.uint16() if max(end_id + 1, words.tokenizer.get_vocab_size()) <= 1 << 16 else pa.uint32()
        with fs.open_output_stream(mine) as sink:
            out = SequenceWriter(sink, sequence, kind=kind)
            place = offset = 0
            for b in batches:
                sizes = []
                for texts in slices(b.column(1)):
                    ids, per_text = words.encode(texts)
                    ends = np.cumsum(per_text)
                    out.add(np.insert(ids, ends, end_id))
                    sizes.append(per_text + 1)
                size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                k = len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rsplit("/", 1)[1]] * k, pa.string()), pa.array(np.full(k, part)), pa.array(np.arange(place, place + k)),
                     b.column(0), pa.array(size), pa.array(offset + np.cumsum(size) - size)],
                    names=["file", "part", "place", "doc_id", "n_tokens", "offset"])
                place, offset = place + k, offset + int(size.sum())
            out.close()
        if place:
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)
            fs.move(mine, name)
        else:
            fs.delete_file(mine)

    index = map_batches(src, run, "file string, part long, place long, doc_id long, n_tokens long, offset long")
    return written(index, "token-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Per document of index: doc_id, start, n_tokens, ids_crc32, ids read back from the files.

    A file is mapped, not copied, where the store allows; documents are slices of its
    flattened lists. start counts the ids of all documents before it: files are few, so their
    sizes are summed over one row per file.
    """
    spark: SparkSession = index.sparkSession
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count())
    rows = index.join(F.broadcast(starts), "part")  # one row per file, at most as many as the writer had tasks
    rows = rows.select("part", "file", "place", "doc_id", "n_tokens", "offset", "base").repartition(n, "part").sortWithinPartitions("part", "place")

    def run(batches):
        fs, base_dir = pafs.FileSystem.from_uri(folder)
        opened, reader = None, None
        for b in batches:
            d = b.to_pydict()
            crc = []
            for file, offset, size in zip(d["file"], d["offset"], d["n_tokens"]):
                if file != opened:
                    opened, reader = file, SequenceReader(fs, f"{base_dir}/{file}")
                crc.append(reader.crc32(offset, size))
            start = np.array(d["base"], np.int64) + np.array(d["offset"], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(start), b.column(4), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class SequenceReader:
    """Random access to the ids of one file; a record batch at a time is mapped or read."""

    def __init__(self, fs, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.sequence = self.file.schema.field("ids").type.list_size
        self.step = self.sequence * BATCH
        self.at, self.ids, self.mask = -1, None, None

    def batch(self, k: int):
        if k != self.at:
            b = self.file.get_batch(k)
            self.at, self.ids, self.mask = k, b.column(0).flatten().to_numpy(), b.column(1).flatten()
        return self.ids, self.mask

    def slices(self, offset: int, size: int):
        """The ids from offset on, in pieces that lie in one batch each, without copies."""
        while size > 0:
            ids, mask = self.batch(offset // self.step)
            lo = offset % self.step
            hi = min(lo + size, len(ids))
            if lo >= hi or not mask[hi - 1].as_py():
                raise ValueError("the file ends before the ids do")
            yield ids[lo:hi]
            size -= hi - lo
            offset += hi - lo

    def crc32(self, offset: int, size: int) -> int:
        got = 0
        for piece in self.slices(offset, size):
            got = zlib.crc32(piece.astype("<u4").view(np.uint8), got)
        return got


def round_trip(docs: DataFrame, tokenizer_path: str, **settings) -> DataFrame:
    """write() to a fresh shared folder, then read()."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer_path, folder, **settings), folder)
