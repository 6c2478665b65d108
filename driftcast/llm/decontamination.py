"""Benchmark decontamination: longest matches of a generalised suffix automaton, word by word."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcast.llm.common import map_batches, shared_dir

WINDOW = 10
#: Words are runs of [0-9a-z] and of everything beyond ASCII, after A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the words of test items.

    A state stands for the word sequences with the same set of ends; following suffix links
    shortens a match. After build, hits(state) has the items of which the match of WINDOW words
    that ends in the state is a window, and short[state] the whole items of fewer words that
    end there.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.short: dict[int, list[tuple[int, int]]] = {}
        ends: list[tuple[int, int]] = []
        self.ids = [i for i, _ in items]
        own_short = []
        for k, (_, seq) in enumerate(items):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                if len(seq) >= window:
                    ends.append((last, k))
            if 0 < len(seq) < window:
                own_short.append((k, seq))
        self.items: dict[int, set[int]] = {}
        for state, k in ends:  # items of each class of substrings of window words or more
            while state > 0 and self.len[state] >= window:
                got = self.items.setdefault(state, set())
                if k in got:
                    break
                got.add(k)
                state = self.link[state]
        mine: dict[int, list[tuple[int, int]]] = {}
        for k, seq in own_short:
            s = 0
            for w in seq:
                s = self.next[s][w]
            mine.setdefault(s, []).append((len(seq), k))
        if mine:
            for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                got = self.short.get(self.link[s], []) + mine.get(s, [])
                if got:
                    self.short[s] = got

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._clone(last, q, w)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words inside occurrences, in order of their ends, and the items."""
        nxt, link, length, short, window = self.next, self.link, self.len, self.short, self.window
        root = nxt[0]
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        s = n = 0
        for i, w in enumerate(seq):
            if s:
                t = nxt[s].get(w)
                while t is None and s:
                    s = link[s]
                    n = length[s]
                    t = nxt[s].get(w)
            else:
                t = root.get(w)
            if t is None:
                continue
            s = t
            n += 1
            if n >= window:
                q = s
                while length[link[q]] >= window:
                    q = link[q]
                items |= self.items[q]
                spans.append((i + 1 - window, i + 1))
            if short and s in short:
                for m, k in short[s]:
                    if m <= n:
                        items.add(k)
                        spans.append((i + 1 - m, i + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Automata:
    """The automata of a benchmark, one file in the shared folder for each block of its items."""

    folder: str
    blocks: tuple[int, ...]
    #: Text that is scanned at once: every block is read for every batch.
    batch_bytes: int = 16 << 20

    def each(self) -> Iterator[SuffixAutomaton]:
        """One automaton after another; a process keeps the last one that it read."""
        for k in self.blocks:
            name = f"{self.folder}/{k}.pickle"
            if _HELD.get("name") != name:
                _HELD.clear()
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(path) as src:
                    _HELD.update(tool=pickle.loads(src.read()), name=name)
            yield _HELD["tool"]

    def hits(self, texts: list[str | None]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Disjoint spans of hit words and the items that occur, for each text, over all blocks."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for tool in self.each():
            for i, t in enumerate(texts):
                found, ids = tool.scan(words(t))
                if found:
                    spans[i] = merged(spans[i] + found)
                    items[i].update(tool.ids[k] for k in ids if tool.ids[k] is not None)
        return spans, items


#: The automaton that this process holds, and the name of its file.
_HELD: dict = {}


def automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
             block_bytes: int = 2 << 20, window: int = WINDOW, batch_bytes: int = 16 << 20) -> Automata:
    """Builds an automaton for each block of about block_bytes of item text, each in a task of its own.

    Items are dealt to blocks by a hash; a task builds the automaton of a block and writes it
    under its attempt's name, then under its final one. So neither the driver nor a worker holds
    more than one block, and documents are read once, whatever the size of the benchmark. Null
    texts are empty. Items with null ids hit like any other, but no list of items has them.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = shared_dir(benchmark.sparkSession, "automata")

    def save(t: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        block = t["block"][0].as_py()
        rows = sorted(zip(t["item_id"].to_pylist(), t["text"].to_pylist()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        data = pickle.dumps(SuffixAutomaton([(i, words(x)) for i, x in rows], window), protocol=5)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        mine, name = f"{base}/.{block}-{TaskContext.get().taskAttemptId()}", f"{base}/{block}.pickle"
        with fs.open_output_stream(mine) as out:
            out.write(data)
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            fs.delete_file(name)
        fs.move(mine, name)
        return pa.table({"block": [block]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(total // block_bytes + 1)))
    done = dealt.groupBy("block").applyInArrow(save, "block long").collect()  # a number for each block
    return Automata(folder, tuple(sorted(r["block"] for r in done)), batch_bytes)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    The words of the whole text, of any length, stream through each automaton, which tracks the
    longest match; a word in any window of an item (an item of fewer words is one window) is hit.
    Documents are read once. Null and empty texts have no words; an empty benchmark hits nothing;
    rows that repeat an item id count as one in n_items, items without an id as none. The digest is that of the sorted item
    ids, comma-joined.
    """
    tools = automata(benchmark, **settings)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            spans, items = tools.hits(texts)
            n_hit = [sum(y - x for x, y in s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(words(t)) for t in texts], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", tools.batch_bytes)


def without(text: str, hit: list[tuple[int, int]]) -> str:
    """The text without the words of disjoint spans, and what stands between the words of one."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    out, done = [], 0
    for a, b in hit:
        out.append(data[done:at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, data[done:]]).decode()


def clean(texts: list[str | None], tools: Automata, max_span: int = 0, max_share: float = 0.5) -> tuple[list[str | None], list[bool]]:
    """The texts without spans of more than max_span hit words, and which stay: those with at most max_share of their words in such spans.

    Spans of all blocks are judged together. Cutting goes on until nothing is hit, as the two ends of a cut may meet.
    """
    new, stay, left, first = list(texts), [True] * len(texts), list(range(len(texts))), True
    while left:
        spans, _ = tools.hits([new[i] for i in left])
        again = []
        for i, found in zip(left, spans):
            hit = [(a, b) for a, b in found if b - a > max_span]
            if hit and first and sum(b - a for a, b in hit) > max_share * len(words(new[i])):
                stay[i] = False
            elif hit:
                new[i] = without(new[i], hit)
                again.append(i)
        left, first = again, False
    return new, stay


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str | None = "n_chars",
                  max_span: int = 0, max_share: float = 0.5, **settings) -> DataFrame:
    """docs without the benchmark: spans of more than max_span hit words are cut out of the text.

    Rows of which over max_share of the words are hit go. All columns stay; length, if docs has
    it, is set anew for rows that were cut. Null and empty texts and clean texts stay as they are.
    """
    tools = automata(benchmark, **settings)
    at = docs.columns.index(text)
    n_at = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new, stay = clean(old, tools, max_span, max_share)
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if n_at is not None:
                sizes = cols[n_at].to_pylist()
                cols[n_at] = pa.array([n if before == after else len(after or "") for before, after, n in zip(old, new, sizes)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(stay, pa.bool_()))

    return map_batches(docs, run, docs.schema, tools.batch_bytes)
