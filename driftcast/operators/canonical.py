"""Canonical prefix codes of small alphabets, and chunks of coded blocks that can each be read alone."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.operators.runs import greedy_fill

#: Symbols of coefficients: no more levels, and sixteen zeros.
END, ZEROS = 0, 240
#: A weight of a 3500th of all keeps a code of up to 256 symbols within 16 bits (deeper trees need Fibonacci-like weights).
ALPHABET, LONGEST, LIGHTEST = 256, 16, 3500


@dataclass(frozen=True)
class CodeTable:
    """Code of each symbol as a string of bits."""

    codes: dict[int, str]

    @classmethod
    def fit(cls, counts: DataFrame) -> CodeTable:
        """The canonical code of (symbol, n): lengths by merging the two lightest, ties by the symbols that were merged."""
        rows = counts.select("symbol", "n").limit(ALPHABET + 1).collect()
        if len(rows) > ALPHABET:
            raise ValueError(f"an alphabet has {ALPHABET} symbols at most")
        return cls.of_counts({r["symbol"]: r["n"] for r in rows if r["n"] > 0})

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> CodeTable:
        least = -(-sum(counts.values()) // LIGHTEST)
        nodes = [(max(n, least), (s,)) for s, n in counts.items()]
        heapq.heapify(nodes)
        lengths = dict.fromkeys(counts, 0)
        while len(nodes) > 1:
            (m, a), (n, b) = heapq.heappop(nodes), heapq.heappop(nodes)
            for s in a + b:
                lengths[s] += 1
            heapq.heappush(nodes, (m + n, a + b))
        # Sorted by length and symbol, a code is the share of all codes before it, cut to its length.
        codes, used = {}, 0
        for length, s in sorted((max(1, n), s) for s, n in lengths.items()):
            codes[s] = format(used >> (LONGEST - length), f"0{length}b")
            used += 1 << (LONGEST - length)
        return cls(codes)

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        """kind, symbol, length, code (as a number): a row for each symbol, 256 at most."""
        rows = [(kind, s, len(c), int(c, 2)) for s, c in self.codes.items()]
        return spark.createDataFrame(rows, "kind string, symbol long, length long, code long")

    def of(self, symbol: Column) -> Column:
        """The code of a symbol; null if it has none."""
        return F.get(F.array(*[F.lit(self.codes.get(k)).cast("string") for k in range(ALPHABET)]), symbol.cast("int"))


def size_of(v: Column) -> Column:
    """Bits of a level's magnitude; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v)))).cast("long")


def extra_bits(v: Column) -> Column:
    """The magnitude bits of a level: itself if positive, else less one and turned over."""
    n = size_of(v).cast("int")
    moved = F.when(v >= 0, v).otherwise(v + F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)
    return F.when(v == 0, "").otherwise(F.lpad(F.bin(moved), n, F.lit("0")))


def with_symbols(blocks: DataFrame, levels: str) -> DataFrame:
    """blocks with tokens, the levels beyond the first in scan order: zeros (16 at a time), symbol (run * 16 + size), v; and ended."""
    at = F.filter(F.transform(F.slice(levels, 2, 1 << 16), lambda v, i: F.struct((i + 1).cast("long").alias("at"), v.cast("long").alias("v"))), lambda s: s["v"] != 0)
    rows = blocks.withColumn("_at", at)
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(F.col("_at.at"), F.lit(1), F.greatest(F.lit(0), F.size("_at") - 1)))

    def token(s: Column, b: Column) -> Column:
        run = s["at"] - b - 1
        return F.struct(F.floor(run / 16).cast("int").alias("zeros"), (run % 16 * 16 + size_of(s["v"])).alias("symbol"), s["v"].alias("v"))

    rows = rows.withColumn("tokens", F.when(F.size("_at") > 0, F.zip_with("_at", before, token)).otherwise(F.array().cast("array<struct<zeros:int,symbol:bigint,v:bigint>>")))
    return rows.withColumn("ended", F.coalesce(F.get(F.col("_at.at"), F.size("_at") - 1) == F.size(levels) - 1, F.lit(False))).drop("_at")


def symbol_counts(rows: DataFrame) -> DataFrame:
    """symbol, n of the tokens of blocks, with runs of sixteen zeros and ends."""
    every = F.concat(F.flatten(F.transform("tokens", lambda t: F.concat(F.array_repeat(F.lit(ZEROS).cast("long"), t["zeros"]), F.array(t["symbol"])))),
                     F.when(F.col("ended"), F.array().cast("array<bigint>")).otherwise(F.array(F.lit(END).cast("long"))))
    return rows.select(F.explode(every).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def chunks(rows: DataFrame, picture: str, block: str, first: str, steps: CodeTable, rest: CodeTable, cap: int = 840, most: int = 255) -> DataFrame:
    """picture, chunk, first, blocks, payload: the blocks of each picture in order, as many a chunk as fit cap bits and most.

    rows: picture, block, first (the block's first level), tokens, ended. A block's first level is sent as its difference to the block
    before; the first of a chunk as itself, so every chunk is read alone. A block that does not fit an empty chunk is an error.
    A picture's blocks are gathered, so pictures are to be bounded.
    """
    tokens = F.array_join(F.transform("tokens", lambda t: F.concat(F.repeat(F.lit(rest.codes.get(ZEROS, "")), t["zeros"]), rest.of(t["symbol"]), extra_bits(t["v"]))), "")
    coded = F.concat(tokens, F.when(F.col("ended"), "").otherwise(F.lit(rest.codes.get(END, ""))))
    own = rows.select(picture, F.col(block).alias("_block"), F.col(first).cast("long").alias("_first"), coded.alias("_rest"))
    each = own.groupBy(picture).agg(F.array_sort(F.collect_list(F.struct("_block", "_first", "_rest"))).alias("_all"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("_all._first"))
    dc = lambda v: F.concat(steps.of(size_of(v)), extra_bits(v))
    codes = F.transform("_all", lambda b, i: F.struct(
        b["_block"].cast("int").alias("at"), F.concat(dc(b["_first"] - F.get("_before", i)), b["_rest"]).alias("more"), F.concat(dc(b["_first"]), b["_rest"]).alias("own")))
    each = each.withColumn("_before", before).withColumn("_codes", codes)
    got = each.select(picture, F.posexplode(greedy_fill("_codes", cap, most)).alias("chunk", "c"))
    return got.select(picture, "chunk", "c.first", F.col("c.symbols").alias("blocks"), "c.payload")


def read_chunks(received: DataFrame, picture: str, steps: CodeTable, rest: CodeTable, size: int = 64) -> DataFrame:
    """picture, block, levels (size, in scan order) of whatever chunks (picture, first, blocks, payload) are there."""
    dc, ac = ({c: s for s, c in t.codes.items()} for t in (steps, rest))

    def run(frames):
        for f in frames:
            out = []
            for key, first, count, bits in zip(f[picture], f["first"], f["blocks"], f["payload"]):
                at, before = 0, 0

                def symbol(table, at):
                    end = next(e for e in range(at + 1, at + LONGEST + 1) if bits[at:e] in table)
                    return table[bits[at:end]], end

                def level(n, at):
                    v = int("0" + bits[at:at + n], 2)
                    return (v if not n or bits[at] == "1" else v - (1 << n) + 1), at + n

                for k in range(count):
                    levels = [0] * size
                    n, at = symbol(dc, at)
                    step, at = level(n, at)
                    levels[0] = before = before + step
                    place = 1
                    while place < size:
                        s, at = symbol(ac, at)
                        if s == END:
                            break
                        place += s >> 4
                        if s != ZEROS:
                            levels[place], at = level(s & 15, at)
                        place += 1
                    out.append((key, first + k, levels))
            yield pd.DataFrame(out, columns=[picture, "block", "levels"])

    kind = received.schema[picture].dataType.simpleString()
    return received.select(picture, "first", "blocks", "payload").mapInPandas(run, f"`{picture}` {kind}, block int, levels array<long>")
