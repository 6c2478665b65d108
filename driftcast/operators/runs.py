"""Self-contained packets of runs and levels: each can be decoded alone, in any order and more than once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftcast.functions import bits as B


@dataclass(frozen=True)
class RunLayout:
    """Groups of positions by their first one, how far an index in a group is aligned, and the orders of the codes.

    Positions below dense are all sent, as differences; beyond, zeros are sent as runs before the next level.
    """

    total: int = 64
    starts: tuple[int, ...] = (0, 4, 20)
    aligns: tuple[int, ...] = (0, 1, 2)
    dense: int = 4
    first_order: int = 2
    run_order: int = 1
    level_order: int = 1

    @property
    def group_bits(self) -> int:
        return max(1, (len(self.starts) - 1).bit_length())

    def index_bits(self, group: int) -> int:
        """Bits of an aligned index in a group."""
        end = [*self.starts, self.total][group + 1]
        return max(0, ((end - self.starts[group] - 1) >> self.aligns[group]).bit_length())

    def group(self, position: Column) -> Column:
        found = F.lit(0)
        for g, start in enumerate(self.starts):
            found = F.when(position >= start, F.lit(g)).otherwise(found)
        return found

    def by_group(self, group: Column, values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), group + 1)

    def aligned(self, position: Column) -> Column:
        """The place from which a packet that begins at a position counts."""
        start, step = (self.by_group(self.group(position), list(v)) for v in (self.starts, [1 << a for a in self.aligns]))
        return position - F.pmod(position - start, step)

    def header(self, position: Column) -> Column:
        """Group and aligned index of a packet's first position."""
        group = self.group(position)
        code = F.lit("")
        for g, start in enumerate(self.starts):
            index = B.to_bits(F.shiftrightunsigned((position - start).cast("long"), self.aligns[g]), n) if (n := self.index_bits(g)) else F.lit("")
            code = F.when(group == g, index).otherwise(code)
        return F.concat(B.to_bits(group, self.group_bits), code)


def greedy_fill(codes: str, cap: int, most: int | None = None) -> Column:
    """Packets (first, symbols, payload) of an array of symbols (at, more, own): as many a packet as fit cap bits, and most at most.

    own is a symbol's code at the start of a packet, more its code after the one before it. A symbol that does not fit
    an empty packet is an error.
    """
    empty = F.lit(None).cast("struct<first:int,symbols:int,payload:string>")
    start = F.struct(F.array().cast("array<struct<first:int,symbols:int,payload:string>>").alias("done"), empty.alias("cur"))

    def step(state: Column, s: Column) -> Column:
        cur = state["cur"]
        fits = cur.isNotNull() & (F.length(cur["payload"]) + F.length(s["more"]) <= cap)
        fits = fits & (cur["symbols"] < most) if most else fits
        checked = F.when(F.length(s["own"]) <= cap, s["own"]).otherwise(F.raise_error(F.lit("a symbol does not fit an empty packet")))
        new = F.struct(s["at"].alias("first"), F.lit(1).alias("symbols"), checked.alias("payload"))
        same = F.struct(cur["first"].alias("first"), (cur["symbols"] + 1).alias("symbols"), F.concat(cur["payload"], s["more"]).alias("payload"))
        done = F.when(fits | cur.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(fits, same).otherwise(new).alias("cur"))

    def close(state: Column) -> Column:
        return F.when(state["cur"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["cur"])))

    return F.aggregate(codes, start, step, close)


def packets(levels: DataFrame, key: str, column: str, cap: int, layout: RunLayout | None = None) -> DataFrame:
    """key, packet, first, symbols, payload: the levels of each row of an array as packets of cap bits at most.

    A packet has its group and aligned index, then symbols until the next does not fit. Symbols are the dense
    positions and the levels other than 0 beyond; one that does not fit an empty packet is an error. Rows without
    such symbols, and null arrays, give no packets.
    """
    lay = layout or RunLayout()
    kind = "struct<at:int,v:bigint>"
    symbols = F.filter(F.transform(F.col(column), lambda v, i: F.struct(i.cast("int").alias("at"), v.cast("long").alias("v"))), lambda s: (s["at"] < lay.dense) | (s["v"] != 0))
    nothing = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("v")).cast(kind)
    before = F.slice(F.concat(F.array(nothing), F.col("_symbols")), F.lit(1), F.size("_symbols"))

    def code(s: Column, place: Column, last: Column) -> Column:
        dense = B.exp_golomb(B.fold(s["v"] - last), lay.first_order)
        sparse = F.concat(B.exp_golomb((s["at"] - place).cast("long"), lay.run_order), B.exp_golomb(B.fold(s["v"]), lay.level_order))
        return F.when(s["at"] < lay.dense, dense).otherwise(sparse)

    def codes(s: Column, p: Column) -> Column:
        """A symbol's code after the one before it, and at the start of a packet: both are known before packets are."""
        return F.struct(s["at"].alias("at"), code(s, p["at"] + 1, p["v"]).alias("more"),
                        F.concat(lay.header(s["at"]), code(s, lay.aligned(s["at"]), F.lit(0).cast("long"))).alias("own"))

    rows = levels.select(key, symbols.alias("_symbols")).select(key, F.zip_with("_symbols", before, codes).alias("_codes"))
    rows = rows.select(key, F.posexplode(greedy_fill("_codes", cap)).alias("packet", "p"))
    return rows.select(key, "packet", "p.*")


def _codes(payload: str, at: int, orders: Iterable[int]) -> Iterator[int]:
    """Values of the Exp-Golomb codes of the given orders from a place on, until one is cut off."""
    for order in orders:
        one = payload.find("1", at)
        end = 2 * one - at + order + 1
        if one < 0 or end > len(payload):
            return
        yield int(payload[one:end], 2) - (1 << order)
        at = end


def _unfolded(values: np.ndarray) -> np.ndarray:
    return np.where(values % 2 == 1, (values + 1) // 2, -(values // 2))


def packet_values(payload: str, lay: RunLayout) -> tuple[np.ndarray, np.ndarray]:
    """Positions and levels that one packet states; what is cut off at its end is left out.

    First all codes are read; then dense levels are running sums of differences, sparse positions running sums of
    runs, and the zeros that a packet states are the positions up to its last level that no level has. Runs
    before the first level of a packet that begins beyond the dense part state nothing.
    """
    none = np.zeros(0, np.int64)
    head = lay.group_bits
    group = int(payload[:head], 2) if len(payload) >= head else len(lay.starts)
    if group >= len(lay.starts) or len(payload) < head + lay.index_bits(group):
        return none, none
    index = int("0" + payload[head:head + lay.index_bits(group)], 2)
    place = lay.starts[group] + (index << lay.aligns[group])
    first = max(0, lay.dense - place)
    found = list(_codes(payload, head + lay.index_bits(group), chain([lay.first_order] * first, cycle((lay.run_order, lay.level_order)))))
    dense = np.cumsum(_unfolded(np.array(found[:first], np.int64)))
    pairs = np.array(found[first:], np.int64)[: max(0, len(found) - first) // 2 * 2].reshape(-1, 2)
    at = max(place, lay.dense) + np.cumsum(pairs[:, 0] + 1) - 1
    inside = at < lay.total
    at, levels = at[inside], _unfolded(pairs[inside, 1])
    zeros = none
    if len(at):
        zeros = np.setdiff1d(np.arange(lay.dense if first else at[0], at[-1]), at, assume_unique=True)
    return np.concatenate((place + np.arange(len(dense)), at, zeros)), np.concatenate((dense, levels, np.zeros(len(zeros), np.int64)))


def decoded(received: DataFrame, key: str, layout: RunLayout | None = None, arrival: str | None = None) -> DataFrame:
    """key, position, level of what received packets (key, payload) say, however often they came.

    With a column of their arrival the last packet that states a position wins, so a clean packet repairs what a
    corrupted one has left; packets of equal arrival go by their payload. Without it packets must agree, as those of one
    picture do; a position on which they do not is decided by the greatest payload.
    """
    lay = layout or RunLayout()
    when = F.col(arrival).cast("long") if arrival else F.lit(0).cast("long")

    def run(frames):
        for f in frames:
            each = [packet_values(p, lay) for p in f["payload"]]
            n = [len(p) for p, _ in each]
            yield pd.DataFrame({key: f[key].repeat(n).to_numpy(), "position": np.concatenate([p for p, _ in each]), "level": np.concatenate([v for _, v in each]),
                                "payload": f["payload"].repeat(n).to_numpy(), "arrival": f["_arrival"].repeat(n).to_numpy()}).astype({"position": "int32"})

    kind = received.schema[key].dataType.simpleString()
    got = received.select(key, "payload", when.alias("_arrival")).filter("payload is not null").groupBy(key, "payload").agg(F.max("_arrival").alias("_arrival"))
    got = got.mapInPandas(run, f"`{key}` {kind}, position int, level long, payload string, arrival long")
    return got.groupBy(key, "position").agg(F.max_by("level", F.struct("arrival", "payload")).alias("level"))
