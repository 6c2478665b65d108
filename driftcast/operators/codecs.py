"""Packet codecs as a pair of DataFrame functions: pictures to units, and received units to pictures.

Units are idempotent: they may come in any order and more than once, and the last one of a
unit wins, so decoding is one max_by per unit and then one pass over what is held.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftcast.functions import bits as B
from driftcast.functions import blocks as K


class Codec(Protocol):
    """blocks: vec_id, block of 64 samples. units: vec_id, unit, payload (a string of 0 and 1), gain."""

    name: str

    def encode(self, blocks: DataFrame) -> DataFrame: ...

    def decode(self, held: DataFrame) -> DataFrame: ...


def held(received: DataFrame, order: Column) -> DataFrame:
    """The last payload of every unit received: vec_id, unit, payload."""
    return received.groupBy("vec_id", "unit").agg(F.max_by("payload", order).alias("payload"))


def _picked(values: str, places: list[int]) -> Column:
    """The elements at places, in their order; the array goes through a lambda, which evaluates it once."""
    pick = lambda v: F.transform(F.array(*[F.lit(i + 1) for i in places]), lambda i: F.element_at(v, i))
    return F.element_at(F.transform(F.array(F.col(values)), pick), 1)


class Raw:
    """Rows of samples at a few bits each; a row that is missing takes the nearest one above, then below."""

    def __init__(self, depth: int = 5):
        self.name, self.depth = f"raw{depth}", depth

    def encode(self, blocks: DataFrame) -> DataFrame:
        top = (1 << self.depth) - 1
        rows = blocks.select("vec_id", F.posexplode(F.array(*[F.slice("block", 8 * r + 1, 8) for r in range(8)])).alias("unit", "row"))
        code = F.transform("row", lambda v: B.to_bits(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(v / 256 * (top + 1)))), self.depth))
        return rows.select("vec_id", "unit", F.array_join(code, "").alias("payload"), F.lit(None).cast("double").alias("gain"))

    def decode(self, held: DataFrame) -> DataFrame:
        values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (B.from_bits(F.substring(F.col("payload"), i * self.depth + 1, F.lit(self.depth))) + 0.5) * (256 / (1 << self.depth)))
        rows = held.select("vec_id", "unit", values.alias("row")).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "row"))).alias("m"))
        near = lambda m, y: F.coalesce(*[m[F.lit(n)] for n in [*range(y, -1, -1), *range(y + 1, 8)]])
        filled = lambda m: F.flatten(F.array(*[near(m, y) for y in range(8)]))
        return rows.select("vec_id", F.element_at(F.transform(F.array("m"), filled), 1).alias("block"))


class Dct:
    """Quantised coefficients in zigzag order, eight to a unit of fixed width; missing ones are 0."""

    name = "dct"
    width = 8

    def encode(self, blocks: DataFrame) -> DataFrame:
        level = blocks.withColumn("block", F.transform("block", lambda v: v - 128))
        c = K.dct(level, "block", "c").withColumn("q", K.quantise("c", K.STEPS))
        zig = _picked("q", K.ZIGZAG)
        rows = c.withColumn("z", zig).select("vec_id", F.posexplode(F.array(*[F.slice("z", 8 * u + 1, 8) for u in range(8)])).alias("unit", "row"))
        top = (1 << (self.width - 1)) - 1
        code = F.transform("row", lambda v: B.to_bits(F.greatest(F.lit(-top), F.least(F.lit(top), v)), self.width))
        gain = F.aggregate("row", F.lit(0.0), lambda s, v: s + v * v)
        return rows.select("vec_id", "unit", F.array_join(code, "").alias("payload"), gain.alias("gain"))

    def decode(self, held: DataFrame) -> DataFrame:
        one = lambda i: B.signed(B.from_bits(F.substring(F.col("payload"), i * self.width + 1, F.lit(self.width))), self.width)
        rows = held.select("vec_id", "unit", F.transform(F.sequence(F.lit(0), F.lit(7)), one).alias("row"))
        flat = rows.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "row"))).alias("m"))
        zero = F.array(*[F.lit(0).cast("long")] * 8)
        flat = flat.select("vec_id", F.flatten(F.array(*[F.coalesce(F.col("m")[F.lit(u)], zero) for u in range(8)])).alias("z"))
        place = {i: k for k, i in enumerate(K.ZIGZAG)}
        flat = flat.select("vec_id", K.dequantise(_picked("z", [place[i] for i in range(64)]), K.STEPS).alias("c"))
        return K.idct(flat, "c", "block").select("vec_id", F.transform("block", lambda v: v + 128).alias("block"))


CODECS: dict[str, Codec] = {c.name: c for c in (Raw(4), Raw(5), Raw(8), Dct())}


def rate_quality(blocks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """codec, bits and mean psnr of every codec when all units arrive."""
    out = None
    for name in names or list(CODECS):
        codec = CODECS[name]
        units = codec.encode(blocks)
        size = units.groupBy("vec_id").agg(F.sum(F.length("payload")).alias("bits"))
        back = codec.decode(units.select("vec_id", "unit", "payload")).withColumnRenamed("block", "coded")
        each = blocks.join(back, "vec_id").join(size, "vec_id").select(F.lit(name).alias("codec"), "bits", K.psnr("block", "coded").alias("psnr"))
        row = each.groupBy("codec").agg(F.round(F.avg("bits"), 3).alias("bits"), F.round(F.avg("psnr"), 4).alias("psnr"))
        out = row if out is None else out.unionByName(row)
    return out
