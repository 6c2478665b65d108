"""Packet layouts, addresses of primitives, QR cells and overlapping boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_BITS = 2
TAIL_BITS = 9
PRIMITIVE_BITS = 58


def layouts(spark: SparkSession, bytes_from: int, bytes_to: int, primitives: tuple[int, ...], bits: int = PRIMITIVE_BITS) -> DataFrame:
    """For each number of bytes and primitives: id bits u, slots k (k0 in the first unit), units, most primitives, spare bits.

    u is the least number of id bits that counts all units; the first unit holds 16 bits of its
    own. Sizes that hold no primitive have no layout. best marks the least bytes for their k.
    """
    grid = spark.range(bytes_from, bytes_to + 1).select(F.col("id").cast("int").alias("bytes"), F.explode(F.array(*[F.lit(p) for p in primitives])).alias("primitives"))
    rows = grid.withColumn("u", F.explode(F.sequence(F.lit(1), F.lit(16))))
    pay = F.col("bytes") * 8 - EPOCH_BITS - F.col("u")
    rows = rows.withColumn("pay", pay).filter(F.col("pay") >= bits)
    rows = rows.withColumn("k", F.floor(F.col("pay") / bits).cast("int")).withColumn("k0", F.greatest(F.lit(0), F.floor((F.col("pay") - 16) / bits)).cast("int"))
    more = F.ceil(F.greatest(F.lit(0), F.col("primitives") - F.col("k0")) / F.col("k"))
    rows = rows.withColumn("units", (1 + more).cast("int")).withColumn("most", (F.col("k0") + more * F.col("k")).cast("int"))
    rows = rows.filter(F.col("units") <= F.shiftleft(F.lit(1), 16) / F.pow(F.lit(2), 16 - F.col("u")))
    least = rows.groupBy("bytes", "primitives").agg(F.min(F.struct("u", "k", "k0", "units", "most", "pay")).alias("l"))
    return least.select("bytes", "primitives", "l.u", "l.k", "l.k0", "l.units", "l.most", (F.col("l.pay") - F.col("l.k") * bits).alias("spare"))


LAYOUT_SQL = """WITH g AS (SELECT b AS bytes, p AS primitives, u, b * 8 - 2 - u AS pay FROM range(6, 33) x(b), (SELECT unnest([1000, 2000, 4000]) AS p), range(1, 17) y(u) WHERE b * 8 - 2 - u >= 58),
l AS (SELECT *, pay // 58 AS k, greatest(0, (pay - 16) // 58) AS k0 FROM g), n AS (SELECT *, 1 + ceil(greatest(0, primitives - k0) / k)::BIGINT AS units FROM l)
SELECT bytes::INTEGER AS bytes, primitives::INTEGER AS primitives, u::INTEGER AS u, k::INTEGER AS k, k0::INTEGER AS k0, units::INTEGER AS units, (k0 + (units - 1) * k)::INTEGER AS most, (pay - k * 58)::INTEGER AS spare
FROM n WHERE units <= 1 << u QUALIFY row_number() OVER (PARTITION BY bytes, primitives ORDER BY u) = 1"""


def good_bytes(solved: DataFrame, least_spare: int = 8) -> DataFrame:
    """The least bytes for each number of slots that leave room for the tail."""
    return solved.filter(F.col("spare") >= least_spare).groupBy("primitives", "k").agg(F.min("bytes").alias("bytes"))


def address(j: Column, k0: int, k: int, bits: int) -> tuple[Column, Column]:
    """Unit and bit of primitive j."""
    rest = j - k0
    return F.when(j < k0, 0).otherwise(1 + F.floor(rest / k)), F.when(j < k0, 16 + j * bits).otherwise(rest % k * bits)


def carrier(tag: Column, payload: Column) -> Column:
    """A float's bits: 2**23 and 2 bits of tag before 28 bits of payload."""
    return F.lit(8388608).cast("long") + F.shiftleft(tag.cast("long").bitwiseAND(F.lit(3)), 28).bitwiseOR(payload.bitwiseAND(F.lit(268435455)))


def qr_cells(spark: SparkSession, sides: tuple[int, ...]) -> DataFrame:
    """side, x, y, cell of all cells outside the corners of 8 x 8, numbered in rows by a closed form."""
    grid = spark.createDataFrame([(s,) for s in sides], "side int").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    low, high = F.col("y") < 8, F.col("y") >= F.col("side") - 8
    corner = ((F.col("x") < 8) & (low | high)) | ((F.col("x") >= F.col("side") - 8) & low)
    before = F.when(low, F.col("y") * 16 + 8).when(high, 128 + (F.col("y") - F.col("side") + 8) * 8 + 8).otherwise(128)
    return grid.filter(~corner).select("side", "x", "y", (F.col("y") * F.col("side") + F.col("x") - before).cast("long").alias("cell"))


def overlaps(boxes: DataFrame, width: int = 32) -> DataFrame:
    """Pairs a < b of boxes (id, x, y, half side r) that touch; boxes meet in the cells of a grid that they cover."""
    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - F.col("r")) / width), F.floor((F.col(c) + F.col("r")) / width))

    cells = boxes.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    one, two = cells.alias("p"), cells.alias("q")
    reach = F.col("p.r") + F.col("q.r")
    near = (F.abs(F.col("p.x") - F.col("q.x")) <= reach) & (F.abs(F.col("p.y") - F.col("q.y")) <= reach)
    same = (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & (F.col("p.id") < F.col("q.id"))
    return one.join(two, same & near).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
