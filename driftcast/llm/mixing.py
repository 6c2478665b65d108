"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftcast.llm.common import written

MAX_EPOCHS = 3
#: White space between words, as a class of a regular expression.
SPACE = r"\x20\x09-\x0D"


def words(text: str = "text"):
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources by code point, null last, weigh 1, 2, 3, repeating. All sizes together are shared by
    weight; a target stops at max_epochs times its source's size and the excess is reshared by
    weight. In order of cap over weight, the capped sources come first, so the level of the
    others follows from one running sum. There is one row per source here, not per document.
    Sources of size 0 get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    rows = rows.select("*", F.sum("source_size").over(everything).cast("double").alias("total"),
                       F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("used"), F.sum("weight").over(after).alias("left"))
    rows = rows.withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
    # The level at the first source that needs no cap; capped ones before it take their caps.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("used", "level"))).over(everything)
    level = free.getField("level")
    return rows.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * level)).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        max_epochs: int = MAX_EPOCHS, seed: int = 7, buckets: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words that the mix takes), columns of keep.

    A source's target is floor(target / source_size) whole rounds of all its documents and a
    fraction of one round: documents in the order of a seeded MD5 of their id until the rest is
    used up, the last of them in part, so that a source's taken words add up to its target (to a
    word) and no document exceeds its whole rounds plus one. Hash buckets of a source are summed
    first and only rows of the one bucket in which the rest runs out are ordered, so a
    source of any size needs no task of its own; documents then meet one row per source.
    Reruns agree. Null text has size 0; null sources are one source; rows of one id at the cut
    share it in proportion to their sizes; an empty table gives no rows.
    """
    keep = keep or []
    extra = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"),
                       F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("key"), *extra)
    rows = rows.withColumn("bucket", F.floor(F.col("key") / F.lit((1 << 48) // buckets)).cast("int"))
    # Words are counted once; the sums, the cut and, if no columns are kept, the result follow from these few bytes a row.
    light = written(rows.select("doc_id", "source", "size", "key", "bucket"), "mix-sizes")
    sums = written(light.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    per_source = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    per_source = per_source.withColumn("whole", whole.cast("long"))
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5))
    per_source = per_source.withColumn("rest", F.least(rest.cast("long"), F.col("source_size")))
    ends = written(_crossing(sums, per_source.select("source", "rest"), "bucket"), "mix-ends")
    near = light.select("source", "bucket", "key", "size").join(
        ends.select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), F.col("room").alias("rest")),
        F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
    keys = near.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    cut = _crossing(keys.select("source", "key", "size"), ends.select("source", F.col("room").alias("rest")), "key")
    cut = cut.select(F.col("source").alias("c_source"), F.col("key").alias("cut_key"), "room", F.col("size").alias("cut_size"))
    plan = per_source.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "whole", "cut_key", "room", "cut_size")
    # One row per source, written: its size is known to the planner, which broadcasts it only if small.
    got = (rows if keep else light).join(written(plan, "mix-plan"), F.col("source").eqNullSafe(F.col("p_source")))
    part = (F.when(F.col("key") < F.col("cut_key"), F.col("size"))
            .when(F.col("key") == F.col("cut_key"), F.expr("size * room div cut_size")).otherwise(F.lit(0)))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + part).alias("taken"),
                      *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def _crossing(sums: DataFrame, rest: DataFrame, order: str) -> DataFrame:
    """Per source the row of sums at which the running sum of size reaches rest, and the room left there."""
    before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rest = rest.select(F.col("source").alias("r_source"), "rest")
    run = run.join(rest, F.col("source").eqNullSafe(F.col("r_source")))
    return run.filter("rest > before and rest <= before + size").select("source", order, "size", (F.col("rest") - F.col("before")).alias("room"))


def repeated(docs: DataFrame, text: str = "text", length: str = "n_chars", **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time in part if need be.

    The columns are those of docs. A part has the first words of the text; length, if docs has
    it, counts its characters. Documents that are not taken go, as do those without words,
    which weigh nothing in any mix.
    """
    got = mix(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", text, "source"), text=text, keep=["_row"], **settings)
    rest = F.col("taken") % F.greatest(F.col("size"), F.lit(1))
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rows = got.filter("taken > 0").select("_row", "size", rest.alias("rest"), times.alias("times"), F.explode(F.sequence(F.lit(1), times)).alias("round"))
    cut = (F.col("rest") > 0) & (F.col("round") == F.col("times"))
    body = F.col(f"_row.{text}")
    part = F.regexp_extract(body, f"^[{SPACE}]*", 0)
    part = F.concat(part, F.array_join(F.slice(F.regexp_extract_all(body, F.lit(f"([^{SPACE}]+[{SPACE}]*)"), F.lit(1)), F.lit(1), F.col("rest").cast("int")), ""))
    new = F.when(cut, F.rtrim(part)).otherwise(body)
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(new.alias(c))
        elif c == length:
            cols.append(F.when(cut, F.char_length(new).cast(docs.schema[c].dataType)).otherwise(F.col(f"_row.{c}")).alias(c))
        else:
            cols.append(F.col(f"_row.{c}").alias(c))
    return rows.select(*cols)
