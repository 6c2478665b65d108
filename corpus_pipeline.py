"""A corpus pipeline of five stages, each of which reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcast.llm import decontamination, language_id, mixing, similar, simhash, token_files
from driftcast.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those with a narrow margin or without letters go."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"), 5, 0)))
    return language_id.keep_clear(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of op10 (3 words, 2 bits); of rows that repeat its id, one.

    Not a stage: drop_similar is, as 2 bits leave out texts that share four fifths of their runs.

    Rows without an id represent no group and go. Documents are shuffled once, by id, at any
    size: ids are as many as documents and are never broadcast.
    """
    ids = written(simhash.near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    kept = docs.select("doc_id", F.struct(*docs.columns).alias("_row")).join(ids.hint("merge"), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("_row.text"), *[f"_row.{c}" for c in ("lang", "source") if c in docs.columns]))
    return kept.withColumn("_n", first).filter("_n = 1").select("_row.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of texts that share four fifths of their five-word runs.

    Ids that are null come last, and ties go by hash of the text, so a row is known by its id
    and text; rows that repeat both leave one. Documents are shuffled once more, at any size.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    kept = written(similar.groups(docs).groupBy("group").agg(best.alias("best")).select("best.id", "best.hash"), "kept-rows")
    h = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), h.alias("_hash"), F.struct(*docs.columns).alias("_row"))
    rows = own.join(kept.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & F.col("_hash").eqNullSafe(F.col("hash")))
    order = [F.col(f"_row.{c}") for c in ("lang", "source") if c in docs.columns] or [F.col("_id")]
    first = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(*order))
    return rows.withColumn("_n", first).filter("_n = 1").select("_row.*")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target of its source asks for."""
    return mixing.repeated(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files, read back: a row per document."""
    import public_tokenizers

    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_similar),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The first stage compresses texts, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
