"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftcast.llm.common import map_batches, written

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
#: Compressible filling around a chunk: without it a text of few words is stored as it is, at one size for all languages.
_PAD = b" " * 32


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, most frequent language first (ties go to it)."""

    dictionaries: dict[str, bytes]
    level: int = 6
    chunk_bytes: int = 2048
    narrow: float = 0.01


def letters_only(text: str) -> bytes:
    """The lower-cased runs of letters of the whole text, one space between."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def fit(labelled: DataFrame, per_lang: int = 256, dict_bytes: int = 16384, max_langs: int = 200, **settings) -> LanguageModel:
    """Dictionaries from the columns text and lang of labelled rows.

    The fit reads a bounded sample: about per_lang distinct texts of each language, those with the
    smallest hashes; copies of a text are one text however many rows they have. A language of fewer
    texts, or of copies of one text only, is learnt from what it has. The sampled texts are read
    whole: their words are counted where the texts are, and the driver gets one dictionary of at most
    dict_bytes for each language. A dictionary holds the words that more of the language's sampled
    texts have than those of any other language, the most telling nearest its end, so single
    mislabelled rows do not matter. Rows with null lang or text teach nothing. More than max_langs
    languages are an error.
    """
    span = 1 << 40
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("texts"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return LanguageModel({}, **settings)
    bars = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(span, span * per_lang // max(1, r["texts"]) + 1)) for r in counts], "lang string, bar long")  # a row for each language
    few = rows.join(F.broadcast(bars), "lang").filter(F.pmod("h", F.lit(span)) < F.col("bar"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", words.alias("words"))
    few = written(few, "language-sample")
    sizes = {r["lang"]: r["n"] for r in few.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    size = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, n)])
    seen = few.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    seen = seen.withColumn("docs", size[F.col("lang")]).filter("n >= least(2, docs)").withColumn("share", F.col("n") / F.col("docs"))
    top = seen.groupBy("word").agg(F.max_by("lang", "share").alias("first"), F.sort_array(F.collect_list("share"), asc=False).alias("shares"))
    led = top.select(F.col("first").alias("lang"), "word", (F.get("shares", F.lit(0)) - F.coalesce(F.get("shares", F.lit(1)), F.lit(0.0))).alias("lead")).filter("lead > 0")
    best = Window.partitionBy("lang").orderBy(F.desc("lead"), F.desc("word"))
    led = led.withColumn("bytes", F.sum(F.octet_length("word") + 1).over(best)).filter(F.col("bytes") <= dict_bytes)
    found: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in led.orderBy("lang", "lead", "word").collect():
        found[r["lang"]].append(r["word"])
    return LanguageModel({lang: f" {' '.join(words)} ".encode() for lang, words in found.items()}, **settings)


class Compressors:
    """Compressors of a model, made once in a task."""

    def __init__(self, model: LanguageModel):
        self.model, self.each = model, {}
        for lang, data in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            self.each[lang] = zstandard.ZstdCompressor(
                level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is rejected."""
        data = letters_only(text) if text else b""
        if not data or not self.each:
            return UNKNOWN, 0.0, True
        step = self.model.chunk_bytes
        parts = [data[i:i + step] for i in range(0, len(data), step)]
        sizes = [(sum(len(c.compress(_PAD + p + _PAD)) for p in parts), k) for k, c in enumerate(self.each.values())]
        best, k = min(sizes)
        other = min((s for s, j in sizes if j != k), default=2 * best)
        margin = (other - best) / other
        return list(self.each)[k], margin / (margin + 2 * self.model.narrow), margin < self.model.narrow


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected, from the whole text of every row.

    The runs of letters are lower-cased and compressed in chunks under each dictionary; the
    smallest sum of sizes wins, ties go to the more frequent language. score grows with the
    margin to the runner-up; a margin under model.narrow is rejected. Null text, empty text and
    text without a letter give und, 0 and rejected. Columns of df with these names are replaced;
    all others stay. Repeated rows get equal answers.
    """
    df = df.drop("lang_pred", "score", "rejected")
    at = df.columns.index(text)
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches):
        tools = Compressors(model)
        for batch in batches:
            got = [tools.classify(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return map_batches(df, run, schema)


def keep_clear(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of df that predict() does not reject, with all their columns."""
    at = df.columns.index(text)

    def run(batches):
        tools = Compressors(model)
        for batch in batches:
            yield batch.filter(pa.array([not tools.classify(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, run, df.schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of doc_id as text, modulo parts, is part."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
