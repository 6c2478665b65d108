"""Phrase collocations: n-grams of distinct pieces counted by multiplicity in duckdb per hash bucket, parts looked up by shuffled requests."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftcast.llm.common import written

#: Where texts are cut, and what parts words within a piece.
CUTS = r"[.,;:!?\x0A-\x0D]"
LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GRAMS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("gram", pa.string()), ("f", pa.int64())])


def pieces(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece, m: every distinct piece of a language, its words parted by one space, and how often it occurs.

    Null texts have none; a null language is `und`. Equal pieces are summed before the shuffle, so a piece of any
    frequency is one row of each task.
    """
    cut = F.split(F.translate(F.col(text), _UPPER, _LOWER), CUTS)
    rows = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(cut).alias("piece"))
    # Most pieces have no run of blanks inside; only the others need a pattern.
    one = F.btrim("piece", F.lit(" \t"))
    rows = rows.select("lang", one.alias("piece")).filter("piece <> ''")
    plain = F.when(F.col("piece").contains("  ") | F.col("piece").contains("\t"), F.regexp_replace("piece", r"[ \t]+", " ")).otherwise(F.col("piece"))
    return rows.groupBy("lang", plain.alias("piece")).agg(F.count(F.lit(1)).alias("m"))


def language_grams(texts: pa.Array, times: np.ndarray, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(grams, counts, 64-bit hashes) for 1 to longest words, of pieces of one language that occur times times.

    Words get codes in the order of their bytes, so sorted codes are sorted grams, which pack well. A gram of k words
    is known by the place of its first k - 1 words among the grams of k - 1 and its last word.
    """
    lists = pc.split_pattern(texts, " ")
    piece = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    flat = lists.flatten().dictionary_encode()
    order = pc.sort_indices(flat.dictionary).to_numpy()
    words = flat.dictionary.take(pa.array(order))
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    own = code = code[flat.indices.to_numpy()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))
    weight, n, grams, mixed = times[piece].astype(np.float64), len(code), words, hashes
    yield grams, np.bincount(code, weight, len(words)).astype(np.int64), mixed
    for k in range(2, longest + 1):
        # Places whose gram of k words ends in the same piece.
        start = np.flatnonzero(piece[k - 1:] == piece[: n - k + 1]) if n >= k else np.zeros(0, np.int64)
        if not len(start):
            return
        key, inverse = np.unique(own[start] * len(words) + code[start + k - 1], return_inverse=True)
        before, last = np.divmod(key, len(words))
        grams = pc.binary_join_element_wise(grams.take(pa.array(before)), words.take(pa.array(last)), " ")
        mixed = (mixed[before] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[last] + (mixed[before] >> np.uint64(29)))
        own = np.full(n, -1)
        own[start] = inverse
        yield grams, np.bincount(inverse, weight[start], len(key)).astype(np.int64), mixed


def dealt_grams(rows: DataFrame, longest: int, buckets: int, chunk_bytes: int = 6 << 20) -> DataFrame:
    """bucket, grams: the grams of pieces, summed within chunks of about chunk_bytes; a chunk packs one row for each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("grams", pa.binary())])

    def of_chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        langs = t["lang"].combine_chunks().dictionary_encode()
        at, parts = langs.indices.to_numpy(), []
        for c, lang in enumerate(langs.dictionary.to_pylist()):
            mine = t.filter(pa.array(at == c)) if len(langs.dictionary) > 1 else t
            for k, (grams, counts, mixed) in enumerate(language_grams(mine["piece"].combine_chunks(), mine["m"].to_numpy(), longest), 1):
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(grams)), pa.repeat(pa.scalar(k, pa.int32()), len(grams)), grams, pa.array(counts)]
                parts.append((pa.table(columns, schema=_GRAMS), ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)))
        bucket = np.concatenate([b for _, b in parts])
        by = np.argsort(bucket, kind="stable")
        dealt, bucket = pa.concat_tables([x for x, _ in parts]).take(pa.array(by)).combine_chunks(), bucket[by]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _GRAMS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(dealt.slice(lo, hi - lo))
            yield pa.record_batch([pa.array([bucket[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= chunk_bytes:
                yield from of_chunk(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()  # the worker stays for later tasks
        if held:
            yield from of_chunk(held)
        held = []
        pa.default_memory_pool().release_unused()

    return rows.select("lang", "piece", "m").mapInArrow(run, "bucket int, grams binary")


def counted(dealt: DataFrame, buckets: int, least: int, memory: str = "100MB", slice_bytes: int = 6 << 20) -> DataFrame:
    """lang, k, gram, f of every gram that occurs least times or more, counted out of core by duckdb, one bucket after another.

    A bucket of more than slice_bytes of packed grams is counted in slices by a hash of the gram, so that the groups of one
    slice are in memory at a time; each slice unpacks the bucket again. Rows whose gram is null have a language's number of words in the
    task's buckets. duckdb spills what goes beyond memory to a folder of the task, which is removed when the task ends; a
    task that is lost is run again from the shuffled grams.
    """

    def run(batches):
        import duckdb

        source = ((bucket, packed) for b in batches for bucket, packed in zip(b.column(0).to_pylist(), b.column(1)))
        folder, words = tempfile.mkdtemp(prefix="grams-"), {}

        def unpacked(held: list[pa.BinaryScalar], first: bool) -> Iterator[pa.RecordBatch]:
            for packed in held:
                for x in pa.ipc.open_stream(packed.as_buffer()):
                    if first:
                        single = pa.table(x).filter(pc.equal(x["k"], 1)).group_by("lang").aggregate([("f", "sum")])
                        for lang, total in zip(single["lang"].to_pylist(), single["f_sum"].to_pylist()):
                            words[lang] = words.get(lang, 0) + total
                    yield x

        def of_bucket(held: list[pa.BinaryScalar]) -> Iterator[pa.RecordBatch]:
            slices = -(-sum(len(x.as_buffer()) for x in held) // slice_bytes)
            for k in range(slices):
                con = duckdb.connect(":memory:", config={"memory_limit": memory, "temp_directory": folder, "threads": 1, "preserve_insertion_order": False})
                reader = pa.RecordBatchReader.from_batches(_GRAMS, unpacked(held, k == 0))  # noqa: F841  read by name below
                mine = f"WHERE hash(gram) % {slices} = {k}" if slices > 1 else ""
                found = con.sql(f"SELECT lang, k, gram, sum(f)::BIGINT AS f FROM reader {mine} GROUP BY ALL HAVING sum(f) >= {int(least)}").to_arrow_reader(10_000)
                yield from (x.cast(_GRAMS) for x in found)
                con.close()
                pa.default_memory_pool().release_unused()

        try:
            held, last = [], None
            for bucket, packed in source:
                if held and bucket != last:
                    yield from of_bucket(held)
                    held = []
                held.append(packed)
                last = bucket
            if held:
                yield from of_bucket(held)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        if words:
            yield pa.record_batch([pa.array(list(words)), pa.array([1] * len(words), pa.int32()), pa.nulls(len(words), pa.string()), pa.array(list(words.values()))], schema=_GRAMS)

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "lang string, k int, gram string, f long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP,
                 bucket_bytes: int = 8 << 20, fewest_buckets: int = 12) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best top phrases of 2 to longest words that occur least times or more.

    a, l and r are the occurrences of the phrase, of its first part and of the rest where the cut scores least (ties: the
    shortest first part); n is the language's number of words; score is floor(1000000 a a / (l r)), in exact decimals.
    Phrases that lie in a longer one which occurs in share percent of their places are left out.

    Phrases are dealt to buckets by a hash. Each asks for its parts by one request for all phrases of its bucket: requests
    are shuffled to where the parts are counted, and answers back to the bucket, so a word that a third of all phrases
    has is asked for once by each bucket. Ranks are taken within slices of a language first; a language's last
    ranking sees top rows of each slice. Order is by score, occurrences, then the bytes of the phrase, so there are no ties.
    Null texts have no pieces, null languages are `und`; empty tables give no rows. Other columns play no part.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(fewest_buckets, -(-size // bucket_bytes))
    grams = written(counted(dealt_grams(pieces(df, text, lang), longest, buckets), buckets, least), "gram-counts")
    words = grams.filter("gram is null").groupBy("lang").agg(F.sum("f").alias("n"))
    known = grams.filter("gram is not null")
    phrases = known.filter("k > 1").withColumn("bucket", F.pmod(F.xxhash64("lang", "gram"), F.lit(buckets)).cast("int"))
    phrases = phrases.select("lang", F.col("gram").alias("phrase"), "k", F.col("f").alias("a"), "bucket")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))

    asked = cuts.select("bucket", "lang", F.explode(F.array("left", "right")).alias("gram")).distinct()
    answers = asked.join(known.select("lang", "gram", "f").hint("merge"), ["lang", "gram"]).select("bucket", "lang", "gram", "f")
    answers = written(answers, "gram-answers")
    for side in ("left", "right"):
        own = answers.select("bucket", "lang", F.col("gram").alias(side), F.col("f").alias(f"of_{side}"))
        cuts = cuts.join(own.hint("merge"), ["bucket", "lang", side])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(of_left as decimal(19,0)) * cast(of_right as decimal(19,0)))")
    best = cuts.select("lang", "phrase", "k", "a", F.struct(score.cast("long").alias("score"), F.col("cut"), F.col("of_left").alias("l"), F.col("of_right").alias("r")).alias("c"))
    best = best.groupBy("lang", "phrase", "k", "a").agg(F.min("c").alias("c")).select("lang", "phrase", "a", "k", "c.score", "c.l", "c.r")

    if longest > 2:
        inside = phrases.filter("k > 2").select("lang", "phrase", "k", "a").select(
            "lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")).select(
            "lang", "phrase", "k", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
        part = F.array_join(F.slice(F.split("phrase", " "), F.col("at"), F.col("size")), " ")
        longer = inside.select("lang", part.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        best = best.join(longer.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Not a window over a language: a language may hold most phrases.
    slices = best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)).cast("int"))
    slices = slices.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The digest of op12 in DuckDB's SQL.
SQL = r"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws, count(*) AS m FROM d GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, sum(m) AS f
      FROM (SELECT lang, ws, m, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 4) t(k) WHERE len(ws) >= k) GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, gram AS phrase, f::HUGEINT AS a, string_split(gram, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
x AS MATERIALIZED (SELECT c.*, cut, array_to_string(ws[:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest FROM c, range(1, 3) t(cut) WHERE cut < k),
h AS MATERIALIZED (SELECT x.*, u.f AS l FROM x JOIN g u ON u.lang = x.lang AND u.gram = x.first AND u.k = cut),
s AS MATERIALIZED (SELECT h.*, v.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * v.f::HUGEINT) AS score
                   FROM h JOIN g v ON v.lang = h.lang AND v.gram = h.rest AND v.k = h.k - cut),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS MATERIALIZED (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
o AS MATERIALIZED (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
k AS MATERIALIZED (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
z AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT z.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000"""
