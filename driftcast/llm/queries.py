"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcast.llm import collocations, decontamination, html_text, language_id, line_dedup, mixing, periods, quality, simhash, spotsigs, token_counts, token_files, toxicity
from driftcast.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"), 5, 0)))
    got = language_id.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", language_id.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller doc_id has, too."""
    got = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    docs, out = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out))
    got = toxicity.score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", out.alias("held_out"), "score", "predicted", "evidence")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprint of every document and of its edited text."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to Arrow files and read back."""
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and its component of links within 2 bits."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, one in ten of which is made periodic."""
    return periods.digest(periods.runs(periods.made_periodic(table(spark, sf_dir, "documents"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the quality rules keep it."""
    return quality.clean(table(spark, sf_dir, "documents")).drop("n_kept_lines", "clean_text")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_decontamination, op3_token_counts, op4_line_dedup, op5_html_text,
    op6_mixing, op7_toxicity, op8_spotsigs, op9_token_files, op10_simhash, op11_periodic_runs, op12_collocations, op13_quality_rules)}

ORACLES = {
    "op2_decontamination": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
m AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM i WHERE len(ws) > 0),
a AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM m),
x AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS s FROM a),
b AS (SELECT doc_id, ws, n, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) AS k FROM w, (SELECT DISTINCT n FROM m)),
d AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS s FROM b),
h AS (SELECT doc_id, item_id, d.n, k FROM d JOIN x ON d.n = x.n AND d.s = x.s),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, n, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id""",
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
k AS (SELECT doc_id, n, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 12) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM w),
l AS (SELECT arg_min((total - used) / rest_weight, used) AS level FROM f WHERE (total - used) / rest_weight * weight <= cap),
t AS (SELECT f.source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM f CROSS JOIN l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, least(floor(target - whole * source_size + 0.5)::BIGINT, source_size) AS rest FROM q),
b AS (SELECT d.doc_id, size, source_size, target, whole, rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM b""",
    "op11_periodic_runs": periods.SQL,
    "op12_collocations": collocations.SQL,
    "op13_quality_rules": quality.SQL,
}
