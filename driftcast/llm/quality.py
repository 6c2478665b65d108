"""Quality rules, lines first: lines that fail a rule go, then documents that lose too much of their text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# The rules' marks and phrases.
#: A sentence ends, possibly in closing quotes or brackets.
ENDS = r"[.!?:;…。！？][\"'”’»)\]*]*([\x20\x09-\x0D]|$)"
#: What stands between the entries of a menu or a path of links.
SEPARATOR = r"[|»›•·→]"
#: Entries of menus in four languages and what may part them; a line of nothing else is navigation.
ENTRY = (r"home|menu|login|log in|sign in|sign up|register|search|contact|about us|about|next|previous|back|read more|more|share|print|top|subscribe|"
         r"startseite|anmelden|suche|kontakt|weiter|zurück|mehr|impressum|datenschutz|accueil|connexion|rechercher|suivant|précédent|partager|"
         r"inicio|buscar|contacto|siguiente|anterior|compartir")
MENU = rf"({ENTRY}|[\x20\x09-\x0D|»›•·/-]+)"
#: Phrases of notices and licenses, in lower case.
BOILERPLATE = (
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled",
    "javascript is required", "lorem ipsum", "powered by ", "licensed under ", "released under the ", "terms and conditions apply", "click here", "subscribe to our")
SHOUTED = r"!{2,}"
CAPITALS = r"\p{Lu}{3,}"


def says_boilerplate(low: Column) -> Column:
    """Whether a lower-case text has one of the phrases."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def line_rules(line: Column, words: Column) -> dict[str, Column]:
    """Each rule that a line of so many words can fail, as a boolean column.

    punctuation: four words or more in which no sentence ends. symbols: more than one of # * $ % & | < > in ten words.
    shouting: every second word followed by two or more exclamation marks, or in capitals (of four words or more).
    navigation: three separators or more, or entries of menus alone. boilerplate: a phrase of notices and licenses.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    return {
        "punctuation": (words >= 4) & ~line.rlike(ENDS),
        "symbols": line.rlike(SYMBOL) & (count(SYMBOL) * 10 > words),
        "shouting": (F.contains(line, F.lit("!!")) & (count(SHOUTED) * 2 > words)) | ((words >= 4) & (count(CAPITALS) * 2 > words)),
        "navigation": (count(SEPARATOR) >= 3) | (line.rlike(f"(?i)^{MENU}") & (F.regexp_replace(F.lower(line), MENU, "") == "")),
        "boilerplate": says_boilerplate(F.lower(line)),
    }


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _lines of every whole text (null: empty).

    Everything happens within a row; nothing is shuffled. Three-word windows are hashed to 64 bits and sorted with
    their places only where some window occurs twice. The steps are columns of their own: an array that a lambda of
    another array referred to would be made anew for each element.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_text", whole).withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size("_words")
    at = lambda k: F.get("_words", k)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    df = df.withColumn("_windows", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    twice = F.transform("_placed", lambda p, j: F.when(
        (p["h"] == F.get("_placed", j - 1)["h"]) | (p["h"] == F.get("_placed", j + 1)["h"]), p["i"]))
    covered = F.flatten(F.transform(F.filter(twice, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))
    spoken = F.filter("_lines", lambda line: line.rlike(WORD))
    df = df.withColumn("_spoken", spoken)
    return df.select(
        "*", n.cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("_text", "_words", "_windows", "_placed", "_spoken")


def clean(df: DataFrame, text: str = "text", doc_id: str = "doc_id", fewest_words: int = 50, most_repeated: float = 0.5, least_left: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_kept_lines, n_kept_words, clean_text.

    Lines with a word that fail a rule are removed; lines without a word stay as they part paragraphs. base_failed:
    fewer than fewest_words words, or more than most_repeated of them in three-word windows that the text has twice. kept:
    not base_failed, and at least least_left of the words are left. Null and empty texts have no words and fail. Rows
    stay as they are, repeated and null ids included; a row depends on itself alone, so order and ties play no part.
    """
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = with_counts(own)

    counted = F.transform("_lines", lambda x: F.struct(x.alias("line"), F.when(x == "", 0).otherwise(F.regexp_count(x, F.lit(WORD))).alias("n")))
    rows = rows.withColumn("_counted", counted).withColumn("_notices", says_boilerplate(F.lower(F.coalesce("text", F.lit("")))))

    def good(searched: bool):
        def test(x: Column) -> Column:
            bad = F.lit(False)
            for name, rule in line_rules(x["line"], x["n"]).items():
                bad = bad | (rule if searched or name != "boilerplate" else F.lit(False))
            return (x["n"] == 0) | ~bad

        return test

    # Lines are searched for phrases only where the text has one; a condition inside the lambda would be made anew for each line.
    rows = rows.withColumn("_kept", F.when(F.col("_notices"), F.filter("_counted", good(True))).otherwise(F.filter("_counted", good(False))))
    rows = rows.withColumn("clean_text", F.array_join("_kept.line", "\n")).withColumn("n_kept_lines", F.size("_kept").cast("long"))
    rows = rows.withColumn("n_kept_words", F.aggregate("_kept.n", F.lit(0).cast("long"), lambda a, n: a + n))
    rows = rows.withColumn("base_failed", (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > round(100 * most_repeated) * F.col("n_words")))
    enough = 100 * F.col("n_kept_words") >= round(100 * least_left) * F.col("n_words")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & enough).alias("kept"), "n_kept_lines", "n_kept_words", "clean_text")


def cleaned(df: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The documents that are kept, all their columns, with the clean text in place of the text."""
    own = df.select(F.struct(*df.columns).alias("doc_id"), F.col(text).alias("text"))
    # Not filter("kept"): a filter would be pushed below the steps and evaluate all of them once more.
    one = F.struct("doc_id", "kept", "clean_text")
    got = clean(own, **rules).select(F.explode(F.filter(F.array(one), lambda r: r["kept"])).alias("r"))
    return got.select(*[F.col("r.clean_text" if c == text else f"r.doc_id.{c}").alias(c) for c in df.columns])


#: The digest of op13 in DuckDB's SQL.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN (SELECT r, s FROM g GROUP BY r, s HAVING count(*) > 1) USING (r, s)) GROUP BY r),
e AS (SELECT r, l, len(regexp_extract_all(l, '{WORD}')) AS n FROM (SELECT r, unnest(ls) AS l FROM w)),
k AS (SELECT r, sum(n) AS n FROM e
      WHERE NOT ((n >= 4 AND NOT regexp_matches(l, '{ENDS}')) OR len(regexp_extract_all(l, '{SYMBOL}')) * 10 > n
                 OR len(regexp_extract_all(l, '{SHOUTED}')) * 2 > n OR (n >= 4 AND len(regexp_extract_all(l, '{CAPITALS}')) * 2 > n)
                 OR len(regexp_extract_all(l, '{SEPARATOR}')) >= 3 OR regexp_replace(lower(l), '{MENU}', '', 'g') = '' OR regexp_matches(lower(l), '{PHRASES}')) GROUP BY r),
b AS (SELECT w.*, len(ws)::BIGINT AS n_words, coalesce(d.n, 0)::BIGINT AS n_repeat_words, coalesce(k.n, 0)::BIGINT AS n_kept_words FROM w LEFT JOIN d USING (r) LEFT JOIN k USING (r))
SELECT doc_id, n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept, n_kept_words FROM b"""
for _name, _text in {"WORD": WORD, "ENDS": ENDS, "SYMBOL": SYMBOL, "SHOUTED": SHOUTED, "CAPITALS": CAPITALS, "SEPARATOR": SEPARATOR, "MENU": MENU, "PHRASES": "|".join(BOILERPLATE)}.items():
    SQL = SQL.replace("{" + _name + "}", _text.replace("'", "''"))
