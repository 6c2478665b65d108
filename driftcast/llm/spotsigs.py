"""SpotSigs fingerprints: chains of content words that follow common words, as DataFrame expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcast.llm.common import partitions, written

#: Common words of four languages, after which a signature may start.
ANCHORS = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you",
    "de": "als am auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im ist mit nicht sich sie sind über um und von war wie zu zum zur",
    "es": "al como con de del el en era es esta este la las lo los más no para pero por que se ser sin sobre son su sus un una y ya",
    "fr": "au aux avec ce ces cette dans de des du elle est et il ils je la le les leur mais ne nous ou par pas plus pour qui que sa se ses son sur un une vous",
}
_MARK = "\x01"


def _trie_pattern(words: set[str]) -> str:
    """One pattern for a set of words, which shares their beginnings."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    inner = "|".join(h + _trie_pattern(rest) for h, rest in sorted(heads.items()))
    if not inner:
        return ""
    return f"(?:{inner})?" if "" in words else f"(?:{inner})"


ANCHOR_PATTERN = _trie_pattern({w for text in ANCHORS.values() for w in text.split()})


def normal(text: Column) -> Column:
    """Lower-cased words of letters and digits, one space between and around."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out, the sorted set of 32-bit signatures of a whole text (null: as empty).

    Every common word is glued to what follows it, so a run of them sticks to the next content
    word. A signature is a common word with the two content words after it. A text without any
    has the hash of all its words as its one signature, so equal words always give equal sets
    and no set is empty. The steps are columns of their own: an array that a lambda of another
    array referred to would be made anew for each element.
    """
    mark = F.lit(_MARK)
    df = df.withColumn("_words", normal(F.coalesce(F.col(text), F.lit(""))))
    glued = F.regexp_replace("_words", f"(?<= )({ANCHOR_PATTERN}) (?=[^ ])", f"$1{_MARK}")
    df = df.withColumn("_tokens", F.split(F.btrim(glued), " "))
    following = F.transform(F.slice("_tokens", F.lit(2), F.size("_tokens")), lambda t: F.substring_index(t, _MARK, -1))
    pairs = F.zip_with("_tokens", following, lambda t, y: F.when(F.contains(t, mark), F.concat(t, F.lit(" "), y)))
    df = df.withColumn("_chains", F.filter(pairs, lambda p: p.isNotNull()))

    def each(p: Column) -> Column:
        chain = F.substring_index(p, _MARK, -1)
        anchors = F.split(F.substring(p, F.lit(1), F.length(p) - F.length(chain) - 1), _MARK)
        return F.transform(anchors, lambda a: F.hash(a, chain))

    df = df.withColumn("_found", F.sort_array(F.array_distinct(F.flatten(F.transform("_chains", each)))))
    df = df.withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.hash("_words"))))
    return df.drop("_words", "_tokens", "_chains", "_found")


def fingerprint(sigs: Column) -> Column:
    """A signature set as text: 8 hexadecimal digits each, in order."""
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 at once where their sizes alone keep it below least."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(low < high * F.lit(least), F.lit(0.0)).otherwise(exact)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_partition: int = 4, max_buckets: int = 65536) -> DataFrame:
    """doc_id, text, next_text and the signatures sigs, next_sigs; next is the next lower doc_id.

    After the lowest id comes the highest. Documents are dealt to buckets of neighbouring ids,
    whose borders are quantiles of all ids; the first document of each bucket also goes to the
    bucket before, so a window per bucket sees every next document and no window spans the
    table. Rows of one id follow by a hash of their text; null ids are last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = min(max_buckets, per_partition * partitions(rows, "text"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    if cuts:
        # Cut k is the lowest id of bucket k + 1. First the group of cuts, then the cut in it.
        group = F.size(F.filter(F.array(*[F.lit(g[0]) for g in fine]), lambda c: c <= low))
        inside = F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in fine]), F.greatest(F.lit(1), group)), lambda c: c <= low))
        bucket = F.when(group == 0, 0).otherwise((group - 1) * step + inside)
    else:
        bucket = F.lit(0)
    heads = [r for r in ids.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.max("doc_id").alias("head")).orderBy("b").collect()]
    pairs = [(r["head"], heads[(k + 1) % len(heads)]["b"]) for k, r in enumerate(heads)]  # at most one row per bucket
    ghosts = spark.createDataFrame(pairs, "head long, ghost int")  # max_buckets rows at most, so it may be broadcast
    rows = rows.withColumn("b", bucket).join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    places = F.when(F.col("ghost").isNull(), F.array(F.struct(F.col("b"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("b"), F.lit(0).alias("extra")), F.struct(F.col("ghost").alias("b"), F.lit(1).alias("extra"))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.b", "p.extra")
    order = Window.partitionBy("b").orderBy("extra", F.desc("doc_id"), F.xxhash64("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = with_signatures(rows, "text", "sigs")
    rows = rows.withColumn("next_sigs", F.lead("sigs").over(order)).filter("extra = 0")
    return rows.select("doc_id", "text", "next_text", "sigs", "next_sigs")


def edited(text: Column, following: Column) -> Column:
    """text with its last half replaced by as many first code points of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends like the next document begins; near_edited and near_next are the
    Jaccard of the signature sets of the text and of the edited and the next text. A table of one
    row is its own next. Null text is empty; empty texts are alike (1).
    """
    rows = with_next(docs, doc_id, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """class_id (smallest doc_id), sigs, size, members: one row for all documents of an equal signature set."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    rows = with_signatures(rows, "text", "sigs").select("doc_id", "sigs")
    each = rows.groupBy("sigs").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    return each.select("class_id", "sigs", F.size("sigs").alias("size"), "members")


def similar(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs class_a < class_b of different signature sets of a Jaccard of least or more, and the Jaccard.

    Copies are one class, so they make no pairs. Classes are partitioned by set length: the
    borders grow by 1 / least, so a pair lies in one partition or in two neighbours. Within a
    partition a pair must share one of its rarest signatures (the first size - ceil(least * size)
    + 1 in order of their frequency), as otherwise too few are left to reach least; frequent
    signatures therefore bring no candidates together unless a set has no others. Candidates
    are compared once, by the sizes first. Rows without an id take no part.
    """
    sets = written(classes(docs, doc_id, text), "signature-sets")
    tokens = sets.select("class_id", "size", F.explode("sigs").alias("sig"))
    seen = tokens.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = tokens.join(seen, "sig")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("n", "sig"))
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)) + 1
    kept = ranked.withColumn("place", place).filter(F.col("place") <= prefix).select("class_id", "size", "sig")
    # Length l is in partition floor(ln l / ln(1 / least)); the longer of a pair is in that of the shorter or the next.
    part = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / least)) + 1e-9) if least < 1 else F.col("size")
    kept = kept.withColumn("part", part)
    a = kept.withColumn("part", F.explode(F.array("part", F.col("part") + 1) if least < 1 else F.array("part"))).select("sig", "part", F.col("class_id").alias("a"), F.col("size").alias("size_a"))
    b = kept.select("sig", "part", F.col("class_id").alias("b"), F.col("size").alias("size_b"))
    shorter = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["sig", "part"]).filter(shorter & (F.col("size_a") >= F.col("size_b") * F.lit(least) - 1e-9)).select("a", "b").distinct()
    left, right = sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sigs_a")), sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sigs_b"))
    got = pairs.join(left, "a").join(right, "b").withColumn("jaccard", likeness(F.col("sigs_a"), F.col("sigs_b"), least)).filter(F.col("jaccard") >= least - 1e-12)
    return got.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "jaccard")


def linked(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, links: each document's class and to how many other classes it is linked."""
    pairs = similar(docs, least, doc_id, text)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = with_signatures(rows, "text", "sigs").select("doc_id", F.md5(fingerprint(F.col("sigs"))).alias("key"))
    ids = rows.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return rows.join(ids, "key").join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
