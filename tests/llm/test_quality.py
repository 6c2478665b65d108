"""Quality rules against plain loops, and over odd, empty and clashing input."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from driftcast.llm import quality

from .conftest import EN, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    left = 0
    for x in lines:
        own = WORDS.findall(x)
        n = len(own)
        capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]{3,}", x))
        bad = n >= 4 and not re.search(quality.ENDS, x) or 10 * len(re.findall(quality.SYMBOL, x)) > n or 2 * len(re.findall("!!+", x)) > n or n >= 4 and 2 * capitals > n
        bad = bad or len(re.findall(quality.SEPARATOR, x)) >= 3 or not re.sub(quality.MENU, "", x.lower()) or any(p in x.lower() for p in quality.BOILERPLATE)
        left += 0 if bad else n
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(quality.SYMBOL, text)), len(lines) - len(set(lines)), len(hit), failed, not failed and 100 * left >= 50 * len(words), left)


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def some_texts():
    r = random.Random(5)
    parts = [EN + ".", "home | about | contact", "HOME", "Buy now!! Cheap!! Now!!", "THE OLD HOUSE IS LARGE.", "all rights reserved.", "a b c", "a b c d", "x # y $ z.",
             "", " \t ", "one. two", "Ünï ÄÖÜSS ÉÀÈ ÖÖÖ ßß.", "He said (“yes.”)", "menu menu", "homework", "a » b » c » d."]
    out = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a " * 60, "a b c d " * 40, "\n".join(["a b."] * 30)]
    return out + ["\n".join(r.choice(parts) for _ in range(r.randrange(1, 14))) + " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(0, 90))) for _ in range(150)]


def test_counts_and_verdict_against_plain_loops(spark):
    texts = some_texts()
    got = quality.clean(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLS) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_odd_rows_clashing_names_and_empty_table(docs, clashing, empty):
    want = sorted((str(r[0]), *plain(r[1])) for r in rows())
    for df in (docs, clashing.withColumn("n_words", F.lit(1)).withColumn("_lines", F.lit(2)).withColumn("kept", F.lit(3))):
        assert sorted((str(r["doc_id"]), *(r[c] for c in COLS)) for r in quality.clean(df).collect()) == want
    assert quality.clean(empty).collect() == []


def test_cleaned_keeps_columns_and_drops_failing_lines(spark):
    body = "\n".join(" ".join(f"word{i}and{k}" for k in range(15)) + "." for i in range(4))
    data = [(1, f"Home | News | About | Contact\n{body}\n\nAll rights reserved.", "x"), (2, "Home | News | About | Contact\n" * 40, "x"), (3, body, None)]
    got = {r["doc_id"]: (r["text"], r["kept"]) for r in quality.cleaned(spark.createDataFrame(data, "doc_id long, text string, kept string")).collect()}
    assert got == {1: (body + "\n", "x"), 3: (body, None)}


def test_no_python_on_the_path(spark, docs):
    plan = quality.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan
