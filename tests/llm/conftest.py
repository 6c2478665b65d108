"""Documents with every oddity that an operator has to bear."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ("fp", "h", "key", "bucket", "size", "taken", "score", "rejected", "lang_pred", "kept_text", "n_lines", "evidence", "sigs", "_row", "file", "place", "source_size")

EN = "the cat and the dog were in the old house by the river when it began to rain in the hills"
DE = "der hund und die katze waren in dem alten haus am fluss als es in den bergen zu regnen begann"
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    long = " ".join(f"word{i % 977} of number {i}" for i in range(8000))
    out = [(1, EN, "en", "a", 1), (2, EN, "en", "a", 1), (3, DE, "de", "b", 1), (4, None, "en", "a", None), (5, "", None, None, 0),
           (6, long, "en", "c", len(long)), (7, f"Before it. {ITEM.upper()}! After it all the rest of the text goes on and on in peace.", "en", "b", 5),
           (8, "\n\nline of text here\n\n", "en", None, 3), (9, " \t\x0b ", None, "a", 2), (10, "1234 5678", "de", "b", 9), (None, EN + " again", "en", "a", 1),
           (11, "É" * 50 + " <|endoftext|> <s> ▁   Ünï", "de", "ü", 1), (3, DE, "de", "b", 1), (12, f"Line of text here\n{EN}\nshort", "en", "c", 7)]
    return out + [(100 + i, f"{EN if i % 2 else DE} number{i} item{i * 7}", "en" if i % 2 else "de", "abc"[i % 3], 9) for i in range(20)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([("i1", ITEM), ("i2", None), ("i3", ""), ("i4", "Short item of words"), (None, ITEM), ("i1", ITEM)], "item_id string, text string")
