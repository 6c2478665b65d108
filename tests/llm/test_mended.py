"""Vocabularies that words cannot be taken from, items without an id, and independent hashes of lines."""

import pyarrow as pa
from pyspark.sql import functions as F

import public_tokenizers
from driftcast.llm import decontamination, line_dedup, token_files

from .conftest import EN, ITEM


def test_other_vocabularies_are_encoded_whole(docs, tmp_path):
    """A vocabulary that keeps case and crosses blanks gives the library's ids, too."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = token_files.encoder(path)
    assert tool.whole and not token_files.encoder(public_tokenizers.path("word_bpe_49k.json")).whole
    texts = ["The cat sat on the mat", EN, None, "", "A.b  C\n\nd"]
    ids, sizes = tool.encode(pa.array(texts))
    want = [tool.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    some = docs.filter("doc_id in (1, 4, 7, 10)")
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.round_trip(some, path).collect()}
    assert got == {r["doc_id"]: len(tool.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in some.collect()}


def test_items_without_an_id_hit(spark, docs):
    nameless = spark.createDataFrame([(None, ITEM), (None, None), (None, ITEM)], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.report(docs, nameless).collect()}
    assert got[7]["contaminated"] and got[7]["n_hit"] == 12 and got[7]["n_items"] == 0 and not got[1]["contaminated"]
    both = {r["doc_id"]: r for r in decontamination.report(docs, nameless.unionByName(spark.createDataFrame([("i1", ITEM)], "item_id string, text string"))).collect()}
    assert both[7]["n_items"] == 1 and both[7]["n_hit"] == 12
    text = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, nameless).collect()}
    assert "nine ten" not in text[7].lower() and text[1] == EN


def test_hashes_of_lines_are_independent(spark):
    keys = ["x" * 32 + str(k) for k in range(50)] + ["y" * 32, "z" * 64]
    got = line_dedup.line_hashes(spark.createDataFrame([(1, "\n".join(keys))], "doc_id long, text string")).collect()
    assert len({r["h1"] for r in got}) == len({r["h2"] for r in got}) == len(keys)
    continued = spark.createDataFrame([(k,) for k in keys], "key string").select(F.xxhash64(F.concat("key", F.lit("\x01"))).alias("h")).collect()
    assert not {r["h2"] for r in got} & {r["h"] for r in continued}


def test_an_articles_names_do_not_outvote_its_text():
    from driftcast.llm import html_text

    tool = html_text.Extractor.fit()
    assert tool is html_text.Extractor.fit()  # learnt once
    text = ["How the old river bridge came down in the winter", *(" ".join(f"{w} of the long storm" for w in ("night", "house", "field", "water", "light", "stone")) + f" on day {k}." for k in range(2))]
    body = f"<h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p>"
    frame = '<nav class="menu"><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>', '<footer class="footer"><p>All rights reserved by the house.</p></footer>'
    for name in ("ad-hoc-report", "related-work", "notice-to-readers", "latest-news-article", "reply-to-critics", "banner-story"):
        for tag in ("article", "div", "section"):
            page = f'<html><body>{frame[0]}<{tag} class="{name}">{body}</{tag}>{frame[1]}</body></html>'
            assert tool.text(page) == "\n".join(text), (name, tag)
    for name in ("werbung", "kommentare", "publicidad", "comentarios", "advert", "comments"):
        page = f'<html><body><article class="post">{body}</article><div class="{name}"><p>Buy this very good new car of the year for little money now.</p></div></body></html>'
        assert tool.text(page) == "\n".join(text), name
    many = "".join(f"<div class=comment><p>{text[1]} says reader number {k}.</p></div>" for k in range(9))
    assert tool.text(f'<html><body><article class="post">{body}</article><section class="comments">{many}</section></body></html>') == "\n".join(text)
