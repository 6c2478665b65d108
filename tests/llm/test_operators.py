"""Each operator against brute force, and over odd, empty and clashing input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from driftcast.llm import decontamination, html_text, language_id, line_dedup, mixing, simhash, spotsigs, token_counts, token_files, toxicity

from .conftest import EN, rows

WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(df):
    return [r.asDict() for r in df.collect()]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Language ID

def test_language_held_out_and_odd_rows(docs, clashing, empty):
    model = language_id.fit(docs)
    got = table(language_id.predict(clashing, model))
    assert len(got) == len(rows())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 3) or (r["doc_id"] or 0) >= 100:
            assert r["lang_pred"] == r["lang"] and not r["rejected"]
    assert table(language_id.predict(empty, model)) == []
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in table(language_id.predict(docs, none))} == {"und"}


def test_language_of_copies_is_learnt(spark):
    en = [("en", f"the old house by the river number {w}") for w in "one two three four five six seven eight nine ten".split()] * 2000
    de = [("de", f"das alte haus am fluss nummer {k} und der hund {k}") for k in range(300)]
    model = language_id.fit(spark.createDataFrame(en + de, "lang string, text string"))
    assert language_id.Compressors(model).classify("the old house by the river number one")[::2] == ("en", False)
    same = language_id.fit(spark.createDataFrame([("xx", "lorem ipsum dolor")] * 50 + de, "lang string, text string"))
    assert language_id.Compressors(same).classify("lorem ipsum dolor")[0] == "xx"


def test_words_at_the_end_of_long_texts_teach(spark):
    data = [("en", "the a of " * 3000 + f"latecomer{k} zebra stripes") for k in "abcdef"] + [("de", "der die das " * 3000 + f"nachsatz{k} gurke") for k in "abcdef"]
    model = language_id.fit(spark.createDataFrame(data, "lang string, text string"))
    assert b"zebra" in model.dictionaries["en"] and b"gurke" in model.dictionaries["de"]


def test_language_against_plain_loop(docs):
    import unicodedata

    import zstandard

    model = language_id.fit(docs)
    texts = [d[1] for d in rows()] + ["½ ²", "Ⅷ 3", "½ der", "x", "_", "Der hund und the cat " * 400, "漢字 the"]
    tools = language_id.Compressors(model)
    for t in texts:
        low_text = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower())
        data = " ".join(low_text.split()).encode()
        got = tools.classify(t)
        if not data:
            assert got == ("und", 0.0, True)
            continue
        sizes = {}
        for lang, raw in model.dictionaries.items():
            c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                         write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(b" " * 32 + data[i:i + model.chunk_bytes] + b" " * 32)) for i in range(0, len(data), model.chunk_bytes))
        first, second = sorted(sizes.values())[:2]
        assert sizes[got[0]] == first and got[2] == ((second - first) / second < model.narrow)


def test_language_needs_bounded_labels(docs):
    with pytest.raises(ValueError):
        language_id.fit(docs, max_langs=1)


# Decontamination

def brute_hits(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == w[k:k + size]:
                    hit.update(range(j, j + size))
                    found.add(name)
    return len(words), len(hit), found


def test_windows_against_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        alphabet = "ab" if rnd.random() < 0.5 else "abcde"
        items = [(str(i), " ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9)))) for i in range(rnd.randint(1, 6))]
        tool = decontamination.SuffixAutomaton([(i, decontamination.words(t)) for i, t in items], window=4)
        text = " ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        spans, ids = tool.scan(decontamination.words(text))
        n, hit, found = brute_hits(text, items, 4)
        assert sum(b - a for a, b in decontamination.merged(spans)) == hit
        assert {tool.ids[i] for i in ids} == found


def test_report_and_odd_rows(docs, clashing, benchmark, empty):
    items = [("i1", benchmark.first()["text"]), ("i4", "Short item of words")]
    for r, d in zip(table(decontamination.report(clashing, benchmark)), rows()):
        n, hit, found = (len(d[1].split()), 0, set()) if d[0] == 6 else brute_hits(d[1], items)  # row 6: words in ASCII, none of an item
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert table(decontamination.report(empty, benchmark)) == []
    assert not any(r["n_hit"] for r in table(decontamination.report(docs, benchmark.limit(0))))
    assert len(decontamination.automata(benchmark, block_bytes=20).blocks) > 1
    one, many = (table(decontamination.report(docs, benchmark, block_bytes=b)) for b in (1 << 20, 20))
    assert sorted(one, key=repr) == sorted(many, key=repr) and any(r["n_hit"] for r in one)


def test_removal_keeps_clean_rows(clashing, benchmark, empty):
    got = table(decontamination.decontaminate(clashing, benchmark))
    assert len(got) == len(rows())
    for r, d in zip(got, rows()):
        if d[0] == 7:
            assert r["text"].startswith("Before it. ") and "TWELVE" not in r["text"] and r["text"].endswith("in peace.") and r["n_chars"] == len(r["text"])
        else:
            assert (r["text"], r["n_chars"]) == (d[1], d[4])
    assert table(decontamination.decontaminate(empty, benchmark)) == []
    assert sorted(table(decontamination.decontaminate(clashing, benchmark, block_bytes=20)), key=repr) == sorted(got, key=repr)
    tools = decontamination.automata(benchmark.sparkSession.createDataFrame([("x", "a b c d")], "item_id string, text string"), window=4)
    texts = ["x a b a b c d c d y z 1 2 3 4 5 6 7 8 9", "a b c d", None]
    assert decontamination.clean(texts, tools) == (["x  y z 1 2 3 4 5 6 7 8 9", "a b c d", None], [True, False, True])


def test_ten_blocks_and_a_long_text(spark):
    rnd = random.Random(11)
    items = [(f"i{k}", " ".join(f"w{rnd.randrange(400)}" for _ in range(30))) for k in range(40)] + [("s", "single")]
    body = [f"w{rnd.randrange(400)}" for _ in range(30000)]
    for at in (0, 777, 15000, 29970):
        body[at:at + 12] = items[at % 40][1].split()[:12]
    texts = [" ".join(body), " ".join(body[:50]), "none of it, single", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert len(decontamination.automata(bench, block_bytes=300).blocks) >= 10
    want = {}
    for i, t in enumerate(texts):
        words, hit, found = (t or "").replace(",", "").split(), set(), set()
        windows = {}
        for name, item in items:
            w = item.split()
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k:k + 10]), set()).add(name)
        for size in (1, 10):
            for j in range(len(words) - size + 1):
                if names := windows.get(tuple(words[j:j + size])):
                    hit.update(range(j, j + size))
                    found |= names
        want[i] = (len(words), len(hit), len(found))
    for size in (1 << 20, 300):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.report(docs, bench, block_bytes=size).collect()}
        assert got == want and got[0][1] >= 48


def test_blocks_of_items_are_judged_together(spark):
    items = [("p", "p0 p1 p2 p3"), ("q", "q0 q1 q2 q3"), ("r", "q3 r0 r1 r2")]
    texts = ["p0 p1 p2 p3 q0 q1 q2 q3 x y",  # each less than half, together more
             "a b c d e f g h p0 p1 q0 q1 q2 q3 p2 p3 i j k l m n",  # ends of a cut meet in a window of another
             "a b c d e f g h q0 q1 p0 p1 p2 p3 q2 q3 i j k l m n",
             "a b c d e f g h q0 q1 q2 q3 r0 r1 r2 i j k l m n",  # windows of two items overlap
             "nothing of it", None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, stay = decontamination.clean(texts, decontamination.automata(bench, window=4))
    want = [(i, c, len(c or "")) for i, (c, keep) in enumerate(zip(whole, stay)) if keep]
    assert [w[0] for w in want] == [1, 2, 3, 4, 5, 6]
    for size in (1 << 20, 9, 2, 1):
        got = decontamination.decontaminate(docs, bench, block_bytes=size, window=4)
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == want, size


# Token counts

def test_piece_counts_match_the_tokenizer(spark, clashing, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    counts, rnd = token_counts.PieceCounts(sp), random.Random(2)
    assert not counts.whole
    parts = ["a", "B", "é", " ", "  ", "\n", "▁", "<s>", "<0x0A>", "İ", ".", "漢", "\t", "the", " the", "\0", "\r", " ", "1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    assert [counts.count(t) for t in texts] == [len(sp.encode(t)) for t in texts]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:600])] + [(9000, "word " * 40000), (9001, "x" * 50000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(odd, PIECE_FILE, bucket_bytes=2000).collect()}
    assert got == {r["doc_id"]: len(sp.encode(r["text"])) for r in odd.collect()}
    want = sorted((repr(d[0]), len((d[1] or "").encode()), n := len(sp.encode(d[1] or "")), n > 4096) for d in rows())
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in table(token_counts.count_tokens(clashing, PIECE_FILE))) == want
    assert table(token_counts.count_tokens(empty, PIECE_FILE)) == []


class Crossing:
    """A tokenizer with a piece that goes across a space."""

    def get_piece_size(self):
        return 2

    def id_to_piece(self, i):
        return ["▁a", "▁a▁b"][i]

    def encode(self, x, num_threads=1):
        return [self.encode(t) for t in x] if isinstance(x, list) else [0] * len(x.replace("a b", "a").split())


def test_a_vocabulary_that_crosses_spaces_is_counted_by_whole_texts():
    counts = token_counts.PieceCounts(Crossing())
    assert counts.whole and counts.count("a b a b c") == 3 and counts.count("") == 0


# Line dedup

def brute_lines(data):
    owner = {}
    for d, t, *_ in data:
        for line in (t or "").split("\n"):
            key = low(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10:
                owner.setdefault(key, set()).add(d if d is not None else 2**63 - 1)
    out = []
    for d, t, *_ in data:
        mine = d if d is not None else 2**63 - 1
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owner.get(low(x.strip(" \t\n\x0b\x0c\r")), ())) < 2 or min(owner[low(x.strip(" \t\n\x0b\x0c\r"))]) == mine]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(clashing, empty, spark):
    key = lambda r: tuple(map(repr, r))
    want = sorted([(d[0], d[1], *b) for d, b in zip(rows(), brute_lines(rows()))], key=key)
    for size in (1 << 19, 1):  # one shard, and about one for each line
        got = table(line_dedup.dedup(clashing, shard_keys=size))
        assert sorted([(r["doc_id"], r["text"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got], key=key) == want
        assert {r["fp"] for r in got} == {"own fp"} and {r["key"] for r in got} == {"own key"}
    assert table(line_dedup.dedup(empty)) == []
    rnd = random.Random(3)
    data = [(i, "\n".join(f"{rnd.choice(['Line', ' line', 'LINE '])} number {rnd.randint(0, 30)}" for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    long = (99, "\n".join(f"Row {k} of a long text" for k in range(30000)) + "\nrow 7 of a long text")
    data += [long, (98, "x\nROW 29999 of a long text\n row 7 of a long text ")] + [(200 + i, "one very common line\nown line number %d" % i) for i in range(300)]
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"), shard_keys=600).collect()}
    assert [got[d[0]] for d in data] == brute_lines(data)


def test_line_index_finds_only_its_keys():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**64, (5000, 2), dtype=np.uint64)
    h[:4, 0] = h[0, 0]  # equal first hashes
    index = line_dedup.LineIndex.load(line_dedup.LineIndex.build(h[:4000, 0], h[:4000, 1], np.arange(4000), np.ones(4000, np.int64)).dump())
    owner, count = index.find(h[:, 0], h[:, 1])
    assert (owner[:4000] == np.arange(4000)).all() and (count[:4000] == 1).all() and (count[4000:] == 0).all()
    none = line_dedup.LineIndex.build(h[:0, 0], h[:0, 1], np.arange(0), np.arange(0))
    assert (none.find(h[:, 0], h[:, 1])[1] == 0).all()


# HTML

@pytest.fixture(scope="module")
def extractor():
    return html_text.Extractor.fit()


def test_blocks_of_held_out_pages(extractor):
    found = [html_text.blocks(p, "data-main") for p in html_text.labelled_pages(150, seed=77)]
    label, got = (np.concatenate(x) for x in ([[b.label for b in f] for f in found], [extractor.main(f) for f in found]))
    assert len(label) > 1000 and (label == got).mean() > 0.96


def splits(tree):
    return set() if tree.feature < 0 else {html_text.FEATURES[tree.feature]} | splits(tree.low) | splits(tree.high)


def test_words_and_links_of_neighbours_carry_the_tree(extractor):
    assert {"words", "link_density", "words_before", "link_density_before", "link_density_after"} <= splits(extractor.tree)


LONG = "A long paragraph of an article goes on for a while with many words and no links at all in it, as they do."


@pytest.mark.parametrize("page, want", [
    (f'<div class="main-menu-free-story"><h1>Head of it</h1><p>{LONG}</p><p>{LONG}</p></div>', f"Head of it\n{LONG}\n{LONG}"),
    (f'<div class="post-tags-text"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
    (f'<div id="feature-trending"><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article></div>', f"Head\n{LONG}\n{LONG}"),
    (f'<article><p>{LONG}</p><div class="message"><p>{LONG}</p></div><p>{LONG}</p></article>', f"{LONG}\n{LONG}\n{LONG}"),
    (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {LONG}</p></article>", f"So x=2 holds. {LONG}"),
    (f"<nav><a href=1>One</a> <a href=2>Two</a></nav><p>{LONG}</p><p>{LONG}</p><div><a href=3>Terms</a> <a href=4>Contact</a></div>", f"{LONG}\n{LONG}"),
    (f'<article><h1>Head</h1><p>{LONG}</p></article><div id="comments"><article class="comment"><p>I like it, and say so here in some more words.</p></article></div>', f"Head\n{LONG}"),
    (f'<p data-main="x">{LONG}</p>', LONG), (f"<p data-main>{LONG}</p>", LONG), (f"<p title=don't>{LONG}</p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    ("<script>var x = '<p>no</p>'", ""), ("<!-- open", ""), ("a &lt; b &amp; c", "a < b & c")])
def test_snippets(extractor, page, want):
    assert extractor.text(page) == want


@pytest.mark.parametrize("unit", ["<![CDATA[", '<p x="', "<p ", "<!--", "<script>", '<p a=">"', "<div>", "</div>", "<div></section>", "<p x='>", "&#", "<a <b "])
def test_time_grows_with_the_page(extractor, unit):
    import time

    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        extractor.text(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5  # eight times the length


def test_pages(spark):
    page = """<html><head><title>No</title><style>p{}</style></head><body><header class=top><p>Site name of ours</p></header>
<nav><a href=1>One</a> <a href=2>Two</a></nav><div class="cookie-banner"><p>We use cookies on this site, as all others do.</p></div>
<article><header><h1>Head&amp;line</h1></header><p>A first   paragraph &lt;here&gt;<br>goes on<!-- not <p>this</p> --></p><p>Short.
<div class="ad"><p>Buy this now</p></div><ul><li>One item</li></ul><script>var x = "<p>no</p>"</script></article>
<section id=comments><p>I like this article a lot, and I would like to say so here.</p></section><form><p>Sign up</p></form>
<footer>Copyright by us</footer></body></html>"""
    data = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<p> <a href='x"), (None, "u", page), (5, "u", "<article><p>" + "word " * 50000 + "</p></article>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("n_chars", F.lit(-1))
    got = table(html_text.extract(df))
    want = "Head&line\nA first paragraph <here> goes on\nShort.\nOne item"
    assert [r["text"] for r in got[:3]] == [want, "", ""] and got[4]["text"] == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[5]["n_chars"] == 5 * 50000 - 1
    assert table(html_text.extract(df.limit(0))) == []


# Mixing

def test_targets_against_iteration(spark):
    rnd = random.Random(4)
    for _ in range(5):
        sizes = {f"s{i:02d}": rnd.choice([1, 5, 30, 400, 3000]) for i in range(rnd.randint(1, 9))} | {None: 7}
        names = sorted(k for k in sizes if k) + [None]
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        total, fixed = sum(sizes.values()), {}
        while True:
            free = [s for s in names if s not in fixed]
            left = total - sum(fixed.values())
            level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if level[s] > 3 * sizes[s]]
            if not over:
                break
            fixed |= {s: 3 * sizes[s] for s in over}
        got = mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long"))
        for r in table(got):
            assert r["target"] == pytest.approx((fixed | level)[r["source"]])


def test_mix_meets_targets(clashing, docs, empty):
    got = table(mixing.mix(clashing))
    again = table(mixing.mix(docs.repartition(5)))
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    by = {}
    for r, d in zip(sorted(got, key=key), sorted(rows(), key=lambda d: (d[0] or -1, len((d[1] or "").split())))):
        assert r["taken"] <= 3 * r["size"]
        by.setdefault(r["target"], []).append(r["taken"])
    for target, taken in by.items():
        assert abs(sum(taken) - target) <= 2 * len(by)
    assert table(mixing.mix(empty)) == [] and table(mixing.repeated(empty)) == []
    text = table(mixing.repeated(clashing))
    assert set(text[0]) == set(clashing.columns)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in text) == sum(r["taken"] for r in got)


# Toxicity

def brute_scores(texts, toxic, share, k, queries, half=25.0):
    """Vote and score of each query by dense vectors over all terms, no index; queries name the example to leave out, or None."""
    n, n1 = len(texts), int(sum(toxic))
    seen = {w: [sum(w in t for t, y in zip(texts, toxic) if y == c) for c in (0, 1)] for w in set().union(*texts)}

    def weight(w):
        b, a = seen[w]
        g = sum(2 * x * np.log(x * n / (m * tot)) for x, m, tot in ((a, n1, a + b), (n1 - a, n1, n - a - b), (b, n - n1, a + b), (n - n1 - b, n - n1, n - a - b)) if x)
        return np.log((1 + n) / (a + b)) * max(max(g, 0) / (max(g, 0) + half), 1e-3) ** 2

    weights = {w: weight(w) for w in seen}

    def vector(t):
        v = {w: (1 + np.log(c)) * weights[w] for w, c in t.items() if w in weights}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = [vector(t) for t in texts]

    def vote(v, skip):
        cos = [(sum(x * u.get(w, 0.0) for w, x in v.items()), i) for i, u in enumerate(vectors) if i != skip]
        best = sorted(((c, i) for c, i in cos if c > 1e-12), key=lambda x: -round(x[0], 9))
        cut = best[:k]
        ties = len(best) > k and abs(best[k][0] - cut[-1][0]) < 1e-8
        w = [1 / (1.05 - min(c, 1.0)) for c, _ in cut]
        return (sum(x * toxic[i] for x, (_, i) in zip(w, cut)) / sum(w) if w else 0.0), ties, [c for c, _ in cut]

    return [vote(vector(t), skip) for t, skip in queries]


def test_nearest_and_scores_against_dense_vectors():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [toxicity.Counter(rnd.choices(words, k=rnd.randint(1, 12)) + [f"rare{i}"]) for i in range(300)]
    toxic = [int("w1" in t or "w2" in t or rnd.random() < 0.1) for t in texts]
    m = toxicity._index(texts, np.array(toxic), np.arange(300), 0.2, 5)
    assert len(m.vocabulary) == len(set().union(*texts)) and sorted(m.ids) == list(range(300))
    want = brute_scores(texts, toxic, 0.2, 5, [(t, None) for t in texts[::7]])
    same = 0
    for t, (vote, ties, cosines) in zip(texts[::7], want):
        near, cosine = m.nearest(*m.vector(t))
        assert np.allclose(cosine, cosines)
        if not ties:
            same += 1
            assert m.vote(near, cosine) == pytest.approx(vote)
            assert m.score(t)[0] == pytest.approx(np.interp(vote, m.places, m.rates))
    assert same > 20
    left_out = brute_scores(texts, toxic, 0.2, 5, [(t, i) for i, t in enumerate(texts)])
    raw = [m.vote(*m.nearest(*m.vector(texts[i]), skip=p)) for p, i in enumerate(m.ids)]
    assert all(ties or r == pytest.approx(vote) for r, (vote, ties, _) in zip(raw, (left_out[i] for i in m.ids)))


def test_copy_of_a_toxic_example_of_rare_words_scores_high():
    rnd = random.Random(12)
    texts = [toxicity.Counter(f"x{rnd.randrange(3000)}" for _ in range(30)) for _ in range(400)]
    toxic = np.array([int(i % 4 == 0) for i in range(400)])
    for i in range(0, 400, 4):
        texts[i].update(["vile"] if i else [])
    m = toxicity._index(texts, toxic, np.arange(400), 0.25, 15)
    assert abs(m.nearest(*m.vector(texts[0]))[1][0] - 1) < 1e-9 and m.ids[m.nearest(*m.vector(texts[0]))[0][0]] == 0
    assert m.score(toxicity.Counter(["vile", "x1"]))[0] > 0.7 and m.score(toxicity.Counter(["x1", "x2"]))[0] < 0.3


def test_words_after_many_characters_teach(spark):
    data = [(i, "word " * 8000 + f"t{i} " + ("vile scum" if i % 2 else "kind deed")) for i in range(40)]
    model = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert model.score(toxicity.terms("vile"))[0] > 0.7 > 0.3 > model.score(toxicity.terms("kind"))[0]


def test_isotonic_rises():
    x, y = np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0.0, 1, 0, 1, 1])
    places, rates = toxicity.isotonic(x, y, np.ones(5))
    assert (np.diff(rates) >= 0).all() and (np.diff(places) >= 0).all() and rates[-1] == 1


def test_toxicity_held_out_and_odd_rows(spark, clashing, empty):
    rnd = random.Random(7)
    bad, fine = ["vile", "scum", "rotten"], [f"word{i}" for i in range(60)]
    data = [(i, " ".join(rnd.choices(fine, k=20) + (rnd.choices(bad, k=3) if i % 4 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(401, None), (None, 1)], "doc_id long, toxic int")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.filter(~out), labels.filter(~out))
    got = table(toxicity.score(docs.filter(out), model))
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and any(r["evidence"] for r in got)
    odd = table(toxicity.score(clashing, model))
    assert len(odd) == len(rows()) and not any(r["predicted"] for r in odd) and all(0 <= r["score"] <= 1 for r in odd)
    assert table(toxicity.score(empty, model)) == []
    none = toxicity.fit(empty, labels.limit(0))
    assert {r["score"] for r in table(toxicity.score(docs, none))} == {0.0}


# SpotSigs

def brute_sigs(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    anchors = {w for t in spotsigs.ANCHORS.values() for w in t.split()}
    content = [(i, w) for i, w in enumerate(words) if w not in anchors or i == len(words) - 1]
    place = {i: k for k, (i, _) in enumerate(content)}
    out = set()
    for i, w in enumerate(words[:-1]):
        if w in anchors:
            j = next(k for k in range(i + 1, len(words)) if k in place)
            if place[j] + 1 < len(content):
                out.add((w, content[place[j]][1], content[place[j] + 1][1]))
    return out or {tuple(words)}


def test_fingerprints_against_brute_force(docs, clashing, empty, spark):
    got = sorted(table(spotsigs.fingerprints(clashing)), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -1), r["n_chars"]))
    data = sorted(rows(), key=lambda d: (-(d[0] if d[0] is not None else -1), len(d[1] or "")))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for k, (r, d) in enumerate(zip(got, data)):
        text, following = d[1] or "", data[(k + 1) % len(data)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert r["doc_id"] == d[0] and r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(brute_sigs(text), brute_sigs(edited)))
        assert r["near_next"] == pytest.approx(jaccard(brute_sigs(text), brute_sigs(following)))
    assert got[data.index(next(d for d in data if d[0] == 1))]["fingerprint"] == got[data.index(next(d for d in data if d[0] == 2))]["fingerprint"]
    assert table(spotsigs.fingerprints(empty)) == []
    one = table(spotsigs.fingerprints(docs.filter("doc_id = 1")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_similar_sets_against_brute_force(spark, clashing, empty, least):
    rnd = random.Random(9)
    base = [" ".join(f"the word{rnd.randrange(50)} thing{k}" for k in range(n)) for n in (3, 6, 10, 20, 40) for _ in range(4)]
    texts = base + [" ".join(w if rnd.random() > p else f"new{rnd.randrange(99)}" for w in t.split()) for t in base for p in (0.02, 0.1)] + base[:3]
    data = list(enumerate(texts))
    got = {(r["class_a"], r["class_b"]): r["jaccard"] for r in spotsigs.similar(spark.createDataFrame(data, "doc_id long, text string"), least).collect()}
    sets = {}
    for i, t in data:
        sets.setdefault(frozenset(brute_sigs(t)), i)
    items, want = list(sets.items()), {}
    for x, (a, i) in enumerate(items):
        for b, j in items[x + 1:]:
            if len(a & b) / len(a | b) >= least:
                want[min(i, j), max(i, j)] = len(a & b) / len(a | b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    if least == 0.8:
        assert len(want) > 5
        rows_ = {r["doc_id"]: (r["class_id"], r["links"]) for r in spotsigs.linked(clashing, least).collect()}
        assert rows_[2][0] == 1 and len(rows_) == len({d[0] for d in rows()})
        assert spotsigs.similar(empty).count() == 0 and spotsigs.linked(empty).count() == 0


# Token files

def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(WORD_FILE), random.Random(1)
    parts = ["a", "B", "é", "É", "'s", "'", "re", ".", " ", "\n", "\x0b", "\x85", " ", "1", "²", "<|endoftext|>", "<|", "<|ENDOFTEXT|>", "İ", "ß", "...", ",", "́", "漢", "-", "T", "\0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    e = token_files.WordEncoder(t, max_chars=500)
    for at in range(0, 4000, 500):
        ids, sizes = e.encode(pa.array(texts[at:at + 500]))
        for x, part in zip(texts[at:at + 500], np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == t.encode(x, add_special_tokens=False).ids


def test_files_round_trip(clashing, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_FILE)
    folder = f"file://{tmp_path}/tokens"
    index = token_files.write(clashing, WORD_FILE, folder, sequence=16)
    got = sorted(table(token_files.read(index, folder)), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == len(rows())
    start, left = 0, [(d[0], t.encode(d[1] or "", add_special_tokens=False).ids + [2]) for d in rows()]
    for r in got:
        mine = next(x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array(x[1], "<u4").tobytes()) == r["ids_crc32"])
        left.remove(mine)
        assert (r["start"], r["n_tokens"]) == (start, len(mine[1]))
        start += len(mine[1])
    files = sorted(tmp_path.glob("tokens/*.arrow"))
    batch = pa.ipc.open_file(pa.memory_map(str(files[0]))).get_batch(0)
    assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 16) and not list(tmp_path.glob("tokens/.part*"))
    assert table(token_files.round_trip(empty, WORD_FILE)) == []


# SimHash

def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_groups(clashing, empty):
    got = table(simhash.near_duplicates(clashing))
    want = {d: brute_simhash(t) for d, t, *_ in rows() if d not in (6, None)}
    for r in got:
        if r["doc_id"] in want:
            assert r["fp"] & (2**64 - 1) == want[r["doc_id"]]
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[2] == 1 and comp[5] == 4 and comp[9] == 4 and comp[6] == 6
    long = " ".join(f"Word{i * i % 7919}" for i in range(140_000))  # more shingles than are summed at once, twice over
    assert simhash.simhash(long) == brute_simhash(long) and simhash.simhash(rows()[5][1]) == brute_simhash(rows()[5][1])
    assert table(simhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("tile", [2, 8, 1024])
def test_links_against_brute_force(spark, tile):
    rnd = random.Random(tile)
    fps = list({rnd.getrandbits(64) for _ in range(40)})
    for base in fps[:6]:  # chains and balls
        for _ in range(25):
            base ^= 1 << rnd.randrange(64)
            fps.append(base)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5) if a != b]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "id long, fp long")
    from driftcast.llm.common import components

    got = {r["node"]: r["root"] for r in components(simhash.links(nodes, tile=tile)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps)


def test_components_of_a_long_chain(spark):
    from driftcast.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(5000, 5001), (7, 7)] + [(6000, 6001 + i) for i in range(500)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(3001)) and got[5001] == 5000 and all(got[6001 + i] == 6000 for i in range(500)) and len(got) == 3001 + 2 + 501
    assert components(edges.limit(0)).count() == 0


def test_batches_are_cut_without_a_session_setting(spark):
    from driftcast.llm.common import map_batches

    before = {k: v for k, v in spark.conf.getAll.items() if "arrow" in k.lower()}

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    df = spark.range(3000).select(F.repeat(F.lit("x"), 2000).alias("t")).union(spark.range(1).select(F.repeat(F.lit("y"), 500_000)))
    got = map_batches(df, run, "n long, size long", 100_000).collect()
    assert sum(r["n"] for r in got) == 3001 and all(r["size"] <= 100_000 or r["n"] == 1 for r in got)
    assert {k: v for k, v in spark.conf.getAll.items() if "arrow" in k.lower()} == before


@pytest.mark.parametrize("name", ["op2_decontamination", "op4_line_dedup", "op6_mixing"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    from driftcast.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = c.execute(ORACLES[name])
    cols = [x[0] for x in got.description]
    want = sorted(tuple(map(str, r)) for r in got.fetchall())
    rows_ = QUERIES[name](spark, sf).collect()
    assert want and sorted(tuple(str(r[k]) for k in cols) for r in rows_) == want
