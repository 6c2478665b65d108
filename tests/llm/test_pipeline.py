"""The pipeline's stages and its run, against their operators' brute-force rules."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from driftcast.llm import language_id
from driftcast.llm.common import written

from .conftest import CLASHES, DOCS, EN, ITEM, rows
from .test_operators import brute_components, brute_simhash, low, table


def test_stages_keep_columns_and_bear_odd_rows(spark, clashing, empty, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, str(tmp_path))
        assert set(got.columns) == set(clashing.columns), name
        assert {tuple(r[c] for c in CLASHES) for r in got.collect()} == {tuple(f"own {c}" for c in CLASHES)}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_one_of_each_group_stays(spark, docs, tmp_path):
    got = [r["doc_id"] for r in table(corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)))]
    data = {d: brute_simhash(t) for d, t, *_ in rows() if d is not None}
    ids = sorted(data)
    roots = brute_components([data[i] for i in ids])
    assert sorted(got) == sorted({ids[r] for r in roots})


def cut(text, items):
    """The text without windows of the items, cut again until none is left; None if over half of its words are in windows."""
    first = True
    while True:
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))]
        words, hit = [low(text)[x:y] for x, y in at], set()
        for item in items:
            n = min(10, len(item))
            windows = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)}
            for j in range(len(words) - n + 1):
                if tuple(words[j:j + n]) in windows:
                    hit.update(range(j, j + n))
        if not hit:
            return text
        if first and len(hit) > len(words) / 2:
            return None
        first, out, k, done = False, [], 0, 0
        while k < len(words):
            if k in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                out.append(text[done:at[k][0]])
                done, k = at[end][1], end
            k += 1
        text = "".join(out) + text[done:]


def test_run_against_plain_loops(spark, benchmark, tmp_path):
    data = rows() + [(50, f"{EN} before it. {ITEM.upper()}! And after it the cat and the dog were in the house by the river again.", "en", "b", 9)]
    docs = spark.createDataFrame(data, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = written(stage(spark, stages, str(tmp_path)), name)
        steps[name] = [tuple(r) for r in stages.collect()]
    key = lambda r: repr(tuple(r))
    # Language: the classifier, one text after another.
    tools = language_id.Compressors(language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"), 5, 0))))
    want = [d for d in data if not tools.classify(d[1])[2]]
    assert sorted(steps["language_id"], key=key) == sorted(want, key=key)
    assert {1, 3, 6, 50} <= {d[0] for d in want} and not {4, 5, 9, 10} & {d[0] for d in want}
    # Near copies: of all pairs of exact similarity, the smallest id of each group.
    root, _ = five_word_groups([d[1] for d in want])
    best = {}
    for r, d in zip(root, want):
        if r not in best or (d[0] is None, d[0] or 0) < (best[r][0] is None, best[r][0] or 0):
            best[r] = d
    want = list(best.values())
    assert sorted(steps["near_copies"], key=key) == sorted(want, key=key) and len(want) < len(best) + 1 and 2 not in {d[0] for d in want}
    # Benchmark passages: cut by windows.
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r["text"])) for r in benchmark.collect() if r["item_id"] and r["text"]]
    new = [(d, cut(d[1], items)) for d in want]
    want = [d if t == d[1] else (d[0], t, d[2], d[3], len(t)) for d, t in new if t is not None]
    assert sorted(steps["decontamination"], key=key) == sorted(want, key=key) and any(d[0] == 50 and ITEM.upper() not in d[1] and d[1].startswith(EN) for d in want)
    # Mixing: each source's words against targets by repeated sharing.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken = {}, {}
    for d in want:
        total[d[3]] = total.get(d[3], 0) + size(d[1])
    for d in steps["mixing"]:
        taken[d[3]] = taken.get(d[3], 0) + size(d[1])
        assert any(w[0] == d[0] and w[1].startswith(d[1]) for w in want)
    names = sorted((x for x in total if x is not None)) + [None] * (None in total)
    weight, fixed = {x: k % 3 + 1 for k, x in enumerate(names)}, {}
    while True:
        free = [x for x in names if x not in fixed]
        rest = sum(total.values()) - sum(fixed.values())
        level = {x: rest * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if level[x] > 3 * total[x]]
        if not over:
            break
        fixed |= {x: 3 * total[x] for x in over}
    assert all(abs(taken.get(x, 0) - (fixed | level)[x]) <= 1 for x in names)
    # Token files: the tokenizer, in ascending order of ids.
    from tokenizers import Tokenizer

    t, got, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), table(corpus_pipeline.run(spark, str(tmp_path))), 0
    left = [(d[0], t.encode(d[1], add_special_tokens=False).ids + [2]) for d in steps["mixing"]]
    assert len(got) == len(left)
    for r in sorted(got, key=lambda r: r["start"]):
        mine = next(x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array(x[1], "<u4").tobytes()) == r["ids_crc32"])
        left.remove(mine)
        assert (r["start"], r["n_tokens"]) == (start, len(mine[1]))
        start += len(mine[1])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def five_word_groups(texts):
    """The index of the first text of each text's group, by all pairs of exact Jaccard."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))], pairs


def test_near_copies_of_five_words_go(spark):
    import random

    rnd, texts = random.Random(8), []
    for k in range(60):
        base = [f"w{k}x{rnd.randrange(500)}" for _ in range(rnd.randint(80, 300))]
        for edits in (0, 1, 2, 4, 8):
            own = list(base)
            for _ in range(edits):
                own[rnd.randrange(len(own))] = f"edit{rnd.randrange(10**6)}"
            texts.append(" ".join(own))
    want, pairs = five_word_groups(texts)
    assert len(pairs) > 100
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    got = {r["doc_id"] for r in stage(spark, docs, "").collect()}
    found = sum(j not in got or i not in got for i, j in pairs)
    print("recall of pairs", found / len(pairs))
    assert got == set(want)


def test_near_copies_keep_rows_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    data = [(1, a), (1, b), (None, c), (None, c), (None, d), (2, d), (1, a)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, a), (1, b), (None, c), (2, d)], key=repr)


def families(seed, count, size, edits, shared):
    """Versions of a text: each pair of twins shares some edits, so only twins are similar enough while all versions are near."""
    import random

    r = random.Random(seed)
    texts = []
    for f in range(count):
        base = [f"w{f}x{r.randrange(10**6)}" for _ in range(804)]
        for twin in range(size // 2):
            places = r.sample(range(5, 799, 7), shared + 2 * (edits - shared))
            both, own = places[:shared], (places[shared:edits], places[edits:])
            for k in (0, 1):
                words = list(base)
                for p in [*both, *own[k]]:
                    words[p] = f"e{f}t{twin}p{p}" if p in both else f"e{f}t{twin}k{k}p{p}"
                texts.append(" ".join(words))
    return texts


def test_no_link_is_lost_among_versions_of_a_text(spark):
    """Every pair of twins is one group although each has many nearer SimHashes that fail the exact test."""
    from driftcast.llm import similar

    texts = families(1, 3, 120, 12, 4) + families(2, 4, 20, 10, 5)
    sets = [similar.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if similar.jaccard(sets[i], sets[j]) >= 0.8:
                near += 1
                parent[root(j)] = root(i)
    got = {r["doc_id"]: r["group"] for r in similar.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert near >= 180 and len({root(i) for i in parent}) > 100
    names = {}
    for i in range(len(texts)):
        assert names.setdefault(root(i), got[i]) == got[i]
    assert len(set(names.values())) == len(names)


def test_near_pairs_and_exact_tests_against_loops():
    import numpy as np

    from driftcast.llm import similar

    rnd = np.random.default_rng(5)
    fp = rnd.integers(0, 2, (4, 90), np.uint64) * np.uint64(2**63 + 5) + rnd.integers(0, 2, (4, 90), np.uint64)
    root, size = rnd.integers(0, 6, 90), rnd.integers(50, 80, 90)
    gap = np.bitwise_count(fp[:, :, None] ^ fp[:, None, :]).sum(axis=0)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if gap[i, j] <= 4 and root[i] != root[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-9}
    got = [p for i, j in similar.near_to(fp, root, size, 4, 0.8, strip=300) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    sets = [np.unique(rnd.choice(np.arange(70, dtype=np.uint64), rnd.integers(0, 60))) for _ in range(40)]
    sets[1], sets[5] = sets[0], sets[4][:-1]
    i, j = np.triu_indices(40, 1)
    for some in (slice(None), slice(0, 50)):
        exact = [similar.jaccard(sets[x], sets[y]) >= 0.3 for x, y in zip(i[some], j[some])]
        assert similar.similar_pairs(sets, i[some], j[some], 0.3, columns=16).tolist() == exact and any(exact)


def test_nodes_meet_by_bands_of_their_simhash(spark):
    """The pairs of the tiles are those that agree on a band of the SimHash's bits, also where buckets are cut; no other hash of the text plays a part."""
    from driftcast.llm import similar

    rnd = np.random.default_rng(6)
    fp = np.repeat(rnd.integers(0, 1 << 63, (30, 4), np.uint64) * np.uint64(2) + np.uint64(1), 4, axis=0)
    fp ^= np.bitwise_or.reduce([np.uint64(1) << rnd.integers(0, 64, fp.shape, np.uint64) for _ in range(10)])
    count = similar.band_count(8)
    parts = fp.view(np.uint8)[:, :count]
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if (parts[i] == parts[j]).any()}
    assert 180 <= len(want) < 120 * 119 / 2
    nodes = spark.createDataFrame([(i, 50, [int(v) for v in f.view(np.int64)]) for i, f in enumerate(fp)] + [(500, 0, [0] * 4)], "node long, size long, fp array<long>")
    for tile in (2048, 3):
        met = {}
        for r in similar.tiles(nodes, tile=tile).collect():
            met.setdefault(r["group"], set()).add(r["node"])
        assert {(i, j) for g in met.values() for i in g for j in g if i < j} == want
        assert tile > 3 or sum(map(len, met.values())) > count * len(fp)
    keys = similar.band_keys(fp[:3], 13, 40)  # more bands than there are disjoint ones
    assert len(np.unique(keys >> 13)) == 40 and (keys[0] != keys[1]).any() and (similar.band_keys(fp[:1], 13, 40) == keys[:1]).all()


def test_bands_of_bits_bring_similar_sets_together():
    """All but about LOST of the pairs of the least similarity share a band and are within the radius; small sets, too."""
    from driftcast.llm import similar
    from driftcast.llm.simhash import radius_of, wide_simhash

    rnd = np.random.default_rng(7)
    radius = radius_of(similar.LEAST, 64 * similar.WIDE, similar.SLACK)
    for own, both in ((0, 4), (1, 8), (25, 200)):  # Jaccard 0.8
        lost = 0
        for _ in range(400):
            h = rnd.integers(0, 1 << 63, both + max(1, 2 * own), np.uint64)
            a, b = wide_simhash(h[:both + own]), wide_simhash(np.concatenate([h[:both], h[both + own:]]))
            keys = similar.band_keys(np.stack([a, b]), 8, similar.band_count(8))
            lost += not ((keys[0] == keys[1]).any() and int(np.bitwise_count(a ^ b).sum()) <= radius)
        assert lost <= 2
