"""Near-duplicates, components, decontamination and the pipeline against brute force."""

import os
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers  # noqa: E402

import corpus_pipeline  # noqa: E402
from hindcast.llm import decontamination as dc  # noqa: E402
from hindcast.llm import language_evidence as le  # noqa: E402
from hindcast.llm import near_dedup as nd  # noqa: E402
from hindcast.llm.components import components  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """{id: smallest id reachable} over a dict of texts, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j > i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    rng.shuffle(chain)
    edges = spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 560)}, 8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    for share in (0.75, 0.8, 0.95):
        common = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, (2000 - len(common)) // 2, dtype=np.uint64)]) for _ in range(2))
        x, y = (nd.odd_sketch(nd.samples(s)).view(np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= nd.MOST_BITS


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def test_near_duplicates_with_a_group_that_is_not_a_star(spark):
    """Hundreds of copies edited to different degrees: many are linked with some others only."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(9999)}" for _ in range(120))
    texts = {k: edited(rng, base, rng.random() * 0.06) for k in range(1000, 1250)}
    texts |= {k: " ".join(f"v{rng.randrange(9999)}" for _ in range(50)) for k in range(40)}
    texts |= {50: "Only three words", 51: "only THREE words", 52: "", 53: " \n", 54: None, 55: base, 56: base.upper()}
    rows = [*texts.items(), (55, base), (None, base), (None, "x")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, sets = groups(texts)
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), want[row.doc_id], want[row.doc_id] == row.doc_id)
    assert len({want[k] for k in range(1000, 1250)}) > 3


def test_tiles_join_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 16)
    test_near_duplicates_with_a_group_that_is_not_a_star(spark)


def test_near_duplicates_on_odd_rows(spark):
    out = nd.near_duplicates(helpers.documents(spark)).collect()
    assert len(out) == len(helpers.ROWS) and [r.component_id for r in out if r.doc_id == 1] == [1, 1]
    assert nd.near_duplicates(helpers.documents(spark, [])).count() == 0


def smith_waterman(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = dc.MATCH if a[i - 1] == b[j - 1] else dc.OTHER
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] + dc.GAP, table[i][j - 1] + dc.GAP)
    return max(map(max, table))


def test_alignment_is_the_best_local_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(1, 25))
        score, first, end, equal = dc.align(a, b)
        assert score == smith_waterman(b, a)
        assert smith_waterman(a[first:end], b) == score and equal <= end - first


BENCH = "item_id long, text string, doc_id int, score string"


def test_edited_copies_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(f"b{rng.randrange(800)}" for _ in range(n))
    items = [(k, draw(rng.randrange(20, 50)), 0, "") for k in range(30)] + [(90, None, 0, ""), (91, "", 0, ""), (92, "two words", 0, "")]
    docs, want = [], set()
    for k in range(200):
        parts = [draw(rng.randrange(0, 200))]
        if k % 3 == 0:
            parts.append(edited(rng, items[k % 30][1], rng.choice([0, 0.1, 0.15])))
            want.add((k, k % 30))
        docs.append((k, " ".join([*parts, draw(30)])))
    docs += [(300, "Two  WORDS"), (301, None), (302, "")]
    want.add((300, 92))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(got) == len(found)
    texts, asked = dict(docs), {i: t for i, t, *_ in items}
    score = lambda d, i: smith_waterman(words(texts[d]), words(asked[i])) / (2 * len(words(asked[i])))
    assert all(score(*pair) >= 0.5 for pair in found)
    assert found <= want and all(score(*pair) < 0.6 for pair in want - found)


def test_edited_copies_are_found_beside_an_exact_one(spark):
    item = [f"e{k}" for k in range(10)]
    one_changed = [item[:k] + ["other"] + item[k + 1 :] for k in (2, 4, 5, 7)]
    docs = [(k, " ".join(["a", *copy, "z"])) for k, copy in enumerate([item, *one_changed, item[:7] + item[8:]])]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item), 0, "")], BENCH)).collect()
    assert {r.doc_id: r.score for r in got} == {0: 20, 1: 17, 2: 17, 3: 17, 4: 17, 5: 17}
    two = spark.createDataFrame([docs[0], docs[3]], "doc_id long, text string")
    assert {r.doc_id for r in dc.contaminated(two, spark.createDataFrame([(1, " ".join(item), 0, "")], BENCH)).collect()} == {0, 3}


def test_blocks_of_a_long_text_align_as_the_whole():
    rng = np.random.default_rng(6)
    for _ in range(40):
        item = rng.integers(0, 40, rng.integers(4, 12))
        text = np.concatenate([rng.integers(0, 90, rng.integers(0, 200)), item[rng.random(len(item)) < 0.9], rng.integers(0, 90, rng.integers(0, 200))])
        whole, parts = dc.align(text, item), dc.best_alignment(text, item, 0.5)
        assert parts == whole if whole[0] >= len(item) else parts[0] < len(item)


def test_a_passage_in_a_third_of_the_documents_is_found_in_each(spark):
    item = " ".join(f"q{k}" for k in range(25))
    docs = [(k, f"a{k} b{k} c{k} {item if k % 3 == 0 else ''} d{k}") for k in range(300)]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item, 0, "")], BENCH)).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 300, 3)) and {r.ratio for r in got} == {1.0}


def test_decontamination_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, helpers.ROWS[0][1], 0, ""), (None, "null ids keep their texts", 0, "")], BENCH)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(helpers.documents(spark), bench).collect()}
    assert got == {(1, 1), (None, None)}
    assert dc.contaminated(helpers.documents(spark, []), bench).count() == 0
    assert dc.contaminated(helpers.documents(spark), bench.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_pipeline_against_brute_force(spark):
    """Stages two to five recomputed plainly from what the first stage keeps."""
    import hashlib

    import public_tokenizers
    from test_secrets import plain_scan
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = {r.doc_id: r.text for r in le.keep_identified(spark, docs, SF_DIR).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert set(first) == lettered
    top, _ = groups(first)
    items = [words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    seeds = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in items]
    kept = {}
    for doc_id, text in first.items():
        if top[doc_id] != doc_id:
            continue
        w = words(text)
        own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        if any(own & s and smith_waterman(w, i) >= len(i) for s, i in zip(seeds, items)):
            continue
        spans, out, done = plain_scan(text), [], 0
        for _, start, end in spans:
            if start >= done:
                out += [text[done:start], "[SECRET]"]
            done = max(done, end)
        kept[doc_id] = "".join(out) + text[done:]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in kept.items():
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want and 0 < len(want) < len(first)


def test_pipeline_bears_odd_rows(spark, tmp_path):
    helpers.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six", 0, "")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe_encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id is None for r in left) == [False] * 4 + [True]


def test_stages_judge_rows_without_a_usable_id(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(12))
    english = "the quick brown fox jumps over the lazy dog and runs away from the hunter "
    rows = [(i, english * 3, "en", "a", 1, 0, "", 0) for i in (None, None, 7)]
    spark.createDataFrame([(1, item, 0, "")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked = [(i, f"x {item} y", "en", "a", 1, 0, "", 0) for i in (None, 7)]
    stages = dict(corpus_pipeline.STAGES)
    left = stages["decontamination"](spark, helpers.documents(spark, rows + leaked), str(tmp_path)).collect()
    assert len(left) == 3 and not any(item in r.text for r in left)
    nothing = [(i, "", None, "odd", 0, 0, "", 0) for i in (None, 7)]
    left = stages["language_id"](spark, helpers.documents(spark, rows + nothing), str(tmp_path)).collect()
    assert len(left) == 3 and all(r.text for r in left)
