"""Filter audit, hard negatives and prefix encoding against brute force and the tiktoken library."""

import hashlib
import os
import random
import re
import sys
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers  # noqa: E402

from hindcast.llm import filter_audit, hard_negatives, prefix_bpe  # noqa: E402
from hindcast.streaming.tables import parquet_stream  # noqa: E402

LABELS = "doc_id long, quality int, toxic int, part string"


def audit(docs, labels):
    """The audit by its definition, document by document and order by order."""
    good = {d for d, quality, _, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, bad, _ in labels if bad == 1 and d is not None}
    rows = []
    for doc_id, text, _, source, *_ in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs):
            fails.add("E")
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if name in r[1] and not r[1] & before]
                shares[part, name] += len(here)
                out[part, order, step] = (
                    sum(not r[1] & (before | {name}) for r in own), len(here), sum(name in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {name} for r in own), sum(r[2] for r in here), sum(r[3] for r in here),
                )
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


def as_dict(rows):
    return {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows
    }


def many_documents(rng):
    texts = [" ".join(rng.choice(["word", "Other", "3", "x#y", "Ä", "very"]) for _ in range(rng.choice([3, 150, 260]))) for _ in range(9)]
    texts += [" ".join(f"w{k}" for k in range(240)), " ".join(f"w{k}" for k in range(240)) + "\x1c", None, "", " \n"]
    ids = rng.sample(range(1000), 120)
    docs = [(i, rng.choice(texts), "en", rng.choice(["a", "b", None, ""]), 0, 1, "b", 1) for i in ids]
    docs += [docs[5], (docs[5][0], docs[5][1], "en", "c", 0, 1, "b", 1), (None, docs[5][1], "en", "a", 0, 1, "b", 1), (None, None, "en", "a", 0, 1, "b", 1)]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in rng.choices(ids, k=60)] + [(None, 1, 1, "x")]
    return docs, labels


def test_audit_retracts_across_batches_and_restarts(spark, tmp_path):
    docs, labels = many_documents(random.Random(3))
    source, root = str(tmp_path / "docs"), str(tmp_path / "state")
    known = spark.createDataFrame(labels, LABELS)
    for k in range(0, len(docs), 31):  # each run starts anew from its checkpoint
        helpers.documents(spark, docs[k : k + 31]).repartition(2).write.mode("append").parquet(source)
        filter_audit.stream_counters(parquet_stream(spark, source, 1), known, root)
    counters = filter_audit.part_counters(spark, root)
    changes = spark.read.parquet(f"{root}/changes")
    assert changes.filter("n < 0").count() > 0 and changes.select("batch").distinct().count() == 8
    assert as_dict(filter_audit.interactions(counters).collect()) == audit(docs, labels)


def test_audit_of_one_folder(spark, tmp_path):
    docs, labels = many_documents(random.Random(4))
    source = str(tmp_path / "docs")
    helpers.documents(spark, docs).repartition(3).write.parquet(source)
    rows = filter_audit.audit_filters(spark, source, spark.createDataFrame(labels, LABELS), batches=2).collect()
    assert as_dict(rows) == audit(docs, labels) and len(rows) == 600 * len({d[3] or "" for d in docs})
    empty = str(tmp_path / "none")
    helpers.documents(spark, []).write.parquet(empty)
    assert filter_audit.audit_filters(spark, empty, spark.createDataFrame([], LABELS)).count() == 0


def mined(rows, every, k, percent):
    """Hard negatives by their definition, in Python integers."""
    usable = {}
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        key = (label, vector)
        usable[vec_id] = min(usable.get(vec_id, key), key)
    whole = {i: (label, [int(np.floor(256 * x)) for x in vector]) for i, (label, vector) in usable.items()}
    out = set()
    for anchor, (label, own) in whole.items():
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(own, v)), i, other == label) for i, (other, v) in whole.items() if i != anchor]
        for minus, positive, _ in sorted(s for s in scored if s[2])[:k]:
            inside = sorted(s for s in scored if not s[2] and percent * -minus <= 100 * -s[0] <= 100 * -minus)
            out |= {(anchor, positive, rank, i, -minus, -m) for rank, (m, i, _) in enumerate(inside[:k], 1)}
    return out


@pytest.mark.parametrize("scale, percent", [(1, 80), (1, 10), (2.0**22, 50)])
def test_hard_negatives(spark, scale, percent):
    rng = random.Random(int(scale) + percent)
    rows = [(i, rng.randint(0, 2), [rng.choice([-1, 0, 1, 2]) * scale / 8 + 0.01 for _ in range(4)]) for i in range(-30, 170)]
    rows += [rows[40], (rows[41][0], rows[41][1] + 1, rows[41][2]), (500, 1, [0.5, 0.5]), (501, 1, []), (20, None, [0.1] * 4)]
    rows += [(None, 1, [0.1] * 4), (502, 1, None), (503, 1, [None, 0.1]), (504, 1, [float("nan"), 0.1]), (505, 1, [float("inf"), 0.1])]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, slot string, score int, rank int")
    clean = hard_negatives.clean_vectors(frame)
    for tile in (4096, 7):
        got = hard_negatives.mine(clean, F.col("id") % 10 == 0, 4, 4, percent, tile).collect()
        assert {tuple(r) for r in got} == mined(rows, 10, 4, percent) and len(got) == len(set(got)) > 0
    assert hard_negatives.mine(clean.limit(0), F.col("id") % 10 == 0).count() == 0


def test_combiner_keeps_the_best_per_slot():
    rng = np.random.default_rng(1)
    best, group, score = hard_negatives.Combiner(6, 3), rng.integers(0, 6, 500), rng.integers(0, 9, 500)
    for k in range(0, 500, 50):
        best.offer(group[k : k + 50], score[k : k + 50], np.arange(k, k + 50))
    wanted = [(g, -m, i) for g in range(6) for m, i in sorted((-s, i) for i, (o, s) in enumerate(zip(group, score)) if o == g)[:3]]
    assert list(zip(best.group, best.score, best.id)) == wanted


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.load_vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return prefix_bpe.Encoder(vocabulary)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {token: rank for rank, token in vocabulary.tokens.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


BITS = [" ", "  ", "\n", "\t", "a", "the", "ing", "tion", "'s", "'", "r", "e", "1", "!", "==", "\x1c", "\x85", "é", "漢", "՘", "<|endoftext|>", "x" * 50]


def test_ids_of_random_texts(encoder, library, vocabulary):
    rng, tokens = random.Random(7), list(vocabulary.tokens.values())
    for _ in range(4000):
        text = rng.choice(
            [
                "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))), b"".join(rng.choices(tokens, k=9)).decode("utf-8", "replace"),
                "".join(rng.choices("abcdefghij", k=30)), "".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(9)),
            ]
        )
        packed = encoder.encode(text)
        assert prefix_bpe.unpack(packed) == library.encode_ordinary(text), text
        assert encoder.decode(packed) == text.encode()


def test_all_letters_are_cut_as_the_library_does(encoder, library):
    for code in [*range(0xD800), *range(0xE000, 0x32000, 3)]:
        text = f"a{chr(code)} {chr(code)}1{chr(code)}!{chr(code)}"
        if library.encode_ordinary(text) != prefix_bpe.unpack(b"".join(map(encoder.__missing__, encoder.cutter.cut(text)))):
            raise AssertionError(hex(code))


@pytest.mark.parametrize("text", ["x" * 70_000, "ab" * 40_000, " " * 50_000, "漢字" * 9_000, "some words here\n" * 40_000])
def test_long_texts(encoder, library, text):
    assert prefix_bpe.unpack(encoder.encode(text)) == library.encode_ordinary(text)


def test_every_prefix_has_the_last_token_of_its_own_encoding(encoder):
    data, ranks = b" internationalisationingthe\xc3\xa9\xe6\xbc\xa2xxxxxxxx", encoder.merges.ranks
    table = prefix_bpe.PrefixTable(encoder.merges, data)
    for n in range(1, len(data) + 1):
        assert encoder.merges.tokens[table.last[n - 1]] == prefix_bpe.merge(data[:n], ranks)[0][-1]


def test_appends_and_edits_are_exact_and_local(encoder, library):
    rng = random.Random(11)
    for _ in range(600):
        held = prefix_bpe.EditableText(encoder, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))))
        for _ in range(4):
            start = rng.choice([len(held.text), rng.randint(0, len(held.text))])
            end, new = min(len(held.text), start + rng.choice([0, 0, 1, 5, 60])), "".join(rng.choices(BITS, k=rng.randint(0, 3)))
            wanted = held.text[:start] + new + held.text[end:]
            held.edit(start, end, new)
            assert held.text == wanted and prefix_bpe.unpack(held.ids()) == library.encode_ordinary(wanted)
    rng = random.Random(12)
    table = prefix_bpe.PrefixTable(encoder.merges, bytes(rng.choices(b"abcdefgh", k=50_000)))
    whole = table.filled
    table.edit(20_000, 20_003, b"zzz")
    assert table.filled - whole < 600
    assert table.last == prefix_bpe.PrefixTable(encoder.merges, table.data).last


def test_prefix_operator(spark, vocabulary, library):
    docs = helpers.documents(spark)
    rows = prefix_bpe.decode_documents(prefix_bpe.encode_documents(docs, vocabulary), vocabulary).collect()
    wanted = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(), len(library.encode_ordinary(r[1] or ""))) for r in helpers.ROWS)
    assert sorted((str(r.doc_id), hashlib.sha256(r.decoded).hexdigest(), len(r.ids) // 4) for r in rows) == wanted
    assert prefix_bpe.encode_documents(helpers.documents(spark, []), vocabulary).count() == 0
    edits = spark.createDataFrame([(1, "the quick fox", 4, 9, "slow"), (2, None, 5, 2, "new"), (3, "abc", None, None, None)], "doc_id long, text string, start int, end int, new string")
    got = {r.doc_id: prefix_bpe.unpack(r.ids) for r in prefix_bpe.encode_edited(edits, vocabulary).collect()}
    assert got == {k: library.encode_ordinary(t) for k, t in ((1, "the slow fox"), (2, "new"), (3, "abc"))}
