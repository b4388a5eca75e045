"""Token counts and BPE encoding against the tokenizers library."""

import hashlib
import os
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers  # noqa: E402

from hindcast.llm import bpe, chunk_bpe, token_counts  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
CODES = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.prove_whole_tokens(BYTE))


@pytest.fixture(scope="module")
def encoder():
    with open(WORD, encoding="utf-8") as file:
        model = file.read()
    return chunk_bpe.Encoder(model, bpe.doubtful(Tokenizer.from_str(model), chunk_bpe.pieces_of))


def test_every_whole_token_is_one_token_of_the_library(counter):
    library = Tokenizer.from_file(BYTE)
    assert len(counter.whole) > 49_000
    for text in counter.whole[::97]:
        assert len(library.model.tokenize(bpe.spell(text))) == 1


def test_merges_agree_with_the_library_on_short_and_long_pieces():
    import json

    with open(BYTE, encoding="utf-8") as file:
        merges = bpe.Merges(json.load(file)["model"]["merges"])
    library = Tokenizer.from_file(BYTE).model
    for piece in ["a", "thethe", "Ġinternational", "zq" * 9, "ab" * 40, "thationing" * 30]:
        assert merges.apply(piece) == [t.value for t in library.tokenize(piece)]


def test_counts_over_all_of_unicode(counter):
    texts = [f"the{c}the 1{c}2 !{c}{c}?  {c} a" for c in CODES]
    wanted = Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, wanted) if counter.count(t) != len(w.ids)] == []


def test_ids_over_all_of_unicode(encoder):
    texts = [f"a{c}b 1{c}2 !{c}{c}? {c}" for c in CODES]
    wanted = Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, wanted) if list(encoder.ids(t)) != w.ids] == []


def test_count_operator(spark):
    rows = token_counts.count_tokens(helpers.documents(spark), token_counts.prove_whole_tokens(BYTE), limit=20).collect()
    library = Tokenizer.from_file(BYTE)
    wanted = []
    for doc_id, text, *_ in helpers.ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.append((doc_id, len((text or "").encode()), n, n > 20))
    assert helpers.by_text([r.asDict() for r in rows]) == helpers.by_text(
        [dict(zip(("doc_id", "n_bytes", "n_tokens", "over_limit"), w)) for w in wanted]
    )
    assert token_counts.count_tokens(helpers.documents(spark, []), token_counts.prove_whole_tokens(BYTE)).count() == 0


@pytest.mark.parametrize("text", ["", "word", " a ", "one two\nthree " * 900, "x" * 20_000, ("é́ " + "ab" * 700) * 9, "a<|endoftext|>b " * 300])
def test_chunks_are_the_text_and_joins_are_repaired(encoder, text):
    assert "".join(chunk_bpe.cut_chunks(text)) == text
    library = Tokenizer.from_file(WORD)
    ids = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode([text])[0]
    assert list(got) == ids
    assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_equal_passages_are_encoded_once(encoder):
    passage = " ".join(f"word{k} comes" for k in range(3000))
    encoder.encode([passage])
    before = encoder.encoded
    encoder.encode(["Another start. " + passage])
    assert encoder.encoded - before <= 3


def test_a_wrong_join_widens_to_the_whole_text(encoder):
    text = "some words here " * 200
    key = chunk_bpe.chunk_hash(chunk_bpe.cut_chunks(text)[0])
    encoder.encode([text])
    head, tail, ids, first, last = encoder.memo[key]
    encoder.memo[key] = (head, tail, ids, first, (last[0], last[1] + 1))
    before = encoder.widened
    assert list(encoder.encode([text])[0]) == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    assert encoder.widened == before + 1
    encoder.memo.clear()


def test_encode_operator(spark):
    rows = chunk_bpe.encode_documents(helpers.documents(spark), WORD).collect()
    library = Tokenizer.from_file(WORD)
    wanted = []
    for doc_id, text, *_ in helpers.ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(wanted, key=str)
    assert chunk_bpe.encode_documents(helpers.documents(spark, []), WORD).count() == 0
