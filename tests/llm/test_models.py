"""Language evidence, the Pitman-Yor model, binary search, archives and surrogates."""

import io
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers  # noqa: E402

from hindcast.llm import binary_search as bs  # noqa: E402
from hindcast.llm import language_evidence as le  # noqa: E402
from hindcast.llm import pitman_yor as py  # noqa: E402
from hindcast.llm import surrogates as su  # noqa: E402
from hindcast.llm import warc_archive as wa  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


# language identification


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_held_out_accuracy_without_and_against_declarations(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = le.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").selectExpr("doc_id AS id", "text", "CAST(NULL AS string) AS declared", "source AS host", "CAST(NULL AS string) AS suffix", "lang AS truth")
    truth = {r.id: r.truth for r in held.collect()}
    rows = le.identify(held, model).collect()
    assert sum(r.lang == truth[r.id] for r in rows) >= 0.99 * len(rows)
    assert all(r.kept for r in rows)
    wrong = held.withColumn("declared", held.truth.substr(2, 1))
    rows = le.identify(wrong, model).collect()
    assert sum(r.lang == truth[r.id] for r in rows) >= 0.97 * len(rows)


def test_host_and_declaration_decide_where_the_text_cannot(spark):
    rng = random.Random(1)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40))
    known = [(k, say("abcd"), "aa") for k in range(60)] + [(k + 60, say("wxyz"), "zz") for k in range(60)]
    model = le.fit(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    schema = "id long, text string, declared string, host string, suffix string, best int"
    rows = [(k, say("abcd"), "aa", "a.example", "example", 0) for k in range(80)] + [(k, say("wxyz"), "zz", "z.example", "example", 0) for k in range(100, 130)]
    rows += [(200, "mmm", None, "a.example", "example", 0), (201, "mmm", None, "z.example", "example", 0), (202, "mmm", "ZZ-x", None, None, 0), (203, "123 !", "aa", "a.example", None, 0), (204, None, None, None, None, 0)]
    got = {r.id: r for r in le.identify(spark.createDataFrame(rows, schema), model).collect()}
    assert got[200].lang == "aa" and got[201].lang == "zz" and got[202].lang == "zz"
    assert not got[203].kept and got[203].lang == "und" and not got[204].kept
    assert all(got[k].lang == "aa" for k in range(80))
    assert le.identify(spark.createDataFrame([], schema), model).count() == 0


def test_odd_documents_and_no_labels(spark):
    rows = le.identify_documents(helpers.documents(spark), helpers.documents(spark)).collect()
    assert len(rows) == len(helpers.ROWS)
    assert {r.doc_id for r in rows if not r.kept} == {2, 3, 4}
    bare = helpers.documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source")
    assert {r.doc_id for r in le.identify_documents(bare, bare).collect() if not r.kept} == {2, 3, 4}


def test_pages_use_markup_and_address(spark):
    docs = [(k, "the and of to in " * 5 if k % 2 else "der die und das ist " * 5, "en" if k % 2 else "de") for k in range(40)]
    pages = [(1, "http://a.example.de/x", '<html lang="de-AT"><script>the of</script><p>und das</p>'), (2, None, None), (3, "not a url", "<p>the of to</p>")]
    got = {r.page_id: r for r in le.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[1].lang == "de" and got[1].declared == "de" and not got[2].kept and got[3].lang == "en"


# language model


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = [b"", b"a", b"ab", b"abc", b"b" * 300]
    pair, _, symbol, starts = py.positions(words)
    assert list(np.diff(np.append(starts, len(symbol)))) == [1, 2, 3, 4, 301]
    codes, counts = np.unique(pair * py.SYMBOLS + symbol, return_counts=True)
    spelling = py.seat_spelling(rng, codes, counts, py.flat_spelling())
    assert np.allclose(spelling.one.sum(axis=1), 1)
    for context in (b"", b"a", b"bb", b"zz"):
        total = sum(math.exp(v) for v in spelling.log_probability([context + bytes([c]) for c in range(1, 256)]) - 0)
        assert 0 < total < 1
    one = spelling.log_probability(words)
    assert len(one) == len(words) and np.isfinite(one).all()


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(2)
    customers, weight, discount = 40, 3.0, 0.4
    tables = []
    for _ in range(4000):
        t = 1
        for seated in range(1, customers):
            t += rng.random() < weight / (weight + seated - discount * t)
        tables.append(t)
    drawn = py.seat(rng, np.full(4000, customers), np.full(4000, weight), discount)
    assert abs(drawn.mean() - np.mean(tables)) < 0.35
    assert (py.seat(rng, np.array([0, 1, 2]), np.full(3, 1e-300), 0.5) == [0, 1, 1]).all()


def test_documents_are_seated_one_by_one_as_in_a_plain_restaurant():
    rng = np.random.default_rng(3)
    customers, weight, documents = np.array([1, 2, 7, 40, 40]), np.array([5.0, 0.5, 1.5, 3.0, 1e-300]), np.array([6, 20, 9, 5, 4])
    plain = np.zeros((3000, 5))
    for k in range(5):
        at = np.arange(1, customers[k])
        opens = rng.random((3000, documents[k], len(at))) < weight[k] / (weight[k] + at)
        plain[:, k] = documents[k] + opens.sum(axis=(1, 2))
    drawn = np.array([py.seat_documents(rng, customers, documents, weight) for _ in range(3000)])
    assert (drawn[:, 0] == 6).all() and (drawn[:, 4] == 4).all()
    assert np.allclose(drawn.mean(axis=0), plain.mean(axis=0), rtol=0.01)
    assert np.allclose(drawn.std(axis=0), plain.std(axis=0), rtol=0.1)


def test_only_the_tables_of_documents_reach_the_corpus(spark):
    ids = [k for k in range(300) if zlib.crc32(str(k).encode()) % 7 != 2][:201]
    texts = [("often " * 200, False)] + [(f"spread filler{k % 9}", False) for k in ids[1:]] + [("spread " * 50, True)]
    model = py.train(spark.createDataFrame(texts, "text string, held_out boolean"))
    rows = {bytes(r.word): r for r in model.words.collect()}
    assert rows[b"often"].c == rows[b"spread"].c == 200
    share = {word: r.likely for word, r in rows.items()}
    # both occur 200 times, one of them in a single document, whose restaurant draws on the corpus far less often
    assert share[b"spread"] > 1.5 * share[b"often"]
    assert math.isclose(sum(share.values()) + model.unknown, 1, rel_tol=1e-9)


def test_a_document_restaurant_predicts_a_distribution():
    probability = np.array([0.5, 0.3, 0.2])
    for seen in ([], [0], [0, 0, 1], [2, 1, 2, 2]):
        before = py.document_score(np.array(seen), probability) if seen else 0.0
        total = sum(10 ** (py.document_score(np.array([*seen, w]), probability) - before) for w in range(3))
        assert abs(total - 1) < 1e-9


def plain_base(texts):
    split = {k: (t or "").encode().lower().split() + [b""] for k, t in texts}
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = Counter(w for k, t in texts if not held(k) for w in (t or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    return {k: (held(k), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for k, w in split.items()}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_scores_against_a_plain_count_and_the_base_score(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    rows = py.score_documents(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows(spark):
    rows = py.score_documents(helpers.documents(spark)).collect()
    want = plain_base([(r[0], r[1]) for r in helpers.ROWS])
    assert len(rows) == len(helpers.ROWS)
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and math.isfinite(r.score) for r in rows)
    assert py.score_documents(helpers.documents(spark, [])).count() == 0
    only_held = helpers.documents(spark, [(k, "a b", "en", "a", 1, 1, "", 1) for k in range(300) if zlib.crc32(str(k).encode()) % 7 == 2])
    assert {(r.base_score, r.n_known, r.train_tokens) for r in py.score_documents(only_held).collect()} == {(0.0, 0, 0)}


# binary codes


def brute(codes, k):
    out = set()
    for q, a in codes.items():
        if q % 100 == 0:
            near = sorted((int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum()), i) for i, b in codes.items() if i != q)
            out |= {(q, i, d, rank + 1) for rank, (d, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("bits", [8, 24, 40, 64])
def test_search_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(bs, "BLOCK_CODES", 100)
    monkeypatch.setattr(bs, "TILE_QUERIES", 2)
    rng = np.random.default_rng(bits)
    values = rng.normal(size=(420, bits))
    values[50:180] = values[300]  # a third of the rows share one code
    rows = [(k, [float(x) for x in v], 0, "x") for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, code string")
    got = {tuple(r) for r in bs.search_embeddings(frame).collect()}
    assert got == brute({k: np.packbits(v >= 0).tobytes() for k, v in enumerate(values)}, 10)


def test_search_on_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, -1.0, 1.0]), (0, [1.0, -1.0, 1.0]), (1, None), (None, [1.0, 1.0, 1.0]), (2, []), (3, [1.0, None, float("nan")]), (4, [0.5])]
    got = {tuple(r) for r in bs.search_embeddings(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, 3, 1, 1), (0, 4, 1, 2)}
    assert bs.search_embeddings(spark.createDataFrame([], schema)).count() == 0


# archives


def test_archive_round_trip_and_single_records():
    rng = random.Random(1)
    records = [wa.record("response", k, f"<urn:{k}>", "http://x/é\r\nX: y", b"<p>" + bytes(rng.choice(b"abc ") for _ in range(rng.randrange(3000))) + b"\r\n\r\n", "D", None) for k in range(300)]
    out = io.BytesIO()
    n, size = wa.write_archive(out, iter(records), train_bytes=100_000)
    raw = out.getvalue()
    assert n == 300 and size == len(raw) and raw[:4] == b"\x5d\x2a\x4d\x18"
    assert list(wa.read_archive(io.BytesIO(raw))) == records
    with pytest.raises(ValueError):
        list(wa.read_archive(io.BytesIO(raw[:-7])))
    few = io.BytesIO()
    wa.write_archive(few, iter(records[:2]))
    assert list(wa.read_archive(io.BytesIO(few.getvalue()))) == records[:2]
    assert list(wa.read_archive(io.BytesIO(b""))) == []
    fields, payload = wa.parse_record(records[5])
    assert fields["WARC-Source-Page"] == "5" and "X" not in fields and payload.endswith(b"\r\n\r\n")


def test_pages_with_equal_empty_and_long_payloads(spark):
    long = "ä" * 3_000_000
    rows = [(5, "u", "same", 1), (3, "v", "same", 1), (9, None, "same", 1), (1, "u", None, 1), (2, "u", "", 1), (7, "u", long, 1), (8, "u", long, 1), (4, "u", "one", 1), (None, "u", "one", 1), (6, "u", "six", 1), (6, "u", "six", 1)]
    got = sorted(map(tuple, wa.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string, least int")).collect()), key=str)
    least = {}
    for page_id, _, html, _ in rows:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    want = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        first = least[html or ""]
        want.append((page_id, len(data), wa.base32_sha1(data), *(("response", None) if page_id == first else ("revisit", first))))
    assert got == sorted(want, key=str)
    assert wa.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# surrogates

PERSONAL = "Mail jo.doe1@Mail.example.com, call +1 (017) 555-7713 or +1 017 555 7713. Mr. John Smith, Mr. SMITH. 4111 1111 1111 1111 97.51.17.173 123-45-6789 DE89 3704 0044 0532 0130 00 г-н Иван Петров"


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_type_format_and_coreference(spark):
    (row,) = su.replace_personal_data(spark.createDataFrame([(1, PERSONAL)], "doc_id long, text string"), "k1").collect()
    text = row.text
    for private in ("jo.doe1", "555", "Smith", "SMITH", "John", "4111", "97.51", "123-45", "3704", "Иван", "Петров"):
        assert private not in text
    one, two = re.search(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3} \d{3} \d{4})", text).group(0), None
    a, two = re.findall(r"\+1 [\d() -]+\d", one)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", two)
    first, last, again = re.search(r"Mr\. (\w+) (\w+), Mr\. (\w+)\.", text).groups()
    assert first in su.FIRST["m", "latin"] and again == last.upper()
    given = re.search(r"г-н (\w+) (\w+)", text)
    assert given[1] in su.FIRST["m", "cyrillic"] and re.fullmatch("[А-Яа-я]+", given[2])
    assert luhn(re.search(r"(?:\d{4} ){3}\d{4}", text)[0])
    assert re.search(r"\b\w{2}\.\w{3}\d\w*@mail\.example\.com", text) and re.search(r" 10\.\d+\.\d+\.\d+ ", text)
    (same,) = su.replace_personal_data(spark.createDataFrame([(7, PERSONAL)], "doc_id long, text string"), "k1").collect()
    (other,) = su.replace_personal_data(spark.createDataFrame([(7, PERSONAL)], "doc_id long, text string"), "k2").collect()
    assert same.text == text and other.text != text


def test_mailboxes_with_letters_of_any_script(spark):
    (row,) = su.replace_personal_data(spark.createDataFrame([(1, "à éau.34@mail3.example.com, Œil@b.fr!")], "doc_id long, text string")).collect()
    assert row.n_email == 2 and re.fullmatch(r"à [a-z]+\.\d\d\w*@mail\.example\.com, \w+@mail\.example\.fr!", row.text)


def test_surrogates_stay_distinct_where_there_are_few(spark):
    """More three-letter mailboxes and social security numbers than a single draw keeps apart."""
    rows = [(k, f"{k % 1000:03d}-{k // 1000:02d}-{k % 9:04d}") for k in range(20_000)]
    got = su.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    new = {r.text for r in got}
    assert len(new) == len({t for _, t in rows}) and not new & {t for _, t in rows}


def test_surrogates_on_odd_rows(spark):
    rows = [*helpers.ROWS, (70, PERSONAL, "en", "a", 1, 1, "", 1), (None, PERSONAL, "en", "a", 1, 1, "", 1), (71, "x@example.org " * 2000, "en", "a", 1, 1, "", 1)]
    got = su.replace_personal_data(helpers.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    out = {(r.doc_id, r.n_entities): r.text for r in got}
    assert all(out[doc_id, 0] == text for doc_id, text, *_ in helpers.ROWS)
    assert out[70, 10] == out[None, 10] and "x@example.org" not in out[71, 2000]
    assert su.replace_personal_data(helpers.documents(spark, [])).count() == 0


def test_no_python_on_the_executors(spark):
    plan = su.replace_personal_data(spark.createDataFrame([(1, PERSONAL)], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


KEPT_WHOLE = [
    "call +49 10.11.12.13.1.5.6.7 then bob@x.com THE END OF TEXT",
    "a@b.co+1 555 123 4567 10.0.0.1:8080 123-45-6789-1 4111111111111111x Mr. Ann",
    "+4412.34.56.78.9 555-123-4567-8 GB82WEST12345698765432Z (555) 123-4567",
]


def test_no_text_between_entities_is_lost(spark):
    rng = random.Random(5)
    bits = ["+49 ", "10.11.12.13", ".1", "555-123-4567", "123-45-6789", "4111 1111 1111 1111", "bob@x.com", "Mr. John Smith", " Smith", "GB82 WEST 1234 5698 7654 32", " ", "-", ".", "x", "(555) 123-4567", "\n", "Ω"]
    texts = KEPT_WHOLE + ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in su.replace_personal_data(docs, "k").collect()}
    for k, text in enumerate(texts):
        introduced = {m.group(0).split(". ", 1)[1] for m in re.finditer(r"Mr\. [A-Z][a-z]+(?: [A-Z][a-z]+){0,2}", text)}
        if introduced:  # then bare names change as well
            continue
        gaps = regex.split(su.ANY, text)
        at = 0
        for gap in gaps:  # what stands outside the entities is still there, in its order
            found = got[k].text.find(gap, at)
            assert found >= 0, (text, got[k].text)
            at = found + len(gap)
        assert got[k].n_entities == len(gaps) - 1 and got[k].text.endswith(gaps[-1])


def test_names_keep_their_surrogate_wherever_they_stand(spark):
    texts = ["Mr. John Smith came. John Smith left. Smith called. Smithson did not.", "Mr. Smith and Frau Schmidt met. Smith, Schmidt!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, second = (r.text for r in su.replace_personal_data(docs, "k").orderBy("doc_id").collect())
    new = re.match(r"Mr\. (\w+) (\w+) came\. (\w+) (\w+) left\. (\w+) called\. Smithson did not\.", first).groups()
    assert new[:2] == new[2:4] and new[1] == new[4] and "Smith" not in new and "John" not in new
    lone = re.match(r"Mr\. (\w+) and Frau (\w+) met\. (\w+), (\w+)!", second).groups()
    assert lone[:2] == lone[2:] and not {"Smith", "Schmidt"} & set(lone)


def test_country_codes_stay_and_accounts_stay_sound(spark):
    text = "+44 20 7946 0958, +351 912 345 678, +1 555 123 4567; GB82 WEST 1234 5698 7654 32, DE89370400440532013000"
    row = su.replace_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert re.match(r"\+44 \d\d \d{4} \d{4}, \+351 \d{3} \d{3} \d{3}, \+1 \d{3} \d{3} \d{4}; ", row.text) and row.n_phone == 3
    for account in re.findall(r"(?:GB|DE)\w\w(?: ?\w{4})+(?: ?\w{1,3})?", row.text):
        account = account.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_a_language_under_one_id_is_learned(spark):
    """Repeated ids used to leave a language without a single row to learn from."""
    for own in range(1, 6):
        rows = [(own, f"zwo drei vier fünf sechs sieben {k}", "xx") for k in range(3000)] + [(k, "one two three four five", "en") for k in range(50)]
        model = le.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        place = model.languages.index("xx")
        assert model.table[:, place].max() - model.table[:, place].min() > 1
