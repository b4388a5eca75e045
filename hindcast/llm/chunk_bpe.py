"""BPE encoding and decoding that encodes shared passages once (operator 5).

Texts are cut where a rolling hash over 32 bytes hits a pattern, so equal passages give equal chunks
wherever they stand. Documents that share content are dealt to the same tasks, by their smallest chunk
hash (a hash that is frequent in one task is spread over several places, eight documents each), and there
each distinct chunk is encoded once. A chunk keeps the ids of its whole words only; the text around each cut is encoded
again together with the last word before and the first word after it. A join stands if both words
come out with the ids they had in their chunks; otherwise the document is encoded as a whole, which
is where the widening ends.

The ids are those of the tokenizers library for the whole text, the decoded text that of its
``decode``. Chunks are remembered per task in a bounded memo, so a chunk in several tasks
is encoded once in each.

Edge cases: null and empty texts have 0 tokens and hashes of the empty string; repeated rows are
encoded from the same chunks; texts without white space are one join; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hindcast.llm import bpe
from hindcast.llm.common import bounded_batches, id_and_text, mix, table
from hindcast.llm.registry import query

WINDOW = 32
#: a cut about every 1,024 bytes, chunks of 256 to 8,192 bytes
CUT_MASK = np.uint32((1 << 10) - 1)
LEAST, MOST = 256, 8192
MEMO_TOKENS = 4_000_000
MEMO_PIECES = 400_000
#: documents of one task that go to the same place for a chunk they share
TOGETHER = 8
#: fixed value: how this vocabulary cuts text into pieces; what is in no piece is dropped
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: the same for texts of ASCII alone
ASCII_PIECES = re.compile(r"""[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t-\ra-z0-9]+""")
#: only these separate words for sure: the tokenizer drops them and merges nothing across
SPACE = " \n"
_WORKERS: dict[int, "Encoder"] = {}


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at every position, by doubling the window five times."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def cut_chunks(text: str, stretch: int = 1 << 20) -> list[str]:
    """Content-defined chunks of a text; joined they are the text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    hits: list[int] = []
    for start in range(0, len(data), stretch):
        before = min(start, WINDOW - 1)
        h = rolling(data[start - before : start + stretch])[before:]
        hits += (np.flatnonzero((h & CUT_MASK) == 0) + start + 1).tolist()
    hits.append(len(data))
    cuts, at = [], 0
    for hit in hits:
        while hit - at > MOST:
            at = _whole_character(raw, at + MOST)
            cuts.append(at)
        if hit - at >= LEAST or hit == len(data):
            at = _whole_character(raw, hit)
            cuts.append(at)
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *cuts], cuts) if b > a]


def _whole_character(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_hash(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def split_chunk(chunk: str) -> tuple[str, str, str]:
    """What touches the cut before, whole words with the space before them, what touches the cut after."""
    first = min((k for k in (chunk.find(c) for c in SPACE) if k >= 0), default=-1)
    last = max(chunk.rfind(c) for c in SPACE)
    if first < 0 or not chunk[first:last].strip():
        return chunk, "", ""
    return chunk[:first], chunk[first:last], chunk[last:]


def pieces_of(text: str) -> list[str]:
    """Composed, in lower case, cut into pieces. A sigma at the end of a word stays an ordinary one."""
    if text.isascii():
        return ASCII_PIECES.findall(text.lower())
    return PIECES.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())


class Encoder:
    """Encodes as the tokenizers library does, with a memo of pieces and one of chunks.

    The steps before the merges (composition, lower case, cutting into pieces) are those that the
    model file names; the tests hold them against the library over all of Unicode.
    """

    def __init__(self, model: str, doubtful: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.doubtful = re.compile(doubtful)
        described = json.loads(model)
        if described["decoder"] is not None or described["normalizer"]["normalizers"][0]["type"] != "NFC":
            raise ValueError("this tokenizer has steps that the chunked encoder does not know")
        size = self.tokenizer.get_vocab_size()
        self.names = [str(k) for k in range(size)]
        self.tokens = [self.tokenizer.id_to_token(k) for k in range(size)]
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.piece_memo: dict[str, tuple[int, ...]] = _Pieces(self.tokenizer.model)
        self.memo: dict[bytes, tuple] = {}
        self.size = 0
        self.encoded = self.reused = self.widened = 0

    def ids(self, text: str) -> array:
        """Ids of a text as a whole; by the library where its Unicode tables may differ."""
        if not text.isascii() and self.doubtful.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.cut_added.split(text) if "<|" in text else [text]
        out = array("I")
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(chain.from_iterable(map(self.piece_memo.__getitem__, pieces_of(part))))
        return out

    def learn(self, chunks: dict[bytes, str]) -> None:
        """Encode the whole words of chunks that are not known yet."""
        if self.size > MEMO_TOKENS:
            self.memo = {key: self.memo[key] for key in chunks if key in self.memo}
            self.size = sum(len(entry[2]) + 100 for entry in self.memo.values())
        for key, chunk in chunks.items():
            if key not in self.memo:
                head, body, tail = split_chunk(chunk)
                ids = self.ids(body)
                self.memo[key] = (head, tail, ids, *(self._anchors(body) if body else (None, None)))
                self.size += len(ids) + 100
                self.encoded += 1

    def _anchors(self, body: str) -> tuple:
        """The start of a body up to its first word and its end from its last word, each with its number of ids."""
        inner = body.strip(SPACE)
        lead, trail = len(body) - len(body.lstrip(SPACE)), len(body.rstrip(SPACE))
        stop = min((k for k in (inner.find(c) for c in SPACE) if k >= 0), default=len(inner))
        start = max(inner.rfind(c) for c in SPACE) + 1
        first, last = body[: lead + stop], body[trail - len(inner) + start :]
        return (first, len(self.ids(first))), (last, len(self.ids(last)))

    def encode(self, texts: list[str]) -> list[array]:
        chunked = [[(chunk_hash(c), c) for c in cut_chunks(text)] for text in texts]
        wanted = {key: c for chunks in chunked for key, c in chunks}
        self.learn(wanted)
        self.reused += sum(map(len, chunked))
        joins: list[str] = []
        plans = []
        for chunks in chunked:
            plan, carried, before = [], "", None
            for key, _ in chunks:
                head, tail, ids, first, last = self.memo[key]
                carried += head
                if first is None:
                    carried += tail
                    continue
                plan.append((before, len(joins), first, ids))
                joins.append((before[0] if before else "") + carried + first[0])
                before, carried = (*last, ids), tail
            plan.append((before, len(joins), None, None))
            joins.append((before[0] if before else "") + carried)
            plans.append(plan)
        repaired = [self.ids(join) for join in joins]
        out = []
        for text, plan in zip(texts, plans):
            whole = array("I")
            for before, k, first, ids in plan:
                got = repaired[k]
                n, m = (before[1] if before else 0), (first[1] if first else 0)
                agree = n + m <= len(got)
                agree = agree and (not n or got[:n] == before[2][-n:])
                agree = agree and (not m or got[len(got) - m :] == ids[:m])
                if not agree:
                    self.widened += 1
                    whole = self.ids(text)
                    break
                whole.extend(got[n : len(got) - m])
                if ids is not None:
                    whole.extend(ids)
            out.append(whole)
        return out

    def decode(self, ids: array) -> str:
        """As the library's decode: the model has no decoder, so tokens are joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Ids per piece, merged by the tokenizer's own model once and remembered up to a bound."""

    def __init__(self, model):
        super().__init__()
        self.merge = model.tokenize

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(token.id for token in self.merge(bpe.spell(piece)))
        if len(self) >= MEMO_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def by_shared_content(docs: DataFrame) -> DataFrame:
    """doc_id and text, documents with a chunk in common mostly in one partition."""

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        met: Counter = Counter()
        for texts in batches:
            keys = []
            for text in texts:
                least = min((chunk_hash(c)[:8] for c in cut_chunks(text)), default=b"")
                met[least] += 1
                # a passage that is frequent in this task goes on to further places
                keys.append((int.from_bytes(least, "little") + (met[least] - 1) // TOGETHER) & (2**63 - 1))
            yield pd.Series(keys, dtype="int64")

    return id_and_text(docs).withColumn("_near", place("text")).repartition("_near").drop("_near")


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. ``path`` names a tokenizer file on the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path, encoding="utf-8") as file:
        model = file.read()
    doubtful = bpe.doubtful(Tokenizer.from_str(model), pieces_of)
    shared, mark = spark.sparkContext.broadcast((model, doubtful)), hash(model)

    @F.pandas_udf(SCHEMA)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _WORKERS.get(mark) or _WORKERS.setdefault(mark, Encoder(*shared.value))
        name = encoder.names.__getitem__
        for texts in batches:
            ids = encoder.encode(texts.tolist())
            decoded = map(encoder.decode, ids)
            yield pd.DataFrame(
                {
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded],
                }
            )

    return by_shared_content(docs).select("doc_id", encode("text").alias("e")).select("doc_id", "e.*")


@query("op5_bpe_encoding")
def op5_bpe_encoding(spark, sf_dir):
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token ids of everything the stages before have kept."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
