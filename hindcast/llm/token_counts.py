"""Token counts per document with a whole-token shortcut (operator 1).

Most pre-tokens of ordinary text are themselves vocabulary strings. Which of them the merges
really turn into one token is proved once, on the driver, by merging every vocabulary string;
those pre-tokens count as one by a single lookup. Only the rest is merged, by the merge step of
the tokenizer's own model.

Edge cases: null and empty texts count 0 tokens and 0 bytes; repeated rows are counted one by
one; strings of added tokens inside a text are one token each, as the library does by default;
very long texts are counted in blocks that end where a pre-token must end; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hindcast.llm import bpe
from hindcast.llm.common import bounded_batches, id_and_text, in_blocks, table
from hindcast.llm.registry import query

#: fixed value: how byte-level vocabularies of this kind cut text before merging
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
MEMO_PIECES = 400_000
_WORKERS: dict[int, "Counter"] = {}


@dataclass
class Vocabulary:
    """What a worker needs: size bounded by the vocabulary, whatever the corpus."""

    model: str
    whole: list[str]
    added: list[str]
    doubtful: str


def prove_whole_tokens(path: str) -> Vocabulary:
    """Merge every vocabulary string on its own and keep those that end as the one token they name."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    model = json.loads(text)
    merges = bpe.Merges(model["model"]["merges"])
    whole = []
    for token in model["model"]["vocab"]:
        piece = bpe.unspell(token)
        if piece and merges.apply(token) == [token]:
            whole.append(piece)
    doubtful = bpe.doubtful(Tokenizer.from_str(text), PIECES.findall)
    return Vocabulary(text, whole, [t["content"] for t in model["added_tokens"]], doubtful)


class Counter(dict):
    """Tokens per pre-token: 1 for proven ones, merged and remembered for the rest."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.whole = vocabulary.whole
        self.tokenizer = Tokenizer.from_str(vocabulary.model)
        self.merge = self.tokenizer.model.tokenize
        self.limit = len(self) + MEMO_PIECES
        self.doubtful = re.compile(vocabulary.doubtful)
        self.added = regex.compile("|".join(regex.escape(t) for t in vocabulary.added)) if vocabulary.added else None

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(bpe.spell(piece)))
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text.isascii() and self.doubtful.search(text):  # newer letters: ask the library
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            for block in in_blocks(part):
                total += sum(map(self.__getitem__, PIECES.findall(block)))
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one pass over the texts, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hash((vocabulary.model, len(vocabulary.whole)))

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        known = shared.value
        counter = _WORKERS.get(key)
        if counter is None:
            counter = _WORKERS[key] = Counter(known)
        return texts.map(counter.count).astype("int64")

    counted = id_and_text(docs).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), prove_whole_tokens(public_tokenizers.path("byte_bpe_50k.json")))
