"""Benchmark decontamination by shared seeds and Smith-Waterman alignment (operator 9).

Items and documents are sequences of lower-case words. Runs of four words of the items are the seeds;
a Bloom filter of fixed size over them lets the one pass over the documents keep only the stretches
around possible seeds. A stretch that shares any seed with an item is aligned with it
(match 2, other word -1, gap -1), so copies with words changed, added or left out score nearly as
high as exact ones. A pair goes unaligned only where too few of the item's words are there for the score.
A row of the result is a document and an item whose best alignment reaches half the item's full score;
a copy that keeps no run of four words of its item is not found.

Edge cases: null, empty and short texts have no seeds; items of fewer than four words are one seed, which
only documents of the same few words share; repeated rows and several stretches of a document give one
row per document and item, the best (ties: the first in the text); a null doc_id is carried along, a null
item_id likewise; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import WordHashes, bounded_batches, id_and_text, lower_words, materialize, mix, shingle_hashes, table
from hindcast.llm.registry import query

SEED_WORDS = 4
#: bits of the Bloom filter over all seeds: its size is fixed, a larger benchmark only lets more stretches through
FILTER_BITS = 1 << 23
MATCH, OTHER, GAP = 2, -1, -1
LEAST_RATIO = 0.5
_WORDS = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    return _WORDS.of(lower_words(text))


def filter_places(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter per seed."""
    spread = mix(seeds)
    return (seeds % np.uint64(FILTER_BITS)).astype(np.int64), (spread % np.uint64(FILTER_BITS)).astype(np.int64)


def _item_parts(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = word_hashes(text)
        seeds = shingle_hashes(words, SEED_WORDS)
        places = np.unique(np.concatenate(filter_places(seeds)))
        rows.append((words.view(np.int64), seeds.view(np.int64), places))
    return pd.DataFrame(rows, columns=["words", "seeds", "places"])


def stretches(words: np.ndarray, flags: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, words, seed places, seeds) around possible seeds; ``reach`` words on either side go along."""
    seeds = shingle_hashes(words, SEED_WORDS)
    if len(seeds) == 0:
        return
    a, b = filter_places(seeds)
    hits = np.flatnonzero(flags[a] & flags[b])
    if len(hits) == 0:
        return
    for group in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
        start = max(0, int(group[0]) - reach)
        end = int(group[-1]) + SEED_WORDS + reach
        yield start, words[start:end], group, seeds[group]


def align(words: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of an item: score, first and one past the last word, equal words."""
    n, m = len(words), len(item)
    table_ = np.zeros((m + 1, n + 1), dtype=np.int32)
    steps = np.arange(n + 1, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        above = table_[i - 1]
        row = table_[i]
        np.maximum(above[:-1] + np.where(words == item[i - 1], MATCH, OTHER), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        # a gap along the text costs the same per word, so a running maximum carries it
        row[:] = np.maximum.accumulate(row + steps) - steps
    end = int(np.argmax(table_.max(axis=0)))
    i, j = int(np.argmax(table_[:, end])), end
    score, equal = int(table_[i, j]), 0
    while i > 0 and j > 0 and table_[i, j] > 0:
        same = words[j - 1] == item[i - 1]
        if table_[i, j] == table_[i - 1, j - 1] + (MATCH if same else OTHER):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif table_[i, j] == table_[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, j, end, equal


def best_alignment(words: np.ndarray, item: np.ndarray, least_ratio: float) -> tuple[int, int, int, int]:
    """The best of ``align``, or zeros if none reaches ``least_ratio``; memory stays at a few times the item squared.

    An alignment above zero covers less than three times the item's length (each gap costs half of what an equal
    word gains), so blocks that overlap by as much hold each one whole. Without enough words of the item, every one
    equal, a block cannot reach the ratio and is left out.
    """
    m, best = len(item), (0, 0, 0, 0)
    for begin in range(0, max(1, len(words) - 3 * m), 5 * m):
        block = words[begin : begin + 8 * m]
        if np.count_nonzero(np.isin(item, block)) < least_ratio * m:
            continue
        score, first, end, equal = align(block, item)
        if score > best[0]:
            best = (score, begin + first, begin + end, equal)
    return best


def _aligner(least_ratio: float):
    def aligned(words: pd.Series, start: pd.Series, low: pd.Series, high: pd.Series, item: pd.Series) -> pd.DataFrame:
        """Align around the diagonals of the seeds, with half an item's length to spare."""
        rows = []
        for w, s, a, b, t in zip(words, start, low, high, item):
            w, t = np.asarray(w), np.asarray(t)
            spare = len(t) // 2 + SEED_WORDS
            begin = max(0, a - s - spare)
            score, first, end, equal = best_alignment(w[begin : b - s + len(t) + spare], t, least_ratio)
            rows.append((score, score / (MATCH * len(t)), s + begin + first, s + begin + end, equal))
        return pd.DataFrame(rows, columns=["score", "ratio", "word_start", "word_end", "equal_words"])

    return aligned


ALIGNED = "score long, ratio double, word_start long, word_end long, equal_words long"
STRETCH = "doc_id long, start int, words array<long>, places array<int>, seeds array<long>"


def contaminated(docs: DataFrame, benchmark: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """doc_id, item_id, n_seeds, score, ratio, word_start, word_end, equal_words of every copied item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = F.pandas_udf(_item_parts, "words array<long>, seeds array<long>, places array<long>")
    items = materialize(id_and_text(benchmark, "item_id").select(F.col("doc_id").alias("item_id"), parts("text").alias("p")).select("item_id", "p.*"))
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    # at most FILTER_BITS / 64 rows, whatever the benchmark
    word, bit = F.shiftright("place", 6), F.col("place").bitwiseAND(63).cast("int")
    bits = items.select(F.explode("places").alias("place")).groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("v")).collect()
    filled = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in bits:
        filled[row.w] = row.v
    shared = spark.sparkContext.broadcast(filled.tobytes())

    def keep_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            rows = [
                (doc_id, start, words.view(np.int64), places.astype(np.int32), seeds.view(np.int64))
                for doc_id, text in zip(batch["doc_id"], batch["text"])
                for start, words, places, seeds in stretches(word_hashes(text), flags, reach)
            ]
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "words", "places", "seeds"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    key = F.xxhash64("doc_id", "start", "words").alias("key")
    kept = materialize(id_and_text(docs).mapInPandas(keep_stretches, STRETCH).select("*", key).dropDuplicates(["doc_id", "key"]))
    hits = kept.select("doc_id", "key", F.explode(F.arrays_zip("places", "seeds")).alias("h")).select(
        "doc_id", "key", F.col("h.places").alias("place"), F.col("h.seeds").alias("seed")
    )
    own = items.select("item_id", F.posexplode("seeds").alias("item_place", "seed"))
    diagonal = F.col("place") - F.col("item_place")
    met = hits.join(own, "seed").groupBy("doc_id", "key", "item_id").agg(
        F.count("*").alias("n_seeds"), F.min(diagonal).alias("low"), F.max(diagonal).alias("high")
    )
    aligned = F.pandas_udf(_aligner(least_ratio), ALIGNED)
    scored = (
        met.drop("doc_id").join(kept.select("doc_id", "key", "start", "words"), "key")
        .join(items.select(F.col("item_id").alias("_item"), F.col("words").alias("item_words")), F.col("item_id").eqNullSafe(F.col("_item")))
        .select("doc_id", "item_id", "n_seeds", aligned("words", "start", "low", "high", "item_words").alias("a"))
        .select("doc_id", "item_id", "n_seeds", "a.*")
        .filter(F.col("ratio") >= least_ratio)
    )
    best = F.max_by(F.struct("n_seeds", "score", "ratio", "word_start", "word_end", "equal_words"), F.struct("score", -F.col("word_start")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a copied benchmark item go."""
    # the verdict follows from the text alone, so a hash of it names the rows, whatever their ids
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    by_text = docs.select(mark.alias("doc_id"), "text")
    gone = contaminated(by_text, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, mark == gone._gone, "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
