"""Near-duplicate groups by MinHash with odd sketches (operator 7).

One pass over the texts gives every document its set of 5-word shingles as 128 MinHash samples, 32
bands of four of them, and an odd sketch: the samples folded into 1,024 parity bits, so that the
population count of two sketches' XOR estimates how many samples differ. Documents with the same set
are one class from then on. Classes that share a band are candidates; sketches sort out those that
cannot reach the threshold; the full sets decide.

Candidates come in two rounds, so that a band with thousands of members never turns into rows of all its
pairs: first every member against the smallest of its band; then, once the confirmed links are merged, bands
that still hold several components are joined into groups, and those are compared in tiles of bounded size,
each of which returns only links that join what is still apart. A pair at the threshold of 0.75 shares
no band with a probability of 5e-6 and is turned away by its sketch (taken as hopeless below an
estimate of 0.5) with about 1e-6.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer
than five words have one shingle, the whole sequence; repeated rows share a class; rows with the same
doc_id count as one document; rows without a doc_id are linked with nothing and kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import WordHashes, bounded_batches, id_and_text, lower_words, materialize, mix, shingle_hashes, table
from hindcast.llm.components import components
from hindcast.llm.registry import query

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: members of one tile, on average
TILE = 512
#: XOR population count of two sketches whose estimate is still 0.5
MOST_BITS = math.floor(SKETCH_BITS / 2 * (1 - math.exp(-2 * SAMPLES / SKETCH_BITS)))
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(1000, 1000 + SAMPLES, dtype=np.uint64))
_WORDS = WordHashes()

FEATURES = "n_shingles long, digest binary, bands array<long>, sketch array<long>"


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(_WORDS.of(lower_words(text)), WORDS))


def samples(shingles: np.ndarray, stretch: int = 2048) -> np.ndarray:
    """The smallest value of each of the 128 hash functions."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), stretch):
            part = shingles[start : start + stretch, None] * _FACTORS[None, :]
            np.minimum(least, part.min(axis=0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            total = mix(total * np.uint64(31) + least[k::ROWS])
    return total.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    with np.errstate(over="ignore"):
        place = mix(least ^ _SALTS) % np.uint64(SKETCH_BITS)
    parity = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            shingles = shingle_set(text)
            if len(shingles) == 0:
                rows.append((0, b"", [], []))
                continue
            least = samples(shingles)
            digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
            rows.append((len(shingles), digest, bands_of(least), odd_sketch(least)))
        yield pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sketch"])


@lru_cache(maxsize=128)
def _remembered_set(text: str) -> np.ndarray:
    return shingle_set(text)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _alike(left: pd.Series, right: pd.Series) -> pd.Series:
    """100 * intersection >= 75 * union, on the full sets."""

    return pd.Series([alike(_remembered_set(a), _remembered_set(b)) for a, b in zip(left, right)], dtype=bool)


def _close(a: str, b: str):
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x) <= MOST_BITS


def _tile_links(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
    """Links of one tile pair that join components which were apart, tried from the closest sketches on.

    A link inside a component that has been joined here already adds nothing, so at most one link per member
    and tile pair comes out, however many pairs are alike.
    """
    _, low, high = key
    members = members.sort_values("node", ignore_index=True)
    sketches = np.stack(members["sketch"].to_numpy()).view(np.uint64)
    tiles, nodes = members["tile"].to_numpy(), members["node"].to_numpy()
    names, place = np.unique(members["component"].to_numpy(), return_inverse=True)
    above = np.arange(len(names))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return int(x)

    sets: dict[int, np.ndarray] = {}

    def own(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_set(members["text"][k])
        return sets[k]

    left, right, differ = [], [], []
    theirs = np.flatnonzero(tiles == high)
    for k in np.flatnonzero(tiles == low):
        others = theirs[(place[theirs] != place[k]) & ((theirs > k) | (low != high))]
        bits = np.bitwise_count(sketches[others] ^ sketches[k]).sum(axis=1, dtype=np.int64)
        near = bits <= MOST_BITS
        left.append(np.full(int(near.sum()), k))
        right.append(others[near])
        differ.append(bits[near])
    found = []
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        for at in np.argsort(np.concatenate(differ), kind="stable"):
            a, b = int(left[at]), int(right[at])
            x, y = top(place[a]), top(place[b])
            if x != y and alike(own(a), own(b)):
                above[max(x, y)] = min(x, y)
                found.append((nodes[a], nodes[b]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs)
    rows = materialize(texts.select("doc_id", F.pandas_udf(_features, FEATURES)("text").alias("f")).select("doc_id", "f.*"))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("_copies")).drop("_copies"))
    nodes = materialize(
        full.join(classes.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
        .dropDuplicates(["doc_id", "digest"])
        .select(F.col("doc_id").alias("node"), "bands", "sketch")
    )
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(banded.join(shared.drop("n"), ["band", "value"]))
    involved = members.select("node").distinct()
    known = nodes.join(involved, "node", "left_semi").select("node", "sketch")
    # a doc_id with several texts is one node with several rows here
    wide = materialize(texts.join(involved, texts.doc_id == involved.node, "left_semi").distinct().join(known.withColumnRenamed("node", "doc_id"), "doc_id"))

    def side(name: str) -> DataFrame:
        return wide.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    # first round: everyone against the smallest member of the band
    stars = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    met = stars.join(side("a"), "a").join(side("b"), "b").filter(_close("sketch_a", "sketch_b"))
    first = materialize(met.filter(F.pandas_udf(_alike, "boolean")("text_a", "text_b")).select("a", "b").distinct())
    merged = materialize(components(first))

    # second round: bands that still hold several components, joined into groups and compared tile by tile
    placed = materialize(members.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node")))
    torn = placed.groupBy("band", "value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    open_ = placed.join(torn.select("band", "value"), ["band", "value"], "left_semi")
    groups = materialize(components(open_.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "group"))
    sized = groups.join(groups.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "group")
    tiled = (
        sized.join(merged, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .join(wide.withColumnRenamed("doc_id", "node"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("group", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "component", "text", "sketch")
    )
    second = tiled.groupBy("group", "low", "high").applyInPandas(_tile_links, "a long, b long")
    links = materialize(first.union(second))
    final = components(links)

    joined = (
        rows.select("doc_id", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .join(final, "node", "left")
    )
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest doc_id stays."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


CHECK = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, [w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if w <> ''] AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[k:k + 4], ' ') for k in range(1, len(words) - 3)] END) AS shingle FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept FROM documents d
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1) r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query("op7_near_duplicates", CHECK)
def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
