"""Hard negatives by slot decomposition (operator 12).

Every anchor has a few positives, and every positive a window of scores in which its negatives lie, up to the score of
the positive itself. The distinct upper limits of an anchor cut the scores into disjoint slots. Each task is a combiner: it
keeps the best k negatives per anchor and slot of the rows it reads. Merging the slots from the lowest
upwards gives, at every slot, the best k of all scores up to its limit; so each row is scored once, however many
windows overlap, and a window only cuts its merged list at its own lower limit.

Anchors are taken in tiles of a fixed number, each a pass over the rows in two steps (positives, then negatives). A
pass moves only the tile to the tasks, a broadcast bounded by ``TILE_ANCHORS`` vectors, and the combiners' best rows
through the shuffle; the rows themselves stay where they are.

Scores are exact: integers through floating-point products where the sums are known to stay below 2^53, otherwise
through Python's own integers.

Edge cases: rows without an id, a label or a vector, or with a null or non-finite component, take no part; rows with the
same id count once (the smallest label and vector); missing components of shorter vectors are 0; equal scores are
ordered by id; fewer than k rows give fewer; an anchor without positives and an empty table give nothing; scores beyond a
long are cut to its range; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import bounded_batches, materialize, table
from hindcast.llm.registry import query
from hindcast.session import shared_dir

POSITIVES = NEGATIVES = 5
#: a negative scores between 80 % and 100 % of its positive
LOWEST_PERCENT = 80
SCALE = 256
#: anchors of one pass; with 1,024 components their vectors take 32 MB
TILE_ANCHORS = 4096
#: rows scored at a time
CHUNK_ROWS = 512
LEAST, MOST = -(2**63 - 1), 2**63 - 1
EXACT = 2.0**53


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """id, label and vector of the rows that take part, one per id."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False))
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(F.forall("embedding", finite))
    kept = rows.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    return kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def shift_labels(rows: DataFrame) -> DataFrame:
    """The query's own labels: every seventh id has the next of ten labels."""
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Integer components, still as floating-point numbers; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for k, vector in enumerate(vectors):
        n = min(width, len(vector))
        out[k, :n] = vector[:n]
    return np.floor(out * SCALE)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors."""
    if rows.size == 0 or anchors.size == 0:
        return np.zeros((len(rows), len(anchors)), dtype=np.int64)
    if np.abs(rows).max() * np.abs(anchors).max() * rows.shape[1] < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(rows) @ whole(anchors).T, LEAST, MOST).astype(np.int64)


class Combiner:
    """The best k (score, id) of every group met so far, higher scores and then smaller ids first."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        #: per group the score that a new row has to reach
        self.bar = np.full(groups, LEAST)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        useful = score >= self.bar[group]
        group, score, ids = (np.concatenate(x) for x in ((self.group, group[useful]), (self.score, score[useful]), (self.id, ids[useful])))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = place[kept] == self.k - 1
        self.bar[self.group[last]] = self.score[last]


class Tile:
    """Anchors of one pass and, once known, the slots of their positives."""

    def __init__(self, anchors: pd.DataFrame):
        self.ids = anchors["id"].to_numpy(dtype=np.int64)
        self.labels = anchors["label"].to_numpy(dtype=np.int64)
        self.vectors = matrix(anchors["v"], max(map(len, anchors["v"])))

    def cut(self, positives: pd.DataFrame, percent: int) -> pd.DataFrame:
        """Distinct upper limits of every anchor, highest first, with the lowest score that any window reaches in
        their slots. Returns the positives with their slot and lower limit."""
        at = {anchor: k for k, anchor in enumerate(self.ids.tolist())}
        limits: list[list[int]] = [[] for _ in at]
        for anchor, score in sorted(zip(positives["anchor_id"], positives["positive_score"]), key=lambda p: -p[1]):
            own = limits[at[anchor]]
            if not own or own[-1] != score:
                own.append(int(score))
        self.slots = max(1, *map(len, limits))
        lowest = lambda limit: -(-percent * limit // 100)  # noqa: E731  the smallest whole score inside
        # a missing slot holds nothing: no score lies below its upper and above its lower limit
        self.upper = np.array([own + [LEAST] * (self.slots - len(own)) for own in limits])
        self.lower = np.array([[*map(lowest, own)] + [MOST] * (self.slots - len(own)) for own in limits])
        slot = [limits[at[a]].index(s) for a, s in zip(positives["anchor_id"], positives["positive_score"])]
        return positives.assign(slot=slot, lowest=[lowest(int(s)) for s in positives["positive_score"]])

    def scored(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids and labels of some rows and their scores with all anchors."""
        for frame in frames:
            for start in range(0, len(frame), CHUNK_ROWS):
                rows = frame.iloc[start : start + CHUNK_ROWS]
                scores = products(matrix(rows["v"], self.vectors.shape[1]), self.vectors)
                yield rows["id"].to_numpy(dtype=np.int64), rows["label"].to_numpy(dtype=np.int64), scores

    def positives(self, frames: Iterator[pd.DataFrame], k: int) -> pd.DataFrame:
        best = Combiner(len(self.ids), k)
        for ids, labels, scores in self.scored(frames):
            row, anchor = np.nonzero((labels[:, None] == self.labels) & (ids[:, None] != self.ids) & (scores >= best.bar))
            best.offer(anchor, scores[row, anchor], ids[row])
        return pd.DataFrame({"anchor_id": self.ids[best.group], "slot": 0, "id": best.id, "score": best.score})

    def negatives(self, frames: Iterator[pd.DataFrame], k: int) -> pd.DataFrame:
        best = Combiner(self.upper.size, k)
        for ids, labels, scores in self.scored(frames):
            floor = np.maximum(self.lower, best.bar.reshape(self.upper.shape)).min(axis=1)
            row, anchor = np.nonzero((scores <= self.upper[:, 0]) & (scores >= floor) & (labels[:, None] != self.labels))
            score = scores[row, anchor]
            slot = (self.upper[anchor] >= score[:, None]).sum(axis=1) - 1
            inside = score >= self.lower[anchor, slot]
            best.offer((anchor * self.slots + slot)[inside], score[inside], ids[row][inside])
        anchor, slot = np.divmod(best.group, self.slots)
        return pd.DataFrame({"anchor_id": self.ids[anchor], "slot": slot, "id": best.id, "score": best.score})


BEST = "anchor_id long, slot int, id long, score long"


def best_of(rows: DataFrame, tile: Tile, step: str, k: int) -> DataFrame:
    """The best k per anchor and slot: by task first, then over all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(tile)

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield getattr(shared.value, step)(frames, k)

    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return rows.mapInPandas(combine, BEST).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merged(best: DataFrame, slots: int, k: int) -> DataFrame:
    """anchor_id and lists: at each slot the best k of it and of all slots below, merged from the lowest slot upwards.

    An anchor has at most k entries per slot, so a group is a few rows.
    """
    entry = F.struct((-F.col("score")).alias("minus"), F.col("id"))
    own = lambda s: F.collect_list(F.when(F.col("slot") == s, entry))
    lists = best.groupBy("anchor_id").agg(*[own(s).alias(f"s{s}") for s in range(slots)])
    for s in reversed(range(slots - 1)):
        lists = lists.withColumn(f"s{s}", F.slice(F.array_sort(F.concat(f"s{s}", f"s{s + 1}")), 1, k))
    lists = lists.withColumn(f"s{slots - 1}", F.array_sort(f"s{slots - 1}"))
    return lists.select("anchor_id", F.array(*[f"s{s}" for s in range(slots)]).alias("lists"))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: int = LOWEST_PERCENT, tile_anchors: int = TILE_ANCHORS,
) -> DataFrame:
    """(id, label, v) rows, one per id, to anchor_id, positive_id, rank, negative_id and both scores."""
    spark = rows.sparkSession
    bounded_batches(spark)
    anchors = rows.filter(is_anchor)
    tiles = -(-anchors.count() * 4 // (3 * tile_anchors))  # dealt by hash, so a tile is not quite even
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    root, written = shared_dir(spark), False
    for number in range(tiles):
        own = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(tiles)) == number).toPandas()
        if own.empty:
            continue
        tile = Tile(own)
        found = best_of(rows, tile, "positives", positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        windows = tile.cut(found.toPandas(), percent)  # a few rows per anchor of the tile
        if windows.empty:
            continue
        asked = spark.createDataFrame(windows, "anchor_id long, positive_id long, positive_score long, slot int, lowest long")
        lists = merged(best_of(rows, tile, "negatives", negatives), tile.slots, negatives)
        inside = F.expr("filter(element_at(lists, slot + 1), e -> -e.minus >= lowest)")
        answers = asked.join(lists, "anchor_id").select("*", F.posexplode(inside).alias("at", "e"))
        answers.select(
            "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"),
            "positive_score", (-F.col("e.minus")).alias("negative_score"),
        ).write.parquet(f"{root}/tile={number}")
        written = True
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


CHECK = """
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", CHECK)
def op12_hard_negatives(spark, sf_dir):
    rows = materialize(shift_labels(clean_vectors(table(spark, sf_dir, "embeddings"))))
    return mine(rows, F.col("id") % 100 == 0)
