"""Exact nearest neighbours of binary codes by incremental multi-index hashing (operator 6).

An embedding becomes one bit per dimension (1 from zero upwards). Codes are dealt to blocks, and every query
visits every block, in tiles of a bounded number of queries and codes. In a block the codes are indexed by
each of their 16-bit segments. A query looks up its own segments first, then all values one bit away, two
bits away, and so on, segment after segment. Once segments 0 to j are searched to radius r (the others to
r - 1), every code within m * r + j bits has been met, m being the number of segments; so the search ends as
soon as the k-th best verified distance is no larger than that. The k best of all blocks are the result.

Edge cases: rows without an id or an embedding are neither indexed nor asked; missing values, NaN and missing
dimensions are bit 0; rows with the same id count once (the smallest code); equal distances are ordered by id;
fewer than k other rows give fewer neighbours; a query is not its own neighbour; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import bounded_batches, materialize, table
from hindcast.llm.registry import query

SEGMENT_BITS = 16
BLOCK_CODES = 8192
TILE_QUERIES = 2048
NEIGHBOURS = 10


def pack(embeddings: pd.Series) -> pd.Series:
    """Sign bits, first dimension first, in whole bytes."""

    def one(values) -> bytes:
        numbers = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
        return np.packbits(numbers >= 0).tobytes()

    return embeddings.map(one)


@lru_cache(maxsize=None)
def flips(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


class SegmentIndex:
    """Codes of one block by the value of each segment."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = codes
        self.widths = [min(SEGMENT_BITS, bits - at) for at in range(0, bits, SEGMENT_BITS)]
        self.order, self.offsets = [], []
        for k, width in enumerate(self.widths):
            values = self.segment(codes, k)
            self.order.append(np.argsort(values, kind="stable"))
            self.offsets.append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << width)))))

    def segment(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Values of the k-th segment; codes are rows of bytes."""
        two = codes[:, 2 * k : 2 * k + 2].astype(np.int64)
        value = two[:, 0] << 8 | (two[:, 1] if two.shape[1] == 2 else 0)
        return value >> (SEGMENT_BITS - self.widths[k])

    def met(self, k: int, values: np.ndarray) -> np.ndarray:
        """Rows whose k-th segment has one of the values."""
        start, end = self.offsets[k][values], self.offsets[k][values + 1]
        n = end - start
        total = int(n.sum())
        if total == 0:
            return np.zeros(0, dtype=np.int64)
        at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        return self.order[k][at]

    def nearest(self, code: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of at least the k nearest (with all ties), rows ``own`` left out."""
        seen = np.zeros(len(self.codes), dtype=bool)
        seen[own] = True
        rows, distances = [], []
        found = np.zeros(0, dtype=np.int64)
        m = len(self.widths)
        values = [int(self.segment(code[None, :], j)[0]) for j in range(m)]
        for radius in range(SEGMENT_BITS + 1):
            for j, width in enumerate(self.widths):
                if radius <= width:
                    new = self.met(j, values[j] ^ flips(width, radius))
                    new = np.unique(new[~seen[new]])
                    if len(new):
                        seen[new] = True
                        distance = np.bitwise_count(self.codes[new] ^ code).sum(axis=1, dtype=np.int64)
                        rows.append(new)
                        distances.append(distance)
                        found = np.partition(np.append(found, distance), min(k, len(found) + len(distance)) - 1)[:k]
                covered = m * radius + j
                if len(found) == k and found.max() <= covered or seen.all():
                    none = np.zeros(0, dtype=np.int64)
                    return np.concatenate(rows or [none]), np.concatenate(distances or [none])
        raise AssertionError("every code lies within the full radius")


def nearest_codes(codes: DataFrame, bits: int, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, code) rows and (id, code) queries to query_id, neighbor_id, hamming, rank."""
    bounded_batches(codes.sparkSession)
    n, asked = codes.count(), queries.count()
    blocks, tiles = max(1, -(-n // BLOCK_CODES)), max(1, -(-asked // TILE_QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    indexed = codes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))
    spread = queries.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))

    def search(key, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            ids = own["id"].to_numpy()
            index = SegmentIndex(np.stack([np.frombuffer(c, dtype=np.uint8) for c in own["code"]]), bits)
            for query_id, code in zip(asking["id"], asking["code"]):
                rows, distance = index.nearest(np.frombuffer(code, dtype=np.uint8), np.flatnonzero(ids == query_id), k)
                best = np.lexsort((ids[rows], distance))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "neighbor_id": ids[rows[best]], "hamming": distance[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "neighbor_id": [], "hamming": []}).astype("int64")

    found = (
        indexed.groupBy("block", "tile")
        .cogroup(spread.groupBy("block", "tile"))
        .applyInPandas(search, "query_id long, neighbor_id long, hamming long")
    )
    order = Window.partitionBy("query_id").orderBy("hamming", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def search_embeddings(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 100) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; all rows are searched."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").alias("id"), "embedding").filter("id is not null and embedding is not null and size(embedding) > 0")
    bits = rows.agg(F.max(F.size("embedding"))).first()[0] or SEGMENT_BITS
    packed = rows.select("id", F.rpad(F.pandas_udf(pack, "binary")("embedding"), -(-bits // 8), b"\0").alias("code"))
    codes = materialize(packed.groupBy("id").agg(F.min("code").alias("code")))
    return nearest_codes(codes, bits, codes.filter(F.col("id") % every == 0), k)


CHECK = """
WITH codes AS (SELECT vec_id, [coalesce(x >= 0, false) for x in embedding] AS code FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
    CAST(list_sum([CAST(x[1] <> x[2] AS INTEGER) for x in list_zip(q.code, n.code)]) AS BIGINT) AS hamming
  FROM codes q JOIN codes n ON q.vec_id % 100 = 0 AND q.vec_id <> n.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, neighbor_id) AS rank FROM pairs) WHERE rank <= 10
"""


@query("op6_exact_top_k", CHECK)
def op6_exact_top_k(spark, sf_dir):
    return search_embeddings(table(spark, sf_dir, "embeddings"))
