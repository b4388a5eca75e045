"""Interaction audit of document filters by incremental retraction streaming (operator 11).

Five filters are applied in all 120 orders, and per part of the corpus the audit says what each filter removes at
each place. Only counts per (part, set of failed filters, label) are needed for that, so the corpus is read once, as
a stream of its files in available-now micro-batches:

* a task finds the filters A to D that a text fails and the digest of the text, and combines equal texts of one part
  into one small row before anything is shuffled, so a text that a third of all documents share stays small;
* keyed state holds the smallest id of every text so far and who has it. A smaller id that comes later takes that
  place: the mask of the earlier holder is retracted from the counters of its part and comes back with E in it;
* every micro-batch writes the sum of its changes to its own folder, which a replay overwrites. The counters are
  the sums over these folders.

State lives in RocksDB below the shared folder's checkpoint, one small entry per distinct text (SHA-256).

Edge cases: a null text is empty, a null source the part ''; a row without an id is never a copy of a smaller id and
makes none, and has no label; rows with the same id and the same text are both kept by E, because neither id is
smaller; a document with several label rows is good (toxic) if one of them says so; null labels say nothing; an empty
table gives an empty result; a part without failures has its rows of zeros; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hindcast.llm.common import bounded_batches, table
from hindcast.llm.registry import query
from hindcast.session import shared_dir
from hindcast.streaming.tables import drain, parquet_stream, read_batches, write_batch

FILTERS = "ABCDE"
COPY = 16  # the bit of filter E
#: micro-batches that a table is read in; a folder with fewer files has as many as it has files
BATCHES = 4
#: entries of a task's table of combined texts before it is handed on
COMBINED = 50_000
LETTERS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"

COMBINED_SCHEMA = "digest binary, part string, mask int, good boolean, toxic boolean, n long, least long, at_least long"
STATE_SCHEMA = "least long, mask int, good boolean, toxic boolean, parts array<string>, counts array<long>"
CHANGES = "part string, mask int, good boolean, toxic boolean, n long"


def failed(text: str) -> int:
    """Bits of the filters A to D that a text fails. ``bytes`` methods know only ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, LETTERS))
    return (
        (n < 200)
        | (100 * len(set(words)) < 50 * n) << 1
        | (100 * capitals > 2 * len(text)) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


def facts(texts: pd.Series) -> pd.DataFrame:
    """Digest and failed filters of texts."""
    return pd.DataFrame(
        {
            "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts],
            "mask": [int(failed(t)) for t in texts],
        }
    )


def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one task by text, part and label: how many, their smallest id, how many have it."""
    seen: dict[tuple, list] = {}

    def handed_on() -> pd.DataFrame:
        rows = [(*key[:-1], *value) for key, value in seen.items()]
        seen.clear()
        columns = ["digest", "part", "mask", "good", "toxic", "n", "least", "at_least"]
        return pd.DataFrame(rows, columns=columns).astype({"least": "Int64"})

    for frame in frames:
        for doc_id, *key in zip(frame["doc_id"].astype("Int64"), *(frame[c] for c in ("digest", "part", "mask", "good", "toxic"))):
            without = doc_id is pd.NA
            entry = seen.setdefault((*key, without), [0, None if without else doc_id, 0])
            entry[0] += 1
            if not without:
                if doc_id < entry[1]:
                    entry[1:] = doc_id, 0
                entry[2] += doc_id == entry[1]
        if len(seen) >= COMBINED:
            yield handed_on()
    if seen:
        yield handed_on()


class SmallestIds(StatefulProcessor):
    """Per text: the smallest id so far and its holders by part. Yields changes of the part counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", STATE_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        least, mask, good, toxic, holders = None, 0, False, False, {}
        before = self.held.get()
        if before is not None:
            least, mask, good, toxic, parts, counts = before
            holders = dict(zip(parts, counts))
        was = least, dict(holders)
        change: defaultdict[tuple, int] = defaultdict(int)
        for row in rows:
            _, part, plain, fine, bad, n, own, at_least = row
            if own is None:
                change[part, plain, fine, bad] += n
                continue
            change[part, plain | COPY, fine, bad] += n - at_least
            if least is not None and own > least:
                change[part, plain | COPY, fine, bad] += at_least
                continue
            if own != least:  # retract the mask of the holders so far, and count them as copies
                for held, count in holders.items():
                    change[held, mask, good, toxic] -= count
                    change[held, mask | COPY, good, toxic] += count
                least, mask, good, toxic, holders = own, plain, fine, bad, {}
            change[part, plain, fine, bad] += at_least
            holders[part] = holders.get(part, 0) + at_least
        if (least, holders) != was:
            self.held.update((least, mask, good, toxic, list(holders), list(holders.values())))
        for (part, bits, fine, bad), n in change.items():
            if n:
                yield Row(part=part, mask=bits, good=fine, toxic=bad, n=n)


@contextmanager
def state_on_disk(spark: SparkSession):
    """Keyed state in RocksDB with a change log, as it can outgrow the memory of an executor."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many small stores: space for logs is not reserved ahead
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: one row per labelled document."""
    says = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False)))
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def mask_changes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A stream of documents to the stream of changes of the counters per part, mask and label."""
    bounded_batches(docs.sparkSession)
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        F.pandas_udf(facts, "digest binary, mask int")(F.coalesce("text", F.lit(""))).alias("f"),
    ).select("doc_id", "part", "f.digest", "f.mask")
    flags = label_flags(labels)
    marked = known.join(flags, "doc_id", "left").fillna(False, ["good", "toxic"])
    combined = marked.select("doc_id", "digest", "part", "mask", "good", "toxic").mapInPandas(combine, COMBINED_SCHEMA)
    return combined.groupBy("digest").transformWithState(SmallestIds(), CHANGES, "Append", "None")


def stream_counters(docs: DataFrame, labels: DataFrame, root: str) -> None:
    """Reads all that a stream has now and writes each micro-batch's changes below ``root``; may be called again."""

    def process(changes: DataFrame, batch_id: int) -> None:
        write_batch(changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), f"{root}/changes", batch_id)

    with state_on_disk(docs.sparkSession):
        drain(mask_changes(docs, labels), process, f"{root}/checkpoint")


def part_counters(spark: SparkSession, root: str) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail exactly the filters of the mask."""
    changes = read_batches(spark, f"{root}/changes")
    flagged = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).cast("long").alias(flag)
    return changes.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), flagged("good"), flagged("toxic"))


def interactions(counters: DataFrame) -> DataFrame:
    """Every part, order and step with what its filter does there.

    What a filter does depends only on the set of filters before it: 5 * 16 cells per part, each a sum over
    the masks, which the 600 places of all orders share.
    """
    spark = counters.sparkSession
    cells, places = [], []
    for k, name in enumerate(FILTERS):
        for earlier in range(32):
            if not earlier >> k & 1:
                size = earlier.bit_count()
                weight = [24, 6, 4, 6, 24][size]  # orders in which exactly these come before it
                cells += [(m, name, earlier, weight, not m & (earlier | 1 << k), m >> k & 1 == 1, m & earlier != 0, m == 1 << k) for m in range(32)]
    for order in map("".join, permutations(FILTERS)):
        earlier = 0
        for step, name in enumerate(order, 1):
            places.append((order, step, name, earlier))
            earlier |= 1 << FILTERS.index(name)
    cell = spark.createDataFrame(cells, "mask int, filter string, earlier int, weight long, stays boolean, fails boolean, gone boolean, alone boolean")
    place = spark.createDataFrame(places, "filter_order string, step int, filter string, earlier int")
    total = lambda column, test: F.sum(F.when(test, F.col(column)).otherwise(0)).cast("long")
    here = F.col("fails") & ~F.col("gone")
    summed = (
        counters.join(cell, "mask")
        .groupBy("part", "filter", "earlier", "weight")
        .agg(
            total("n", F.col("stays")).alias("kept"), total("n", here).alias("removed"),
            total("n", F.col("fails") & F.col("gone")).alias("redundant"), total("n", F.col("alone")).alias("unique_fails"),
            total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        )
    )
    shares = summed.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).cast("long").alias("shapley"))
    return (
        summed.join(shares, ["part", "filter"])
        .join(place, ["filter", "earlier"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        )
    )


def audit_filters(spark: SparkSession, documents: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The audit of a folder or file of documents, read in about ``batches`` micro-batches."""
    files = len(spark.read.parquet(documents).inputFiles())
    root = shared_dir(spark)
    stream_counters(parquet_stream(spark, documents, max(1, -(-files // batches))), labels, root)
    return interactions(part_counters(spark, root))


CHECK = r"""
WITH known AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
flags AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
  FROM known LEFT JOIN flags USING (doc_id)),
counters AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.l <> b.l AND a.l <> c.l AND a.l <> d.l AND a.l <> e.l AND b.l <> c.l AND b.l <> d.l AND b.l <> e.l AND c.l <> d.l AND c.l <> e.l AND d.l <> e.l),
places AS (
  SELECT filter_order, s.step::INT AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
told AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counters, places GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
"""


@query("op11_filter_audit", CHECK)
def op11_filter_audit(spark, sf_dir):
    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
