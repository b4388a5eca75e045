"""Streaming bar quality: row rules, order across batches, gap sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hindcast.functions import numbers as nums
from hindcast.operators import quality
from hindcast.streaming.tables import drain, drain_until_idle, keyed_state, read_batch, write_batch

DAY_SECONDS = 86400


class SeenStamps(StatefulProcessor):
    """The stamps of one series and day so far, each with the smallest row number that had it.

    Passes rows on with that number as ``first_row``. A hot series is as many keys as it has days.
    """

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "stamps array<long>, row_nos array<long>", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        if not any(row.us is not None for row in rows):  # rows without a stamp repeat nothing
            yield from rows
            return
        known = self.seen.get()
        first = dict(zip(*known)) if known else {}
        for row in rows:
            first[row.us] = min(row.row_no, first.get(row.us, row.row_no))
        for row in rows:
            yield Row(**{**row.asDict(), "first_row": first[row.us]})
        self.seen.update((list(first), list(first.values())))


def stream_validate_bars(
    bars: DataFrame, root: str, checkpoint: str, key: str = "series_key", forget_seconds: float | None = None
) -> None:
    """Bar rules over a stream, equal to the batch rules over all rows so far.

    The stamps seen so far are keyed state, one small entry per series and day, so a batch touches only
    the days it has rows of and reads no earlier batch. The last row of every series travels from batch to
    batch in a small table, which gives the first row of a batch its predecessor. Input needs
    ``row_no``, and no batch may hold rows before those of an earlier one: what was told is not taken back. With ``forget_seconds`` a day's stamps expire that long after its last row came, and what
    repeats them later counts as out of order only.
    """
    spark = bars.sparkSession
    # rows without a stamp are dealt by their number
    block = F.coalesce(nums.time_bucket(F.col("ts"), DAY_SECONDS), F.col("row_no").cast("bigint"))
    numbered = bars.withColumns({"us": nums.micros(F.col("ts")), "day": block, "first_row": F.lit(None).cast("bigint")})
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)

    def process(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.drop("us", "day"), f"{root}/bars", batch_id)
        batch = read_batch(spark, f"{root}/bars", batch_id)
        rows = batch.withColumn("_carried", F.lit(False))
        state = read_batch(spark, f"{root}/state", batch_id - 1) if batch_id else None
        if state is not None:
            rows = rows.unionByName(state.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
        broken = quality.validate_ohlc(rows.drop("_carried"), key)
        if state is not None:
            broken = broken.join(state.select(key, "row_no"), [key, "row_no"], "left_anti")
        write_batch(broken, f"{root}/violations", batch_id)
        carried = [c for c in batch.columns if c not in (key, "row_no", "first_row")]
        last = rows.groupBy(key).agg(F.max("row_no").alias("row_no"), *[F.max_by(c, "row_no").alias(c) for c in carried])
        write_batch(last, f"{root}/state", batch_id)

    with keyed_state(spark):
        keyed = numbered.groupBy(key, "day")
        if forget_seconds is None:
            drain(keyed.transformWithState(SeenStamps(), passed, "Append", "None"), process, checkpoint)
        else:
            stamps = SeenStamps(round(forget_seconds * 1000))
            drain_until_idle(keyed.transformWithState(stamps, passed, "Append", "ProcessingTime"), process, checkpoint)


STRETCHES = "bar_count long, first_ts timestamp, last_ts timestamp"


def merge_stretches(stretches: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """(first, last, bars) stretches, those no further apart than ``limit`` made one."""
    out: list[tuple[int, int, int]] = []
    for first, last, bars in sorted(stretches):
        if out and first - out[-1][1] <= limit:
            out[-1] = out[-1][0], max(last, out[-1][1]), out[-1][2] + bars
        else:
            out.append((first, last, bars))
    return out


def _runs(key: str):
    """A combiner: the stretches that the bars of a task make on their own, a few rows per series."""

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for (series, limit), own in frame.groupby([key, "limit"], dropna=False)["us"]:
                rows += [(series, limit, *run) for run in merge_stretches([(us, us, 1) for us in own.tolist()], limit)]
            yield pd.DataFrame(rows, columns=[key, "limit", "first", "last", "bars"])

    return combine


class OpenStretches(StatefulProcessor):
    """The stretches of one series that later bars may still change.

    A stretch is told when the clock of its series has left it behind by the limit and the delay, or
    by a processing-time timer when the series has been silent for the idle time. A series
    that wakes up again goes on with its stretch: it is told once more with its new end, and a
    stretch that another one took in is told with no bars.
    """

    def __init__(self, key: str, delay: int, idle_ms: int):
        self.key, self.delay, self.idle_ms = key, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "stretches array<struct<first: long, last: long, bars: long>>, told array<long>, due long")

    def _row(self, key: tuple, first: int, last: int, bars: int) -> Row:
        return Row(**{self.key: key[0], "bars": bars, "first": first, "last": last})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, told, _ = self.held.get() or ([], [], 0)
        rows = list(rows)
        limit = max(row.limit for row in rows)
        stretches = merge_stretches([*map(tuple, held), *((row.first, row.last, row.bars) for row in rows)], limit)
        starts = {first for first, _, _ in stretches}
        for first in told:
            if first not in starts:  # another one took it in
                yield self._row(key, first, first, 0)
        clock = max(last for _, last, _ in stretches)
        kept = []
        for stretch in stretches:
            if stretch[1] + limit + self.delay < clock:
                yield self._row(key, *stretch)
            else:
                kept.append(stretch)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        self.held.update((kept, [first for first in told if first in starts], due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, _, due = self.held.get()
        held = [tuple(stretch) for stretch in held]
        if expiredTimerInfo.getExpiryTimeInMs() >= due:  # nothing came since this timer was set
            for stretch in held:
                yield self._row(key, *stretch)
            self.held.update((held, [first for first, _, _ in held], due))


def stream_gap_monitor(
    bars: DataFrame, root: str, checkpoint: str, delay_seconds: float = 3600.0, key: str = "series_key", idle_seconds: float = 10.0
) -> None:
    """Uninterrupted stretches per series; each one's end marks an excessive gap.

    A stretch ends where the next bar is more than the declared maximum gap (plus cadence tolerance) away;
    equality still belongs to it. ``bars`` carries ts, cadence_seconds and maximum_gap_seconds. Bars may come up to
    ``delay_seconds`` behind the clock of their own series and still join their stretch; later ones make one of their own.
    The last stretch of a series comes out once the series has been silent for ``idle_seconds``. Runs
    until everything that is available has been read and told; ``latest_stretches`` reads the result.
    """
    limit = F.col("maximum_gap_seconds") + quality.cadence_tolerance(F.col("cadence_seconds"))
    timed = bars.filter("ts IS NOT NULL").select(
        key, F.floor(limit * 1000000).cast("bigint").alias("limit"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    kind = bars.schema[key].dataType.simpleString()
    runs = timed.mapInPandas(_runs(key), f"{key} {kind}, limit long, first long, last long, bars long")
    keeper = OpenStretches(key, round(delay_seconds * 1e6), round(idle_seconds * 1000))

    def process(rows: DataFrame, batch_id: int) -> None:
        stamp = lambda c: F.timestamp_micros(c).alias(f"{c}_ts")
        write_batch(rows.select(key, F.col("bars").alias("bar_count"), stamp("first"), stamp("last")), f"{root}/stretches", batch_id)

    with keyed_state(bars.sparkSession):
        told = runs.groupBy(key).transformWithState(keeper, f"{key} {kind}, bars long, first long, last long", "Append", "ProcessingTime")
        drain_until_idle(told, process, checkpoint, idle_seconds)


def latest_stretches(updates: DataFrame, key: str = "series_key") -> DataFrame:
    """Newest version of every stretch from the update table; one that another took in is gone."""
    newest = updates.groupBy(key, "first_ts").agg(F.max_by(F.struct("bar_count", "last_ts"), "batch").alias("_v"))
    return newest.filter("_v.bar_count > 0").select(key, "_v.bar_count", "first_ts", "_v.last_ts")
