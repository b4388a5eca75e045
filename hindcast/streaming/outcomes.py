"""Streaming outcome windows and score roll-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hindcast import fixed_values as fv
from hindcast.functions import numbers as nums
from hindcast.operators import quality, windows
from hindcast.streaming.tables import drain, keyed_state, read_batch, write_batch

HOUR, DAY = 3_600_000_000, 86_400_000_000
FIGURES = {
    "bar_count": "long", "open": "double", "high": "double", "high_ts": "long", "low": "double", "low_ts": "long", "close": "double",
    "last_bar_ts": "long", "maximum_observed_gap_seconds": "double", "irregular_gaps": "long", "excessive_gaps": "long",
}
ROUTED = "series_key string, day long, us long, open double, high double, low double, close double, own long, valid boolean, cadence double, gap_limit double, clock timestamp, step int"
BLANK = (0, None, None, None, None, None, None, None, None, 0, 0)


def merge_bars(have: tuple, us: np.ndarray, ohlc: np.ndarray, cadence: float, limit: float) -> tuple:
    """Figures of a window (in the order of ``FIGURES``) after some more bars, all newer than those so far."""
    if not len(us):
        return have
    n, first, high, high_ts, low, low_ts, _, last, gap, irregular, excessive = have
    top, bottom = int(ohlc[1].argmax()), int(ohlc[2].argmin())
    if high is None or ohlc[1][top] > high:
        high, high_ts = float(ohlc[1][top]), int(us[top])
    if low is None or ohlc[2][bottom] < low:
        low, low_ts = float(ohlc[2][bottom]), int(us[bottom])
    gaps = np.diff(us if last is None else np.concatenate(([last], us))) / 1e6
    if len(gaps):
        # the rules of ``quality.irregular_gap`` and ``quality.excessive_gap``
        tolerance, steps = max(0.001, cadence * 0.01), gaps / cadence
        irregular += int(((gaps < cadence - tolerance) | (np.abs(steps - np.rint(steps)) > tolerance / cadence)).sum())
        excessive += int((gaps > limit + tolerance).sum())
        gap = float(max(gaps.max(), gaps[0] if gap is None else gap))
    opened = float(ohlc[0][0]) if n == 0 else first
    return n + len(us), opened, high, high_ts, low, low_ts, float(ohlc[3][-1]), int(us[-1]), gap, irregular, excessive


class EntryWindows(StatefulProcessor):
    """Open windows of one series for the anchors of one day, one per entry bar however many claims share it.

    State is what the anchors up to ``passed`` came to: entry bars still open, each with the anchors ``(after, until]``
    that it is the first bar for and the figures of its windows so far. It is bounded by the bars of a day. A window
    leaves when the clock of its series has passed the longest one, or when a timer on the newest clock of all fires.
    """

    def __init__(self, hours: tuple[int, ...]):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        figures = ", ".join(f"{name}: {kind}" for name, kind in FIGURES.items())
        self.held = handle.getValueState(
            "held", f"passed long, open array<struct<after: long, until: long, entry: long, windows: array<struct<{figures}>>>>"
        )

    def _held(self) -> tuple[int, list[tuple]] | None:
        """The state in plain tuples, which can be written back."""
        held = self.held.get()
        return held and (held[0], [(after, until, entry, [tuple(f) for f in figures]) for after, until, entry, figures in held[1]])

    def _told(self, key: tuple, after: int, until: int, entry: int | None = None, status: str | None = None, figures: list[tuple] | None = None) -> Iterator[Row]:
        for hours, values in zip(self.hours, figures or [(None,) * len(FIGURES)] * len(self.hours)):
            yield Row(series_key=key[0], after=after, until=until, entry=entry, entry_status=status, hours=hours, **dict(zip(FIGURES, values)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batches: dict[int, list[Row]] = {}
        for row in rows:
            batches.setdefault(row.step, []).append(row)
        if key[0] is None:  # the clock's own row
            return
        (passed, opened), stop = self._held() or (key[1] * DAY - 1, []), (key[1] + 1) * DAY - 1
        for _, batch in sorted(batches.items()):
            if not all(row.valid for row in batch):
                for after, until, _, _ in [*opened, (passed, stop, None, None)]:
                    if after < until:
                        yield from self._told(key, after, until, status="invalid_market_series")
                opened, passed = [], stop
                break
            own, cadence, limit = max(row.own for row in batch), batch[0].cadence, batch[0].gap_limit
            reach = int(limit * 1e6)
            bars = sorted((row.us, row.open, row.high, row.low, row.close) for row in batch if row.us is not None)
            us, *ohlc = np.array(bars, dtype=np.float64).reshape(-1, 5).T
            us = np.array([bar[0] for bar in bars], dtype=np.int64)
            # every bar is the first one for the anchors since the bar before; a series without one there has passed them by
            for bar in [*us.tolist(), None]:
                first = own if bar is None else bar
                late, until = min(first - reach - 1, stop), min(first, stop)
                if late > passed:
                    yield from self._told(key, passed, late, status="next_tradable_bar_too_late")
                    passed = late
                if bar is not None and until > passed:
                    opened.append((passed, until, bar, [BLANK] * len(self.hours)))
                    self.handle.registerTimer(self._due(bar))
                    passed = until
            still = []
            for after, until, entry, figures in opened:
                start = int(np.searchsorted(us, entry))
                ends = [int(np.searchsorted(us, entry + hours * HOUR)) for hours in self.hours]
                figures = [
                    merge_bars(have, us[start:end], [x[start:end] for x in ohlc], cadence, limit) for have, end in zip(figures, ends)
                ]
                if own >= entry + max(self.hours) * HOUR:
                    yield from self._told(key, after, until, entry, None, figures)
                else:
                    still.append((after, until, entry, figures))
            opened = still
        self.held.update((passed, opened))

    def _due(self, entry: int) -> int:
        """Milliseconds at which the longest window has passed."""
        return -(-(entry + max(self.hours) * HOUR) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, held = self._held() or (None, [])
        still = []
        for after, until, entry, figures in held:
            if self._due(entry) <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._told(key, after, until, entry, None, figures)
            else:
                still.append((after, until, entry, figures))
        if len(still) < len(held):
            self.held.update((passed, still))


def _stamp(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def stream_outcome_windows(
    bars: DataFrame, assets: DataFrame, series: DataFrame, root: str, checkpoint: str, lateness_seconds: float = 0.0,
    hours: tuple[int, ...] = fv.HORIZON_HOURS,
) -> None:
    """Settles claim windows as bars arrive, in two streams of which neither reads an earlier batch again.

    The first checks fresh bars and keeps one row per series (newest stamp, soundness). Bars not newer than what
    their own series has shown in earlier batches are late: they go to the table ``late`` and count nowhere else. The
    others are routed to the claims they can touch, by series and day of the anchor; a claim's day also hears once that
    its series has passed it or is unsound.

    The second keeps the open windows as keyed state (``EntryWindows``), one per entry bar; claims meet them in a join
    once they are settled, so no worker holds the claims of a series. A window is settled once and for all when the clock
    of its series has passed it, or, by a timer, when the newest clock of all has passed it by
    ``lateness_seconds`` (how far a series may lag behind the others). Claims without a bar after them stay open.
    Claims on series without a usable policy are settled at the start.
    """
    spark = bars.sparkSession
    unseen = spark.createDataFrame([], "series_key string, last_ts timestamp_ntz, valid boolean")
    profile = windows.series_profile(series, unseen).select("series_key", "blocked_status", *windows.POLICY)
    claims = assets.join(profile, "series_key").withColumns(
        {"_at": nums.micros(F.col("anchor")), "day": nums.time_bucket(F.col("anchor"), DAY // 1000000)}
    )
    ready = claims.filter("blocked_status IS NULL")
    reach = (F.col("maximum_gap_seconds") * 1000000.0).cast("bigint") + max(hours) * HOUR
    days = ready.select("series_key", "day", ((F.col("day") + 1) * DAY + reach).alias("_due")).distinct()

    def route(batch: DataFrame, batch_id: int) -> None:
        before = read_batch(spark, f"{root}/state", batch_id - 1) if batch_id else None
        fresh = batch
        if before is not None:
            shown = before.select("series_key", F.col("last_ts").alias("_shown"))
            marked = batch.join(shown, "series_key", "left").withColumn("_late", F.coalesce(F.col("ts") <= F.col("_shown"), F.lit(False)))
            write_batch(marked.filter("_late").drop("_shown", "_late"), f"{root}/late", batch_id)
            fresh = marked.filter("NOT _late").select(*batch.columns)
        write_batch(fresh, f"{root}/bars", batch_id)
        fresh = read_batch(spark, f"{root}/bars", batch_id)
        verdicts = quality.series_verdicts(fresh).select("series_key", "last_ts", "valid")
        both = verdicts.withColumn("_new", F.lit(True))
        if before is not None:
            both = both.unionByName(before.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        earlier = F.when(~F.col("_new"), F.col("last_ts"))
        write_batch(
            both.groupBy("series_key").agg(
                F.max("last_ts").alias("last_ts"), F.every("valid").alias("valid"), F.max("_new").alias("touched"),
                F.max(earlier).alias("shown_ts"), F.coalesce(F.every(F.when(~F.col("_new"), F.col("valid"))), F.lit(True)).alias("was_valid"),
            ),
            f"{root}/state", batch_id,
        )
        state = read_batch(spark, f"{root}/state", batch_id)
        # half a millisecond keeps rows of an unchanged clock ahead of the watermark, which has whole ones
        newest = state.agg(F.max("last_ts")).scalar()
        clock = F.timestamp_micros(F.floor(nums.micros(newest) / 1000) * 1000 + 500)
        known = state.select("series_key", nums.micros(F.col("last_ts")).alias("own"), "valid", "touched", "was_valid", nums.micros(F.col("shown_ts")).alias("_shown"))
        limits = ready.select(
            "series_key", reach.alias("_reach"), F.col("cadence_seconds").alias("cadence"), F.col("maximum_gap_seconds").alias("gap_limit")
        ).distinct()
        near = (
            fresh.join(limits, "series_key").withColumn("us", nums.micros(F.col("ts")))
            .withColumn("day", F.explode(F.sequence(F.floor((F.col("us") - F.col("_reach")) / DAY), F.floor(F.col("us") / DAY))))
            .join(days.drop("_due"), ["series_key", "day"]).join(known, "series_key")
            .select("series_key", "day", "us", "open", "high", "low", "close", "own", "valid", "cadence", "gap_limit")
        )
        passed = (F.col("_due") <= F.col("own")) & F.coalesce(F.col("_due") > F.col("_shown"), F.lit(True))
        heard = days.join(known.filter("touched"), "series_key").filter(passed | (F.col("was_valid") & ~F.col("valid")))
        heard = heard.join(limits, "series_key")
        tick = spark.range(1).select(F.lit(None).cast("string").alias("series_key"), F.lit(0).cast("bigint").alias("day"))
        routed = near.unionByName(heard.select("series_key", "day", "own", "valid", "cadence", "gap_limit"), allowMissingColumns=True)
        routed = routed.unionByName(tick, allowMissingColumns=True).withColumns({"clock": clock, "step": F.lit(batch_id)})
        write_batch(routed, f"{root}/routed", batch_id)

    # claims and the stretches of anchors that were settled meet in buckets of one cadence, of a minute at least
    width = (F.greatest(F.col("cadence_seconds"), F.lit(60.0)) * 1000000.0).cast("bigint")
    asked = ready.select(*assets.columns, "_at", F.floor(F.col("_at") / width).alias("_bucket"))
    widths = ready.select("series_key", width.alias("_width")).distinct()

    def settle(rows: DataFrame, batch_id: int) -> None:
        buckets = F.sequence(F.floor((F.col("after") + 1) / F.col("_width")), F.floor(F.col("until") / F.col("_width")))
        spread = rows.join(widths, "series_key").withColumn("_bucket", F.explode(buckets))
        met = asked.join(spread, ["series_key", "_bucket"]).filter((F.col("_at") > F.col("after")) & (F.col("_at") <= F.col("until")))
        write_batch(_settled(met, assets.columns, profile), f"{root}/settled", batch_id)

    drain(bars, route, checkpoint)
    blocked = claims.filter("blocked_status IS NOT NULL").select(
        *assets.columns, F.explode(F.array(*map(F.lit, hours))).alias("hours"), F.col("blocked_status").alias("entry_status"),
        F.lit(None).cast("bigint").alias("entry"), *[F.lit(None).cast(kind).alias(name) for name, kind in FIGURES.items()],
    )
    write_batch(_settled(blocked, assets.columns, profile), f"{root}/settled", -1)
    told = "series_key string, after long, until long, entry long, entry_status string, hours int, " + ", ".join(f"{name} {kind}" for name, kind in FIGURES.items())
    with keyed_state(spark):
        # a batch is routed again only if its own stream failed, and then nothing has been read from here yet
        routed = spark.readStream.schema(ROUTED).option("recursiveFileLookup", True).parquet(f"{root}/routed").withWatermark("clock", f"{round(lateness_seconds * 1000)} milliseconds")
        settled = routed.groupBy("series_key", "day").transformWithState(
            EntryWindows(hours), told, "Append", "EventTime"
        )
        drain(settled, settle, f"{checkpoint}-windows")


def _settled(rows: DataFrame, columns: list[str], profile: DataFrame) -> DataFrame:
    """Rows of ``windows.windows_over`` from claims (``columns``) with the figures of their settled windows."""
    stamps = {c: _stamp(F.col(c)) for c in ("high_ts", "low_ts", "last_bar_ts")}
    located = rows.withColumns({"entry_ts": _stamp(F.col("entry")), **stamps}).drop("entry")
    figured = windows.window_coverage(located.join(profile.drop("blocked_status"), "series_key"))
    stats = windows.window_status(windows.rounded_returns(windows.window_returns(figured)), F.col("window_end"))
    stats = stats.withColumn("status", F.coalesce("entry_status", "status"))
    # a window without an entry has neither an end nor figures
    entered = lambda c: F.when(F.col("entry_ts").isNotNull(), F.col(c)).alias(c)
    plain = [*columns, "entry_ts", "hours", "status"]
    rest = [c for c in stats.columns if c not in (*plain, *windows.POLICY, "entry_status", "elapsed", "_at", "_bucket", "_width", "after", "until")]
    return stats.select(*plain, *map(entered, rest), (F.col("status") == "complete").alias("complete"))


def daily_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Score sums per tumbling day and key."""
    counted = F.col("counts_in_final_score")
    return (
        scores.groupBy(F.window("ts", "1 day").alias("_w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("total_claims"),
            F.count_if(counted).alias("counted_claims"),
            F.sum(F.when(counted, F.col("score"))).alias("points"),
        )
        .select(F.col("_w.start").alias("day"), *keys, "total_claims", "counted_claims", "points")
    )


def stream_score_rollup(scores: DataFrame, root: str, checkpoint: str, keys: list[str]) -> None:
    """Keeps the daily roll-up of a score stream up to date.

    Only groups touched by a batch are written; ``latest_rollup`` takes the newest
    state of each.
    """
    drain(daily_scores(scores, keys), lambda rows, i: write_batch(rows, f"{root}/rollup", i), checkpoint, mode="update")


def latest_rollup(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of every group from the update table."""
    value = F.struct("total_claims", "counted_claims", "points")
    return updates.groupBy("day", *keys).agg(F.max_by(value, "batch").alias("_v")).select("day", *keys, "_v.*")
