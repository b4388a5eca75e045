"""Outcome windows: as-of entry bars, half-open range joins, level events.

Work is done per distinct entry bar, not per claim. Every bar owns the anchors
in ``(previous bar, this bar]``, so the forward as-of lookup is a bucketed
interval join with at most one match; window aggregates are then computed once
for each (series, entry bar) and level events once for each (series, entry bar,
level), however many claims share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import numbers as nums
from hindcast.operators import quality

POLICY = [
    "session_type", "cadence_seconds", "maximum_gap_seconds", "boundary_tolerance_seconds",
    "minimum_bars_per_24h",
]
WINDOW_BUCKET_SECONDS = 86400


def series_profile(series: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Series dimension with policy status, validity and last bar.

    ``blocked_status`` holds the status that every window of the series gets
    before any bar is looked at; null when windows can be computed.
    """
    checked = quality.validate_coverage_policy(series)
    conflict = F.col("provider").eqNullSafe(F.lit(fv.CONTINUOUS_PROVIDER)) & (
        F.col("session_type") != "continuous"
    )
    return checked.join(
        verdicts.select("series_key", F.col("last_ts").alias("series_last_ts"), "valid"), "series_key", "left"
    ).withColumn(
        "blocked_status",
        F.coalesce(
            "policy_status",
            F.when(conflict, "coverage_policy_invalid"),
            F.when(~F.coalesce("valid", F.lit(True)), "invalid_market_series"),
        ),
    )


def usable_bars(bars: DataFrame, profile: DataFrame) -> DataFrame:
    """Bars (with ``prev_ts``) of series that can be windowed, plus policy and gap."""
    ready = profile.filter("blocked_status IS NULL").select("series_key", *POLICY)
    return bars.join(ready, "series_key").withColumn(
        "gap_seconds", nums.seconds_between(F.col("ts"), F.col("prev_ts"))
    )


def prepare(bars: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, usable bars): every bar is checked once, not once per claim.

    In a sound series the bar before is the row before.
    """
    checked = quality.checked_bars(bars)
    profile = series_profile(series, quality.verdicts_of(checked))
    return profile, usable_bars(checked.drop("broken"), profile)


#: buckets that a declared gap is cut into at most
MOST_BUCKETS = 64.0


def asof_entry_bar(anchors: DataFrame, bars: DataFrame, profile: DataFrame) -> DataFrame:
    """First bar at or after each anchor, inclusive, within the declared gap.

    ``anchors`` has (series_key, anchor) and keeps all its columns and rows;
    adds ``entry_ts`` and ``entry_status`` (null, ``no_bar_after_publication`` or
    ``next_tradable_bar_too_late``). ``bars`` are the usable ones of ``prepare``.

    Bars and anchors meet in buckets of one cadence, or of a 64th of the gap where that is wider: no
    bar takes more than 66 buckets under any policy.
    """
    limit = F.col("maximum_gap_seconds")
    width = F.greatest(F.col("cadence_seconds"), limit / MOST_BUCKETS)
    reach = F.greatest(
        nums.micros(F.col("ts")) - (limit * 1000000.0).cast("bigint"),
        F.coalesce(nums.micros(F.col("prev_ts")) + 1, F.lit(-(2**62))),
    )
    first_bucket = F.floor(reach.cast("double") / (width * 1000000.0))
    owned = bars.select(
        "series_key",
        F.col("ts").alias("entry_ts"),
        reach.alias("_from"),
        nums.micros(F.col("ts")).alias("_to"),
        F.explode_outer(F.sequence(first_bucket, nums.time_bucket(F.col("ts"), width))).alias("_bucket"),
    )
    dim = profile.select("series_key", width.alias("_width"), "series_last_ts", "blocked_status")
    keyed = (
        anchors.join(dim, "series_key", "left")
        .withColumn("_at", nums.micros(F.col("anchor")))
        .withColumn(
            "_bucket",
            F.when(F.col("blocked_status").isNull(), nums.time_bucket(F.col("anchor"), F.col("_width"))),
        )
    )
    matched = keyed.alias("a").join(
        owned.alias("b"),
        (F.col("a.series_key") == F.col("b.series_key"))
        & (F.col("a._bucket") == F.col("b._bucket"))
        & (F.col("a._at") >= F.col("b._from"))
        & (F.col("a._at") <= F.col("b._to")),
        "left",
    )
    return matched.select(
        *[F.col(f"a.{name}") for name in anchors.columns],
        F.col("b.entry_ts").alias("entry_ts"),
        F.when(F.col("a.blocked_status").isNotNull(), F.col("a.blocked_status"))
        .when(F.col("b.entry_ts").isNotNull(), F.lit(None).cast("string"))
        .when(
            F.col("a.series_last_ts").isNull() | (F.col("a.anchor") > F.col("a.series_last_ts")),
            "no_bar_after_publication",
        )
        .otherwise("next_tradable_bar_too_late")
        .alias("entry_status"),
    )


def _hours(hours: int) -> Column:
    return F.expr(f"INTERVAL '{hours}' HOUR")


def range_join_window(
    entries: DataFrame, bars: DataFrame, hours: int, bar_columns: list[str]
) -> DataFrame:
    """Bars with ``entry_ts <= ts < entry_ts + hours``, by day bucket."""
    start, stop = nums.micros(F.col("entry_ts")), nums.micros(F.col("entry_ts")) + hours * 3600 * 1000000 - 1
    day = WINDOW_BUCKET_SECONDS * 1000000.0
    spread = entries.withColumn(
        "_bucket",
        F.explode_outer(F.sequence(F.floor(start.cast("double") / day), F.floor(stop.cast("double") / day))),
    ).alias("e")
    keyed = bars.select(
        "series_key", "ts", *bar_columns, nums.time_bucket(F.col("ts"), WINDOW_BUCKET_SECONDS).alias("_bucket")
    ).alias("b")
    return spread.join(
        keyed,
        (F.col("e.series_key") == F.col("b.series_key"))
        & (F.col("e._bucket") == F.col("b._bucket"))
        & (F.col("b.ts") >= F.col("e.entry_ts"))
        & (F.col("b.ts") < F.col("e.entry_ts") + _hours(hours)),
    ).select(*[F.col(f"e.{c}") for c in entries.columns], F.col("b.ts").alias("ts"), *[F.col(f"b.{c}") for c in bar_columns])


def _bar_pieces(bars: DataFrame) -> DataFrame:
    """Single bars in the shape of ``_roll_up``."""
    gap, cadence = F.col("gap_seconds"), F.col("cadence_seconds")
    return bars.select(
        "series_key", "ts", *POLICY,
        F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), "open", "close",
        "high", F.col("ts").alias("high_ts"), "low", F.col("ts").alias("low_ts"), F.lit(1).cast("bigint").alias("n"),
        gap.alias("gap"),
        F.coalesce(quality.irregular_gap(gap, cadence), F.lit(False)).cast("bigint").alias("irregular"),
        F.coalesce(quality.excessive_gap(gap, F.col("maximum_gap_seconds"), cadence), F.lit(False)).cast("bigint").alias("excessive"),
    )


#: bars in a block of the finest roll-up, blocks in one of the next tier, and number of tiers
ROLL_UP_FACTOR = 8
ROLL_UP_TIERS = 3


def _block_start(at: Column, width: Column) -> Column:
    """Start of the aligned block that holds ``at``; both are whole microseconds."""
    return at - F.pmod(at, width)


def _roll_up(pieces: DataFrame, width: Column) -> DataFrame:
    """Pieces merged into aligned blocks of ``width``, without loss."""
    extreme = lambda sign, v, t: F.min(F.struct((F.col(v) * sign).alias("k"), F.col(t).alias("t")))
    rolled = pieces.groupBy("series_key", _block_start(nums.micros(F.col("first_ts")), width).alias("block")).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.min_by("open", "first_ts").alias("open"), F.max_by("close", "last_ts").alias("close"),
        F.max("high").alias("high"), extreme(-1, "high", "high_ts").alias("_hi"),
        F.min("low").alias("low"), extreme(1, "low", "low_ts").alias("_lo"),
        F.sum("n").alias("n"), F.max("gap").alias("gap"), F.sum("irregular").alias("irregular"), F.sum("excessive").alias("excessive"),
        *[F.any_value(c).alias(c) for c in POLICY],
    )
    return rolled.withColumns({"high_ts": F.col("_hi.t"), "low_ts": F.col("_lo.t")}).drop("_hi", "_lo")


PIECE = ["first_ts", "last_ts", "open", "close", "high", "high_ts", "low", "low_ts", "n", "gap", "irregular", "excessive"]


def _block_widths(block_seconds: int | None) -> list[Column]:
    """Block widths in microseconds, fine to coarse; each divides the next. They follow the cadence unless one is given."""
    if block_seconds is not None:
        return [F.lit(block_seconds * 1000000).cast("bigint")]
    bar = F.greatest((F.col("cadence_seconds") * 1000000).cast("bigint"), F.lit(1).cast("bigint"))
    return [bar * F.lit(ROLL_UP_FACTOR ** (k + 1)).cast("bigint") for k in range(ROLL_UP_TIERS)]


def _covering(start: Column, stop: Column, widths: list[Column], holds_entry: bool) -> Column:
    """(tier, block) pairs that make up ``[start, stop)``: the widest aligned blocks that fit, and tier -1 for the
    blocks at the edges, which are read bar by bar. The block of the entry bar is an edge even where it fits, since
    the gap before the entry is not part of the window.
    """
    first = start + 1 if holds_entry else start
    low = [_block_start(first + w - 1, w) for w in widths]
    high = [_block_start(stop, w) for w in widths]
    tag = lambda tier, blocks: F.transform(blocks, lambda b: F.struct(F.lit(tier).alias("tier"), b.alias("block")))
    run = lambda a, b, w: F.when(a < b, F.sequence(a, b - w, w)).otherwise(F.array().cast("array<bigint>"))
    parts = []
    for k, w in enumerate(widths):
        if k + 1 < len(widths):
            # what the wider tier covers is left out; where it covers nothing this tier takes all
            none = low[k + 1] >= high[k + 1]
            left, right = F.when(none, high[k]).otherwise(low[k + 1]), F.when(none, high[k]).otherwise(high[k + 1])
            parts += [tag(k, run(low[k], left, w)), tag(k, run(right, high[k], w))]
        else:
            parts.append(tag(k, run(low[k], high[k], w)))
    head, tail = _block_start(start, widths[0]), high[0]
    edges = F.filter(F.array(F.when(start < low[0], head), F.when(stop > tail, tail)), lambda b: b.isNotNull())
    return F.concat(tag(-1, F.array_distinct(edges)), *parts)


def _pieces_of_windows(
    entries: DataFrame, pieces: DataFrame, series: DataFrame, hours: tuple[int, ...], block_seconds: int | None
) -> DataFrame:
    """Joined (entry, piece) rows with one membership flag ``in_<h>`` per horizon.

    The horizons cut a window into stretches; each stretch is a few aligned blocks per tier and the bars at its ends.
    48 h over minute bars meet some 70 rows instead of 2,880. Blocks wider than every stretch are not built.
    """
    ends = sorted(set(hours))
    longest = max(b - a for a, b in zip([0, *ends], ends)) * 3600 * 1000000
    widths = _block_widths(block_seconds)
    entry = nums.micros(F.col("entry_ts"))
    at = lambda h: entry + F.lit(h * 3600 * 1000000).cast("bigint")
    def stretch(a: int, b: int) -> Column:
        return F.transform(
            _covering(at(a), at(b), widths, a == 0),
            lambda c: F.struct(F.lit(a).alias("after"), F.lit(b).alias("until"), c["tier"].alias("tier"), c["block"].alias("block")),
        )

    cadence = series.select("series_key", "cadence_seconds")
    asked = entries.select("series_key", "entry_ts").join(cadence, "series_key").select(
        "series_key", "entry_ts", F.inline_outer(F.concat(*[stretch(a, b) for a, b in zip([0, *ends], ends)]))
    )
    blocks = pieces.withColumns({"tier": F.lit(-1), "block": _block_start(nums.micros(F.col("ts")), widths[0])})
    kept, finer = ["series_key", "tier", "block", *PIECE, *POLICY], pieces
    blocks = blocks.select(*kept)
    for k, w in enumerate(widths):
        finer = _roll_up(finer.filter(w <= longest), w)
        blocks = blocks.unionByName(finer.withColumn("tier", F.lit(k)).select(*kept))
    met = asked.join(blocks, ["series_key", "tier", "block"])
    stamp = nums.micros(F.col("first_ts"))
    in_stretch = (stamp >= entry + F.col("after") * F.lit(3600000000).cast("bigint")) & (stamp < entry + F.col("until") * F.lit(3600000000).cast("bigint"))
    return met.filter((F.col("tier") >= 0) | in_stretch).withColumns(
        {"inner": F.col("first_ts") > F.col("entry_ts"), **{f"in_{h}": F.col("until") <= h for h in hours}}
    )


def window_ohlc(
    entries: DataFrame, bars: DataFrame, hours: tuple[int, ...] = fv.HORIZON_HOURS, block_seconds: int | None = None,
    series: DataFrame | None = None,
) -> DataFrame:
    """OHLC, extremes with their earliest stamps, and gap profile per entry.

    One join feeds all horizons; the result is long: (series_key, entry_ts, hours, ...). The inside of each window comes
    from roll-ups in tiers that follow the cadence of its series, or from blocks of ``block_seconds``; only the edges
    read single bars. ``series`` (series_key, cadence_seconds) saves looking the cadences up in the bars.
    """
    if series is None:
        series = bars.groupBy("series_key").agg(F.any_value("cadence_seconds").alias("cadence_seconds"))
    joined = _pieces_of_windows(entries, _bar_pieces(bars), series, hours, block_seconds)
    aggregates = []
    for h in hours:
        inside = F.col(f"in_{h}")
        inner = inside & F.col("inner")  # the gap before the entry bar is not part of the window
        pick = lambda c, test=inside: F.when(test, F.col(c))
        aggregates += [
            F.coalesce(F.sum(pick("n")), F.lit(0)).alias(f"bar_count_{h}"),
            F.min_by("open", pick("first_ts")).alias(f"open_{h}"),
            F.max(pick("high")).alias(f"high_{h}"),
            F.min(F.when(inside, F.struct((-F.col("high")).alias("k"), F.col("high_ts").alias("t")))).alias(f"_hi_{h}"),
            F.min(pick("low")).alias(f"low_{h}"),
            F.min(F.when(inside, F.struct(F.col("low").alias("k"), F.col("low_ts").alias("t")))).alias(f"_lo_{h}"),
            F.max_by("close", pick("last_ts")).alias(f"close_{h}"),
            F.max(pick("last_ts")).alias(f"last_bar_ts_{h}"),
            F.max(pick("gap", inner)).alias(f"maximum_observed_gap_seconds_{h}"),
            F.coalesce(F.sum(pick("irregular", inner)), F.lit(0)).alias(f"irregular_gaps_{h}"),
            F.coalesce(F.sum(pick("excessive", inner)), F.lit(0)).alias(f"excessive_gaps_{h}"),
        ]
    # the policy is the same on every bar of a series
    wide = joined.groupBy("series_key", "entry_ts").agg(*aggregates, *[F.any_value(c).alias(c) for c in POLICY])
    plain = ["bar_count", "open", "high", "low", "close", "last_bar_ts",
             "maximum_observed_gap_seconds", "irregular_gaps", "excessive_gaps"]
    per_hour = [
        F.struct(
            F.lit(h).alias("hours"),
            *[F.col(f"{name}_{h}").alias(name) for name in plain],
            F.col(f"_hi_{h}.t").alias("high_ts"),
            F.col(f"_lo_{h}.t").alias("low_ts"),
        )
        for h in hours
    ]
    return wide.select("series_key", "entry_ts", *POLICY, F.inline(F.array(*per_hour)))


def window_returns(windows: DataFrame) -> DataFrame:
    """Percent moves against the entry open; null when it is zero. Unrounded."""
    entry = F.nullif(F.col("open"), F.lit(0.0))
    move = lambda name: (F.col(name) / entry - 1) * 100
    return windows.withColumns(
        {"return_pct": move("close"), "max_up_pct": move("high"), "max_down_pct": move("low")}
    )


RETURN_COLUMNS = ("return_pct", "max_up_pct", "max_down_pct")


def rounded_returns(windows: DataFrame) -> DataFrame:
    return windows.withColumns({c: nums.round_half_even(F.col(c), 6) for c in RETURN_COLUMNS})


def window_coverage(windows: DataFrame) -> DataFrame:
    """Adds window end, coverage figures, reasons and note."""
    end = F.col("entry_ts") + F.make_dt_interval(hours=F.col("hours"))
    return (
        windows.withColumns({"window_end": end, "minimum_required_bars": quality.minimum_bars(F.col("hours"))})
        .withColumn(
            "boundary_lag_seconds",
            F.greatest(nums.seconds_between(F.col("window_end"), F.col("last_bar_ts")), F.lit(0.0)),
        )
        .withColumn("reasons", quality.coverage_reasons())
        .withColumns(
            {"coverage_complete": F.size("reasons") == 0, "coverage_note": quality.coverage_note(F.col("reasons"))}
        )
    )


def window_status(windows: DataFrame, as_of: Column) -> DataFrame:
    """Tri-state of a computed window: complete, source gap, or not elapsed."""
    elapsed = as_of >= F.col("window_end")
    return windows.withColumn("elapsed", elapsed).withColumn(
        "status",
        F.when(elapsed & F.col("coverage_complete"), "complete")
        .when(elapsed, "source_coverage_gap")
        .otherwise("window_not_elapsed"),
    )


#: spans of the tree over bars, coarse to fine; each divides the one before
TREE_SECONDS = (28800, 1800)
_ASKED = ["series_key", "entry_ts", "level"]
_EVENTS = ("first_touch", "first_close_above", "first_close_below")


def level_tree(bars: DataFrame, spans: tuple[int, ...] = TREE_SECONDS) -> list[DataFrame]:
    """Extremes per span of time, coarse to fine; each tier is built from the finer one.

    A node is ``solid`` when the ranges of its bars join up, so that every price between its low and its high was
    inside some bar. A bar is known by the node of the finest tier that holds it.
    """
    below = bars.select(
        "series_key", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), "low", "high",
        F.col("close").alias("close_low"), F.col("close").alias("close_high"), F.lit(True).alias("solid"),
    )
    tiers = []
    for span in reversed(spans):
        grouped = below.groupBy("series_key", nums.time_bucket(F.col("first_ts"), span).alias("node")).agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
            F.min("close_low").alias("close_low"), F.max("close_high").alias("close_high"),
            F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_ranges"), F.bool_and("solid").alias("_solid"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        # ranges by their low end: each has to start at or below the highest end before it
        joined_up = F.aggregate(
            "_ranges",
            F.struct(F.col("_solid").alias("ok"), F.col("low").alias("top")),
            lambda seen, r: F.struct((seen["ok"] & (r["low"] <= seen["top"])).alias("ok"), F.greatest(seen["top"], r["high"]).alias("top")),
        )["ok"]
        below = grouped.withColumn("solid", F.coalesce(joined_up, F.lit(False))).drop("_ranges", "_solid")
        tiers.insert(0, below)
    return tiers


def _level_tests(low: str, high: str, close_low: str, close_high: str) -> dict[str, Column]:
    """Per event whether a bar, or any bar of a node, can show it."""
    level = F.col("level")
    return {
        "first_touch": (F.col(low) <= level) & (level <= F.col(high)),
        "first_close_above": F.col(close_high) > level,
        "first_close_below": F.col(close_low) < level,
    }


def _node_runs(tier: DataFrame, first_starts: Column) -> DataFrame:
    """Every node once per start of a run that holds it, from ``first_starts`` up to itself, with what comes before it there.

    ``_top``, ``_bottom`` and ``_solid`` are the extreme closes and the solid ranges between start and node; ``_start``
    is the node at the start itself, which a window may cut.
    """
    runs = tier.withColumn("start", F.explode_outer(F.sequence(first_starts, F.col("node"))))
    run = Window.partitionBy("series_key", "start").orderBy("node")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    inner = lambda c: F.when(F.col("node") > F.col("start"), c)
    figures = F.when(F.col("node") == F.col("start"), F.struct("first_ts", "low", "high", "close_low", "close_high", "solid"))
    return runs.withColumns(
        {
            "_top": F.max(inner(F.col("close_high"))).over(earlier),
            "_bottom": F.min(inner(F.col("close_low"))).over(earlier),
            "_solid": F.collect_list(inner(F.when(F.col("solid"), F.struct("low", "high")))).over(earlier),
            "_start": F.first(figures).over(earlier),
        }
    )


def _surely_earlier() -> dict[str, Column]:
    """Per event whether a node of the run before this one surely holds it, inside the window."""
    level, start, holds = F.col("level"), F.col("_start"), lambda r: (r["low"] <= F.col("level")) & (F.col("level") <= r["high"])
    whole = start["first_ts"] >= F.col("entry_ts")
    return {
        "first_touch": F.exists("_solid", holds) | F.coalesce(whole & start["solid"] & holds(start), F.lit(False)),
        "first_close_above": F.coalesce(F.col("_top") > level, F.lit(False)) | F.coalesce(whole & (start["close_high"] > level), F.lit(False)),
        "first_close_below": F.coalesce(F.col("_bottom") < level, F.lit(False)) | F.coalesce(whole & (start["close_low"] < level), F.lit(False)),
    }


def _bars_by_level(
    entry_levels: DataFrame, bars: DataFrame, hours: int, events: tuple[str, ...], first: bool, spans: tuple[int, ...]
) -> DataFrame:
    """(entry, level, ts, one flag per event) of the bars that show an event, found from the top of the tree down.

    A node is opened only where its extremes allow the event. With ``first`` an event is not looked for behind a node
    of the same run that surely holds it: one inside the window, and solid where touches are meant. What comes before a
    node is a property of the tree, so levels are neither sorted nor brought together on their way down.
    """
    spans = tuple(s for s in spans if s <= hours * 3600)
    if not spans or any(a % b for a, b in zip(spans, spans[1:])):
        raise ValueError("spans must divide each other, and one has to fit into the window")
    entry, end = F.col("entry_ts"), F.col("entry_ts") + _hours(hours)
    # bars come dealt by series, which would build the whole tree of a series in one task
    bars = bars.repartition("series_key", nums.time_bucket(F.col("ts"), spans[0]))
    opened = entry_levels.select(*_ASKED, nums.time_bucket(entry, spans[0]).alias("start"), *[F.lit(True).alias(e) for e in events])
    for k, (span, tier) in enumerate(zip(spans, level_tree(bars, spans))):
        if k:  # the children of an opened node, from the one of the entry on
            ratio = spans[k - 1] // span
            starts = F.floor(F.col("node") / ratio) * ratio
            opened = opened.withColumn("start", F.greatest(nums.time_bucket(entry, span), F.col("node") * ratio)).drop("node")
        else:
            starts = F.col("node") - -(-hours * 3600 // span)
        runs = _node_runs(tier, starts)
        runs = runs if first else runs.drop("_top", "_bottom", "_solid", "_start")
        # the few nodes are hashed, so that the many levels are not sorted: a task holds its share of the tree only
        met = opened.join(runs.hint("shuffle_hash"), ["series_key", "start"])
        met = met.filter((F.col("last_ts") >= entry) & (F.col("first_ts") < end))
        tests = _level_tests("low", "high", "close_low", "close_high")
        if first:
            tests = {e: tests[e] & ~earlier for e, earlier in _surely_earlier().items()}
        met = met.withColumns({e: F.col(e) & tests[e] for e in events})
        any_left = F.greatest(*[F.col(e) for e in events]) if len(events) > 1 else F.col(events[0])
        opened = met.filter(any_left).select(*_ASKED, "node", *events)
    leaves = bars.select("series_key", "ts", "low", "high", "close", nums.time_bucket(F.col("ts"), spans[-1]).alias("node"))
    tests = _level_tests("low", "high", "close", "close")
    found = opened.join(leaves.hint("shuffle_hash"), ["series_key", "node"]).filter((F.col("ts") >= entry) & (F.col("ts") < end))
    return found.select(*_ASKED, "ts", *[(F.col(e) & tests[e]).alias(e) for e in events])


def level_events(
    entry_levels: DataFrame, bars: DataFrame, hours: tuple[int, ...] = fv.HORIZON_HOURS, spans: tuple[int, ...] = TREE_SECONDS
) -> DataFrame:
    """First touch and first close above/below each level, long by horizon.

    ``entry_levels`` has distinct (series_key, entry_ts, level), all of which come back. Levels descend a tree of
    extremes over the bars, so each meets a few nodes per tier and a few bars, not all bars of its window.
    """
    found = _bars_by_level(entry_levels, bars, max(hours), _EVENTS, True, spans)
    times = found.select(*_ASKED, *[F.when(F.col(e), F.col("ts")).alias(e) for e in _EVENTS])
    # joined, not united: a grouping may trust the partitioning of a union whose parts AQE has read differently
    seen = times.groupBy(*_ASKED).agg(*[F.min(e).alias(e) for e in _EVENTS])
    firsts = entry_levels.select(*_ASKED).join(seen, _ASKED, "left")
    # The first event inside a shorter horizon is the overall first one, if early enough.
    per_hour = [
        F.struct(
            F.lit(h).alias("hours"),
            *[
                (F.col(n) if h == max(hours) else F.when(F.col(n) < F.col("entry_ts") + _hours(h), F.col(n))).alias(n)
                for n in _EVENTS
            ],
        )
        for h in hours
    ]
    return firsts.select(*_ASKED, F.inline(F.array(*per_hour)))


def level_touches(entry_levels: DataFrame, bars: DataFrame, hours: int, spans: tuple[int, ...] = TREE_SECONDS) -> DataFrame:
    """(series_key, entry_ts, level, ts) of every bar in the window whose range holds the level.

    Only nodes of the tree whose extremes enclose the level are opened.
    """
    found = _bars_by_level(entry_levels, bars, hours, ("first_touch",), False, spans)
    return found.filter("first_touch").drop("first_touch")


def outcome_windows(
    assets: DataFrame,
    bars: DataFrame,
    series: DataFrame,
    as_of: Column,
    hours: tuple[int, ...] = fv.HORIZON_HOURS,
    block_seconds: int | None = None,
) -> DataFrame:
    """Long outcome rows: one per input row and horizon.

    ``assets`` are available (claim_id, asset_pos, series_key, anchor) rows.
    """
    return windows_over(assets, *prepare(bars, series), as_of, hours, block_seconds)


def windows_over(
    assets: DataFrame,
    profile: DataFrame,
    usable: DataFrame,
    as_of: Column,
    hours: tuple[int, ...] = fv.HORIZON_HOURS,
    block_seconds: int | None = None,
) -> DataFrame:
    """``outcome_windows`` on bars that were checked before."""
    located = asof_entry_bar(assets, usable, profile)
    entries = located.filter("entry_ts IS NOT NULL").select("series_key", "entry_ts").distinct()
    stats = window_status(
        rounded_returns(window_returns(window_coverage(window_ohlc(entries, usable, hours, block_seconds, profile)))), as_of
    ).drop(*POLICY, "elapsed")
    # a located row meets its horizons in the join; only the others are spread here
    joined = located.join(stats.withColumnRenamed("hours", "_hours"), ["series_key", "entry_ts"], "left")
    every = F.array(*[F.lit(h) for h in hours])
    spread = joined.withColumn(
        "hours", F.explode_outer(F.when(F.col("_hours").isNull(), every).otherwise(F.array("_hours")))
    )
    return spread.withColumns(
        {"status": F.coalesce("entry_status", "status"), "complete": F.coalesce("entry_status", "status") == "complete"}
    ).drop("entry_status", "_hours")


def claim_levels(located: DataFrame) -> DataFrame:
    """Distinct (series_key, entry_ts, level) behind located claims.

    They are dealt to as many partitions as the session asks for, which AQE does not merge: the rows shrink to a few
    bytes each in a shuffle, while the tree works on what they unfold to.
    """
    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        located.filter("entry_ts IS NOT NULL")
        .select("series_key", "entry_ts", F.explode("levels").alias("level"))
        .repartition(parts, *_ASKED)
        .distinct()
    )


def with_level_events(long: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``level_events`` to long outcome rows: per level of the claim, in its order, the first touch and the first
    close above and below inside the window. Null where there is no window.

    ``long`` has claim_id, asset_pos, hours, series_key, entry_ts and ``levels``; ``events`` comes from
    ``level_events``. A claim names a handful of levels.
    """
    keys, names = ["claim_id", "asset_pos", "hours"], ["first_touch", "first_close_above", "first_close_below"]
    asked = long.filter("entry_ts IS NOT NULL").select(*keys, "series_key", "entry_ts", F.posexplode("levels").alias("_pos", "level"))
    told = asked.join(events, ["series_key", "entry_ts", "level", "hours"], "left")
    nested = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "level", *names))).alias("_events"))
    plain = F.transform("_events", lambda e: F.struct(e["level"].alias("level"), *[e[n].alias(n) for n in names]))
    return long.join(nested, keys, "left").withColumn(
        "level_events", F.when(F.col("entry_ts").isNotNull(), F.coalesce(plain, F.array().cast(
            "array<struct<level: double, first_touch: timestamp_ntz, first_close_above: timestamp_ntz, first_close_below: timestamp_ntz>>"))),
    ).drop("_events")


def claim_outcome_status(claims: DataFrame) -> DataFrame:
    """Status of the whole claim outcome."""
    return claims.withColumn(
        "outcome_status",
        F.when(~F.col("precise"), "insufficient_timestamp_precision")
        .when(F.coalesce(F.size("assets"), F.lit(0)) <= 0, "no_asset")
        .otherwise("evaluated_for_price_outcome"),
    )


def assemble_outcomes(long: DataFrame) -> DataFrame:
    """Nest long rows per claim, assets in position order.

    ``long`` has claim_id, asset_pos, asset, asset_status, hours, status,
    complete and any further window columns, such as ``level_events``. A claim has a handful of assets.
    """
    identity = {"claim_id", "asset_pos", "asset", "asset_status", "series_key", "hours"}
    window = F.struct(*[c for c in long.columns if c not in identity])
    per_asset = long.groupBy("claim_id", "asset_pos").agg(
        F.first("asset").alias("asset"),
        F.first("asset_status").alias("status"),
        F.first("series_key").alias("series_key"),
        *[
            F.first(F.when(F.col("hours") == h, window), ignorenulls=True).alias(f"window_{h}h")
            for h in fv.HORIZON_HOURS
        ],
    )
    nested = F.struct("asset_pos", "asset", "status", "series_key", "window_24h", "window_48h")
    return per_asset.groupBy("claim_id").agg(F.sort_array(F.collect_list(nested)).alias("assets"))


def window_supported(assets: DataFrame, window: str) -> DataFrame:
    """Per claim: every asset available with the chosen window complete.

    ``assets`` is long (claim_id, asset_pos, asset_status, hours, complete) and
    ``window`` names the column with the claim's required window. Positions run
    from zero without holes. Claims without assets do not appear; a missing
    claim is not supported.
    """
    chosen = F.concat(F.col("hours").cast("string"), F.lit("h")) == F.col(window)
    good = (F.col("asset_status") == "available") & chosen & F.coalesce("complete", F.lit(False))
    return assets.groupBy("claim_id").agg(
        (F.max("asset_pos") + 1 == F.count_if(good)).alias("supported")
    )
