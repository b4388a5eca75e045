"""Outcome windows on literal bars, and against a plain loop on random ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hindcast.operators import resolve, windows

T0 = datetime(2026, 6, 1)
HOUR = timedelta(hours=1)
HOURLY = ("non_continuous", 3600.0, 259200.0, 259200.0, 4)
MINUTE = ("continuous", 60.0, 60.0, 60.0, 1440)
BARS = "series_key string, row_no bigint, ts timestamp_ntz, open double, high double, low double, close double"
SERIES = (
    "series_key string, provider string, session_type string, cadence_seconds double, maximum_gap_seconds double, "
    "boundary_tolerance_seconds double, minimum_bars_per_24h int"
)


def run(spark, bars, anchors, policy=HOURLY, as_of=T0 + 100 * HOUR, provider="csv", hours=(24, 48), block=None):
    """{(claim, hours): row} for one series 's'."""
    rows = [("s", i, *b) for i, b in enumerate(bars)]
    series = [("s", provider, *(policy or (None,) * 5))]
    out = windows.outcome_windows(
        spark.createDataFrame([(i, 0, "s", a) for i, a in enumerate(anchors)], "claim_id int, asset_pos int, series_key string, anchor timestamp_ntz"),
        spark.createDataFrame(rows, BARS),
        spark.createDataFrame(series, SERIES),
        F.lit(as_of).cast("timestamp_ntz"),
        hours,
        block,
    )
    return {(r.claim_id, r.hours): r for r in out.collect()}


def flat(ts, price=100.0):
    return (ts, price, price + 1, price - 1, price)


def test_first_tradable_bar_opens_the_window(spark):
    bars = [(T0 + (11 + h) * HOUR, 100.0 + h, 102.0 + h, 99.0 + h, 101.0 + h) for h in range(26)]
    row = run(spark, bars, [T0 + 10.5 * HOUR], (*HOURLY[:4], 24))[0, 24]
    assert (row.status, row.open, row.high, row.low, row.bar_count) == ("complete", 100.0, 125.0, 99.0, 24)
    assert row.entry_ts == T0 + 11 * HOUR and row.high_ts == T0 + 34 * HOUR


def test_window_is_half_open(spark):
    bars = [flat(T0), (T0 + 24 * HOUR, 100.0, 999.0, 1.0, 500.0)]
    row = run(spark, bars, [T0])[0, 24]
    assert (row.high, row.low, row.bar_count) == (101.0, 99.0, 1)
    assert run(spark, bars, [T0])[0, 48].high == 999.0


def test_not_elapsed_is_not_complete(spark):
    row = run(spark, [flat(T0)], [T0], as_of=T0 + 2 * HOUR)[0, 24]
    assert row.status == "window_not_elapsed" and not row.complete


def test_continuous_series_needs_every_bar(spark):
    minute = timedelta(minutes=1)
    full = [flat(T0 + i * minute) for i in range(1440 * 2)]
    for block in (None, 3600):
        rows = run(spark, full, [T0, T0 + 90 * minute], MINUTE, provider="Binance public market data", block=block)
        assert rows[0, 24].status == rows[0, 48].status == rows[1, 24].status == "complete"
        assert rows[1, 48].status == "source_coverage_gap" and rows[1, 48].bar_count == 2790
    holed = full[:700] + full[701:]
    row = run(spark, holed, [T0], MINUTE)[0, 24]
    assert row.status == "source_coverage_gap"
    assert row.reasons == ["bar_count_below_declared_minimum", "gap_exceeds_declared_session_maximum"]


def test_statuses_before_any_bar_is_used(spark):
    good = [flat(T0), flat(T0 + HOUR)]
    assert run(spark, good, [T0], None)[0, 24].status == "coverage_policy_missing"
    assert run(spark, good, [T0], (*HOURLY[:4], 2))[0, 24].status == "coverage_policy_invalid"
    assert run(spark, good, [T0], HOURLY, provider="Binance public market data")[0, 24].status == "coverage_policy_invalid"
    assert run(spark, [flat(T0), flat(T0)], [T0])[0, 24].status == "invalid_market_series"
    assert run(spark, [(T0, 10.0, 9.0, 8.0, 10.0)], [T0])[0, 24].status == "invalid_market_series"
    assert run(spark, [flat(T0 + HOUR), flat(T0)], [T0])[0, 24].status == "invalid_market_series"


def test_late_and_missing_entry(spark):
    policy = ("non_continuous", 3600.0, 7200.0, 7200.0, 4)
    bars = [flat(T0), flat(T0 + 10 * HOUR)]
    rows = run(spark, bars, [T0, T0 + HOUR, T0 + 8 * HOUR, T0 + 11 * HOUR], policy)
    assert rows[0, 24].entry_ts == T0
    assert rows[1, 24].status == "next_tradable_bar_too_late"
    assert rows[2, 24].entry_ts == T0 + 10 * HOUR  # exactly the allowed gap
    assert rows[3, 24].status == "no_bar_after_publication"


def test_level_events_in_order(spark):
    minute = timedelta(minutes=1)
    bars = [(T0, 100.0, 101.0, 99.0, 100.0), (T0 + minute, 100.0, 106.0, 100.0, 105.0), (T0 + 2 * minute, 105.0, 105.0, 94.0, 95.0)]
    levels = spark.createDataFrame([("s", T0, 105.0), ("s", T0, 95.0)], "series_key string, entry_ts timestamp_ntz, level double")
    table = spark.createDataFrame([("s", i, *b) for i, b in enumerate(bars)], BARS)
    found = {r.level: r for r in windows.level_events(levels, table, (1,)).collect()}
    assert found[105.0].first_touch == T0 + minute and found[105.0].first_close_above is None
    assert found[95.0].first_close_below is None and found[95.0].first_touch == T0 + 2 * minute
    assert found[95.0].first_close_above == T0


def test_aliases(spark):
    rows = [("btc / usd",), ("eth–btc",), ("USDIRR",), ("DowJones",), ("macro",), ("BTC.D",)]
    exploded = spark.createDataFrame(rows, "asset string")
    out = resolve.classify_unresolved(resolve.resolve_asset(exploded, resolve.default_registry(spark)))
    got = {r.asset: (r.series_key, r.unresolved_status) for r in out.collect()}
    assert got["btc / usd"] == ("BTC-USD", None) and got["eth–btc"] == ("ETH-BTC", None) and got["DowJones"] == ("^DJI", None)
    assert got["USDIRR"] == (None, "unsupported_asset") and got["macro"] == (None, "out_of_scope_non_price")
    reason = {r.asset: r.unresolved_reason for r in out.collect()}["BTC.D"]
    assert reason.startswith("TradingView's BTC dominance")


def test_operator_aliases_override_defaults(spark):
    own = spark.createDataFrame([("gold ", "MY-GOLD", "desk")], "alias string, series_key string, proxy_note string")
    registry = resolve.asset_registry(resolve.default_registry(spark), own)
    assert [r.series_key for r in registry.filter("alias = 'GOLD'").collect()] == ["MY-GOLD"]


def plain_window(bars, anchor, hours, max_gap):
    """The window by a loop over sorted bars."""
    after = [b for b in bars if b[0] >= anchor]
    if not after:
        return "no_bar_after_publication"
    entry = after[0][0]
    if (entry - anchor).total_seconds() > max_gap:
        return "next_tradable_bar_too_late"
    inside = [b for b in after if b[0] < entry + hours * HOUR]
    high, low = max(b[2] for b in inside), min(b[3] for b in inside)
    return (
        entry, len(inside), inside[0][1], high, next(b[0] for b in inside if b[2] == high), low,
        next(b[0] for b in inside if b[3] == low), inside[-1][4], round((inside[-1][4] / inside[0][1] - 1) * 100, 6),
    )


@pytest.mark.parametrize("block", [None, 5000, 6 * 3600, 40 * 3600])
def test_random_bars_with_gaps_and_ties(spark, block):
    rng = random.Random(7)
    bars, ts = [], T0
    for _ in range(400):
        ts += HOUR * rng.choice([1, 1, 1, 2, 9])
        o, c = rng.randint(5, 9), rng.randint(5, 9)
        bars.append((ts, float(o), float(max(o, c) + rng.randint(0, 2)), float(min(o, c) - rng.randint(0, 2)), float(c)))
    policy = ("non_continuous", 3600.0, 4 * 3600.0, 4 * 3600.0, 4)
    anchors = [T0 + timedelta(minutes=rng.randint(-100, 60 * 1700)) for _ in range(300)]
    rows = run(spark, bars, anchors, policy, as_of=T0 + 9000 * HOUR, block=block)
    for i, anchor in enumerate(anchors):
        for hours in (24, 48):
            want, r = plain_window(bars, anchor, hours, 4 * 3600), rows[i, hours]
            if isinstance(want, str):
                assert r.status == want
            else:
                assert (r.entry_ts, r.bar_count, r.open, r.high, r.high_ts, r.low, r.low_ts, r.close, r.return_pct) == want


@pytest.mark.parametrize("cadence", [60.0, 97.0, 1800.0])
def test_roll_ups_of_every_tier_equal_the_bars(spark, cadence):
    """Entries on and off block borders; odd cadences; gaps inside and at the edges of blocks."""
    rng, step = random.Random(11), timedelta(seconds=cadence)
    bars, ts = [], T0
    while ts < T0 + 110 * HOUR:
        o, c = rng.randint(5, 99), rng.randint(5, 99)
        bars.append((ts, float(o), float(max(o, c) + rng.randint(0, 2)), float(min(o, c) - rng.randint(0, 2)), float(c)))
        ts += step * rng.choice([1] * 20 + [2, 3, 7])
    anchors = [bars[0][0], *[T0 + timedelta(hours=8 * k) for k in range(8)], *[T0 + timedelta(seconds=rng.randint(0, 62 * 3600)) for _ in range(60)]]
    fewest = max(2, -(-8640 // int(cadence)) + 1)
    rows = run(spark, bars, anchors, ("non_continuous", cadence, 8 * cadence, 8 * cadence, fewest), as_of=T0 + 9000 * HOUR)
    for i, anchor in enumerate(anchors):
        for hours in (24, 48):
            r, want = rows[i, hours], plain_window(bars, anchor, hours, 8 * cadence)
            assert (r.entry_ts, r.bar_count, r.open, r.high, r.high_ts, r.low, r.low_ts, r.close, r.return_pct) == want
            stamps = [b[0] for b in bars if r.entry_ts <= b[0] < r.entry_ts + hours * HOUR]
            gaps = [(b - a).total_seconds() for a, b in zip(stamps, stamps[1:])]
            assert r.last_bar_ts == stamps[-1] and r.maximum_observed_gap_seconds == max(gaps)
            assert r.irregular_gaps == sum(g % cadence != 0 for g in gaps)


def test_minute_windows_meet_few_rows(spark):
    """The join behind a window grows with its pieces, not with its bars."""
    minute = timedelta(minutes=1)
    rows = [("s", i, *flat(T0 + i * minute)) for i in range(1440 * 3)]
    series = spark.createDataFrame([("s", "csv", *MINUTE)], SERIES)
    profile, usable = windows.prepare(spark.createDataFrame(rows, BARS), series)
    entries = spark.createDataFrame([("s", T0 + k * minute) for k in (0, 1, 333, 479, 480)], "series_key string, entry_ts timestamp_ntz")
    met = windows._pieces_of_windows(entries, windows._bar_pieces(usable), profile, (24, 48), None)
    counts = met.groupBy("entry_ts").agg(F.count("*").alias("rows"), F.sum("n").alias("bars")).collect()
    assert len(counts) == 5 and all(r.bars == 2880 and r.rows <= 100 for r in counts)


def test_one_series_and_bar_may_hold_most_claims(spark):
    bars = [flat(T0 + i * HOUR) for i in range(60)]
    rows = run(spark, bars, [T0 + timedelta(seconds=i % 3000) for i in range(3000)])
    assert len(rows) == 6000 and {r.status for r in rows.values()} == {"complete"}


def test_window_support_needs_every_asset(spark):
    rows = [
        (1, 0, "available", 24, True, "24h"), (1, 1, "available", 24, True, "24h"),
        (2, 0, "available", 24, True, "24h"), (2, 1, "available", 24, False, "24h"),
        (3, 0, "available", 24, False, "48h"), (3, 0, "available", 48, True, "48h"),
        (4, 0, "unsupported_asset", None, None, "24h"), (5, 0, "available", 24, True, None),
    ]
    long = spark.createDataFrame(rows, "claim_id int, asset_pos int, asset_status string, hours int, complete boolean, w string")
    got = {r.claim_id: bool(r.supported) for r in windows.window_supported(long, "w").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_a_fine_cadence_with_a_year_of_gap_takes_few_buckets(spark):
    """One bar under a policy of one second and a gap of a year must not become millions of rows."""
    stamp = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"
    bars = spark.sql(f"SELECT 's' AS series_key, {stamp} AS ts, CAST(NULL AS TIMESTAMP_NTZ) AS prev_ts, 1D AS cadence_seconds, 3e7D AS maximum_gap_seconds")
    profile = spark.sql(f"SELECT 's' AS series_key, 1D AS cadence_seconds, 3e7D AS maximum_gap_seconds, {stamp} AS series_last_ts, CAST(NULL AS STRING) AS blocked_status")
    anchors = spark.sql("SELECT 's' AS series_key, explode(array(TIMESTAMP_NTZ '2024-05-31 00:00:00', TIMESTAMP_NTZ '2023-06-25 00:00:00', TIMESTAMP_NTZ '2023-01-01 00:00:00')) AS anchor")
    rows = windows.asof_entry_bar(anchors, bars, profile).collect()
    assert sorted((r.anchor.year, r.entry_ts is not None, r.entry_status) for r in rows) == [
        (2023, False, "next_tradable_bar_too_late"), (2023, True, None), (2024, True, None),
    ]


def test_level_events_are_nested_in_the_order_of_the_levels(spark):
    bars = [("s", i, T0 + i * HOUR, 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i) for i in range(60)]
    profile, usable = windows.prepare(spark.createDataFrame(bars, BARS), spark.createDataFrame([("s", "csv", *HOURLY)], SERIES))
    claims = [(1, 0, "s", T0, [40.0, 12.0, 500.0]), (2, 0, "s", T0, []), (3, 0, "s", T0 + 400 * HOUR, [12.0])]
    assets = spark.createDataFrame(claims, "claim_id int, asset_pos int, series_key string, anchor timestamp_ntz, levels array<double>")
    long = windows.windows_over(assets, profile, usable, F.lit(T0 + 100 * HOUR).cast("timestamp_ntz"))
    nested = windows.with_level_events(long, windows.level_events(windows.claim_levels(long), usable))
    got = {(r.claim_id, r.hours): r.level_events for r in nested.collect()}
    day, two = got[1, 24], got[1, 48]
    assert [e.level for e in day] == [40.0, 12.0, 500.0] and day[0].first_touch is None and two[0].first_touch == T0 + 29 * HOUR
    assert day[1].first_touch == T0 + HOUR and day[1].first_close_above == T0 + 3 * HOUR and day[1].first_close_below == T0
    assert day[2].first_close_above is None and got[2, 24] == [] and got[3, 48] is None


@pytest.mark.parametrize("spans", [(28800, 1800), (14400, 3600, 900), (7200,)])
def test_level_tree_finds_the_events_of_a_plain_scan(spark, spans):
    rng = random.Random(7)
    bars, price, ts = [], 100.0, T0
    for _ in range(400):
        # jumps leave prices that no bar held, holes leave spans without bars
        price += rng.choice([rng.uniform(-0.4, 0.4), rng.uniform(-3, 3)])
        low, high = price - rng.uniform(0, 0.5), price + rng.uniform(0, 0.5)
        bars.append(("s", ts, round(low, 2), round(high, 2), round(rng.uniform(low, high), 2)))
        ts += timedelta(minutes=rng.choice([5, 5, 5, 15, 15, 700]))
    asked = {(bar[1], round(bar[3] + rng.choice([0, rng.uniform(-2, 2)]), 2)) for bar in rng.sample(bars, 60)}
    table = spark.createDataFrame(bars, "series_key string, ts timestamp_ntz, low double, high double, close double")
    levels = spark.createDataFrame([("s", *a) for a in asked], "series_key string, entry_ts timestamp_ntz, level double")
    got = {(r.entry_ts, r.level, r.hours): (r.first_touch, r.first_close_above, r.first_close_below) for r in windows.level_events(levels, table, spans=spans).collect()}
    touches = {}
    for r in windows.level_touches(levels, table, 24, spans).collect():
        touches.setdefault((r.entry_ts, r.level), []).append(r.ts)
    assert len(got) == 2 * len(asked)
    for (entry, level, hours), events in got.items():
        window = [b for b in bars if entry <= b[1] < entry + hours * HOUR]
        first = lambda test: next((b[1] for b in window if test(b)), None)
        assert events == (first(lambda b: b[2] <= level <= b[3]), first(lambda b: b[4] > level), first(lambda b: b[4] < level))
        if hours == 24:
            assert sorted(touches.get((entry, level), [])) == [b[1] for b in window if b[2] <= level <= b[3]]


def test_levels_descend_without_being_sorted(spark):
    """Only tables over the bars are ordered: no window brings the rows of a level together, and AQE leaves levels spread."""
    table = spark.createDataFrame([("s", T0, None, 1.0, 2.0, 0.5, 1.5)], "series_key string, ts timestamp_ntz, prev_ts timestamp_ntz, open double, high double, low double, close double")
    located = spark.createDataFrame([("s", T0, [1.0, 3.0])], "series_key string, entry_ts timestamp_ntz, levels array<double>")
    levels = windows.claim_levels(located)
    plan = windows.level_events(levels, table)._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line]
    assert ordered and all("level#" not in line for line in ordered)
    assert "RepartitionByExpression" in levels._jdf.queryExecution().optimizedPlan().toString()


def test_level_tree_reads_few_bars_and_refuses_odd_spans(spark):
    bars = [("s", T0 + timedelta(minutes=m), 100.0 + m / 100, 100.02 + m / 100, 100.01 + m / 100) for m in range(2880)]
    table = spark.createDataFrame(bars, "series_key string, ts timestamp_ntz, low double, high double, close double")
    levels = spark.createDataFrame([("s", T0, 115.005)], "series_key string, entry_ts timestamp_ntz, level double")
    opened = windows._bars_by_level(levels, table, 48, windows._EVENTS, True, windows.TREE_SECONDS).count()
    assert opened <= 4 * 30
    with pytest.raises(ValueError):
        windows.level_events(levels, table, spans=(5000, 1800))


def test_levels_without_bars_come_back_without_events(spark):
    table = spark.createDataFrame([], "series_key string, ts timestamp_ntz, low double, high double, close double")
    levels = spark.createDataFrame([("s", T0, 1.0)], "series_key string, entry_ts timestamp_ntz, level double")
    rows = windows.level_events(levels, table).collect()
    assert [(r.hours, r.first_touch) for r in rows] == [(24, None), (48, None)]


def test_levels_meet_the_tree_without_being_sorted(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    bars = spark.range(200).selectExpr(
        "'a' AS series_key", "CAST('2024-01-01' AS timestamp_ntz) + make_dt_interval(0, CAST(id AS int)) AS ts",
        "CAST(id % 7 AS double) AS low", "CAST(id % 7 + 2 AS double) AS high", "CAST(id % 7 + 1 AS double) AS close",
    )
    levels = bars.selectExpr("series_key", "ts AS entry_ts", "explode(array(1.5D, 4.5D)) AS level")
    try:
        spark.conf.set(key, "-1")
        touches = windows.level_touches(levels, bars, 24)
        plan = touches._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan
        assert touches.count() == levels.alias("l").join(
            bars.alias("b"), F.expr("b.ts >= entry_ts AND b.ts < entry_ts + INTERVAL 24 HOURS AND low <= level AND level <= high")
        ).count()
    finally:
        spark.conf.set(key, usual)
