"""Streams equal their batch operators; text sources keep file order."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hindcast.operators import quality, windows
from hindcast.plans import files as file_plans
from hindcast.plans import series as series_plans
from hindcast.plans import streams as stream_plans
from hindcast.sources import bars as bar_sources
from hindcast.streaming import bars as bar_streams
from hindcast.streaming import outcomes as outcome_streams
from hindcast.streaming.tables import parquet_stream, read_batches

T0 = datetime(2026, 6, 1)
HOUR = timedelta(hours=1)
BARS = "series_key string, row_no bigint, ts timestamp_ntz, open double, high double, low double, close double"
SERIES = (
    "series_key string, provider string, session_type string, cadence_seconds double, maximum_gap_seconds double, "
    "boundary_tolerance_seconds double, minimum_bars_per_24h int"
)


def drop_files(spark, path, rows, schema, parts, run):
    """Feeds the rows in ``parts`` slices, draining the stream after each."""
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)
        run()


def test_bar_rules_across_batches(spark, tmp_path):
    rng = random.Random(5)
    rows, clock = [], {"a": T0, "b": T0}
    for i in range(240):
        key = rng.choice("ab")
        clock[key] += HOUR
        ts = clock[key] - HOUR * rng.choice([0] * 12 + [1, 2, 30])
        rows.append((key, i, ts, 1.0, rng.choice([2.0] * 20 + [0.5]), 1.0, 1.5))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for half in (rows[:120], rows[120:]):
        for k in range(0, 120, 24):
            spark.createDataFrame(half[k : k + 24], BARS).coalesce(1).write.mode("append").parquet(source)
        bar_streams.stream_validate_bars(parquet_stream(spark, source, 1), root, f"{root}/cp")
    streamed = {tuple(r) for r in read_batches(spark, f"{root}/violations").drop("batch").collect()}
    batch = {tuple(r) for r in quality.validate_ohlc(spark.createDataFrame(rows, BARS)).collect()}
    assert streamed == batch and {r[3] for r in batch} >= {"duplicate_timestamp", "timestamps_not_increasing", "high_below_low"}


def test_validation_query_streams_rows_in_order(spark, tmp_path, monkeypatch):
    """Four parts, each batch wholly behind the one before, whichever files were finished first."""
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id / 3 as int), id % 7)"
    events = spark.range(4000).selectExpr("id AS event_id", "id % 8 AS user_id", f"{at} AS ts", "'click' AS event_type", "cast(id % 50 as double) AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    root = str(tmp_path / "out")
    monkeypatch.setattr(stream_plans, "shared_dir", lambda _: root)
    got = {tuple(r) for r in stream_plans.stream_validate_bars_query(spark, str(tmp_path)).collect()}
    spans = read_batches(spark, f"{root}/bars").groupBy("batch").agg(F.min("row_no"), F.max("row_no"), F.count("*")).orderBy("batch").collect()
    assert len(spans) == 4 and sum(s[3] for s in spans) == 4000
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    assert got == {tuple(r) for r in quality.validate_ohlc(series_plans.typed_ticks(spark, str(tmp_path))).collect()}


def test_windows_settle_as_in_batch(spark, tmp_path):
    """Twelve files, one a batch, with a new start in the middle; then the batch operator over all of them."""
    rng = random.Random(9)
    bars, ts = [], T0
    for i in range(156):
        ts += HOUR * rng.choice([1] * 40 + [3])
        bars.append(("s", i, ts, 5.0, 5.0 + rng.randint(0, 3), 5.0 - rng.randint(0, 3), 5.0))
        bars.append(("broken", i, ts, 5.0, 4.0 if i == 2 else 5.0, 5.0, 5.0))
    series = [(k, "csv", "non_continuous", 3600.0, 7200.0, 7200.0, 4) for k in ("s", "broken", "silent")]
    series = spark.createDataFrame([*series, ("undeclared", "csv", None, None, None, None, None)], SERIES)
    anchors = [(i, 0, "s", T0 + timedelta(minutes=rng.randint(-900, 60 * 200))) for i in range(60)]
    anchors += [(100 + i, i, k, T0 + HOUR * hours) for i, k in enumerate(("broken", "silent", "undeclared", "unknown")) for hours in (5,)]
    anchors.append((200, 0, "broken", T0 + 5000 * HOUR))
    assets = spark.createDataFrame(anchors, "claim_id int, asset_pos int, series_key string, anchor timestamp_ntz")
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for half in (bars[:156], bars[156:]):
        for k in range(0, 156, 26):
            spark.createDataFrame(half[k : k + 26], BARS).coalesce(1).write.mode("append").parquet(source)
        outcome_streams.stream_outcome_windows(parquet_stream(spark, source, 1), assets, series, root, f"{root}/cp")
    columns = ["claim_id", "hours", "status", "entry_ts", "bar_count", "high", "high_ts", "low", "low_ts", "close", "irregular_gaps",
               "excessive_gaps", "maximum_observed_gap_seconds", "reasons", "window_end", "return_pct", "complete"]
    streamed = sorted(map(tuple, read_batches(spark, f"{root}/settled").select(*columns).collect()), key=str)
    batch = windows.outcome_windows(assets, spark.createDataFrame(bars, BARS), series, F.lit(ts).cast("timestamp_ntz")).select(*columns).collect()
    open_claims = {r.claim_id for r in batch if r.status in ("window_not_elapsed", "no_bar_after_publication")}
    assert streamed == sorted((tuple(r) for r in batch if r.claim_id not in open_claims), key=str) and open_claims and streamed
    assert {r[2] for r in streamed} >= {"complete", "invalid_market_series", "coverage_policy_missing", "next_tradable_bar_too_late"}
    assert spark.read.parquet(f"{root}/routed").select("step").distinct().count() == 12


def test_open_windows_are_held_per_entry_bar():
    """The state knows stretches of anchors and their bar, not claims; unsound series settle whatever is still open."""
    box, due = [None], []
    held = SimpleNamespace(get=lambda: box[0], update=lambda value: box.__setitem__(0, value))
    keeper = outcome_streams.EntryWindows((24, 48))
    keeper.init(SimpleNamespace(getValueState=lambda *_: held, registerTimer=due.append))
    hour = outcome_streams.HOUR
    bar = lambda us, step, own, valid=True: SimpleNamespace(us=us, open=1.0, high=2.0, low=0.5, close=1.5, own=own, valid=valid, cadence=3600.0, gap_limit=7200.0, step=step)
    assert not list(keeper.handleInputRows(("s", 0), iter([bar(hour, 0, 2 * hour), bar(2 * hour, 0, 2 * hour)]), None))
    assert [w[:3] for w in box[0][1]] == [(-1, hour, hour), (hour, 2 * hour, 2 * hour)] and len(due) == 2
    told = list(keeper.handleInputRows(("s", 0), iter([bar(6 * hour, 1, 6 * hour)]), None))
    assert [(r.after, r.until, r.entry_status) for r in told] == [(2 * hour, 4 * hour - 1, "next_tradable_bar_too_late")] * 2
    told = list(keeper.handleInputRows(("s", 0), iter([bar(None, 2, 7 * hour, False)]), None))
    assert {r.entry_status for r in told} == {"invalid_market_series"} and (min(r.after for r in told), max(r.until for r in told)) == (-1, 24 * hour - 1)
    assert not list(keeper.handleInputRows(("s", 0), iter([bar(8 * hour, 3, 8 * hour)]), None))


def test_lagging_series_settles_by_timer(spark, tmp_path):
    """A window that its own series never passes is settled once the newest clock is far enough ahead."""
    series = spark.createDataFrame([(k, "csv", "non_continuous", 3600.0, 7200.0, 7200.0, 4) for k in "ab"], SERIES)
    assets = spark.createDataFrame([(1, 0, "a", T0)], "claim_id int, asset_pos int, series_key string, anchor timestamp_ntz")
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    first = [("a", i, T0 + i * HOUR, 5.0, 6.0, 4.0, 5.0) for i in range(10)]
    for rows, settled in ((first, 0), ([("b", 0, T0 + 49 * HOUR, 1.0, 1.0, 1.0, 1.0)], 0), ([("b", 1, T0 + 60 * HOUR, 1.0, 1.0, 1.0, 1.0)], 2)):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(source)
        outcome_streams.stream_outcome_windows(parquet_stream(spark, source, 1), assets, series, root, f"{root}/cp", 6 * 3600.0)
        got = read_batches(spark, f"{root}/settled").collect()
        assert len(got) == settled
    assert {(r.hours, r.bar_count, r.status) for r in got} == {(24, 10, "source_coverage_gap"), (48, 10, "source_coverage_gap")}


def stretches_of(spark, tmp_path, rows, **kwargs):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "series_key string, ts timestamp").withColumns(
        {"cadence_seconds": F.lit(3600.0), "maximum_gap_seconds": F.lit(7200.0)}
    ).repartition(3).write.mode("append").parquet(source)
    bar_streams.stream_gap_monitor(parquet_stream(spark, source), root, f"{root}/cp", idle_seconds=0.5, **kwargs)
    return {(r.series_key, r.bar_count, r.first_ts, r.last_ts) for r in bar_streams.latest_stretches(read_batches(spark, f"{root}/stretches")).collect()}


@pytest.mark.parametrize("seconds, stretches", [(7200, 1), (7273, 2)])
def test_gap_session_edge(spark, tmp_path, seconds, stretches):
    # tolerance is 36 s at hourly cadence: a gap of exactly 7236 s would still belong
    rows = [("s", T0), ("s", T0 + timedelta(seconds=seconds)), ("s", T0 + 500 * HOUR), ("z", T0 + 900 * HOUR)]
    got = stretches_of(spark, tmp_path, rows)
    assert len(got) == stretches + 2 and ("z", 1, T0 + 900 * HOUR, T0 + 900 * HOUR) in got


def test_silent_series_wakes_up(spark, tmp_path):
    assert stretches_of(spark, tmp_path, [("s", T0), ("s", T0 + HOUR), ("s", T0 + 5 * HOUR), (None, T0)], delay_seconds=86400.0) == {
        ("s", 2, T0, T0 + HOUR), ("s", 1, T0 + 5 * HOUR, T0 + 5 * HOUR), (None, 1, T0, T0)}
    # a late bar joins both stretches, which takes the second one back
    assert stretches_of(spark, tmp_path, [("s", T0 + 3 * HOUR), ("s", T0 + 6 * HOUR)], delay_seconds=86400.0) == {
        ("s", 5, T0, T0 + 6 * HOUR), (None, 1, T0, T0)}


def test_rollup_updates(spark, tmp_path):
    rows = [(T0 + HOUR * i, "c", i % 3 > 0, 1.0) for i in range(60)]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp_ntz, category string, counts_in_final_score boolean, score double"
    drop_files(spark, source, rows, schema, 4, lambda: outcome_streams.stream_score_rollup(parquet_stream(spark, source), root, f"{root}/cp", ["category"]))
    latest = outcome_streams.latest_rollup(read_batches(spark, f"{root}/rollup"), ["category"])
    batch = outcome_streams.daily_scores(spark.createDataFrame(rows, schema), ["category"])
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, batch.collect()))


KLINE = "{},100,102,99,101,10,1,1000,12"


@pytest.mark.parametrize(
    "lines, reason",
    [
        (["open_time,open,high,low,close,volume,close_time,quote_volume,trades", KLINE.format(1717200000000)], None),
        ([KLINE.format(1717200000000), "", KLINE.format(1717200060000)], None), ([KLINE.format(1717200000000), "not-a-time,1,1,1,1,1,1,1,1"], "non_numeric_timestamp"),
        ([KLINE.format(1717200000000), "open_time,a,b"], "non_numeric_timestamp"), (["1717200000000,100"], "truncated_row"),
    ],
)
def test_kline_files(spark, tmp_path, lines, reason):
    (tmp_path / "BTC-USD.csv").write_text("\n".join(lines) + "\n")
    read = bar_sources.scan_kline_csv(spark, str(tmp_path))
    verdict = bar_sources.kline_verdicts(read).first()
    assert (verdict.series_key, verdict.reason) == ("BTC-USD", reason)
    if reason is None:
        rows = bar_sources.kline_bars(read).orderBy("row_no").collect()
        assert rows[0].high == 102.0 and rows[0].trade_count == 12 and [r.ts for r in rows] == sorted(r.ts for r in rows)


def test_row_numbers_follow_a_split_file(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "S.csv").write_text("".join(KLINE.format(1717200000 + 60 * i) + "\n" for i in range(1000)))
        rows = bar_sources.kline_bars(bar_sources.scan_kline_csv(spark, str(tmp_path))).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.row_no for r in rows}) == 1000 and [r.ts for r in rows] == sorted(r.ts for r in rows)


def test_operator_csv_rejects_instead_of_repairing(spark, tmp_path):
    (tmp_path / "GOLD.csv").write_text("timestamp_utc,open,high,low,close,volume\n2026-06-01T00:00:00Z,1,2,1,2,\n2026-06-01T01:00:00Z,1,2,1,2,3,9\n2026-06-01T00:30:00Z,1,2,1,2,4\n")
    rows = bar_sources.scan_series_csv(spark, str(tmp_path), ["timestamp_utc", "open", "high", "low", "close", "volume"])
    got = rows.orderBy("row_no").collect()
    assert [r.extra_fields for r in got] == [False, True, False] and got[0].volume is None and got[0].series_key == "GOLD"
    assert quality.series_verdicts(rows).first().reason == "timestamps_not_increasing"
    heads = spark.createDataFrame([("a", "timestamp_utc,open,high,low,close"), ("b", "open,open,high,low,close"), ("c", "open,high")], "series_key string, header string")
    sound = spark.createDataFrame([("GOLD", None)], "series_key string, header_error string")
    assert bar_sources.csv_verdicts(rows, sound).first().reason == "row_has_extra_fields"
    assert [r.header_error for r in bar_sources.header_errors(heads).collect()] == [None, "duplicate_columns", "missing_columns: close, low, timestamp_utc"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_searched_once_per_split(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp_utc,open,high,low,close,volume\n2026-06-01T00:00:00Z,1,2,1,1,1\n")
    rows = bar_sources.scan_series_csv(spark, str(tmp_path), ["timestamp_utc", "open", "high", "low", "close", "volume"])
    lines = plan_of(rows).splitlines()
    searches = [i for i, line in enumerate(lines) if "regexp_extract" in line]
    assert len(searches) == 1 and "Aggregate [_file" in lines[searches[0]] + lines[searches[0] + 1]
    assert [(r.series_key, r.row_no) for r in rows.collect()] == [("s", 0)]


def test_verdicts_do_not_parse_their_files_again(spark, tmp_path):
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, id, 0, 0)"
    events = spark.range(300).selectExpr("id AS event_id", "id % 30 AS user_id", f"{at} AS ts", "'click' AS event_type", "cast(id as double) AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    verdicts = file_plans.scan_series_csv_verdicts_query(spark, str(tmp_path))
    assert "csv" not in plan_of(verdicts)
    assert {r.series_key: r.row_count for r in verdicts.collect()} == {f"click-{k}": 30 for k in range(10)}
