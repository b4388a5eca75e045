"""Series quality queries: parsing, bar rules, policies, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import numbers as nums
from hindcast.operators import quality
from hindcast.plans.registry import query
from hindcast.plans.views import view
from hindcast.sources import bars as bar_sources

# text faults 1, 3 give no stamp; 2 is naive; 6 is 3:30 ahead of UTC
TICKS_CTE = """
typed AS (
  SELECT series_key, row_no, fault,
    CASE fault WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN {hour} WHEN 5 THEN ts - INTERVAL 2 HOUR
      WHEN 6 THEN ts - INTERVAL 210 MINUTE WHEN 20 THEN TIMESTAMP '2024-01-02 03:00:00' WHEN 21 THEN TIMESTAMP '2024-01-02 03:04:05.123456' ELSE ts END AS ts,
    CASE fault WHEN 1 THEN 'timestamp_empty' WHEN 2 THEN 'timestamp_naive' WHEN 3 THEN 'timestamp_invalid' END AS ts_error,
    CASE WHEN fault IN (7, 8) THEN NULL WHEN fault = 22 THEN CAST(1.0 AS DOUBLE) WHEN fault = 23 THEN CAST(1.00000001 AS DOUBLE) WHEN fault = 24 THEN CAST(2.675 AS DOUBLE)
      WHEN fault = 25 THEN CAST(2e-08 AS DOUBLE) ELSE round(CAST(open AS DOUBLE), 8) END AS open,
    round(CAST(high AS DOUBLE), 8) AS high, round(CAST(low AS DOUBLE), 8) AS low,
    CASE WHEN fault IN (12, 13) THEN NULL ELSE round(CAST(close AS DOUBLE), 8) END AS close
  FROM {ticks}),
seen AS (
  SELECT *, lag(ts) OVER (PARTITION BY series_key ORDER BY row_no) AS prev_ts,
    ts IS NOT NULL AND row_number() OVER (PARTITION BY series_key, ts ORDER BY row_no) > 1 AS repeated FROM typed),
broken AS (
  SELECT series_key, row_no, rank, code FROM (
    SELECT series_key, row_no, 1 AS rank, ts_error AS code FROM seen WHERE ts_error IS NOT NULL
    UNION ALL SELECT series_key, row_no, 2, 'duplicate_timestamp' FROM seen WHERE repeated
    UNION ALL SELECT series_key, row_no, 3, 'timestamps_not_increasing' FROM seen WHERE NOT repeated AND ts <= prev_ts
    UNION ALL SELECT series_key, row_no, 4, 'missing_ohlc' FROM seen WHERE open IS NULL OR close IS NULL
    UNION ALL SELECT series_key, row_no, 5, 'high_below_low' FROM seen WHERE high < low
    UNION ALL SELECT series_key, row_no, 6, 'high_below_body' FROM seen WHERE high < greatest(open, close)
    UNION ALL SELECT series_key, row_no, 7, 'low_above_body' FROM seen WHERE low > least(open, close)
    UNION ALL SELECT series_key, row_no, 8, 'invalid_volume' FROM seen WHERE fault = 14
    UNION ALL SELECT series_key, row_no, 9, 'negative_volume' FROM seen WHERE fault = 15
    UNION ALL SELECT series_key, row_no, 10, 'invalid_trade_count' FROM seen WHERE fault = 16
    UNION ALL SELECT series_key, row_no, 11, 'negative_trade_count' FROM seen WHERE fault = 17))"""


def typed_ticks(spark, sf):
    return quality.clean_bars(view(spark, sf, "ticks").drop("ts", "fault")).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


@query("parse_aware_ts", f"WITH {TICKS_CTE} SELECT row_no, ts, substr(ts_error, 11) AS ts_error FROM typed")
def parse_aware_ts_query(spark, sf):
    parsed = view(spark, sf, "ticks").withColumn("parsed", nums.parse_aware_ts(F.col("timestamp_utc")))
    return parsed.select(
        "row_no",
        F.col("parsed").cast("timestamp_ntz").alias("ts"),
        nums.aware_ts_error(F.col("timestamp_utc"), F.col("parsed")).alias("ts_error"),
    )


@query("clean_number", f"WITH {TICKS_CTE} SELECT row_no, open, high, low, close FROM typed")
def clean_number_query(spark, sf):
    return view(spark, sf, "ticks").select(
        "row_no", *[nums.clean_number(F.col(c), text=True).alias(c) for c in quality.OHLC]
    )


@query("validate_ohlc", f"WITH {TICKS_CTE} SELECT series_key, row_no, rank, code FROM broken")
def validate_ohlc_query(spark, sf):
    return quality.validate_ohlc(typed_ticks(spark, sf))


@query(
    "series_validation_summary",
    f"""WITH {TICKS_CTE},
    worst AS (SELECT series_key, count(*) AS violations, min(row_no) AS first_bad_row FROM broken GROUP BY 1)
    SELECT t.series_key, count(*) AS row_count, min(t.ts) AS first_ts, max(t.ts) AS last_ts,
      coalesce(any_value(w.violations), 0) AS violations, any_value(w.first_bad_row) AS first_bad_row,
      (SELECT arg_min(b.code, b.rank) FROM broken b WHERE b.series_key = t.series_key AND b.row_no = any_value(w.first_bad_row)) AS reason,
      any_value(w.first_bad_row) IS NULL AS valid
    FROM typed t LEFT JOIN worst w ON w.series_key = t.series_key GROUP BY t.series_key""",
)
def series_validation_summary_query(spark, sf):
    return quality.series_verdicts(typed_ticks(spark, sf))


@query(
    "epoch_unit_detect",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN date_trunc('milliseconds', ts) ELSE date_trunc('second', ts) END AS at FROM {events}",
)
def epoch_unit_detect_query(spark, sf):
    us = nums.micros(F.col("ts"))
    unit = F.when(F.col("event_id") % 3 == 0, us).when(F.col("event_id") % 3 == 1, F.floor(us / 1000)).otherwise(
        F.floor(us / 1000000)
    )
    return view(spark, sf, "events").select("event_id", nums.epoch_to_ts(unit).cast("timestamp_ntz").alias("at"))


POLICY_CHECK = """
WITH checked AS (
  SELECT *, ceil(86400 / nullif(cadence_seconds, 0)) AS full_count, cadence_seconds + greatest(0.001, cadence_seconds * 0.01) AS slack,
    session_type IS NULL AND cadence_seconds IS NULL AND maximum_gap_seconds IS NULL AS undeclared
  FROM {policies}),
verdict AS (
  SELECT series_key, CASE WHEN undeclared THEN 'policy_missing'
    WHEN session_type IS NULL OR session_type NOT IN ('continuous', 'non_continuous') THEN 'session_type_invalid'
    WHEN cadence_seconds <= 0 THEN 'cadence_not_positive'
    WHEN maximum_gap_seconds <= 0 THEN 'maximum_gap_not_positive'
    WHEN boundary_tolerance_seconds <= 0 THEN 'boundary_tolerance_not_positive'
    WHEN maximum_gap_seconds < cadence_seconds THEN 'maximum_gap_below_cadence'
    WHEN boundary_tolerance_seconds < cadence_seconds THEN 'boundary_tolerance_below_cadence'
    WHEN minimum_bars_per_24h < 2 THEN 'minimum_bars_too_small'
    WHEN minimum_bars_per_24h > full_count THEN 'minimum_bars_above_cadence'
    WHEN session_type = 'non_continuous' AND minimum_bars_per_24h < greatest(2, ceil(full_count * CAST(0.1 AS DOUBLE))) THEN 'minimum_bars_below_tenth'
    WHEN session_type = 'continuous' AND minimum_bars_per_24h <> full_count THEN 'minimum_bars_not_full'
    WHEN session_type = 'continuous' AND maximum_gap_seconds > slack THEN 'continuous_gap_not_cadence'
    WHEN session_type = 'continuous' AND boundary_tolerance_seconds > slack THEN 'continuous_tolerance_not_cadence'
  END AS policy_error FROM checked)
SELECT series_key, policy_error, CASE WHEN policy_error = 'policy_missing' THEN 'coverage_policy_missing'
  WHEN policy_error IS NOT NULL THEN 'coverage_policy_invalid' END AS policy_status FROM verdict"""


@query("validate_coverage_policy", POLICY_CHECK)
def validate_coverage_policy_query(spark, sf):
    return quality.validate_coverage_policy(view(spark, sf, "policies")).select(
        "series_key", "policy_error", "policy_status"
    )


@query(
    "lag_gap",
    "SELECT series_key, ts, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)) AS DOUBLE) / 1000000 AS gap_seconds FROM {bars}",
)
def lag_gap_query(spark, sf):
    return quality.lag_gap(view(spark, sf, "bars").select("series_key", "ts")).select("series_key", "ts", "gap_seconds")


@query(
    "gap_profile",
    """WITH gaps AS (
      SELECT b.series_key, s.maximum_gap_seconds, (epoch_us(b.ts) - epoch_us(lag(b.ts) OVER (PARTITION BY b.series_key ORDER BY b.ts))) / 1000000 AS gap
      FROM {bars} b JOIN {series} s ON s.series_key = b.series_key)
    SELECT series_key, count(*) AS bar_count, CAST(max(gap) AS DOUBLE) AS maximum_observed_gap_seconds,
      count(*) FILTER (WHERE gap % 3600 <> 0) AS irregular_gaps, count(*) FILTER (WHERE gap > maximum_gap_seconds + 36) AS excessive_gaps
    FROM gaps GROUP BY series_key""",
)
def gap_profile_query(spark, sf):
    policy = view(spark, sf, "series").select("series_key", "cadence_seconds", "maximum_gap_seconds")
    return quality.gap_profile(view(spark, sf, "bars").join(policy, "series_key"))


@query(
    "bar_close_to_open",
    """SELECT series_key, row_no, CASE WHEN series_key IN ('click', 'error') THEN ts - INTERVAL 1 HOUR ELSE ts END AS ts,
      CASE WHEN series_key IN ('click', 'error') THEN 'bar_close_to_bar_open' ELSE 'not_required' END AS timestamp_normalization FROM {bars}""",
)
def bar_close_to_open_query(spark, sf):
    semantics = view(spark, sf, "series").select(
        "series_key", "cadence_seconds",
        F.when(F.col("series_key").isin("click", "error"), "bar_close").otherwise("bar_open").alias("timestamp_semantics"),
    )
    return quality.bar_close_to_open(view(spark, sf, "bars").join(semantics, "series_key")).select(
        "series_key", "row_no", "ts", "timestamp_normalization"
    )


@query(
    "range_restrict",
    "SELECT event_id, ts FROM {events} WHERE ts >= TIMESTAMP '2024-01-04 00:00:00' AND ts < TIMESTAMP '2024-01-19 00:00:00'",
)
def range_restrict_query(spark, sf):
    start, end = quality.audit_range("2024-01-05", "2024-01-15", "2024-02-01")
    return quality.range_restrict(view(spark, sf, "events"), start, end).select("event_id", "ts")


DAYS_CTE = """
days AS (
  SELECT series_key, CAST(ts AS DATE) AS day, count(*) AS rows FROM {bars} GROUP BY 1, 2),
chosen AS (
  SELECT *, CASE WHEN day >= DATE '2024-01-28' THEN 'live' WHEN day_no % 5 = 0 THEN 'live' ELSE 'archive' END AS source
  FROM (SELECT *, extract(day FROM day) AS day_no FROM days))"""


def day_choice(spark, sf):
    """Days before today come from the archive when it has them, else live."""
    bars = view(spark, sf, "bars")
    days = bars.groupBy("series_key", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    archive = days.filter(F.dayofmonth("day") % 5 != 0).select(
        "series_key", "day", F.lit(True).alias("checksum_verified")
    )
    return bar_sources.day_source_choice(days, archive, "2024-01-28")


@query(
    "day_source_choice",
    f"WITH {DAYS_CTE} SELECT series_key, day, rows, source, source = 'archive' AS checksum_verified FROM chosen",
)
def day_source_choice_query(spark, sf):
    return day_choice(spark, sf).select("series_key", "day", "rows", "source", "checksum_verified")


@query(
    "union_daily_series",
    f"""WITH {DAYS_CTE} SELECT b.series_key, b.ts, b.close, c.source FROM {{bars}} b
      JOIN chosen c ON c.series_key = b.series_key AND c.day = CAST(b.ts AS DATE)
      WHERE b.ts >= TIMESTAMP '2024-01-03 06:00:00' AND b.ts < TIMESTAMP '2024-01-29 18:00:00'""",
)
def union_daily_series_query(spark, sf):
    bars = view(spark, sf, "bars").select("series_key", "ts", "close")
    archive = bars.filter(F.dayofmonth("ts") % 5 != 0).withColumn("source", F.lit("archive"))
    live = bars.withColumn("source", F.lit("live"))
    return bar_sources.union_daily_series(
        archive, live, day_choice(spark, sf),
        F.lit("2024-01-03 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-29 18:00:00").cast("timestamp_ntz"),
    )
