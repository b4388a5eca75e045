"""Outcome queries: resolution, as-of, windows, levels, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions.numbers import round_half_even_sql
from hindcast.operators import quality, resolve, windows
from hindcast.plans.registry import query
from hindcast.plans.views import claims_with_arrays, view

AS_OF = "2024-01-29 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Series profile and usable bars."""
    return windows.prepare(view(spark, sf, "bars"), view(spark, sf, "series"))


def resolved_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Claim assets with series, status and reason."""
    claims = resolve.precision_gate(claims_with_arrays(spark, sf))
    exploded = resolve.explode_assets(
        claims, ["claim_id", "video_id", F.col("published_at").alias("anchor"), "precise", "levels", "scoreability", "time_horizon"]
    )
    resolved = resolve.classify_unresolved(resolve.resolve_asset(exploded, view(spark, sf, "registry")))
    joined = resolve.join_series(resolved, view(spark, sf, "series").select("series_key", "status", "error"))
    return joined.withColumn(
        "asset_status",
        F.when(~F.col("precise"), "insufficient_timestamp_precision").otherwise(F.col("asset_status")),
    )


def available_assets(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_assets(spark, sf).filter("asset_status = 'available'")


def located_assets(spark: SparkSession, sf: str, bars: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    profile, usable = bars or prepared(spark, sf)
    rows = available_assets(spark, sf).select("claim_id", "asset_pos", "series_key", "anchor", "levels")
    return windows.asof_entry_bar(rows, usable, profile)


def entry_bars(located: DataFrame) -> DataFrame:
    return located.filter("entry_ts IS NOT NULL").select("series_key", "entry_ts").distinct()


def outcome_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = available_assets(spark, sf).select("claim_id", "asset_pos", "series_key", "anchor")
    return windows.outcome_windows(rows, view(spark, sf, "bars"), view(spark, sf, "series"), as_of())


# --- checking SQL shared by this module ----------------------------------------------

RESOLVED_CTE = """
resolved AS (
  SELECT c.claim_id, c.video_id, a.asset_pos, a.asset, c.published_at AS anchor, c.level_1, c.level_2,
    c.published_at_source, c.scoreability, c.time_horizon, r.series_key, r.proxy_note,
    replace(replace(replace(replace(upper(a.asset), ' ', ''), '/', ''), '–', '-'), '—', '-') AS alias
  FROM {claims} c JOIN {claim_assets} a ON a.claim_id = c.claim_id
  LEFT JOIN {registry} r
    ON r.alias = replace(replace(replace(replace(upper(a.asset), ' ', ''), '/', ''), '–', '-'), '—', '-')),
asset_rows AS (
  SELECT r.*, CASE WHEN published_at_source = 'date_noon_fallback' THEN 'insufficient_timestamp_precision'
    WHEN r.series_key IS NULL THEN
      CASE WHEN r.alias IN ('BTC-ETF', 'BTCSPOTETFS', 'MACRO') THEN 'out_of_scope_non_price' ELSE 'unsupported_asset' END
    WHEN s.status = 'available' THEN 'available' ELSE 'data_unavailable' END AS asset_status,
    CASE WHEN r.series_key IS NULL THEN CASE r.alias
        WHEN 'MACRO' THEN 'Macro-release facts are contextual inputs and outside this price-outcome audit.'
        WHEN 'BTC-ETF' THEN 'ETF-flow claims are contextual inputs and outside this price-outcome audit.'
        ELSE 'No exact market-data mapping is configured for this asset.' END
      WHEN s.status = 'available' THEN NULL
      ELSE coalesce(s.error, 'Market series was not available.') END AS asset_reason
  FROM resolved r LEFT JOIN {series} s ON s.series_key = r.series_key)"""

# signup declares too few bars; error has an inverted bar; newsletter declares nothing
LOCATED_CTE = RESOLVED_CTE + """,
broken AS (SELECT DISTINCT series_key FROM {bars} WHERE high < low OR high < greatest(open, close) OR low > least(open, close)),
blocked AS (
  SELECT s.series_key, s.maximum_gap_seconds, s.boundary_tolerance_seconds, s.minimum_bars_per_24h, s.session_type,
    CASE WHEN session_type IS NULL THEN 'coverage_policy_missing'
      WHEN s.session_type = 'non_continuous' AND minimum_bars_per_24h < 3 THEN 'coverage_policy_invalid'
      WHEN s.series_key IN (SELECT series_key FROM broken) THEN 'invalid_market_series' END AS blocked_status,
    (SELECT max(ts) FROM {bars} b WHERE b.series_key = s.series_key) AS last_ts
  FROM {series} s),
first_bar AS (
  SELECT a.claim_id, a.asset_pos, min(b.ts) AS found
  FROM asset_rows a JOIN {bars} b ON b.series_key = a.series_key AND b.ts >= a.anchor
    AND b.ts <= a.anchor + INTERVAL 73 HOUR
  WHERE a.asset_status = 'available' GROUP BY ALL),
located AS (
  SELECT a.*, k.maximum_gap_seconds, k.boundary_tolerance_seconds, k.minimum_bars_per_24h, k.session_type,
    CASE WHEN k.blocked_status IS NOT NULL THEN k.blocked_status
      WHEN k.last_ts IS NULL OR a.anchor > k.last_ts THEN 'no_bar_after_publication'
      WHEN f.found IS NULL OR epoch_us(f.found) - epoch_us(a.anchor) > k.maximum_gap_seconds * 1000000 THEN 'next_tradable_bar_too_late'
    END AS entry_status,
    CASE WHEN k.blocked_status IS NULL AND a.anchor <= k.last_ts
      AND epoch_us(f.found) - epoch_us(a.anchor) <= k.maximum_gap_seconds * 1000000 THEN f.found END AS entry_ts
  FROM asset_rows a JOIN blocked k ON k.series_key = a.series_key
  LEFT JOIN first_bar f ON f.claim_id = a.claim_id AND f.asset_pos = a.asset_pos
  WHERE a.asset_status = 'available')"""

WINDOW_CTE = LOCATED_CTE + """,
gapped AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)) AS gap_us FROM {bars}),
entries AS (
  SELECT DISTINCT series_key, entry_ts, maximum_gap_seconds, boundary_tolerance_seconds, minimum_bars_per_24h, session_type, hours
  FROM located CROSS JOIN (VALUES (24), (48)) AS h(hours) WHERE entry_ts IS NOT NULL),
raw_windows AS (
  SELECT e.*, e.entry_ts + to_hours(e.hours) AS window_end, count(*) AS bar_count,
    arg_min(b.open, b.ts) AS open, max(b.high) AS high, min(b.low) AS low, arg_max(b.close, b.ts) AS close,
    max(b.ts) AS last_bar_ts,
    min(b.ts) FILTER (WHERE b.high = m.mx) AS high_ts, min(b.ts) FILTER (WHERE b.low = m.mn) AS low_ts,
    max(b.gap_us) FILTER (WHERE b.ts > e.entry_ts) AS gap_us,
    count(*) FILTER (WHERE b.ts > e.entry_ts AND b.gap_us % 3600000000 <> 0) AS irregular_gaps,
    count(*) FILTER (WHERE b.ts > e.entry_ts AND b.gap_us > (e.maximum_gap_seconds + 36) * 1000000) AS excessive_gaps
  FROM entries e
  JOIN gapped b ON b.series_key = e.series_key AND b.ts >= e.entry_ts AND b.ts < e.entry_ts + to_hours(e.hours)
  JOIN (SELECT e2.series_key, e2.entry_ts, e2.hours, max(b2.high) AS mx, min(b2.low) AS mn FROM entries e2
        JOIN {bars} b2 ON b2.series_key = e2.series_key AND b2.ts >= e2.entry_ts AND b2.ts < e2.entry_ts + to_hours(e2.hours)
        GROUP BY ALL) m ON m.series_key = e.series_key AND m.entry_ts = e.entry_ts AND m.hours = e.hours
  GROUP BY ALL),
covered AS (
  SELECT *, CAST(CASE WHEN session_type = 'continuous' THEN hours ELSE ceil(minimum_bars_per_24h * hours / 24) END AS BIGINT) AS minimum_required_bars,
    CAST(greatest(epoch_us(window_end) - epoch_us(last_bar_ts), 0) AS DOUBLE) / 1000000 AS boundary_lag_seconds,
    (close / nullif(open, 0) - 1) * 100 AS return_pct, (high / nullif(open, 0) - 1) * 100 AS max_up_pct,
    (low / nullif(open, 0) - 1) * 100 AS max_down_pct
  FROM raw_windows),
reasoned AS (
  SELECT *, concat_ws(', ',
      CASE WHEN bar_count < minimum_required_bars THEN 'bar_count_below_declared_minimum' END,
      CASE WHEN irregular_gaps > 0 THEN 'timestamps_do_not_follow_declared_cadence' END,
      CASE WHEN excessive_gaps > 0 THEN 'gap_exceeds_declared_session_maximum' END,
      CASE WHEN boundary_lag_seconds > boundary_tolerance_seconds + 36 THEN 'series_does_not_reach_window_boundary' END) AS reasons
  FROM covered),
statused AS (
  SELECT *, CASE WHEN TIMESTAMP '2024-01-29 00:00:00' < window_end THEN 'window_not_elapsed'
    WHEN reasons = '' THEN 'complete' ELSE 'source_coverage_gap' END AS window_state
  FROM reasoned),
outcomes AS (
  SELECT l.claim_id, l.asset_pos, h.hours, coalesce(l.entry_status, s.window_state) AS status,
    coalesce(l.entry_status, s.window_state) = 'complete' AS complete
  FROM located l CROSS JOIN (VALUES (24), (48)) AS h(hours)
  LEFT JOIN statused s ON s.series_key = l.series_key AND s.entry_ts = l.entry_ts AND s.hours = h.hours)"""

_r6 = lambda name: round_half_even_sql(name, 6)


@query("resolve_asset", f"WITH {RESOLVED_CTE} SELECT claim_id, asset_pos, asset, series_key, proxy_note FROM resolved")
def resolve_asset_query(spark, sf):
    exploded = resolve.explode_assets(claims_with_arrays(spark, sf), ["claim_id"])
    return resolve.resolve_asset(exploded, view(spark, sf, "registry")).select(
        "claim_id", "asset_pos", "asset", "series_key", "proxy_note"
    )


@query(
    "classify_unresolved",
    f"""WITH {RESOLVED_CTE} SELECT claim_id, asset_pos, asset,
      CASE WHEN alias IN ('BTC-ETF', 'BTCSPOTETFS', 'MACRO') THEN 'out_of_scope_non_price' ELSE 'unsupported_asset' END AS unresolved_status,
      asset_reason AS unresolved_reason FROM asset_rows WHERE series_key IS NULL""",
)
def classify_unresolved_query(spark, sf):
    return resolved_assets(spark, sf).filter("series_key IS NULL").select(
        "claim_id", "asset_pos", "asset", "unresolved_status", "unresolved_reason"
    )


@query(
    "join_series",
    f"WITH {RESOLVED_CTE} SELECT claim_id, asset_pos, asset_status, asset_reason, count(*) OVER (PARTITION BY asset_status) AS n FROM asset_rows",
)
def join_series_query(spark, sf):
    rows = resolved_assets(spark, sf)
    totals = rows.groupBy("asset_status").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(totals, "asset_status").select("claim_id", "asset_pos", "asset_status", "asset_reason", "n")


@query(
    "precision_gate",
    "SELECT claim_id, published_at_source <> 'date_noon_fallback' AS precise FROM {claims}",
)
def precision_gate_query(spark, sf):
    return resolve.precision_gate(view(spark, sf, "claims")).select("claim_id", "precise")


@query(
    "claim_outcome_status",
    """SELECT claim_id, CASE WHEN published_at_source = 'date_noon_fallback' THEN 'insufficient_timestamp_precision'
      WHEN asset_1 IS NULL AND asset_2 IS NULL THEN 'no_asset' ELSE 'evaluated_for_price_outcome' END AS outcome_status FROM {claims}""",
)
def claim_outcome_status_query(spark, sf):
    claims = resolve.precision_gate(claims_with_arrays(spark, sf))
    return windows.claim_outcome_status(claims).select("claim_id", "outcome_status")


@query(
    "prune_referenced_series",
    f"""WITH {RESOLVED_CTE} SELECT series_key, ts, open, high, low, close FROM {{bars}}
      WHERE series_key IN (SELECT series_key FROM resolved WHERE asset LIKE '%e%')""",
)
def prune_referenced_series_query(spark, sf):
    named = resolved_assets(spark, sf).filter(F.col("asset").contains("e"))
    return resolve.prune_referenced_series(view(spark, sf, "bars"), named).select(
        "series_key", "ts", "open", "high", "low", "close"
    )


@query(
    "asof_entry_bar",
    f"WITH {LOCATED_CTE} SELECT claim_id, asset_pos, series_key, entry_ts, entry_status FROM located",
)
def asof_entry_bar_query(spark, sf):
    return located_assets(spark, sf).select("claim_id", "asset_pos", "series_key", "entry_ts", "entry_status")


@query(
    "range_join_window",
    f"""WITH {WINDOW_CTE} SELECT e.series_key, e.entry_ts, b.ts, b.close FROM entries e
      JOIN {{bars}} b ON b.series_key = e.series_key AND b.ts >= e.entry_ts AND b.ts < e.entry_ts + INTERVAL 48 HOUR WHERE e.hours = 48""",
)
def range_join_window_query(spark, sf):
    entries = entry_bars(located_assets(spark, sf))
    return windows.range_join_window(entries, view(spark, sf, "bars"), 48, ["close"])


@query(
    "window_ohlc",
    f"""WITH {WINDOW_CTE} SELECT series_key, entry_ts, hours, bar_count, open, high, high_ts, low, low_ts, close, last_bar_ts FROM raw_windows""",
)
def window_ohlc_query(spark, sf):
    bars = prepared(spark, sf)
    entries = entry_bars(located_assets(spark, sf, bars))
    return windows.window_ohlc(entries, bars[1], series=bars[0]).select(
        "series_key", "entry_ts", "hours", "bar_count", "open", "high", "high_ts", "low", "low_ts", "close", "last_bar_ts"
    )


@query(
    "window_ohlc_blocks",
    f"""WITH {WINDOW_CTE} SELECT series_key, entry_ts, hours, bar_count, open, high, high_ts, low, low_ts, close, last_bar_ts,
      CAST(gap_us AS DOUBLE) / 1000000 AS maximum_observed_gap_seconds, excessive_gaps FROM raw_windows""",
)
def window_ohlc_blocks_query(spark, sf):
    """The same windows from six-hour roll-ups plus edge bars."""
    bars = prepared(spark, sf)
    entries = entry_bars(located_assets(spark, sf, bars))
    return windows.window_ohlc(entries, bars[1], block_seconds=21600, series=bars[0]).select(
        "series_key", "entry_ts", "hours", "bar_count", "open", "high", "high_ts", "low", "low_ts", "close", "last_bar_ts",
        "maximum_observed_gap_seconds", "excessive_gaps",
    )


@query(
    "window_returns",
    f"""WITH {WINDOW_CTE} SELECT DISTINCT series_key, entry_ts, hours, {_r6('return_pct')} AS return_pct,
      {_r6('max_up_pct')} AS max_up_pct, {_r6('max_down_pct')} AS max_down_pct FROM covered""",
)
def window_returns_query(spark, sf):
    bars = prepared(spark, sf)
    entries = entry_bars(located_assets(spark, sf, bars))
    moves = windows.rounded_returns(windows.window_returns(windows.window_ohlc(entries, bars[1], series=bars[0])))
    return moves.select("series_key", "entry_ts", "hours", *windows.RETURN_COLUMNS)


@query(
    "coverage_assessment",
    f"""WITH {WINDOW_CTE} SELECT series_key, entry_ts, hours, bar_count, minimum_required_bars, boundary_lag_seconds,
      CAST(gap_us AS DOUBLE) / 1000000 AS maximum_observed_gap_seconds, reasons, reasons = '' AS coverage_complete,
      CASE WHEN reasons = '' THEN '{fv.COVERAGE_PASSED_NOTE}' ELSE 'Coverage failed: ' || reasons || '.' END AS coverage_note FROM reasoned""",
)
def coverage_assessment_query(spark, sf):
    bars = prepared(spark, sf)
    entries = entry_bars(located_assets(spark, sf, bars))
    covered = windows.window_coverage(windows.window_ohlc(entries, bars[1], series=bars[0]))
    return covered.select(
        "series_key", "entry_ts", "hours", "bar_count", "minimum_required_bars", "boundary_lag_seconds",
        "maximum_observed_gap_seconds", F.concat_ws(", ", "reasons").alias("reasons"), "coverage_complete", "coverage_note",
    )


@query("window_status", f"WITH {WINDOW_CTE} SELECT claim_id, asset_pos, hours, status, complete FROM outcomes")
def window_status_query(spark, sf):
    return outcome_rows(spark, sf).select("claim_id", "asset_pos", "hours", "status", "complete")


LEVEL_CTE = LOCATED_CTE + """,
entry_levels AS (
  SELECT DISTINCT series_key, entry_ts, level FROM (
    SELECT series_key, entry_ts, level_1 AS level FROM located WHERE entry_ts IS NOT NULL
    UNION ALL SELECT series_key, entry_ts, level_2 FROM located WHERE entry_ts IS NOT NULL)),
events_at AS (
  SELECT e.series_key, e.entry_ts, e.level, h.hours,
    min(b.ts) FILTER (WHERE b.low <= e.level AND e.level <= b.high) AS first_touch,
    min(b.ts) FILTER (WHERE b.close > e.level) AS first_close_above,
    min(b.ts) FILTER (WHERE b.close < e.level) AS first_close_below
  FROM entry_levels e CROSS JOIN (VALUES (24), (48)) AS h(hours)
  JOIN {bars} b ON b.series_key = e.series_key AND b.ts >= e.entry_ts AND b.ts < e.entry_ts + to_hours(h.hours)
  GROUP BY ALL)"""


@query("level_events", f"WITH {LEVEL_CTE} SELECT * FROM events_at")
def level_events_query(spark, sf):
    bars = prepared(spark, sf)
    return windows.level_events(windows.claim_levels(located_assets(spark, sf, bars)), bars[1])


@query(
    "level_bar_join",
    f"""WITH {LEVEL_CTE} SELECT e.series_key, e.entry_ts, count(*) AS touches FROM entry_levels e
      JOIN {{bars}} b ON b.series_key = e.series_key AND b.ts >= e.entry_ts AND b.ts < e.entry_ts + INTERVAL 24 HOUR
        AND b.low <= e.level AND e.level <= b.high GROUP BY ALL""",
)
def level_bar_join_query(spark, sf):
    levels = windows.claim_levels(located_assets(spark, sf))
    return (
        windows.level_touches(levels, view(spark, sf, "bars"), 24)
        .groupBy("series_key", "entry_ts")
        .agg(F.count(F.lit(1)).alias("touches"))
    )


@query(
    "first_match",
    f"""WITH {LEVEL_CTE} SELECT l.claim_id, l.asset_pos, a.first_touch, b.first_close_above FROM located l
      LEFT JOIN events_at a ON a.series_key = l.series_key AND a.entry_ts = l.entry_ts AND a.level = l.level_1 AND a.hours = 24
      LEFT JOIN events_at b ON b.series_key = l.series_key AND b.entry_ts = l.entry_ts AND b.level = l.level_2 AND b.hours = 48""",
)
def first_match_query(spark, sf):
    bars = prepared(spark, sf)
    located = located_assets(spark, sf, bars)
    found = windows.level_events(windows.claim_levels(located), bars[1])
    keys = ["series_key", "entry_ts", "level"]
    touch = found.filter("hours = 24").select(*keys, "first_touch")
    above = found.filter("hours = 48").select(*keys, "first_close_above")
    rows = located.withColumn("level", F.col("levels")[0]).join(touch, keys, "left")
    rows = rows.withColumn("level", F.col("levels")[1]).join(above, keys, "left")
    return rows.select("claim_id", "asset_pos", "first_touch", "first_close_above")


SUPPORT_CTE = WINDOW_CTE + """,
needed AS (
  SELECT claim_id, CASE WHEN time_horizon IS NULL OR trim(time_horizon) = '' THEN
      CASE WHEN normalized_horizon_hours IS NULL THEN '24h' END
    WHEN time_horizon IN ('24 hours', 'یک روز') THEN
      CASE WHEN normalized_horizon_hours IS NULL OR normalized_horizon_hours = 24 THEN '24h' END
    WHEN time_horizon IN ('two days', '۲ روز') THEN
      CASE WHEN normalized_horizon_hours IS NULL OR normalized_horizon_hours = 48 THEN '48h' END
    END AS required_window FROM {claims}),
support AS (
  SELECT n.claim_id, n.required_window, (coalesce(bool_and(a.asset_status = 'available' AND coalesce(o.complete, FALSE)), FALSE)
    AND count(a.asset_pos) > 0 AND n.required_window IS NOT NULL) AS supported
  FROM needed n LEFT JOIN asset_rows a ON a.claim_id = n.claim_id
  LEFT JOIN outcomes o ON o.claim_id = a.claim_id AND o.asset_pos = a.asset_pos AND o.hours || 'h' = n.required_window
  GROUP BY n.claim_id, n.required_window)"""


def supported_claims(spark: SparkSession, sf: str) -> DataFrame:
    """All claims with ``required_window`` and ``supported``."""
    from hindcast.operators import scoring

    claims = view(spark, sf, "claims").withColumn("required_window", scoring.required_window())
    long = (
        resolved_assets(spark, sf)
        .select("claim_id", "asset_pos", "asset_status")
        .join(outcome_rows(spark, sf).select("claim_id", "asset_pos", "hours", "complete"), ["claim_id", "asset_pos"], "left")
        .join(claims.select("claim_id", "required_window"), "claim_id")
    )
    supported = windows.window_supported(long, "required_window")
    return claims.join(supported, "claim_id", "left").withColumn(
        "supported", F.coalesce("supported", F.lit(False))
    )


@query("window_supported", f"WITH {SUPPORT_CTE} SELECT claim_id, required_window, supported FROM support")
def window_supported_query(spark, sf):
    return supported_claims(spark, sf).select("claim_id", "required_window", "supported")


@query(
    "complete_claims",
    f"""WITH {SUPPORT_CTE} SELECT c.category, count(*) AS claims, count(*) FILTER (WHERE s.supported) AS complete_claims
      FROM support s JOIN {{claims}} c ON c.claim_id = s.claim_id GROUP BY ALL""",
)
def complete_claims_query(spark, sf):
    return supported_claims(spark, sf).groupBy("category").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("complete_claims")
    )


_EVENT_CODE = "concat(CASE WHEN {0}.first_touch IS NOT NULL THEN 't' ELSE '' END, CASE WHEN {0}.first_close_above IS NOT NULL THEN 'a' ELSE '' END, CASE WHEN {0}.first_close_below IS NOT NULL THEN 'b' ELSE '' END)"
NESTED_CTE = WINDOW_CTE + LEVEL_CTE.removeprefix(LOCATED_CTE) + f""",
told AS (
  SELECT l.claim_id, l.asset_pos, h.hours, concat({_EVENT_CODE.format('x')}, '/', {_EVENT_CODE.format('y')}) AS events
  FROM located l CROSS JOIN (VALUES (24), (48)) AS h(hours)
  LEFT JOIN events_at x ON x.series_key = l.series_key AND x.entry_ts = l.entry_ts AND x.level = l.level_1 AND x.hours = h.hours
  LEFT JOIN events_at y ON y.series_key = l.series_key AND y.entry_ts = l.entry_ts AND y.level = l.level_2 AND y.hours = h.hours
  WHERE l.entry_ts IS NOT NULL)"""


@query(
    "assemble_outcomes",
    f"""WITH {NESTED_CTE} SELECT a.claim_id, count(*) AS n_assets, string_agg(a.asset_status, ',' ORDER BY a.asset_pos) AS statuses,
      string_agg(coalesce(o.status, '-'), ',' ORDER BY a.asset_pos) AS windows_24h,
      string_agg(coalesce(p.status, '-'), ',' ORDER BY a.asset_pos) AS windows_48h,
      string_agg(coalesce(t.events, '-'), ',' ORDER BY a.asset_pos) AS events_24h,
      string_agg(coalesce(u.events, '-'), ',' ORDER BY a.asset_pos) AS events_48h
      FROM asset_rows a LEFT JOIN outcomes o ON o.claim_id = a.claim_id AND o.asset_pos = a.asset_pos AND o.hours = 24
      LEFT JOIN outcomes p ON p.claim_id = a.claim_id AND p.asset_pos = a.asset_pos AND p.hours = 48
      LEFT JOIN told t ON t.claim_id = a.claim_id AND t.asset_pos = a.asset_pos AND t.hours = 24
      LEFT JOIN told u ON u.claim_id = a.claim_id AND u.asset_pos = a.asset_pos AND u.hours = 48 GROUP BY a.claim_id""",
)
def assemble_outcomes_query(spark, sf):
    nested = windows.assemble_outcomes(nested_input(spark, sf))
    part = lambda f: F.array_join(F.transform("assets", f), ",", "-")
    happened = lambda e, name, letter: F.when(e[name].isNotNull(), letter).otherwise("")
    code = lambda e: F.concat(happened(e, "first_touch", "t"), happened(e, "first_close_above", "a"), happened(e, "first_close_below", "b"))
    codes = lambda window: F.array_join(F.transform(window["level_events"], code), "/")
    return nested.select(
        "claim_id",
        F.size("assets").cast("bigint").alias("n_assets"),
        part(lambda a: a["status"]).alias("statuses"),
        part(lambda a: a["window_24h"]["status"]).alias("windows_24h"),
        part(lambda a: a["window_48h"]["status"]).alias("windows_48h"),
        part(lambda a: codes(a["window_24h"])).alias("events_24h"),
        part(lambda a: codes(a["window_48h"])).alias("events_48h"),
    )


def nested_input(spark: SparkSession, sf: str) -> DataFrame:
    """Long outcome rows of all assets, with the level events of their windows."""
    profile, usable = prepared(spark, sf)
    rows = available_assets(spark, sf).select("claim_id", "asset_pos", "series_key", "anchor", "levels")
    outcome = windows.windows_over(rows, profile, usable, as_of())
    outcome = windows.with_level_events(outcome, windows.level_events(windows.claim_levels(outcome), usable))
    return resolved_assets(spark, sf).select(
        "claim_id", "asset_pos", "asset", "asset_status", "series_key"
    ).join(outcome.drop("anchor", "series_key", "levels"), ["claim_id", "asset_pos"], "left")


@query(
    "claim_outcomes",
    f"""WITH {WINDOW_CTE} SELECT l.claim_id, l.asset_pos, h.hours, l.series_key, l.entry_ts, s.window_end,
      coalesce(l.entry_status, s.window_state) AS status, s.bar_count, s.open, s.high, s.high_ts, s.low, s.low_ts, s.close,
      {_r6('s.return_pct')} AS return_pct, {_r6('s.max_up_pct')} AS max_up_pct, {_r6('s.max_down_pct')} AS max_down_pct
      FROM located l CROSS JOIN (VALUES (24), (48)) AS h(hours)
      LEFT JOIN statused s ON s.series_key = l.series_key AND s.entry_ts = l.entry_ts AND s.hours = h.hours""",
)
def claim_outcomes_query(spark, sf):
    """The headline plan: claims to bars to statuses, end to end."""
    return outcome_rows(spark, sf).select(
        "claim_id", "asset_pos", "hours", "series_key", "entry_ts", "window_end", "status", "bar_count", "open",
        "high", "high_ts", "low", "low_ts", "close", *windows.RETURN_COLUMNS,
    )
