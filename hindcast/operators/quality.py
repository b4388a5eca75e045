"""Series quality: row rules, verdicts, declared-cadence coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import numbers as nums
from hindcast.functions.skew import block_lag

OHLC = ("open", "high", "low", "close")


def clean_bars(raw: DataFrame) -> DataFrame:
    """Text bars -> typed bars plus the flags that ``validate_ohlc`` reads."""
    text = lambda name: F.col(name).cast("string")
    columns = [c for c in raw.columns if c not in {"timestamp_utc", *OHLC, "volume", "trade_count"}]
    out = [
        *columns,
        F.col("_ts").alias("ts"),
        nums.aware_ts_error(F.col("timestamp_utc"), F.col("_ts")).alias("ts_error"),
        *[nums.clean_number(text(name), text=True).alias(name) for name in OHLC],
    ]
    if "volume" in raw.columns:
        volume = nums.clean_number(text("volume"), text=True)
        out += [
            volume.alias("volume"),
            (F.col("volume").isNotNull() & volume.isNull()).alias("volume_invalid"),
        ]
    if "trade_count" in raw.columns:
        count = F.when(text("trade_count").rlike(r"^\s*[+-]?\d+\s*$"), text("trade_count").try_cast("bigint"))
        out += [
            count.alias("trade_count"),
            (F.col("trade_count").isNotNull() & count.isNull()).alias("trade_count_invalid"),
        ]
    return raw.withColumn("_ts", nums.parse_aware_ts(F.col("timestamp_utc"))).select(*out)


def checked_bars(bars: DataFrame, key: str = "series_key", block_rows: int = 65536) -> DataFrame:
    """Bars with ``prev_ts`` (row before in file order) and ``broken``.

    ``broken`` is the array of (rank, code) a bar violates, empty when it is
    sound. Order matters and DataFrames have none, so ``row_no`` is the file
    order. A column ``first_row``, if there is one, tells the first row with the same stamp.
    """
    have = set(bars.columns)
    flag = lambda name: F.col(name) if name in have else F.lit(False)
    extra = ("ts_error", "volume", "volume_invalid", "trade_count", "trade_count_invalid")
    kept = [key, "row_no", "ts", *OHLC, *[c for c in (*extra, "first_row") if c in have]]
    ordered = block_lag(
        bars.select(*kept), [key], "row_no", F.floor(F.col("row_no") / block_rows), "ts", "prev_ts"
    )
    if "first_row" in have:
        rows = ordered.withColumnRenamed("first_row", "_first_row")
    else:
        repeated = (
            bars.groupBy(key, "ts")
            .agg(F.min("row_no").alias("_first_row"), F.count(F.lit(1)).alias("_n"))
            .filter("_n > 1 AND ts IS NOT NULL")
            .drop("_n")
        )
        rows = ordered.join(repeated, [key, "ts"], "left")
    ts_error = F.col("ts_error") if "ts_error" in have else F.when(F.col("ts").isNull(), F.lit("empty"))
    duplicate = F.coalesce(F.col("row_no") > F.col("_first_row"), F.lit(False))
    missing = F.lit(False)
    for name in OHLC:
        missing = missing | F.col(name).isNull()
    bodies = [
        (ts_error.isNotNull(), F.concat(F.lit("timestamp_"), ts_error)),
        (duplicate, F.lit("duplicate_timestamp")),
        (~duplicate & (F.col("ts") <= F.col("prev_ts")), F.lit("timestamps_not_increasing")),
        (missing, F.lit("missing_ohlc")),
        (F.col("high") < F.col("low"), F.lit("high_below_low")),
        (F.col("high") < F.greatest("open", "close"), F.lit("high_below_body")),
        (F.col("low") > F.least("open", "close"), F.lit("low_above_body")),
        (flag("volume_invalid"), F.lit("invalid_volume")),
        (F.col("volume") < 0 if "volume" in have else F.lit(False), F.lit("negative_volume")),
        (flag("trade_count_invalid"), F.lit("invalid_trade_count")),
        (F.col("trade_count") < 0 if "trade_count" in have else F.lit(False), F.lit("negative_trade_count")),
    ]
    rules = [
        F.when(condition, F.struct(F.lit(rank).alias("rank"), code.alias("code")))
        for rank, (condition, code) in enumerate(bodies, start=1)
    ]
    return rows.select(key, "row_no", "ts", "prev_ts", *OHLC, F.array_compact(F.array(*rules)).alias("broken"))


def validate_ohlc(bars: DataFrame, key: str = "series_key", block_rows: int = 65536) -> DataFrame:
    """Every rule a bar breaks, as (key, row_no, rank, code) rows.

    Nothing is sorted, repaired or dropped; clean series yield no rows.
    """
    return checked_bars(bars, key, block_rows).select(
        key, "row_no", F.inline_outer("broken")
    ).filter("rank IS NOT NULL")


def verdicts_of(checked: DataFrame, key: str = "series_key") -> DataFrame:
    """One row per series: counts, range, and the first failing row if any."""
    bad = F.size("broken") > 0
    return checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(F.size("broken")).cast("bigint").alias("violations"),
        F.min(F.when(bad, F.col("row_no"))).alias("first_bad_row"),
        F.min_by(F.col("broken")[0]["code"], F.when(bad, F.col("row_no"))).alias("reason"),
        (F.count_if(bad) == 0).alias("valid"),
    )


def series_verdicts(bars: DataFrame, key: str = "series_key", block_rows: int = 65536) -> DataFrame:
    return verdicts_of(checked_bars(bars, key, block_rows), key)


def series_validation_summary(bars: DataFrame, key: str = "series_key") -> DataFrame:
    return bars.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def bar_close_to_open(bars: DataFrame) -> DataFrame:
    """Shift bar-close stamps back by the declared cadence."""
    shifted = F.col("ts") - F.make_dt_interval(secs=F.col("cadence_seconds").cast("decimal(18,6)"))
    closing = F.col("timestamp_semantics") == "bar_close"
    return bars.withColumn("ts", F.when(closing, shifted).otherwise(F.col("ts"))).withColumn(
        "timestamp_normalization",
        F.when(closing, "bar_close_to_bar_open").otherwise("not_required"),
    )


def range_restrict(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Half-open ``start <= ts < end``; both bounds reach the scan."""
    return bars.filter((F.col("ts") >= start) & (F.col("ts") < end))


def audit_range(start_date: str, end_date: str, today: str) -> tuple[Column, Column]:
    """Bars needed for an audit: a day before it to four days after its last day."""
    last = F.least(F.date_add(F.lit(end_date).cast("date"), 3), F.lit(today).cast("date"))
    return (
        F.date_sub(F.lit(start_date).cast("date"), 1).cast("timestamp_ntz"),
        F.date_add(last, 1).cast("timestamp_ntz"),
    )


def policy_error(prefix: str = "") -> Column:
    """First broken rule of a declared coverage policy, or null when it holds."""
    c = lambda name: F.col(prefix + name)
    cadence, gap, tolerance = c("cadence_seconds"), c("maximum_gap_seconds"), c("boundary_tolerance_seconds")
    minimum, session = c("minimum_bars_per_24h"), c("session_type")
    bad = lambda v: v.isNull() | F.isnan(v) | (v == float("inf")) | (v <= 0)
    full = F.ceil(F.lit(86400.0) / F.nullif(cadence, F.lit(0.0)))
    tenth = F.greatest(F.lit(2), F.ceil(full.cast("double") * F.lit(0.10)))
    slack = cadence + F.greatest(F.lit(0.001), cadence * 0.01)
    continuous = session == "continuous"
    return (
        F.when(session.isNull() | ~session.isin(fv.SESSION_TYPES), "session_type_invalid")
        .when(bad(cadence), "cadence_not_positive")
        .when(bad(gap), "maximum_gap_not_positive")
        .when(bad(tolerance), "boundary_tolerance_not_positive")
        .when(gap < cadence, "maximum_gap_below_cadence")
        .when(tolerance < cadence, "boundary_tolerance_below_cadence")
        .when(minimum.isNull() | (minimum < 2), "minimum_bars_too_small")
        .when(minimum > full, "minimum_bars_above_cadence")
        .when(~continuous & (minimum < tenth), "minimum_bars_below_tenth")
        .when(continuous & (minimum != full), "minimum_bars_not_full")
        .when(continuous & (gap > slack), "continuous_gap_not_cadence")
        .when(continuous & (tolerance > slack), "continuous_tolerance_not_cadence")
    )


def validate_coverage_policy(policies: DataFrame) -> DataFrame:
    """Adds ``policy_error`` and the window status it causes."""
    declared = F.lit(False)
    for name in ("session_type", "cadence_seconds", "maximum_gap_seconds",
                 "boundary_tolerance_seconds", "minimum_bars_per_24h"):
        declared = declared | F.col(name).isNotNull()
    return policies.withColumn("policy_error", F.when(declared, policy_error()).otherwise("policy_missing")).withColumn(
        "policy_status",
        F.when(F.col("policy_error") == "policy_missing", "coverage_policy_missing").when(
            F.col("policy_error").isNotNull(), "coverage_policy_invalid"
        ),
    )


def cadence_tolerance(cadence: Column) -> Column:
    return F.greatest(F.lit(0.001), cadence * 0.01)


def irregular_gap(gap: Column, cadence: Column) -> Column:
    """The gap is shorter than the cadence or not a whole multiple of it."""
    tolerance = cadence_tolerance(cadence)
    steps = gap / cadence
    return (gap < cadence - tolerance) | (F.abs(steps - F.rint(steps)) > tolerance / cadence)


def excessive_gap(gap: Column, maximum: Column, cadence: Column) -> Column:
    return gap > maximum + cadence_tolerance(cadence)


def lag_gap(bars: DataFrame, key: str = "series_key", block_seconds: int = 86400) -> DataFrame:
    """Adds ``prev_ts`` and ``gap_seconds`` to the previous bar of the series."""
    return block_lag(
        bars, [key], "ts", nums.time_bucket(F.col("ts"), block_seconds), "ts", "prev_ts"
    ).withColumn("gap_seconds", nums.seconds_between(F.col("ts"), F.col("prev_ts")))


def gap_profile(bars: DataFrame, key: str = "series_key") -> DataFrame:
    """Gap statistics of each series under its declared policy columns."""
    policy = ["cadence_seconds", "maximum_gap_seconds"]
    gap, cadence, maximum = F.col("gap_seconds"), F.col("cadence_seconds"), F.col("maximum_gap_seconds")
    return lag_gap(bars.select(key, "ts", *policy), key).groupBy(key).agg(
        F.count(F.lit(1)).alias("bar_count"),
        F.max(gap).alias("maximum_observed_gap_seconds"),
        F.count_if(irregular_gap(gap, cadence)).alias("irregular_gaps"),
        F.count_if(excessive_gap(gap, maximum, cadence)).alias("excessive_gaps"),
    )


def minimum_bars(hours: Column) -> Column:
    per_day = F.col("minimum_bars_per_24h").cast("double")
    return F.when(
        F.col("session_type") == "continuous",
        F.ceil(hours.cast("double") * 3600.0 / F.col("cadence_seconds")),
    ).otherwise(F.ceil(per_day * hours.cast("double") / 24.0))


def coverage_reasons() -> Column:
    """Array of failed coverage checks in their fixed order.

    Reads bar_count, minimum_required_bars, irregular_gaps, excessive_gaps,
    boundary_lag_seconds and the policy columns.
    """
    lag_limit = F.col("boundary_tolerance_seconds") + cadence_tolerance(F.col("cadence_seconds"))
    failed = [
        F.col("bar_count") < F.col("minimum_required_bars"),
        F.col("irregular_gaps") > 0,
        F.col("excessive_gaps") > 0,
        F.col("boundary_lag_seconds") > lag_limit,
    ]
    return F.array_compact(
        F.array(*[F.when(test, F.lit(code)) for test, code in zip(failed, fv.COVERAGE_REASONS)])
    )


def coverage_note(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, F.lit(fv.COVERAGE_PASSED_NOTE)).otherwise(
        F.concat(F.lit("Coverage failed: "), F.concat_ws(", ", reasons), F.lit("."))
    )
