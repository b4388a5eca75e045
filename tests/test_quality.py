"""Bar rules, policies, stamps and numbers."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hindcast.functions import numbers as nums
from hindcast.operators import quality

RAW = "series_key string, row_no bigint, timestamp_utc string, open string, high string, low string, close string, volume string, trade_count string"


def codes(spark, rows):
    raw = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], RAW)
    found = quality.validate_ohlc(quality.clean_bars(raw)).collect()
    return [(r.row_no, r.code) for r in sorted(found, key=lambda r: (r.row_no, r["rank"]))]


def bar(ts, o="1", h="2", low="1", c="2", v=None, n=None):
    return (ts, o, h, low, c, v, n)


def test_every_rule(spark):
    z = "2026-06-01T{:02d}:00:00Z"
    rows = [
        bar(z.format(0)), bar(z.format(0)), bar("2026-05-31T00:00:00Z"), bar("2026-06-01T05:00:00"), bar("soon"), bar(""),
        bar(z.format(6), c="nan"), bar(z.format(7), h="0"), bar(z.format(8), o="1.5", low="1.7", h="3"), bar(z.format(9), v="abc"),
        bar(z.format(10), v="-1"), bar(z.format(11), n="1.5"), bar(z.format(12), n="-2"), bar(z.format(13), v="3", n="4"),
    ]
    assert codes(spark, rows) == [
        (1, "duplicate_timestamp"), (2, "timestamps_not_increasing"), (3, "timestamp_naive"), (4, "timestamp_invalid"), (5, "timestamp_empty"),
        (6, "missing_ohlc"), (7, "high_below_low"), (7, "high_below_body"), (8, "low_above_body"), (9, "invalid_volume"), (10, "negative_volume"),
        (11, "invalid_trade_count"), (12, "negative_trade_count"),
    ]


def test_block_size_does_not_matter(spark):
    rng = random.Random(3)
    rows = [("ab"[rng.random() < 0.3], i, datetime(2026, 1, 1, rng.randint(0, 23), rng.randint(0, 59)), 1.0, 1.0, 1.0, 1.0) for i in range(800)]
    bars = spark.createDataFrame(rows, "series_key string, row_no bigint, ts timestamp_ntz, open double, high double, low double, close double")
    plain = {tuple(r) for r in quality.validate_ohlc(bars).collect()}
    assert plain == {tuple(r) for r in quality.validate_ohlc(bars, block_rows=7).collect()} and plain


@pytest.mark.parametrize(
    "text, want",
    [
        ("2026-06-01T10:00:00Z", datetime(2026, 6, 1, 10)), ("2026-06-01 10:00:00+03:30", datetime(2026, 6, 1, 6, 30)),
        ("2026-06-01T10:00:00,25-0100", datetime(2026, 6, 1, 11, 0, 0, 250000)), ("2026-06-01T10:00+02", datetime(2026, 6, 1, 8)),
        ("2026-06-01T10:00:00", None), ("2026-13-01T10:00:00Z", None), ("2026-06-01T10:00:00 Europe/Paris", None), (None, None),
    ],
)
def test_aware_stamps(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(nums.parse_aware_ts(F.col("t")).cast("timestamp_ntz"))
    assert df.first()[0] == want


def test_clean_number(spark):
    texts = ["1", " 2.5 ", "1e3", "nan", "inf", "-Infinity", "1d", "0x10", "", None, "1.123456789"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(nums.clean_number(F.col("t"), text=True))
    assert [r[0] for r in df.collect()] == [1.0, 2.5, 1000.0, None, None, None, None, None, None, None, 1.12345679]


def test_epoch_units(spark):
    df = spark.createDataFrame([(1717200000,), (1717200000000,), (1717200000000000,)], "v bigint")
    got = df.select(nums.epoch_to_ts(F.col("v")).cast("timestamp_ntz")).collect()
    assert {r[0] for r in got} == {datetime(2024, 6, 1)}


@pytest.mark.parametrize("places", [1, 2, 6])
def test_rounding_equals_correct_half_even(spark, places):
    rng = random.Random(places)
    values = [0.125, 0.375, 2.675, 44.45, 6.25, 0.05, 0.15, 12.5, 33.35, 99.95, 0.0, 100.0, -0.125, -2.5, 1 / 3]
    values += [rng.randint(0, 10**6) / rng.choice([8, 16, 20, 40, 80, 1000, 10**6]) for _ in range(3000)]
    values += [rng.uniform(-200, 200) for _ in range(3000)] + [k / n * 100 for n in range(1, 90) for k in range(n)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", nums.round_half_even(F.col("v"), places).alias("r")).collect()
    assert all(math.isclose(r.r, round(r.v, places), rel_tol=0, abs_tol=0) for r in got)


POLICY = "session_type string, cadence_seconds double, maximum_gap_seconds double, boundary_tolerance_seconds double, minimum_bars_per_24h int"


@pytest.mark.parametrize(
    "policy, error",
    [
        (("continuous", 60.0, 60.0, 60.0, 1440), None), (("non_continuous", 3600.0, 7200.0, 3600.0, 3), None),
        (("non_continuous", 3600.0, 7200.0, 3600.0, 2), "minimum_bars_below_tenth"), (("continuous", 60.0, 61.0, 60.0, 1440), "continuous_gap_not_cadence"),
        (("continuous", 60.0, 60.0, 60.0, 1439), "minimum_bars_not_full"), (("x", 60.0, 60.0, 60.0, 1440), "session_type_invalid"),
        (("continuous", float("nan"), 60.0, 60.0, 1440), "cadence_not_positive"), (("continuous", 60.0, 60.0, 30.0, 1440), "boundary_tolerance_below_cadence"),
        ((None,) * 5, "policy_missing"), (("non_continuous", 3600.0, 7200.0, 3600.0, 25), "minimum_bars_above_cadence"),
    ],
)
def test_policies(spark, policy, error):
    assert quality.validate_coverage_policy(spark.createDataFrame([policy], POLICY)).first().policy_error == error
