"""Rounding and stamps against the standard library."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from hindcast.functions import numbers

STAMPS = [
    "2024-01-02T03:04:05Z", "20240102T030405Z", "2024-01-02T03:04:05.1234567+00:00", "2024-01-02T03+00:00", "2024-W01-2T03:04Z",
    "2024W012T0304+0330", "2024-01-02T03:04:05+03:30:15", "2024-01-02x03:04:05-05", "2024-01-02 03:04:05,5+0100", "2024-01-02T03:04:05",
    "2024-01-02", "2024-13-02T03:04:05Z", "2024-01-02T25:04:05Z", "2020-W53-7T00:00Z", "2021-W53-1T00:00Z", "", "  ", "not a time", "2024-W01",
    "2024-W01-8", "20240102", "2024-01-02T03:0405Z", "2024-02-30T00:00Z", "2024-01-02T03:60Z", "2024-01-02T03:04:05.+00:00", "2024-W10T05:00Z",
    "1969-12-31T23:59:59.999999Z", "0001-01-01T00:00:00Z", "2024-01-02T", "2024-01-02T03:04:05-0000",
]


def plain_stamp(text):
    text = text.strip()
    if not text:
        return None, "empty"
    try:
        parsed = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None, "invalid"
    return (None, "naive") if parsed.tzinfo is None else (parsed.astimezone(timezone.utc).replace(tzinfo=None), None)


def test_stamps_in_every_iso_form(spark):
    rows = spark.createDataFrame([(t,) for t in STAMPS], "t string").withColumn("p", numbers.parse_aware_ts(F.col("t")))
    got = rows.select("t", F.col("p").cast("timestamp_ntz"), numbers.aware_ts_error(F.col("t"), F.col("p"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {t: plain_stamp(t) for t in STAMPS}


def test_eight_places_are_rounded_correctly(spark):
    rng = random.Random(1)
    values = [1.000000005, 1.000000015, 2.675000005, 5e-9, 1.5e-8, -5e-9, 67108863.123456785, 67108864.5, 1e300, -1.000000005, 0.0]
    values += [rng.uniform(-1e5, 1e5) for _ in range(2000)] + [rng.randrange(1, 10**10) * 1e-8 + 5e-9 for _ in range(6000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", numbers.clean_number(F.col("v"))).collect()
    assert [r for r in got if r[1] != round(r[0], 8)] == []
