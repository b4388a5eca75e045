"""Bar sources: exchange klines, operator CSV with sidecar, hourly frames."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import numbers as nums
from hindcast.operators import quality

KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades",
]


# "<series>.csv" for plain files, "series_key=<series>/" for partitioned ones
KEY_IN_PATH = r"(?:series_key=([^/]+)/.*|([^/]+)\.csv)$"


def path_key(path: Column) -> Column:
    return F.concat(F.regexp_extract(path, KEY_IN_PATH, 1), F.regexp_extract(path, KEY_IN_PATH, 2))


def with_file_row_no(rows: DataFrame, keep: list) -> DataFrame:
    """Adds ``series_key``, told by the path, and ``row_no``, strictly increasing along every text file.

    ``rows`` carries ``_file``, ``_offset`` (start of its split) and ``_seq``
    (``monotonically_increasing_id``). Splits may be packed into tasks in any
    order, so the position inside the split is added to the split's byte
    offset; lines are at least a byte long, so the sum never overlaps. The path
    is searched for its key once per split: the search takes longer than a line.
    """
    starts = rows.groupBy("_file", "_offset").agg(F.min("_seq").alias("_start"))
    starts = starts.withColumn("series_key", path_key(F.col("_file")))
    return rows.join(starts, ["_file", "_offset"]).select(
        *keep, (F.col("_offset") + F.col("_seq") - F.col("_start")).alias("row_no")
    )


def _file_position() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_seq"),
    ]


def scan_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Positional kline lines -> bars in file order, with an error per bad line.

    Lines are read whole, so that a truncated or overlong line stays visible.
    """
    lines = with_file_row_no(
        spark.read.text(path).select(*_file_position(), "value"),
        ["series_key", F.col("_file").alias("source_file"), "value"],
    )
    cells = F.split("value", ",")
    first = F.lower(F.trim(cells[0]))
    digits = first.rlike(r"^-*\d+$")
    header = first.isin("open_time", "opentime")
    return (
        lines.filter(F.trim("value") != "")
        .withColumn("is_header", header)
        .withColumn(
            "error",
            F.when(header, F.lit(None).cast("string"))
            .when(~digits, "non_numeric_timestamp")
            .when(F.size(cells) < len(KLINE_FIELDS), "truncated_row"),
        )
        .withColumn("cells", cells)
    )


def kline_bars(lines: DataFrame) -> DataFrame:
    """Bars of the well-formed kline lines."""
    return lines.filter("NOT is_header AND error IS NULL").select(
        "series_key", "source_file", "row_no", *_kline_columns("cells")
    )


def _kline_columns(cells: str) -> list[Column]:
    cell = lambda i: F.get(F.col(cells), i)
    number = lambda i: nums.clean_number(cell(i), text=True)
    return [
        nums.epoch_to_ts(cell(0).try_cast("bigint")).alias("ts"),
        number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"),
        number(5).alias("volume"), cell(8).try_cast("bigint").alias("trade_count"),
    ]


def kline_verdicts(lines: DataFrame) -> DataFrame:
    """Per file: a header below line one or any bad line rejects it."""
    per_key = lines.groupBy("series_key", "source_file").agg(
        F.max(F.when(F.col("is_header"), F.col("row_no"))).alias("_last_header"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_no"))).alias("_error"),
        F.count_if(~F.col("is_header")).alias("lines"),
    )
    late = F.col("_last_header") > 0
    return per_key.select(
        "series_key", "source_file", "lines", F.coalesce("_error", F.when(late, "non_numeric_timestamp")).alias("reason")
    )


def scan_kline_json(payloads: DataFrame) -> DataFrame:
    """(series_key, payload) array-of-arrays text -> bars plus error per element."""
    parsed = payloads.select("series_key", F.from_json("payload", "array<array<string>>").alias("klines"))
    rows = parsed.select("series_key", F.posexplode_outer("klines").alias("row_no", "cells"))
    error = F.when(
        F.col("cells").isNull() | (F.size("cells") < len(KLINE_FIELDS)), F.lit("truncated_row")
    )
    return rows.select("series_key", "row_no", *_kline_columns("cells"), error.alias("error"))


def scan_series_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Operator CSV with a header -> typed bars in file order, nothing repaired.

    ``columns`` is the declared header in file order. Rows with more fields than
    the header surface in ``extra_fields``; an empty volume is null.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("columnPruning", False)  # a pruned parser would not see surplus fields
        .csv(path)
    )
    volume = F.nullif(F.col("volume"), F.lit("")) if "volume" in columns else F.lit(None).cast("string")
    located = rows.select(
        *_file_position(),
        "timestamp_utc", "open", "high", "low", "close",
        volume.alias("volume"),
        # naming a real column keeps the reader from being asked for the corrupt record alone
        (F.col("_corrupt").isNotNull() & (F.coalesce(F.length("timestamp_utc"), F.lit(0)) >= 0)).alias("extra_fields"),
    )
    keep = ["series_key", *[c for c in located.columns if not c.startswith("_")]]
    return quality.clean_bars(with_file_row_no(located, keep))


def header_errors(header_lines: DataFrame) -> DataFrame:
    """(series_key, header) -> missing or duplicated column names."""
    names = F.transform(F.split(F.regexp_replace("header", "^\ufeff", ""), ","), lambda n: F.trim(n))
    required = F.array(*[F.lit(c) for c in ("close", "high", "low", "open", "timestamp_utc")])
    missing = F.array_except(required, names)
    return header_lines.select(
        "series_key",
        F.when(F.size(names) != F.size(F.array_distinct(names)), F.lit("duplicate_columns"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing_columns: "), F.array_join(missing, ", ")))
        .alias("header_error"),
    )


def csv_verdicts(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Per series, why its CSV is rejected: header, surplus fields, then bar rules."""
    surplus = rows.groupBy("series_key").agg(F.some("extra_fields").alias("_surplus"))
    judged = quality.series_verdicts(rows).join(surplus, "series_key")
    joined = judged.join(headers, "series_key", "left")
    reason = F.coalesce("header_error", F.when(F.col("_surplus"), "row_has_extra_fields"), "reason")
    return joined.select(
        "series_key", "row_count", "first_ts", "last_ts", reason.alias("reason"), reason.isNull().alias("valid")
    )


SIDECAR_SCHEMA = (
    "schema_version string, series_key string, symbol string, venue string, timezone string, interval string, "
    "cadence_seconds double, timestamp_semantics string, "
    "session struct<type: string, maximum_gap_seconds: double, boundary_tolerance_seconds: double, minimum_bars_per_24h: int>, "
    "license struct<name: string, redistribution: string, source_url: string>"
)


def scan_series_sidecar(payloads: DataFrame) -> DataFrame:
    """(series_key, payload) JSON text -> normalized dimension row and errors.

    The first error in ``errors`` is the one that rejects the series.
    """
    keys = F.json_object_keys("payload")
    rows = payloads.select(
        F.col("series_key").alias("expected_key"),
        keys.alias("_keys"),
        F.from_json("payload", SIDECAR_SCHEMA).alias("m"),
    )
    rows = rows.select("expected_key", "_keys", "m.*").withColumns(
        {
            "session_type": F.col("session.type"),
            "maximum_gap_seconds": F.col("session.maximum_gap_seconds"),
            "boundary_tolerance_seconds": F.col("session.boundary_tolerance_seconds"),
            "minimum_bars_per_24h": F.col("session.minimum_bars_per_24h"),
        }
    )
    control = r"[\x00-\x1f]"
    texts = []
    for name in ("symbol", "venue", "timezone", "interval"):
        value = F.col(name)
        texts.append((value.isNull() | (F.trim(value) == "") | (F.length(value) > 128), f"{name}_missing_or_long"))
        texts.append((value.rlike(control), f"{name}_control_characters"))
    zone = F.trim("timezone").isin(sorted(zoneinfo.available_timezones()))
    url = F.col("license.source_url")
    rules = [
        (F.col("_keys").isNull(), "not_a_json_object"),
        (F.size("_keys") != F.size(F.array_distinct("_keys")), "duplicate_json_keys"),
        (~F.col("schema_version").eqNullSafe(F.lit(fv.SIDECAR_SCHEMA_VERSION)), "schema_version_unsupported"),
        (~F.col("series_key").eqNullSafe(F.col("expected_key")), "series_key_mismatch"),
        *texts,
        (~zone, "timezone_unknown"),
        (~F.coalesce(F.col("timestamp_semantics").isin("bar_open", "bar_close"), F.lit(False)), "timestamp_semantics_invalid"),
        (F.col("session").isNull(), "session_missing"),
        (quality.policy_error().isNotNull(), "coverage_policy_invalid"),
        (F.col("license.name").isNull() | (F.trim("license.name") == "") | (F.length("license.name") > 240), "license_name_missing_or_long"),
        (F.col("license.name").rlike(control), "license_name_control_characters"),
        (~F.coalesce(F.col("license.redistribution").isin(fv.REDISTRIBUTION), F.lit(False)), "license_redistribution_invalid"),
        (
            (url != "") & ((F.length(url) > 2048) | url.rlike(control) | ~url.rlike(r"(?i)^https?://[^/@?#\s]+(?:[/?#].*)?$")),
            "license_source_url_invalid",
        ),
    ]
    return rows.withColumn(
        "errors", F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))
    ).drop("_keys")


def series_dimension(sidecars: DataFrame, verdicts: DataFrame, bars_in_range: DataFrame) -> DataFrame:
    """Series rows as the window operators expect them.

    A rejected sidecar or bar file is ``unavailable`` with its reason, as is a
    series without bars inside the audit range.
    """
    counts = bars_in_range.groupBy("series_key").agg(F.count(F.lit(1)).alias("row_count"))
    dim = sidecars.drop("series_key").withColumnRenamed("expected_key", "series_key")
    joined = dim.join(verdicts.select("series_key", "reason"), "series_key", "left").join(counts, "series_key", "left")
    error = F.coalesce(
        F.try_element_at("errors", F.lit(1)),
        "reason",
        F.when(F.coalesce("row_count", F.lit(0)) == 0, "CSV contains no rows inside the audit window"),
    )
    return joined.select(
        "series_key",
        F.when(error.isNull(), "available").otherwise("unavailable").alias("status"),
        F.lit(fv.CSV_PROVIDER).alias("provider"),
        "venue", "symbol", "interval", "timezone", "timestamp_semantics", "session_type", "cadence_seconds",
        "maximum_gap_seconds", "boundary_tolerance_seconds", "minimum_bars_per_24h", "license",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        error.alias("error"),
    )


def scan_hourly_history(frame: DataFrame, zone: str = "UTC") -> DataFrame:
    """Provider frame with local stamps -> bars; only all-null OHLC rows go."""
    prices = list(quality.OHLC)
    return frame.na.drop(how="all", subset=prices).select(
        "series_key",
        F.to_utc_timestamp("ts", zone).alias("ts"),
        *[nums.clean_number(F.col(c)).alias(c) for c in prices],
        nums.clean_number(F.col("volume")).alias("volume"),
    )


def day_source_choice(days: DataFrame, archive: DataFrame, today: str) -> DataFrame:
    """Source per (series_key, day): archive for past days it has, else live."""
    archived = F.coalesce("checksum_verified", F.lit(False)) & (F.col("day") < F.lit(today).cast("date"))
    return (
        days.join(archive, ["series_key", "day"], "left")
        .withColumn("source", F.when(archived, "archive").otherwise("live"))
        .withColumn("checksum_verified", archived)
    )


def union_daily_series(archive: DataFrame, live: DataFrame, choice: DataFrame, start: Column, end: Column) -> DataFrame:
    """All chosen days of a series, cut to ``start <= ts < end``."""
    both = archive.unionByName(live)
    ranged = quality.range_restrict(both, start, end).withColumn("day", F.to_date("ts"))
    picked = choice.select("series_key", "day", "source")
    return ranged.join(picked, ["series_key", "day", "source"], "left_semi").drop("day")
