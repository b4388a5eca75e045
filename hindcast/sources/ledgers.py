"""Ledger files: source records, provided sources, JSONL, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import fixed_values as fv
from hindcast.operators import manifest

SOURCE_RECORD = (
    "id string, title string, upload_date string, channel_id string, webpage_url string, description string, "
    "duration double, release_timestamp bigint, timestamp bigint, audit_category string, provided_source boolean"
)
PROVIDED_SOURCES = (
    "channel_id string, videos array<struct<video_id: string, title: string, upload_date: string, "
    "published_at_utc: string, webpage_url: string, duration_seconds: double, category: string, "
    "transcript_language: string, transcript_path: string, description: string>>"
)
CORRUPT = "_corrupt"


def scan_jsonl(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON rows with a declared schema; what does not parse is kept in ``_corrupt``.

    Blank lines are ignored. A line that is JSON but no object counts as corrupt.
    """
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multiline)
        .json(path)
    )


def scan_source_ledger(spark: SparkSession, path: str, start_compact: str, end_compact: str, multiline: bool = False) -> DataFrame:
    """Source records split by date range: adds ``in_range`` and ``error``."""
    rows = scan_jsonl(spark, path, SOURCE_RECORD, multiline)
    unsafe = F.size(manifest.safe_id_violations({"id": fv.VIDEO_ID_PATTERN})) > 0
    return rows.withColumn("in_range", manifest.in_date_range(F.col("upload_date"), start_compact, end_compact)).withColumn(
        "error", F.when(F.col(CORRUPT).isNotNull(), "not_a_json_object").when(unsafe, "video_id_unsafe")
    ).drop(CORRUPT).withColumnRenamed("id", "video_id")


def scan_provided_sources(
    spark: SparkSession, path: str, start: str, end: str, channel_id: str | None = None, most_videos: int = 5000, **bounds: int
) -> DataFrame:
    """Provided-source files -> normalized videos with errors.

    No file vanishes: one that is no JSON object or has no videos gives one row with that error; every
    video of a file with too many, or of another channel than ``channel_id``, carries the error.
    """
    files = scan_jsonl(spark, path, PROVIDED_SOURCES)
    n = F.coalesce(F.size("videos"), F.lit(0))
    other = F.lit(False) if channel_id is None else (F.coalesce("channel_id", F.lit("")) != "") & (F.col("channel_id") != channel_id)
    error = (
        F.when(F.col(CORRUPT).isNotNull(), "not_a_json_object").when(n < 1, "no_videos")
        .when(n > most_videos, "too_many_videos").when(other, "channel_mismatch")
    )
    videos = files.select(error.alias("file_error"), F.inline_outer("videos"))
    return manifest.normalize_provided_sources(videos, start, end, **bounds)


def sink_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept, stamps to the microsecond."""
    (
        rows.write.mode("errorifexists")
        .option("ignoreNullFields", False)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .json(path)
    )


def sink_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed header order."""
    (
        rows.select(*columns)
        .write.mode("errorifexists")
        .option("header", True)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
