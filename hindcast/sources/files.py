"""Whole-file sources: transcripts and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixed_values as fv


def scan_transcripts(spark: SparkSession, path: str, id_pattern: str) -> DataFrame:
    """One row per subtitle file: (video_id, text, too_large).

    ``id_pattern`` takes the video id out of the path. Bytes that are not UTF-8
    are replaced. Oversized files are marked; their text is there all the same.
    """
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("video_id"),
        (F.col("_metadata.file_size") > fv.SUBTITLE_BYTES_LIMIT).alias("too_large"),
        F.col("value").alias("text"),
    )


def scan_file_inventory(spark: SparkSession, path: str, scope: str, root: str | None = None) -> DataFrame:
    """(scope, relative_path, size_bytes, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = (root or path).rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), rf"^(?:file:)?/*?(?=/)\Q{base}\E", "")
    return files.select(
        F.lit(scope).alias("scope"),
        relative.alias("relative_path"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
