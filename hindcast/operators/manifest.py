"""Source manifest: selection, eligibility, provenance, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import text as tx


def in_date_range(raw: Column, start_compact: str, end_compact: str) -> Column:
    """Inclusive window on ``YYYYMMDD`` text; malformed or null is outside."""
    inside = raw.rlike(r"^\d{8}$") & (raw >= start_compact) & (raw <= end_compact)
    return F.coalesce(inside, F.lit(False))


def compact_date(raw: Column) -> Column:
    """``YYYYMMDD`` text -> date, or null when it is no calendar day."""
    return F.when(raw.rlike(r"^\d{8}$"), F.try_to_date(raw, "yyyyMMdd"))


def filter_requested_ids(rows: DataFrame, requested: DataFrame, key: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """(rows that were requested, requested ids that are unknown)."""
    return rows.join(requested, key, "left_semi"), requested.join(rows.select(key), key, "left_anti")


def limit_videos(videos: DataFrame, n: int) -> DataFrame:
    """First n in manifest order; a distributed top-n, no full sort."""
    if n < 1:
        raise ValueError("the limit must be at least one")
    return videos.orderBy("upload_date", "category", "title", "video_id").limit(n)


def published_at(videos: DataFrame) -> DataFrame:
    """Publication time and where it came from; zero stamps count as absent."""
    release, stamp = F.nullif(F.col("release_timestamp"), F.lit(0)), F.nullif(F.col("timestamp"), F.lit(0))
    best = F.coalesce(release, stamp)
    iso = tx.compact_to_iso(F.col("upload_date_raw"))
    noon = F.concat(iso, F.lit("T12:00:00+00:00")).try_cast("timestamp")
    return videos.withColumn(
        "published_at", F.coalesce(F.timestamp_seconds(best), noon).cast("timestamp_ntz")
    ).withColumn(
        "published_at_source",
        F.when(F.coalesce("provided_source", F.lit(False)), "operator_provided_timestamp")
        .when(best.isNotNull(), "youtube_timestamp")
        .otherwise("date_noon_fallback"),
    )


def subtitle_provenance(videos: DataFrame, languages: list[str]) -> DataFrame:
    """Language and origin of the picked track (``subtitle_file``, ``manual_tracks``)."""
    name = F.lower("subtitle_file")
    language = F.coalesce(*[F.when(name.contains(f".{lang.lower()}."), F.lit(lang)) for lang in languages])
    return videos.withColumn("subtitle_language", language).withColumn(
        "subtitle_provenance",
        F.when(F.col("subtitle_file").isNull(), F.lit(None).cast("string"))
        .when(name.contains(".ai."), "openai_audio_transcription")
        .when(name.contains(".provided."), "operator_provided_transcript")
        .when(
            F.coalesce(F.array_contains("manual_tracks", F.col("subtitle_language")), F.lit(False)),
            "youtube_manual_subtitle",
        )
        .otherwise("youtube_automatic_caption"),
    )


def eligibility(videos: DataFrame, require_subtitles: bool = True) -> DataFrame:
    """Audit eligibility and exclusion reason; an empty transcript overrides."""
    has, empty = F.col("has_subtitle"), F.coalesce(F.col("clean_text"), F.lit("")) == ""
    blank = has & empty
    missing = ~has & F.lit(require_subtitles)
    return videos.withColumn("audit_eligible", ~blank & ~missing).withColumn(
        "exclusion_reason", F.when(blank, "empty_transcript").when(missing, "missing_subtitle")
    )


def manifest_summary(videos: DataFrame, keys: list[str]) -> DataFrame:
    """Collection counts per key in one pass."""
    eligible = F.col("audit_eligible")
    return videos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_videos_found"),
        F.count_if(eligible).alias("videos_included"),
        F.count_if(~eligible).alias("videos_automatically_excluded"),
        F.count_if(eligible & F.col("has_subtitle")).alias("videos_with_subtitles"),
        F.count_if(eligible & ~F.col("has_subtitle")).alias("videos_without_subtitles"),
        F.count_if(~F.col("has_subtitle")).alias("missing_subtitles_found"),
        F.count_if(F.col("category") == "unknown").alias("unknown_category_count"),
    )


def manifest_breakdown(videos: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by category, date and provenance as long rows (facet, value)."""
    key_columns = [F.col(k) for k in keys]
    # one row per combination before the three grouping sets multiply it
    facets = (
        videos.withColumn("provenance", F.coalesce("subtitle_provenance", F.lit("missing")))
        .groupBy(*keys, "category", "upload_date", "provenance")
        .agg(F.count_if("audit_eligible").alias("_included"), F.count(F.lit(1)).alias("_found"))
    )
    grouped = facets.groupingSets(
        [[*key_columns, F.col(c)] for c in ("category", "upload_date", "provenance")],
        *keys, "category", "upload_date", "provenance",
    ).agg(
        F.grouping_id(*keys, "category", "upload_date", "provenance").alias("_set"),
        F.sum("_included").alias("included"),
        F.sum("_found").alias("found"),
    )
    facet = F.when(F.col("_set") == 3, "category").when(F.col("_set") == 5, "date").otherwise("provenance")
    value = F.when(F.col("_set") == 3, F.col("category")).when(F.col("_set") == 5, F.col("upload_date")).otherwise(F.col("provenance"))
    return grouped.select(*keys, facet.alias("facet"), value.alias("value"), "included", "found")


def scope_summary(videos: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """What the category scope keeps, excludes and leaves out.

    The distinct out-of-scope categories are a bounded vocabulary.
    """
    inside = F.coalesce(F.col("category").isin(scope), F.lit(False))
    eligible = F.col("audit_eligible")
    return videos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_videos_found"),
        F.count_if(inside).alias("videos_in_scope_found"),
        F.count_if(inside & eligible).alias("videos_audited"),
        F.count_if(inside & ~eligible).alias("automatic_exclusions"),
        F.count_if(~inside).alias("out_of_scope_videos"),
        F.array_sort(F.collect_set(F.when(~inside, F.col("category")))).alias("out_of_scope_categories"),
    )


def channel_mismatch(videos: DataFrame, expected: Column) -> DataFrame:
    """Rows of another or an unidentified channel."""
    return videos.filter(~F.col("channel_id").eqNullSafe(expected))


def safe_id_violations(columns: dict[str, str]) -> Column:
    """Array of column names that break their identifier pattern.

    ``columns`` maps a column to one of the fixed patterns.
    """
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.col(name).rlike(f"^(?:{pattern})$") & ~F.col(name).isin(".", ".."), F.lit(False)), F.lit(name))
                for name, pattern in columns.items()
            ]
        )
    )


def normalize_provided_sources(
    videos: DataFrame, start: str, end: str, max_title: int = 1000, max_description: int = 200000, max_language: int = 24
) -> DataFrame:
    """Provided-source rows -> normalized rows plus ``errors`` and ``cuts``.

    In-range rows only; the others are skipped, not rejected. ``file_error`` is an error of the whole file;
    the first two kinds stand alone, on a row without a video. ``cuts`` names the fields that a bound cut.
    """
    from hindcast.functions import numbers as nums
    from hindcast.operators.scoring import repeated_keys

    day = F.when(F.col("upload_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("upload_date").try_cast("date"))
    published = nums.parse_aware_ts(F.col("published_at_utc"))
    language = F.regexp_replace(F.coalesce(F.nullif("transcript_language", F.lit("")), F.lit("und")), "[^A-Za-z0-9_-]", "-")
    language = F.regexp_replace(language, "^-+|-+$", "")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled provided source"))
    description = F.coalesce("description", F.lit(""))
    fields = {"title": (title, max_title), "description": (description, max_description), "transcript_language": (language, max_language)}
    cuts = F.array_compact(F.array(*[F.when(F.length(text) > most, F.lit(name)) for name, (text, most) in fields.items()]))
    kept = {name: F.substring(text, 1, most) for name, (text, most) in fields.items()}
    suffix = F.lower(F.regexp_extract("transcript_path", r"(\.[^./]+)$", 1))
    duration = F.col("duration_seconds")
    repeated = repeated_keys(videos.filter("video_id IS NOT NULL"), ["video_id"]).select("video_id", F.lit(True).alias("_repeated"))
    rules = [
        (F.size(safe_id_violations({"video_id": fv.VIDEO_ID_PATTERN})) > 0, "video_id_unsafe"),
        (F.coalesce("_repeated", F.lit(False)), "video_id_repeated"),
        (day.isNull(), "upload_date_invalid"),
        (published.isNull(), "published_at_invalid"),
        (~F.coalesce(suffix.isin(".txt", ".srt", ".vtt"), F.lit(False)), "transcript_extension_unsupported"),
        (F.coalesce(F.col("category"), F.lit("")) != "", None),
        (duration.isNotNull() & ~((duration > 0) & (duration <= 21600)), "duration_out_of_range"),
    ]
    bad_category = (F.coalesce(F.col("category"), F.lit("")) != "") & ~F.col("category").rlike(f"^(?:{fv.CATEGORY_PATTERN})$")
    file_error = F.col("file_error") if "file_error" in videos.columns else F.lit(None).cast("string")
    alone = F.coalesce(file_error.isin("not_a_json_object", "no_videos"), F.lit(False))
    codes = [F.when(~alone & (bad_category if code is None else test), F.lit(code or "category_unsafe")) for test, code in rules]
    return (
        videos.join(repeated, "video_id", "left")
        .filter(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .select(
            "video_id",
            F.when(~alone, kept["title"]).alias("title"),
            day.alias("upload_date"),
            published.cast("timestamp_ntz").alias("published_at"),
            "duration_seconds",
            F.nullif("category", F.lit("")).alias("category"),
            F.when(~alone, F.coalesce(F.nullif(kept["transcript_language"], F.lit("")), F.lit("und"))).alias("transcript_language"),
            F.when(~alone, kept["description"]).alias("description"),
            F.array_compact(F.array(file_error, *codes)).alias("errors"),
            cuts.alias("cuts"),
        )
    )
