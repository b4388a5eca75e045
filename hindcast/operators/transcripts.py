"""Transcript operators: captions to lines, segments to captions, evidence binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import text as tx
from hindcast.functions.skew import block_lag, block_running_sum

_CUE_LINE = rf"(?U)^\s*({fv.CUE_TIME})\s*-->\s*({fv.CUE_TIME})(?:\s+.*)?$"


def caption_lines(captions: DataFrame, key: str = "video_id", text: str = "text") -> DataFrame:
    """One row per raw line with cue stamps, blank and skip marks.

    Whether a file is timed is decided on its line array before it is exploded,
    so no window over the file is needed for it.
    """
    # Whole files are shuffled once, before the work on their lines: fewer rows
    # move, row groups of any size spread, and the windows by file need no more.
    files = captions.select(key, text).repartition(key)
    marked = F.col(text).startswith("\ufeff")
    plain = files.select(key, F.when(marked, F.regexp_replace(F.col(text), "^\ufeff+", "")).otherwise(F.col(text)).alias("_text"))
    arrays = plain.select(key, tx.lines_of(F.col("_text")).alias("_lines"))
    timed = arrays.withColumn("timed", F.exists("_lines", lambda line: line.rlike(_CUE_LINE)))
    # outer: the plain generator would first split every text once more, at the scan, to drop empty arrays
    lines = (
        timed.select(key, "timed", F.posexplode_outer("_lines").alias("pos", "raw_line"))
        .filter("pos IS NOT NULL")
        .withColumn("line_text", tx.strip(F.col("raw_line")))
    )
    skipped = F.col("line_text").rlike("(?i)^(?:" + "|".join(fv.CAPTION_SKIP_PREFIXES) + ")")
    marked = lines.select(
        key, "pos", "line_text", "timed",
        F.col("line_text").rlike(_CUE_LINE).alias("is_cue"),
        (F.col("line_text") == "").alias("is_blank"),
        (skipped | F.col("line_text").rlike(r"(?U)^\d+$")).alias("is_skipped"),
    )
    # column by column, so that a stamp is cut out and read once
    stamp = lambda at: F.when(F.col("is_cue"), tx.cue_seconds(F.get("_stamps", F.lit(at))))
    stamps = F.when(F.col("is_cue"), F.split(F.regexp_replace("line_text", _CUE_LINE, "$1 $2"), " "))
    timed_lines = marked.withColumn("_stamps", stamps).withColumns({"cue_start": stamp(0), "_end": stamp(1)})
    return timed_lines.select(
        key, "pos", "line_text", "timed", "is_cue", "cue_start", F.greatest("cue_start", "_end").alias("cue_end"),
        "is_blank", "is_skipped",
    )


def carry_cues(lines: DataFrame, key: str = "video_id") -> DataFrame:
    """Carries the active cue forward; a blank line of a timed file ends it."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    setter = F.col("is_cue") | (F.col("is_blank") & F.col("timed"))
    cue = F.last(F.when(setter, F.struct("cue_start", "cue_end")), ignorenulls=True).over(order)
    return lines.withColumn("_cue", cue).withColumns(
        {"active_start": F.col("_cue.cue_start"), "active_end": F.col("_cue.cue_end")}
    ).drop("_cue")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Adds ``clean``, null for cue, blank and skipped lines.

    Before the cues are carried: a filter after that does not clean every line once more.
    """
    said = ~F.col("is_cue") & ~F.col("is_blank") & ~F.col("is_skipped")
    return lines.withColumn("clean", F.when(said, tx.clean_caption(F.col("line_text"))))


def spoken_lines(carried: DataFrame) -> DataFrame:
    """Drops cue, blank, skipped and orphan lines, and those that were cleaned away."""
    return carried.filter((F.col("clean") != "") & (~F.col("timed") | F.col("active_start").isNotNull()))


def consecutive_dedupe(
    rows: DataFrame, keys: list[str], order: str, value: str, block: Column | None = None
) -> DataFrame:
    """Numbers runs of equal neighbours (``run`` counts from one).

    Give ``block`` (non-decreasing in ``order``) when a key may be of any size;
    without it a key is one window, which suits files of bounded length.
    """
    if block is None:
        sequence = Window.partitionBy(*keys).orderBy(order)
        before = F.lag(F.struct(F.col(value))).over(sequence)
        fresh = F.when(before[value].eqNullSafe(F.col(value)) & before.isNotNull(), 0).otherwise(1)
        running = F.sum("_fresh").over(sequence.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("_fresh", fresh).withColumn("run", running).drop("_fresh")
    boxed = block_lag(rows.withColumn("_box", F.struct(F.col(value).alias("v"))), keys, order, block, "_box", "_before")
    same = F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(F.col(value))
    marked = boxed.withColumn("_fresh", F.when(same, 0).otherwise(1)).drop("_box", "_before")
    return block_running_sum(marked, keys, order, block, "_fresh", "run").drop("_fresh")


def canonicalize_subtitle(captions: DataFrame, key: str = "video_id", text: str = "text") -> DataFrame:
    """Canonical transcript lines with cue timing: (key, line, text, start, end).

    A caption file is at most 20 MiB, so the windows by file stay small. All of
    them and the final grouping share one shuffle by file.
    """
    spoken = spoken_lines(carry_cues(clean_lines(caption_lines(captions, key, text)), key))
    runs = consecutive_dedupe(spoken, [key], "pos", "clean")
    return runs.groupBy(key, "run").agg(
        F.first("clean").alias("text"),
        F.min_by("active_start", "pos").alias("start_seconds"),
        F.max("active_end").alias("end_seconds"),
    ).select(key, F.col("run").cast("int").alias("line"), "text", "start_seconds", "end_seconds")


def transcript_text(lines: DataFrame, key: str = "video_id") -> DataFrame:
    """Canonical lines -> one text per video with its counts and hash."""
    ordered = F.sort_array(F.collect_list(F.struct("line", "text")))
    joined = lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("transcript"))
    return joined.select(
        key, "transcript",
        F.length("transcript").alias("char_count"),
        F.size(tx.lines_of(F.col("transcript"))).alias("line_count"),
        F.sha2("transcript", 256).alias("transcript_sha256"),
    )


def segment_offsets(segments: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Segment times moved by their chunk offset.

    ``segments`` has keys, seq, start, end, text; ``chunks`` has keys, offset,
    duration, text. A chunk without segments but with text becomes one segment
    of the chunk's duration.
    """
    offset = F.col("offset")
    start = F.coalesce("start", F.lit(0.0)) + offset
    local_end = F.coalesce(F.nullif("end", F.lit(0.0)), start - offset)
    moved = segments.join(chunks.select(*keys, "offset"), keys).select(
        *keys, "seq", start.alias("start"),
        F.greatest(local_end + offset, start + 0.001).alias("end"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    silent = chunks.join(segments.select(*keys).distinct(), keys, "left_anti").filter(tx.has_text(F.col("text")))
    fallback = silent.select(
        *keys, F.lit(0).cast("bigint").alias("seq"), offset.alias("start"),
        (offset + F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.001))).alias("end"),
        tx.strip(F.col("text")).alias("text"),
    )
    return moved.unionByName(fallback)


def segments_to_srt(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Segments (key, seq, start, end, text) -> one SRT text per video.

    Blank segments are left out but keep their number.
    """
    start = F.coalesce("start", F.lit(0.0))
    end = F.greatest(F.coalesce(F.nullif("end", F.lit(0.0)), start), start + 0.001)
    index = F.col("seq") + 1
    blocks = segments.withColumn("clean", tx.collapse(F.coalesce("text", F.lit("")))).filter("clean <> ''").select(
        key, "seq",
        F.concat(index.cast("string"), F.lit("\n"), tx.srt_time(start), F.lit(" --> "), tx.srt_time(end), F.lit("\n"), F.col("clean")).alias("block"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "block")))
    return blocks.groupBy(key).agg(
        F.concat(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("srt")
    )


def number_lines(transcripts: DataFrame, key: str = "video_id", text: str = "text") -> DataFrame:
    """``L0001: ...`` labels, one row per line."""
    lines = transcripts.select(key, F.posexplode_outer(tx.lines_of(F.col(text))).alias("pos", "_line"))
    return lines.filter("pos IS NOT NULL").select(
        key, (F.col("pos") + 1).alias("line"), tx.number_line(F.col("pos"), F.col("_line")).alias("labelled")
    )


def evidence_slice(
    claims: DataFrame, max_lines: int = fv.MAX_EVIDENCE_LINES, max_characters: int = fv.MAX_EVIDENCE_CHARACTERS
) -> DataFrame:
    """Adds ``selected`` (cited lines) and the first range violation.

    Claims carry ``transcript``, ``source_line_start`` and ``source_line_end``. Cited lines beyond
    the limits are reported, not cut.
    """
    first, last = F.col("source_line_start"), F.col("source_line_end")
    cited = F.when(
        (first >= 1) & (first <= last) & (last <= F.size("_lines")),
        F.array_join(F.slice("_lines", first, F.greatest(last - first + 1, F.lit(0))), "\n"),
    )
    violation = (
        F.when(last < first, "reversed_line_range")
        .when(last > F.size("_lines"), "line_outside_transcript")
        .when(last - first + 1 > max_lines, "too_many_lines")
        .when(F.length("selected") > max_characters, "evidence_too_long")
    )
    return (
        claims.withColumn("_lines", tx.lines_of(F.col("transcript")))
        .withColumn("selected", cited)
        .withColumn("range_violation", violation)
        .drop("_lines")
    )


def token_overlap(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, coverage): shared tokens over the shorter text, as multisets.

    Tokens of both sides are counted in one grouping; all tokens of a row start
    in one task, so the partial aggregation already combines them.
    """

    def tagged(name: str, side: int) -> Column:
        tokens = tx.evidence_tokens(F.coalesce(name, F.lit("")))
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(side).alias("side")))

    counts = (
        pairs.select(key, F.inline_outer(F.concat(tagged(left, 0), tagged(right, 1))))
        .filter("side IS NOT NULL")
        .groupBy(key, "token")
        .agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    )
    sums = counts.groupBy(key).agg(
        F.sum(F.least("l", "r")).alias("shared"), F.least(F.sum("l"), F.sum("r")).alias("shorter")
    )
    return sums.select(
        key,
        F.when(F.col("shorter") > 0, F.col("shared").cast("double") / F.col("shorter").cast("double"))
        .otherwise(0.0)
        .alias("coverage"),
    )


def evidence_coverage(claims: DataFrame, key: str = "claim_id") -> DataFrame:
    """Slices the cited lines and adds ``exact_match``, ``coverage`` and
    ``excerpt_violation``.

    One shuffle by claim serves the token counts and the join back. Coverage is measured
    wherever lines are cited, also beyond the limits that ``range_violation`` reports.
    """
    advisory = tx.strip_line_labels(F.col("source_excerpt"))
    sliced = evidence_slice(claims.repartition(key))
    within = F.col("selected").isNotNull()
    exact = F.contains(tx.normalize_evidence(F.col("selected")), tx.normalize_evidence(advisory))
    bounded = sliced.select(
        key, F.when(within, F.col("source_excerpt")).alias("_quoted"), F.when(within, F.col("selected")).alias("_cited")
    )
    overlap = token_overlap(bounded, key, "_quoted", "_cited")
    return (
        sliced.join(overlap, key, "left")
        .withColumn("coverage", F.when(within, F.coalesce("coverage", F.lit(0.0))))
        .withColumn("exact_match", F.when(within, exact))
        .withColumn(
            "excerpt_violation",
            F.when(~F.col("exact_match") & (F.col("coverage") < fv.MIN_EVIDENCE_COVERAGE), "excerpt_mismatch"),
        )
    )


def level_binding(sliced: DataFrame) -> DataFrame:
    """Adds ``level_violations``: one code per price level that is not bound.

    Nothing is bound by a claim without cited lines.
    """
    present = F.coalesce(tx.numeric_tokens(F.col("selected")), F.array().cast("array<string>"))

    def check(level: Column) -> Column:
        numbers = tx.numeric_tokens(level)
        return (
            F.when(F.size(numbers) == 0, "non_numeric_level")
            .when(~tx.is_price_level(level), "duration_or_percentage_level")
            .when(F.size(F.array_except(numbers, F.col("_present"))) > 0, "level_not_in_evidence")
        )

    return (
        sliced.withColumn("_present", present)
        .withColumn("level_violations", F.array_compact(F.transform("levels", check)))
        .drop("_present")
    )


def review_policy(claims: DataFrame) -> DataFrame:
    """Review flags, required fields and demotion of unsupported horizons."""
    hours = tx.normalize_horizon(F.col("time_horizon"))
    stated = F.coalesce(F.length("time_horizon"), F.lit(0)) > 0
    unsupported = stated & hours.isNull()
    flags = F.array_compact(
        F.array(
            F.lit(fv.REVIEW_FLAGS[0]),
            F.when(tx.instruction_like(F.col("selected")), F.lit(fv.REVIEW_FLAGS[1])),
            F.when(unsupported, F.lit(fv.REVIEW_FLAGS[2])),
        )
    )
    return claims.withColumns(
        {
            "review_flags": F.array_sort(flags),
            "scoreability": F.when(unsupported, "not_scoreable").otherwise(F.col("scoreability")),
            "not_scoreable_reason": F.when(unsupported, fv.UNSUPPORTED_HORIZON_REASON).otherwise(F.col("not_scoreable_reason")),
            "normalized_horizon_hours": hours,
            "human_review_required": F.lit(True),
            "review_required_fields": F.array(*[F.lit(f) for f in fv.REVIEW_REQUIRED_FIELDS]),
        }
    )


def claim_logic_check(claims: DataFrame) -> DataFrame:
    """Adds ``logic_violations``: contradictions between claim fields."""
    state = F.col("scoreability")
    rules = [
        ((state == "not_scoreable") & (F.coalesce(F.length("not_scoreable_reason"), F.lit(0)) == 0), "not_scoreable_without_reason"),
        ((state != "not_scoreable") & (F.col("claim_type") == "not_scoreable"), "contradictory_scoreability"),
        ((state == "conditional_scoreable") & ~tx.has_text(F.col("condition")), "conditional_without_condition"),
    ]
    return claims.withColumn("logic_violations", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules])))


def pick_track(files: DataFrame, languages: list[str], key: str = "video_id") -> DataFrame:
    """Best subtitle file per video: (key, name).

    100 points per step up the language list, 20 more for SRT; among equals the
    alphabetically first name wins.
    """
    name = F.lower("name")
    candidate = name.endswith(".srt") | name.endswith(".vtt") | (name.contains(".provided.") & name.endswith(".txt"))
    language = F.coalesce(
        *[F.when(name.contains(f".{lang.lower()}."), F.lit((len(languages) - i) * 100)) for i, lang in enumerate(languages)],
        F.lit(0),
    )
    score = language + F.when(name.endswith(".srt"), 20).otherwise(0)
    best = F.min(F.struct((-score).alias("_score"), F.col("name").alias("name")))
    return files.filter(candidate).groupBy(key).agg(best.alias("_best")).select(
        key, F.col("_best.name").alias("name"), (-F.col("_best._score")).alias("track_score")
    )


def scrape_log_summary(lines: DataFrame, key: str, start: str, end: str, scan_limit: int) -> DataFrame:
    """Counts of a collection log given as (key, line_no, line) rows."""
    rejected = F.regexp_extract("line", r"\[download\] (\d{4}-\d{2}-\d{2}) upload date is not in range", 1)
    rejected = F.nullif(rejected, F.lit(""))
    item = lambda i: F.regexp_extract("line", r".*Downloading item (\d+) of (\d+)", i).try_cast("int")
    at = F.when(item(1).isNotNull(), F.col("line_no"))
    summary = lines.groupBy(key).agg(
        F.count_if(F.col("line").startswith("ERROR:")).alias("error_count"),
        F.count_if(F.col("line").startswith("WARNING:")).alias("warning_count"),
        F.coalesce(F.max_by(item(1), at), F.lit(0)).alias("scanned_items"),
        F.max_by(item(2), at).alias("_reported"),
        F.count_if(rejected > end).alias("rejected_newer_than_end"),
        F.count_if(rejected < start).alias("rejected_older_than_start"),
    )
    exhausted = F.coalesce(F.col("_reported") < scan_limit, F.lit(False))
    crossed = F.col("rejected_older_than_start") > 0
    return (
        summary.withColumn("reported_playlist_items", F.coalesce("_reported", F.lit(0)))
        .withColumn("scan_reached_before_start", crossed)
        .withColumn("playlist_exhausted_before_limit", exhausted)
        .withColumn("completeness_boundary_confirmed", crossed | exhausted)
        .drop("_reported")
    )
