"""Score roll-ups, verdicts, claim profiles, usage, top-k and paging.

Every roll-up takes grouping keys, so that many audits run in one job. Group
aggregates combine map-side; top-k per group relies on Spark's window group
limit, which keeps only k rows per group and map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import text as tx
from hindcast.functions.numbers import percent, round_half_even


def _score_sums() -> list[Column]:
    counted = F.col("counts_in_final_score")
    return [
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(counted).alias("counted_claims"),
        F.sum(F.when(counted, F.col("score"))).alias("points"),
        *[F.count_if(F.col("result") == r).alias(r) for r in fv.RESULTS],
    ]


def _final_score(df: DataFrame) -> DataFrame:
    raw = F.col("points") / F.nullif(F.col("counted_claims").cast("double"), F.lit(0.0)) * 100.0
    return (
        df.withColumn("_raw", raw).withColumn("final_score", round_half_even(F.col("_raw"), 2)).drop("_raw", "points")
    )


def score_aggregate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key and per (key, category) in one pass; category null = total.

    Score rows are reduced to one row per (key, category) first, so that the
    grouping sets only multiply those.
    """
    fine = scores.groupBy(*keys, "category").agg(*_score_sums())
    sets = [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col("category")]]
    summed = [F.sum(c).alias(c) for c in fine.columns if c not in (*keys, "category")]
    grouped = fine.groupingSets(sets, *keys, "category").agg(
        F.grouping("category").cast("int").alias("is_total"), *summed
    )
    return _final_score(grouped)


def score_totals(scores: DataFrame, keys: list[str]) -> DataFrame:
    return _final_score(scores.groupBy(*keys).agg(*_score_sums()))


def result_distribution(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys, "result").agg(F.count(F.lit(1)).alias("n"))


def score_presentation(aggregate: DataFrame) -> DataFrame:
    """Adds the presentation figures to score aggregate rows."""
    total, counted = F.col("total_claims"), F.col("counted_claims")
    counts = aggregate.withColumns(
        {
            "not_counted_claims": F.greatest(total - counted, F.lit(0)),
            "data_supported_claims": F.greatest(
                total - F.col("insufficient_data") - F.col("not_scoreable"), F.lit(0)
            ),
            "resolved_claims": counted + F.col("not_triggered"),
            "at_least_partial_count": F.col("correct") + F.col("partially_correct"),
            "weighted_points": F.col("correct").cast("double") + F.col("partially_correct").cast("double") * 0.5,
        }
    )
    shares = {
        "score_bearing_percent": (counted, total),
        "evidence_coverage_percent": (F.col("data_supported_claims"), total),
        "resolution_percent": (F.col("resolved_claims"), total),
        "activation_percent": (counted, F.col("resolved_claims")),
        "at_least_partial_percent": (F.col("at_least_partial_count"), counted),
        "correct_percent": (F.col("correct"), counted),
        "partial_percent": (F.col("partially_correct"), counted),
        "incorrect_percent": (F.col("incorrect"), counted),
    }
    return round_columns(counts.withColumns({n: percent(p, t) for n, (p, t) in shares.items()}), list(shares), 1)


def round_columns(df: DataFrame, names: list[str], places: int) -> DataFrame:
    return df.withColumns({n: round_half_even(F.col(n), places) for n in names})


def conclusion_ladder(presentation: DataFrame) -> DataFrame:
    """Adds ``conclusion`` and ``conclusion_tone``."""
    score = F.col("final_score")
    steps = [
        (score.isNull() | (F.col("counted_claims") < fv.MATURE_COUNTED), fv.CONCLUSION_IMMATURE),
        (F.col("evidence_coverage_percent") < fv.MATURE_COVERAGE, fv.CONCLUSION_PROVISIONAL),
        *[(score >= bound, value) for bound, value in fv.CONCLUSIONS.items()],
        (F.lit(True), fv.CONCLUSION_CAUTION),
    ]
    chain = lambda i: F.coalesce(*[F.when(test, F.lit(value[i])) for test, value in steps])
    return presentation.withColumn("conclusion", chain(0)).withColumn("conclusion_tone", chain(1))


def hero_verdict(audits: DataFrame) -> DataFrame:
    """Adds verdict key, tone and missed share.

    ``audits`` joins presentation and scenario rows: final_score, counted_claims,
    evidence_coverage_percent, at_least_partial_percent, incorrect, total_videos,
    explicit_condition_percent, level_claim_percent. A missing scenario side
    (total_videos null) gives a null verdict.
    """
    score, aligned = F.col("final_score"), F.col("at_least_partial_percent")
    limited = (
        score.isNull()
        | (F.col("counted_claims") < fv.VERDICT_MIN_COUNTED)
        | (F.col("total_videos") < fv.VERDICT_MIN_VIDEOS)
        | (F.col("evidence_coverage_percent") < fv.VERDICT_MIN_COVERAGE)
    )
    support = (
        (score >= fv.VERDICT_SUPPORT["score"])
        & (aligned >= fv.VERDICT_SUPPORT["alignment"])
        & (F.col("explicit_condition_percent") >= fv.VERDICT_SUPPORT["conditions"])
        & (F.col("level_claim_percent") >= fv.VERDICT_SUPPORT["levels"])
    )
    caution = (score < fv.VERDICT_CAUTION["score"]) & (aligned < fv.VERDICT_CAUTION["alignment"])
    known = F.col("total_videos").isNotNull() & F.col("counted_claims").isNotNull()
    key = F.when(
        known,
        F.when(limited, "insufficient").when(support, "supports_following").when(caution, "caution").otherwise("mixed"),
    )
    tones = {"insufficient": "limited", "supports_following": "qualified_positive", "caution": "caution", "mixed": "mixed"}
    tone = F.coalesce(*[F.when(F.col("verdict") == k, F.lit(v)) for k, v in tones.items()])
    judged = audits.withColumn("verdict", key).withColumn("tone", tone)
    return round_columns(
        judged.withColumn("missed_percent", percent(F.col("incorrect"), F.col("counted_claims"))), ["missed_percent"], 1
    )


def scenario_profile(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claim structure per key: two-level roll-up over (key, video).

    Claims need scoreability, condition, levels (array), invalidation_condition,
    claim_type, direction and video_id.
    """
    n_levels = F.coalesce(F.size("levels"), F.lit(0))
    per_video = claims.groupBy(*keys, "video_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("scoreability") == "conditional_scoreable").alias("conditional"),
        F.count_if(tx.has_text(F.col("condition"))).alias("explicit"),
        F.count_if(n_levels > 0).alias("level"),
        F.count_if(n_levels >= 2).alias("multi_level"),
        F.count_if(tx.has_text(F.col("invalidation_condition"))).alias("invalidation"),
        F.count_if(F.col("claim_type") == "scenario").alias("scenario"),
        F.some(F.col("direction") == "bullish").alias("bullish"),
        F.some(F.col("direction") == "bearish").alias("bearish"),
    )
    totals = per_video.groupBy(*keys).agg(
        F.sum("claims").alias("total_claims"),
        F.count(F.lit(1)).alias("total_videos"),
        F.sum("conditional").alias("conditional_claims"),
        F.sum("explicit").alias("explicit_condition_claims"),
        F.sum("level").alias("level_claims"),
        F.sum("multi_level").alias("multi_level_claims"),
        F.sum("invalidation").alias("invalidation_claims"),
        F.sum("scenario").alias("scenario_claims"),
        F.count_if(F.coalesce(F.col("bullish") & F.col("bearish"), F.lit(False))).alias("both_directions_videos"),
        F.count_if(F.col("invalidation") > 0).alias("invalidation_videos"),
        F.count_if(F.col("claims") >= fv.BUSY_VIDEO_CLAIMS).alias("ten_plus_claim_videos"),
    )
    claims_total, videos = F.col("total_claims"), F.col("total_videos")
    shares = {
        "average_claims_per_video": claims_total.cast("double") / videos.cast("double"),
        "conditional_claim_percent": percent(F.col("conditional_claims"), claims_total),
        "explicit_condition_percent": percent(F.col("explicit_condition_claims"), claims_total),
        "level_claim_percent": percent(F.col("level_claims"), claims_total),
        "multi_level_claim_percent": percent(F.col("multi_level_claims"), claims_total),
        "invalidation_claim_percent": percent(F.col("invalidation_claims"), claims_total),
        "scenario_claim_percent": percent(F.col("scenario_claims"), claims_total),
        "both_directions_video_percent": percent(F.col("both_directions_videos"), videos),
        "invalidation_video_percent": percent(F.col("invalidation_videos"), videos),
        "ten_plus_claim_video_percent": percent(F.col("ten_plus_claim_videos"), videos),
    }
    return round_columns(totals.withColumns(shares), list(shares), 1)


def extraction_summary(claims: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda name, test: F.count_if(test).alias(name)
    state = F.col("scoreability")
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_claims"),
        count("scoreable_claims", state == "scoreable"),
        count("conditional_claims", state == "conditional_scoreable"),
        count("not_scoreable_claims", state == "not_scoreable"),
        count("human_review_required_claims", F.col("human_review_required")),
    )


def review_flag_counts(claims: DataFrame, keys: list[str]) -> DataFrame:
    return (
        claims.select(*keys, F.explode("review_flags").alias("flag"))
        .groupBy(*keys, "flag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


TOKEN_COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in TOKEN_COUNTERS],
        F.count_if(F.col("response_id") != "").alias("api_artifacts"),
    )


def usage_cost(usage: DataFrame) -> DataFrame:
    """Adds ``estimated_cost_usd`` (decimal, eight places); null without rates.

    Rates are decimals per million tokens, which keeps totals exact in any
    order of summation.
    """
    tokens = lambda name: F.coalesce(name, F.lit(0)).cast("decimal(18,0)")
    cached = F.least(tokens("cached_input_tokens"), tokens("input_tokens"))
    millionths = (
        (tokens("input_tokens") - cached) * F.col("input_rate")
        + cached * F.coalesce("cached_rate", "input_rate")
        + tokens("output_tokens") * F.col("output_rate")
    ).cast("decimal(26,4)")
    cost = millionths * F.lit("0.000001").cast("decimal(7,6)")
    return usage.withColumn("estimated_cost_usd", F.bround(cost, 8).cast("decimal(28,8)"))


def poisoned_sum(value: Column) -> Column:
    """Sum that is null as soon as one value is null; zero for no values."""
    return F.when(F.count_if(value.isNull()) == 0, F.coalesce(F.sum(value), F.lit(0)))


def usage_cost_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage_cost(usage).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("artifacts"),
        poisoned_sum(F.col("estimated_cost_usd")).cast("double").alias("estimated_cost_usd"),
    )


def run_status(eligible: DataFrame, completed: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``complete`` per key when the completed ids equal the eligible ids."""
    both = eligible.select(*keys, item).distinct().withColumn("want", F.lit(1)).join(
        completed.select(*keys, item).distinct().withColumn("have", F.lit(1)), [*keys, item], "full_outer"
    )
    return both.groupBy(*keys).agg(
        F.count("want").alias("eligible"),
        F.count("have").alias("completed"),
        F.when(F.every(F.col("want").isNotNull() & F.col("have").isNotNull()), "complete")
        .otherwise("partial")
        .alias("status"),
    )


def provider_rollup(providers: DataFrame, series: DataFrame) -> DataFrame:
    """Provider list with figures of their series; providers without any stay."""
    joined = providers.join(series.withColumnRenamed("provider", "name"), "name", "left")
    has = F.col("series_key").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(has, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("bigint").alias(c)
    return joined.groupBy("name").agg(
        F.count_if(has).alias("series_count"),
        F.count_if(F.col("status") == "available").alias("available_series"),
        total("row_count"), total("raw_file_count"), total("upstream_checksums_verified"),
    )


def highlights(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Videos with enough counted claims and their unrounded-to-1dp score."""
    counted = scores.filter("counts_in_final_score")
    video = counted.groupBy(*keys, "video_id").agg(
        F.count(F.lit(1)).alias("counted"),
        F.sum("score").alias("points"),
        F.max("upload_date").alias("upload_date"),
        *[F.count_if(F.col("result") == r).alias(r) for r in fv.COUNTED_RESULTS],
    )
    scored = video.filter(F.col("counted") >= fv.HIGHLIGHT_MIN_COUNTED).withColumn(
        "video_score", F.col("points") / F.col("counted").cast("double") * 100.0
    )
    return round_columns(scored, ["video_score"], 1).drop("points")


def top_strongest_weakest(scores: DataFrame, keys: list[str], limit: int = fv.HIGHLIGHT_LIMIT) -> DataFrame:
    """Best and worst videos per key with their rank."""
    videos = highlights(scores, keys)

    def ranked(kind: str, first: Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(first, F.desc("counted"), "upload_date", "video_id")
        return (
            videos.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= limit)
            .withColumn("kind", F.lit(kind))
        )

    return ranked("strongest", F.desc("video_score")).unionByName(ranked("weakest", F.asc("video_score")))


def diverse_examples(scores: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """Examples per (key, result), preferring unused categories.

    Greedy rule over candidates by (confidence desc, claim_id): take a row if
    its category is new or ``taken + categories used >= limit``. Every taken
    row counts on both sides until the first repeat, so rows are taken
    category-first up to the ceil(limit/2)-th distinct category and in plain
    order after it. Only the best ``limit`` rows of a category can matter.
    """
    order = [F.desc("scoring_confidence"), F.asc("claim_id")]
    groups = [*keys, "result"]
    wanted = scores.filter(F.col("counts_in_final_score") & F.col("result").isin(list(fv.COUNTED_RESULTS)))
    best = wanted.withColumn(
        "_in_category", F.row_number().over(Window.partitionBy(*groups, "category").orderBy(*order))
    ).filter(F.col("_in_category") <= limit)
    running = Window.partitionBy(*groups).orderBy(*order)
    placed = best.withColumn("_position", F.row_number().over(running)).withColumn(
        "_categories", F.sum(F.when(F.col("_in_category") == 1, 1).otherwise(0)).over(running.rowsBetween(Window.unboundedPreceding, 0))
    )
    switch = (limit + 1) // 2
    taken = placed.withColumn(
        "_pivot",
        F.min(F.when((F.col("_in_category") == 1) & (F.col("_categories") == switch), F.col("_position"))).over(
            Window.partitionBy(*groups)
        ),
    ).filter((F.col("_in_category") == 1) | (F.col("_position") > F.col("_pivot")))
    ranked = taken.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_position"))
    )
    return ranked.filter(F.col("rank") <= limit).drop("_in_category", "_position", "_categories", "_pivot")


def sort_manifest(videos: DataFrame) -> DataFrame:
    """Manifest order: date, category, title; nulls first as empty text."""
    return videos.orderBy(*[F.coalesce(F.col(c), F.lit("")) for c in ("upload_date", "category", "title")], "video_id")


def ledger_join(claims: DataFrame, scores: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Claim left-joined with its score and its outcome."""
    return claims.join(scores, "claim_id", "left").join(outcomes, "claim_id", "left")


def ledger_filter(ledger: DataFrame, result: str | None = None, category: str | None = None, counted: bool | None = None) -> DataFrame:
    """Ledger filters; a claim without a score is not counted."""
    rows = ledger
    if result is not None:
        rows = rows.filter(F.col("result") == result)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    if counted is not None:
        rows = rows.filter(F.coalesce("counts_in_final_score", F.lit(False)) == counted)
    return rows


def ledger_page(rows: DataFrame, limit: int = 100, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """One page in (upload_date, claim_id) order plus the unpaged total.

    ``after`` is the (upload_date, claim_id) of the last row seen and costs the same on every page; an
    ``offset`` sorts and skips that many rows, so it is for the first pages only.
    """
    if not 1 <= limit <= 2000 or offset < 0:
        raise ValueError("limit must be 1..2000 and offset not negative")
    total = rows.agg(F.count(F.lit(1))).scalar()
    if after is not None:
        day, claim = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter((F.col("upload_date") > day) | ((F.col("upload_date") == day) & (F.col("claim_id") > claim)))
    return rows.orderBy("upload_date", "claim_id").offset(offset).limit(limit).withColumn("total", total)
