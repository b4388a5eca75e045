"""Rule-based scoring: required window, exclusions, contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import text as tx


def required_window() -> Column:
    """24h, 48h or null from ``time_horizon`` and ``normalized_horizon_hours``."""
    stated, declared = F.col("time_horizon"), F.col("normalized_horizon_hours")
    hours = tx.normalize_horizon(stated)
    return F.when(
        tx.has_text(stated),
        F.when(hours.isNotNull() & (declared.isNull() | (declared == hours)), F.concat(hours.cast("string"), F.lit("h"))),
    ).when(declared.isNull(), F.lit("24h"))


def asset_summary(assets: DataFrame) -> DataFrame:
    """Per claim: how many assets and which statuses (long asset rows in)."""
    status = F.col("asset_status")
    return assets.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_assets"),
        F.every(status == "out_of_scope_non_price").alias("only_non_price"),
        F.every(status == "unsupported_asset").alias("only_unsupported"),
        F.some(status == "available").alias("any_available"),
    )


def deterministic_exclusion(claims: DataFrame) -> DataFrame:
    """Score rows that need no judgment; claims that do need it drop out.

    ``claims`` carries scoreability, required_window, supported and the columns
    of ``asset_summary`` (null for claims without assets).
    """
    text = fv.EXCLUSION_TEXT
    window = F.col("required_window")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    reason = F.col("not_scoreable_reason") if "not_scoreable_reason" in claims.columns else F.lit(None).cast("string")
    rule = (
        F.when(F.col("scoreability") == "not_scoreable", "not_scoreable")
        .when(window.isNull(), "unsupported_horizon")
        .when(F.col("supported"), F.lit(None).cast("string"))
        .when(yes("only_non_price"), "non_price")
        .when(yes("only_unsupported"), "unsupported_asset")
        .when(yes("any_available"), "partial")
        .when(F.coalesce("n_assets", F.lit(0)) > 0, "no_series")
        .otherwise("no_asset")
    )
    ruled = claims.withColumn("rule", rule).filter("rule IS NOT NULL")
    context = F.col("rule").isin("not_scoreable", "unsupported_horizon", "non_price")
    pick = lambda cases: F.coalesce(*[F.when(F.col("rule") == k, v) for k, v in cases.items()])
    with_window = lambda template: F.concat(F.lit(template.split("{}")[0]), window, F.lit(template.split("{}")[1]))
    return ruled.select(
        "claim_id",
        "rule",
        F.when(context, "not_scoreable").otherwise("insufficient_data").alias("result"),
        F.lit(0.0).alias("score"),
        F.lit(False).alias("counts_in_final_score"),
        F.when(~context & (F.col("scoreability") == "conditional_scoreable"), "unclear")
        .otherwise("not_applicable")
        .alias("trigger_status"),
        F.when(context, "sufficient")
        .when(F.col("rule") == "unsupported_asset", "unsupported_asset")
        .when(F.col("rule") == "partial", "partial")
        .otherwise("insufficient")
        .alias("data_sufficiency"),
        pick(
            {
                "not_scoreable": F.lit(text["not_scoreable"][0]),
                "unsupported_horizon": F.lit(text["unsupported_horizon"][0]),
                "non_price": F.lit(text["non_price"][0]),
                "unsupported_asset": F.lit(text["unsupported_asset"]),
                "partial": with_window(text["partial"]),
                "no_series": F.lit(text["no_series"]),
                "no_asset": F.lit(text["no_asset"]),
            }
        ).alias("evidence_summary"),
        F.coalesce(
            pick(
                {
                    "not_scoreable": F.coalesce(F.nullif(reason, F.lit("")), F.lit(text["not_scoreable"][1])),
                    "unsupported_horizon": F.lit(text["unsupported_horizon"][1]),
                    "non_price": F.lit(text["non_price"][1]),
                }
            ),
            with_window(text["window_policy"]),
        ).alias("reasoning"),
        F.when(~context, window).alias("evaluation_window"),
        F.lit(1.0).alias("scoring_confidence"),
    )


SCORE_COLUMNS = [
    "claim_id", "result", "score", "counts_in_final_score", "trigger_status", "data_sufficiency",
    "evidence_summary", "reasoning", "evaluation_window", "scoring_confidence",
]


def merge_scores(claims: DataFrame, excluded: DataFrame, judged: DataFrame) -> DataFrame:
    """Exclusions first, judged rows only for claims that were not excluded."""
    known = claims.select("claim_id")
    open_rows = judged.select(*SCORE_COLUMNS).join(excluded.select("claim_id"), "claim_id", "left_anti")
    return excluded.select(*SCORE_COLUMNS).unionByName(open_rows).join(known, "claim_id", "left_semi")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def score_contract_check(scores: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, row, violations[]) for every score row and every missing score.

    ``claims`` carries claim_id, video_id, scoreability, required_window,
    supported and has_outcome.
    """
    facts = claims.select(
        "claim_id",
        F.col("video_id").alias("claim_video"),
        "scoreability", "required_window", "supported", "has_outcome",
        F.lit(True).alias("known"),
    )
    repeated = repeated_keys(scores.filter("claim_id IS NOT NULL"), ["claim_id"]).withColumnRenamed("n", "copies")
    rows = scores.join(facts, "claim_id", "left").join(repeated, "claim_id", "left")
    result = F.col("result")
    counted = result.isin(list(fv.COUNTED_RESULTS))
    fixed = F.coalesce(*[F.when(result == k, F.lit(v)) for k, v in fv.COUNTED_RESULTS.items()])
    known = F.coalesce("known", F.lit(False))
    scored = F.col("counts_in_final_score") | (F.col("score") != 0)
    wrong_window = F.col("required_window").isNull() | ~F.col("evaluation_window").eqNullSafe(F.col("required_window"))
    unsupported = ~F.coalesce("supported", F.lit(False))
    sufficient = F.col("data_sufficiency") == "sufficient"
    idle = result == "not_triggered"
    conditional = F.col("scoreability") == "conditional_scoreable"
    rules = [
        (~known, "R02_unexpected_score"),
        (F.col("copies").isNotNull(), "R02_repeated_score"),
        (known & ~F.col("video_id").eqNullSafe(F.col("claim_video")), "R01_video_mismatch"),
        (known & ~F.coalesce("has_outcome", F.lit(False)), "R03_no_outcome"),
        (known & (F.col("scoreability") == "not_scoreable") & ((result != "not_scoreable") | scored), "R04_not_scoreable_claim"),
        (known & (F.col("scoreability") == "scoreable") & (F.col("trigger_status") != "not_applicable"), "R05_direct_trigger"),
        (counted & (~F.col("counts_in_final_score") | (F.col("score") != fixed)), "R06_counted_score"),
        (counted & ~sufficient, "R07_counted_sufficiency"),
        (known & counted & wrong_window, "R08_counted_window"),
        (known & counted & unsupported, "R09_counted_unsupported"),
        (known & counted & conditional & (F.col("trigger_status") != "triggered"), "R10_counted_trigger"),
        (~counted & scored, "R11_uncounted_score"),
        (idle & (F.col("trigger_status") != "not_triggered"), "R12_idle_trigger"),
        (known & idle & ~conditional, "R13_idle_unconditional"),
        (idle & ~sufficient, "R14_idle_sufficiency"),
        (known & idle & wrong_window, "R15_idle_window"),
        (known & idle & unsupported, "R16_idle_unsupported"),
        ((result == "insufficient_data") & sufficient, "R17_insufficient_sufficiency"),
        ((result == "not_scoreable") & F.col("evaluation_window").isNotNull(), "R18_not_scoreable_window"),
    ]
    checked = rows.select(
        "claim_id", "result", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules])).alias("violations")
    )
    missing = facts.join(scores, "claim_id", "left_anti").select(
        "claim_id", F.lit(None).cast("string").alias("result"), F.array(F.lit("R02_missing_score")).alias("violations")
    )
    return checked.unionByName(missing)


def score_artifact_check(scores: DataFrame, videos: DataFrame) -> DataFrame:
    """Score rows whose video metadata is not the canonical one."""
    fields = ("upload_date", "category")
    canonical = videos.select("video_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_known"))
    rows = scores.join(canonical, "video_id", "left")
    wrong = [F.when(F.col("_known").isNull(), "video_id")] + [
        F.when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in fields
    ]
    return rows.withColumn("wrong_fields", F.array_compact(F.array(*wrong))).filter(F.size("wrong_fields") > 0).drop(
        *[f"_{c}" for c in fields], "_known"
    )


def _member(name: str, values: list[str]) -> Column:
    return ~F.coalesce(F.col(name).isin(values), F.lit(False))


def _unit(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(name) | (F.col(name) < 0) | (F.col(name) > 1)


def _empty(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0)) < 1


def claim_row_contract(claims: DataFrame) -> DataFrame:
    """Adds ``violations``: schema constraints of a claim row as data."""
    unique = lambda name: F.size(name) != F.size(F.array_distinct(name))
    rules = [
        (_empty("claim_text"), "claim_text_empty"),
        (_member("claim_type", fv.CLAIM_TYPES), "claim_type_unknown"),
        (_empty("source_excerpt"), "source_excerpt_empty"),
        (F.length("source_excerpt") > fv.MAX_EVIDENCE_CHARACTERS, "source_excerpt_long"),
        (~F.coalesce(F.col("source_line_start") >= 1, F.lit(False)), "source_line_start_below_one"),
        (~F.coalesce(F.col("source_line_end") >= 1, F.lit(False)), "source_line_end_below_one"),
        (_member("direction", fv.DIRECTIONS), "direction_unknown"),
        (F.col("normalized_horizon_hours").isNotNull() & ~F.col("normalized_horizon_hours").isin(24, 48), "normalized_horizon_unknown"),
        (_member("scoreability", fv.SCOREABILITY), "scoreability_unknown"),
        (_unit("extraction_confidence"), "extraction_confidence_range"),
        (unique("review_flags"), "review_flags_repeated"),
        (F.size(F.array_except("review_flags", F.array(*[F.lit(v) for v in fv.REVIEW_FLAGS]))) > 0, "review_flags_unknown"),
    ]
    return claims.withColumn("violations", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules])))


def score_row_contract(scores: DataFrame) -> DataFrame:
    """Adds ``violations``: schema constraints of a score row as data."""
    rules = [
        (_empty("claim_id"), "claim_id_empty"),
        (_member("result", fv.RESULTS), "result_unknown"),
        (_unit("score"), "score_range"),
        (F.col("counts_in_final_score").isNull(), "counts_missing"),
        (_member("trigger_status", fv.TRIGGER_STATUSES), "trigger_status_unknown"),
        (_member("data_sufficiency", fv.DATA_SUFFICIENCY), "data_sufficiency_unknown"),
        (_empty("evidence_summary"), "evidence_summary_empty"),
        (_empty("reasoning"), "reasoning_empty"),
        (F.col("evaluation_window").isNotNull() & _member("evaluation_window", fv.EVALUATION_WINDOWS), "evaluation_window_unknown"),
        (_unit("scoring_confidence"), "scoring_confidence_range"),
    ]
    return scores.withColumn("violations", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules])))


def unknown_fields(payloads: DataFrame, payload: str, allowed: list[str]) -> DataFrame:
    """JSON rows with keys outside the closed schema."""
    extra = F.array_except(F.json_object_keys(payload), F.array(*[F.lit(k) for k in allowed]))
    return payloads.withColumn("unknown_fields", F.array_sort(extra))
