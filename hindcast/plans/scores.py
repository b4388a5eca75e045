"""Scoring and metric queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions.numbers import percent_sql, round_half_even_sql
from hindcast.operators import metrics, resolve, scoring
from hindcast.plans import outcomes as oc
from hindcast.plans.registry import query
from hindcast.plans.views import claims_with_arrays, view

_RESULT_COUNTS = ", ".join(f"count(*) FILTER (WHERE result = '{r}') AS {r}" for r in fv.RESULTS)
_RESULT_NAMES = ", ".join(fv.RESULTS)
_SUMS = f"""count(*) AS total_claims, count(*) FILTER (WHERE counts_in_final_score) AS counted_claims,
  sum(score) FILTER (WHERE counts_in_final_score) / nullif(CAST(count(*) FILTER (WHERE counts_in_final_score) AS DOUBLE), 0) * CAST(100 AS DOUBLE) AS raw, {_RESULT_COUNTS}"""


def audited_claims(spark, sf):
    """Claims with arrays and the audit they belong to."""
    return claims_with_arrays(spark, sf).withColumn("audit_id", F.col("video_id") % 20)


def claim_facts(spark, sf):
    """Claims with required window, support and asset summary."""
    claims = oc.supported_claims(spark, sf)
    return claims.join(scoring.asset_summary(oc.resolved_assets(spark, sf)), "claim_id", "left")


@query("required_window", f"WITH {oc.SUPPORT_CTE} SELECT claim_id, required_window FROM needed")
def required_window_query(spark, sf):
    return view(spark, sf, "claims").select("claim_id", scoring.required_window().alias("required_window"))


EXCLUSION_CTE = oc.SUPPORT_CTE + """,
assets_of AS (
  SELECT claim_id, count(*) AS n, bool_and(asset_status = 'out_of_scope_non_price') AS all_context,
    bool_and(asset_status = 'unsupported_asset') AS all_unsupported, bool_or(asset_status = 'available') AS any_available
  FROM asset_rows GROUP BY 1),
ruled AS (
  SELECT c.claim_id, c.scoreability, s.required_window,
    CASE WHEN c.scoreability = 'not_scoreable' THEN 'not_scoreable' WHEN s.required_window IS NULL THEN 'unsupported_horizon'
      WHEN s.supported THEN NULL WHEN a.all_context THEN 'non_price' WHEN a.all_unsupported THEN 'unsupported_asset'
      WHEN a.any_available THEN 'partial' WHEN a.n > 0 THEN 'no_series' ELSE 'no_asset' END AS rule
  FROM {claims} c JOIN support s ON s.claim_id = c.claim_id LEFT JOIN assets_of a ON a.claim_id = c.claim_id),
excluded AS (
  SELECT claim_id, rule, CASE WHEN rule IN ('not_scoreable', 'unsupported_horizon', 'non_price') THEN 'not_scoreable' ELSE 'insufficient_data' END AS result,
    CASE WHEN rule NOT IN ('not_scoreable', 'unsupported_horizon', 'non_price') AND scoreability = 'conditional_scoreable' THEN 'unclear' ELSE 'not_applicable' END AS trigger_status,
    CASE WHEN rule IN ('not_scoreable', 'unsupported_horizon', 'non_price') THEN 'sufficient' WHEN rule = 'unsupported_asset' THEN 'unsupported_asset'
      WHEN rule = 'partial' THEN 'partial' ELSE 'insufficient' END AS data_sufficiency,
    CASE WHEN rule NOT IN ('not_scoreable', 'unsupported_horizon', 'non_price') THEN required_window END AS evaluation_window
  FROM ruled WHERE rule IS NOT NULL)"""


@query(
    "deterministic_exclusion",
    f"""WITH {EXCLUSION_CTE} SELECT claim_id, rule, result, trigger_status, data_sufficiency, evaluation_window,
      CASE WHEN rule = 'partial' THEN 'Market data exists, but the required ' || evaluation_window || ' outcome window is not complete for every asset.'
        ELSE '' END AS partial_text FROM excluded""",
)
def deterministic_exclusion_query(spark, sf):
    return scoring.deterministic_exclusion(claim_facts(spark, sf)).select(
        "claim_id", "rule", "result", "trigger_status", "data_sufficiency", "evaluation_window",
        F.when(F.col("rule") == "partial", F.col("evidence_summary")).otherwise("").alias("partial_text"),
    )


@query(
    "merge_scores",
    f"""WITH {EXCLUSION_CTE} SELECT claim_id, result, CAST(0 AS DOUBLE) AS score, FALSE AS counts_in_final_score, evaluation_window FROM excluded
      UNION ALL SELECT j.claim_id, j.result, j.score, j.counts_in_final_score, j.evaluation_window FROM {{judged}} j
      WHERE j.claim_id IN (SELECT claim_id FROM {{claims}}) AND j.claim_id NOT IN (SELECT claim_id FROM excluded)""",
)
def merge_scores_query(spark, sf):
    excluded = scoring.deterministic_exclusion(claim_facts(spark, sf))
    return scoring.merge_scores(view(spark, sf, "claims"), excluded, view(spark, sf, "judged")).select(
        "claim_id", "result", "score", "counts_in_final_score", "evaluation_window"
    )


def _contract_sql() -> str:
    counted = "j.result IN ('correct', 'partially_correct', 'incorrect')"
    scored = "(j.counts_in_final_score OR j.score <> 0)"
    wrong_window = "(s.required_window IS NULL OR j.evaluation_window IS DISTINCT FROM s.required_window)"
    idle = "j.result = 'not_triggered'"
    known = "c.claim_id IS NOT NULL"
    rules = [
        ("c.claim_id IS NULL", "R02_unexpected_score"),
        ("j.claim_id IN (SELECT claim_id FROM copies)", "R02_repeated_score"),
        (f"{known} AND j.video_id <> c.video_id", "R01_video_mismatch"),
        (f"{known} AND o.claim_id IS NULL", "R03_no_outcome"),
        (f"c.scoreability = 'not_scoreable' AND (j.result <> 'not_scoreable' OR {scored})", "R04_not_scoreable_claim"),
        ("c.scoreability = 'scoreable' AND j.trigger_status <> 'not_applicable'", "R05_direct_trigger"),
        (f"{counted} AND (NOT j.counts_in_final_score OR j.score <> CASE j.result WHEN 'correct' THEN 1 WHEN 'partially_correct' THEN 0.5 ELSE 0 END)", "R06_counted_score"),
        (f"{counted} AND j.data_sufficiency <> 'sufficient'", "R07_counted_sufficiency"),
        (f"{known} AND {counted} AND {wrong_window}", "R08_counted_window"),
        (f"{known} AND {counted} AND NOT s.supported", "R09_counted_unsupported"),
        (f"{counted} AND c.scoreability = 'conditional_scoreable' AND j.trigger_status <> 'triggered'", "R10_counted_trigger"),
        (f"NOT {counted} AND {scored}", "R11_uncounted_score"),
        (f"{idle} AND j.trigger_status <> 'not_triggered'", "R12_idle_trigger"),
        (f"{idle} AND c.scoreability <> 'conditional_scoreable'", "R13_idle_unconditional"),
        (f"{idle} AND j.data_sufficiency <> 'sufficient'", "R14_idle_sufficiency"),
        (f"{known} AND {idle} AND {wrong_window}", "R15_idle_window"),
        (f"{known} AND {idle} AND NOT s.supported", "R16_idle_unsupported"),
        ("j.result = 'insufficient_data' AND j.data_sufficiency = 'sufficient'", "R17_insufficient_sufficiency"),
        ("j.result = 'not_scoreable' AND j.evaluation_window IS NOT NULL", "R18_not_scoreable_window"),
    ]
    checks = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for test, code in rules)
    return f"""WITH {oc.SUPPORT_CTE},
      copies AS (SELECT claim_id FROM {{judged}} GROUP BY 1 HAVING count(*) > 1),
      with_outcome AS (SELECT DISTINCT claim_id FROM asset_rows)
      SELECT j.claim_id, j.result, concat_ws(', ', {checks}) AS violations
      FROM {{judged}} j LEFT JOIN {{claims}} c ON c.claim_id = j.claim_id LEFT JOIN support s ON s.claim_id = j.claim_id
      LEFT JOIN with_outcome o ON o.claim_id = j.claim_id
      UNION ALL SELECT claim_id, NULL, 'R02_missing_score' FROM {{claims}} WHERE claim_id NOT IN (SELECT claim_id FROM {{judged}})"""


@query("score_contract_check", _contract_sql())
def score_contract_check_query(spark, sf):
    # a claim's outcome row exists here when it names at least one asset
    facts = oc.supported_claims(spark, sf).withColumn(
        "has_outcome", F.col("asset_1").isNotNull() | F.col("asset_2").isNotNull()
    )
    return scoring.score_contract_check(view(spark, sf, "judged"), facts).select(
        "claim_id", "result", F.concat_ws(", ", "violations").alias("violations")
    )


@query(
    "score_artifact_check",
    """SELECT r.claim_id, r.video_id, concat_ws(',', CASE WHEN r.category IS DISTINCT FROM v.category THEN 'category' END) AS wrong_fields
      FROM {score_rows} r JOIN (SELECT o_orderkey AS video_id, CASE o_custkey % 4 WHEN 0 THEN 'crypto' WHEN 1 THEN 'global_markets'
        WHEN 2 THEN 'local_markets' ELSE 'unknown' END AS category FROM {orders}) v ON v.video_id = r.video_id
      WHERE r.category IS DISTINCT FROM v.category
      UNION ALL SELECT r.claim_id, r.video_id, 'video_id' FROM {score_rows} r WHERE r.video_id NOT IN (SELECT o_orderkey FROM {orders})""",
)
def score_artifact_check_query(spark, sf):
    scores = view(spark, sf, "score_rows")
    # dates are taken as given; the category comes from the order's customer
    videos = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"),
        F.lit(None).cast("string").alias("upload_date"),
        F.element_at(F.array(*[F.lit(c) for c in ("crypto", "global_markets", "local_markets", "unknown")]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("category"),
    )
    undated = scores.withColumn("upload_date", F.lit(None).cast("string"))
    return scoring.score_artifact_check(undated, videos).select(
        "claim_id", "video_id", F.concat_ws(",", "wrong_fields").alias("wrong_fields")
    )


@query(
    "row_contract_check",
    """SELECT claim_id, concat_ws(',', CASE WHEN trigger_status NOT IN ('not_applicable', 'triggered') THEN 'trigger_status_unknown' END,
      CASE WHEN evidence_summary = '' THEN 'evidence_summary_empty' END,
      CASE WHEN scoring_confidence > 0.9 THEN 'scoring_confidence_range' END) AS violations FROM
      (SELECT claim_id, evidence_summary, CASE WHEN trigger_status IN ('unclear', 'not_triggered') THEN trigger_status || '?' ELSE trigger_status END AS trigger_status,
        scoring_confidence FROM {judged})""",
)
def row_contract_check_query(spark, sf):
    # shift confidences above .9 out of range and spoil two trigger states, to have something to find
    status = F.col("trigger_status")
    rows = view(spark, sf, "judged").select(
        "claim_id", "result", "score", "counts_in_final_score", "data_sufficiency", "evidence_summary", "reasoning", "evaluation_window",
        F.when(status.isin("unclear", "not_triggered"), F.concat(status, F.lit("?"))).otherwise(status).alias("trigger_status"),
        (F.col("scoring_confidence") + F.when(F.col("scoring_confidence") > 0.9, 1).otherwise(0)).alias("scoring_confidence"),
    ).withColumn("claim_id", F.col("claim_id").cast("string"))
    return scoring.score_row_contract(rows).select(
        F.col("claim_id").cast("bigint").alias("claim_id"), F.concat_ws(",", "violations").alias("violations")
    )


@query(
    "claim_row_contract",
    """SELECT claim_id, concat_ws(',', CASE WHEN claim_id % 10 = 3 THEN 'source_line_start_below_one' END,
      CASE WHEN normalized_horizon_hours = 48 THEN 'normalized_horizon_unknown' END,
      CASE WHEN direction = 'conditional' THEN 'review_flags_repeated' END, CASE WHEN direction = 'neutral' THEN 'review_flags_unknown' END) AS violations FROM {claims}""",
)
def claim_row_contract_query(spark, sf):
    flag = F.lit("ai_semantic_interpretation")
    rows = view(spark, sf, "claims").select(
        "claim_id", "claim_type", "direction", "scoreability",
        F.lit("text").alias("claim_text"), F.lit("excerpt").alias("source_excerpt"),
        F.when(F.col("claim_id") % 10 == 3, 0).otherwise(1).alias("source_line_start"), F.lit(1).alias("source_line_end"),
        F.when(F.col("normalized_horizon_hours") == 48, 36).otherwise(F.col("normalized_horizon_hours")).alias("normalized_horizon_hours"),
        F.lit(0.5).alias("extraction_confidence"),
        F.when(F.col("direction") == "conditional", F.array(flag, flag)).when(F.col("direction") == "neutral", F.array(F.lit("other"))).otherwise(F.array(flag)).alias("review_flags"),
    )
    return scoring.claim_row_contract(rows).select("claim_id", F.concat_ws(",", "violations").alias("violations"))


# --- aggregates ---------------------------------------------------------------------------


@query(
    "score_aggregate",
    f"""WITH g AS (SELECT audit_id, category, CAST(grouping(category) AS INTEGER) AS is_total, {_SUMS}
      FROM {{score_rows}} GROUP BY GROUPING SETS ((audit_id), (audit_id, category)))
    SELECT audit_id, category, is_total, total_claims, counted_claims, {_RESULT_NAMES}, {round_half_even_sql('raw', 2)} AS final_score FROM g""",
)
def score_aggregate_query(spark, sf):
    return metrics.score_aggregate(view(spark, sf, "score_rows"), ["audit_id"])


@query("result_distribution", "SELECT category, result, count(*) AS n FROM {score_rows} GROUP BY ALL")
def result_distribution_query(spark, sf):
    return metrics.result_distribution(view(spark, sf, "score_rows"), ["category"])


_SHARES = {
    "score_bearing_percent": ("counted_claims", "total_claims"),
    "evidence_coverage_percent": ("data_supported_claims", "total_claims"),
    "resolution_percent": ("counted_claims + not_triggered", "total_claims"),
    "activation_percent": ("counted_claims", "(counted_claims + not_triggered)"),
    "at_least_partial_percent": ("correct + partially_correct", "counted_claims"),
    "correct_percent": ("correct", "counted_claims"),
    "partial_percent": ("partially_correct", "counted_claims"),
    "incorrect_percent": ("incorrect", "counted_claims"),
}
PRESENTATION_CTE = f"""
totals AS (SELECT audit_id, category, {_SUMS} FROM {{score_rows}} GROUP BY 1, 2),
shares AS (
  SELECT *, {', '.join(f"{percent_sql('(' + a + ')', b)} AS raw_{n}" for n, (a, b) in _SHARES.items())}
  FROM (SELECT *, greatest(total_claims - insufficient_data - not_scoreable, 0) AS data_supported_claims FROM totals)),
shown AS (
  SELECT audit_id, category, total_claims, counted_claims, {_RESULT_NAMES}, {round_half_even_sql('raw', 2)} AS final_score,
    greatest(total_claims - counted_claims, 0) AS not_counted_claims, data_supported_claims,
    counted_claims + not_triggered AS resolved_claims, correct + partially_correct AS at_least_partial_count,
    CAST(correct AS DOUBLE) + CAST(partially_correct AS DOUBLE) / 2 AS weighted_points,
    {', '.join(f"{round_half_even_sql('raw_' + n, 1)} AS {n}" for n in _SHARES)}
  FROM shares)"""


def presentation(spark, sf, keys):
    return metrics.score_presentation(metrics.score_totals(view(spark, sf, "score_rows"), keys))


@query("score_presentation", f"WITH {PRESENTATION_CTE} SELECT * FROM shown")
def score_presentation_query(spark, sf):
    return presentation(spark, sf, ["audit_id", "category"])


@query(
    "conclusion_ladder",
    f"""WITH {PRESENTATION_CTE} SELECT audit_id, category, final_score,
      CASE WHEN final_score IS NULL OR counted_claims < 30 THEN 'Not enough activated calls' WHEN evidence_coverage_percent < 50 THEN 'Provisional mixed record'
        WHEN final_score >= 75 THEN 'Strong measured record' WHEN final_score >= 55 THEN 'Useful daily analysis'
        WHEN final_score >= 45 THEN 'A useful daily framework' ELSE 'Useful context, with caution' END AS conclusion,
      CASE WHEN final_score IS NULL OR counted_claims < 30 OR evidence_coverage_percent < 50 THEN 'limited' WHEN final_score >= 55 THEN 'positive' ELSE 'mixed' END AS conclusion_tone
      FROM shown""",
)
def conclusion_ladder_query(spark, sf):
    return metrics.conclusion_ladder(presentation(spark, sf, ["audit_id", "category"])).select(
        "audit_id", "category", "final_score", "conclusion", "conclusion_tone"
    )


_PROFILE = {
    "conditional_claim_percent": ("conditional_claims", "total_claims"),
    "explicit_condition_percent": ("explicit_condition_claims", "total_claims"),
    "level_claim_percent": ("level_claims", "total_claims"),
    "multi_level_claim_percent": ("multi_level_claims", "total_claims"),
    "invalidation_claim_percent": ("invalidation_claims", "total_claims"),
    "scenario_claim_percent": ("scenario_claims", "total_claims"),
    "both_directions_video_percent": ("both_directions_videos", "total_videos"),
    "invalidation_video_percent": ("invalidation_videos", "total_videos"),
    "ten_plus_claim_video_percent": ("ten_plus_claim_videos", "total_videos"),
}
PROFILE_CTE = f"""
per_video AS (
  SELECT video_id % 20 AS audit_id, video_id, count(*) AS n, count(*) FILTER (WHERE scoreability = 'conditional_scoreable') AS cond,
    count(*) FILTER (WHERE trim(condition) <> '') AS expl, count(*) FILTER (WHERE level_1 IS NOT NULL AND level_2 IS NOT NULL) AS lev,
    count(invalidation_condition) AS inval, count(*) FILTER (WHERE claim_type = 'scenario') AS scen,
    count(*) FILTER (WHERE direction = 'bullish') > 0 AND count(*) FILTER (WHERE direction = 'bearish') > 0 AS both_ways
  FROM {{claims}} GROUP BY ALL),
counts AS (
  SELECT audit_id, CAST(sum(n) AS BIGINT) AS total_claims, count(*) AS total_videos, CAST(sum(cond) AS BIGINT) AS conditional_claims, CAST(sum(expl) AS BIGINT) AS explicit_condition_claims,
    CAST(sum(lev) AS BIGINT) AS level_claims, CAST(sum(lev) AS BIGINT) AS multi_level_claims, CAST(sum(inval) AS BIGINT) AS invalidation_claims, CAST(sum(scen) AS BIGINT) AS scenario_claims,
    count(*) FILTER (WHERE both_ways) AS both_directions_videos, count(*) FILTER (WHERE inval > 0) AS invalidation_videos,
    count(*) FILTER (WHERE n >= 10) AS ten_plus_claim_videos FROM per_video GROUP BY 1),
raw_profile AS (
  SELECT *, CAST(total_claims AS DOUBLE) / CAST(total_videos AS DOUBLE) AS raw_average,
    {', '.join(f"{percent_sql(a, b)} AS raw_{n}" for n, (a, b) in _PROFILE.items())} FROM counts),
scenario AS (
  SELECT audit_id, total_claims, total_videos, conditional_claims, explicit_condition_claims, level_claims, multi_level_claims, invalidation_claims,
    scenario_claims, both_directions_videos, invalidation_videos, ten_plus_claim_videos, {round_half_even_sql('raw_average', 1)} AS average_claims_per_video,
    {', '.join(f"{round_half_even_sql('raw_' + n, 1)} AS {n}" for n in _PROFILE)} FROM raw_profile)"""


@query("scenario_profile", f"WITH {PROFILE_CTE} SELECT * FROM scenario")
def scenario_profile_query(spark, sf):
    return metrics.scenario_profile(audited_claims(spark, sf), ["audit_id"])


_AUDIT_PRESENTATION = PRESENTATION_CTE.replace("audit_id, category, count(*)", "audit_id, count(*)").replace(
    "GROUP BY 1, 2", "GROUP BY 1"
).replace("SELECT audit_id, category, total_claims", "SELECT audit_id, total_claims")


@query(
    "hero_verdict",
    f"""WITH {_AUDIT_PRESENTATION}, {PROFILE_CTE},
    judged_audits AS (
      SELECT s.audit_id, s.final_score, s.counted_claims, p.total_videos, CASE WHEN p.total_videos IS NULL THEN NULL
        WHEN s.final_score IS NULL OR s.counted_claims < 30 OR p.total_videos < 10 OR s.evidence_coverage_percent < 50 THEN 'insufficient'
        WHEN s.final_score >= 45 AND s.at_least_partial_percent >= 60 AND p.explicit_condition_percent >= 50 AND p.level_claim_percent >= 50 THEN 'supports_following'
        WHEN s.final_score < 30 AND s.at_least_partial_percent < 40 THEN 'caution' ELSE 'mixed' END AS verdict,
        {percent_sql('s.incorrect', 's.counted_claims')} AS raw_missed
      FROM shown s LEFT JOIN scenario p ON p.audit_id = s.audit_id)
    SELECT audit_id, final_score, counted_claims, total_videos, verdict, CASE verdict WHEN 'insufficient' THEN 'limited' WHEN 'supports_following' THEN 'qualified_positive' ELSE verdict END AS tone,
      {round_half_even_sql('raw_missed', 1)} AS missed_percent FROM judged_audits""",
)
def hero_verdict_query(spark, sf):
    profile = metrics.scenario_profile(audited_claims(spark, sf), ["audit_id"]).drop("total_claims")
    audits = presentation(spark, sf, ["audit_id"]).join(profile, "audit_id", "left")
    return metrics.hero_verdict(audits).select(
        "audit_id", "final_score", "counted_claims", "total_videos", "verdict", "tone", "missed_percent"
    )


@query(
    "extraction_summary",
    """SELECT category, count(*) AS total_claims, count(*) FILTER (WHERE scoreability = 'scoreable') AS scoreable_claims,
      count(*) FILTER (WHERE scoreability = 'conditional_scoreable') AS conditional_claims,
      count(*) FILTER (WHERE scoreability = 'not_scoreable') AS not_scoreable_claims,
      count(*) FILTER (WHERE claim_type <> 'level') AS human_review_required_claims FROM {claims} GROUP BY category""",
)
def extraction_summary_query(spark, sf):
    claims = view(spark, sf, "claims").withColumn("human_review_required", F.col("claim_type") != "level")
    return metrics.extraction_summary(claims, ["category"])


@query(
    "usage_totals",
    """SELECT audit_id, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
      count(*) FILTER (WHERE response_id <> '') AS api_artifacts FROM {usage} GROUP BY audit_id""",
)
def usage_totals_query(spark, sf):
    return metrics.usage_totals(view(spark, sf, "usage"), ["audit_id"])


@query(
    "usage_cost",
    """SELECT audit_id, count(*) AS artifacts, CASE WHEN count(*) = count(cost) THEN CAST(sum(cost) AS DOUBLE) END AS estimated_cost_usd FROM (
      SELECT audit_id, CAST((t - c) * input_rate + c * coalesce(cached_rate, input_rate) + output_tokens * output_rate AS DECIMAL(28, 2)) * CAST(0.000001 AS DECIMAL(7, 6)) AS cost
      FROM (SELECT *, CAST(coalesce(input_tokens, 0) AS DECIMAL(12, 0)) AS t, CAST(least(cached_input_tokens, coalesce(input_tokens, 0)) AS DECIMAL(12, 0)) AS c FROM {usage}))
      GROUP BY audit_id""",
)
def usage_cost_query(spark, sf):
    return metrics.usage_cost_totals(view(spark, sf, "usage"), ["audit_id"])


@query(
    "run_status",
    """WITH want AS (SELECT DISTINCT o_custkey % 50 AS audit_id, o_orderkey AS video_id FROM {orders}),
      have AS (SELECT DISTINCT o.o_custkey % 50 AS audit_id, l.l_orderkey AS video_id FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey)
      SELECT coalesce(w.audit_id, h.audit_id) AS audit_id, count(w.video_id) AS eligible, count(h.video_id) AS completed,
        CASE WHEN bool_and(w.video_id IS NOT NULL AND h.video_id IS NOT NULL) THEN 'complete' ELSE 'partial' END AS status
      FROM want w FULL JOIN have h ON h.audit_id = w.audit_id AND h.video_id = w.video_id GROUP BY 1""",
)
def run_status_query(spark, sf):
    eligible = view(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("audit_id"), F.col("o_orderkey").alias("video_id"))
    done = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video_id")).distinct()
    return metrics.run_status(eligible, eligible.join(done, "video_id"), ["audit_id"], "video_id")


@query(
    "provider_rollup",
    """WITH s AS (SELECT series_key, provider, status, (SELECT count(*) FROM {bars} b WHERE b.series_key = s.series_key) AS n FROM {series} s)
      SELECT p.name, count(s.series_key) AS series_count, count(*) FILTER (WHERE s.status = 'available') AS available_series,
        CAST(coalesce(sum(s.n), 0) AS BIGINT) AS row_count, CAST(coalesce(sum(CASE WHEN s.n > 0 THEN 30 END), 0) AS BIGINT) AS raw_file_count,
        CAST(coalesce(sum(CASE WHEN s.n > 0 THEN 29 END), 0) AS BIGINT) AS upstream_checksums_verified
      FROM (VALUES ('Binance public market data'), ('Operator-provided CSV'), ('Yahoo')) AS p(name) LEFT JOIN s ON s.provider = p.name GROUP BY p.name""",
)
def provider_rollup_query(spark, sf):
    counts = view(spark, sf, "bars").groupBy("series_key").agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(30).alias("raw_file_count"), F.lit(29).alias("upstream_checksums_verified")
    )
    names = spark.createDataFrame([(fv.CONTINUOUS_PROVIDER,), (fv.CSV_PROVIDER,), ("Yahoo",)], "name string")
    dim = view(spark, sf, "series").select("series_key", "provider", "status").join(counts, "series_key", "left")
    return metrics.provider_rollup(names, dim)


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys_query(spark, sf):
    return scoring.repeated_keys(view(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- top-k, ordering, paging -------------------------------------------------------------------

_HIGHLIGHT = f"""
vids AS (
  SELECT audit_id, video_id, count(*) AS counted, sum(score) / CAST(count(*) AS DOUBLE) * CAST(100 AS DOUBLE) AS raw, max(upload_date) AS upload_date,
    {', '.join(f"count(*) FILTER (WHERE result = '{r}') AS {r}" for r in fv.COUNTED_RESULTS)}
  FROM {{score_rows}} WHERE counts_in_final_score GROUP BY 1, 2 HAVING count(*) >= 3),
scored AS (SELECT *, {round_half_even_sql('raw', 1)} AS video_score FROM vids)"""


@query(
    "top_strongest_weakest",
    f"""WITH {_HIGHLIGHT},
    best AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY video_score DESC, counted DESC, upload_date, video_id) AS rank, 'strongest' AS kind FROM scored),
    worst AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY video_score, counted DESC, upload_date, video_id) AS rank, 'weakest' AS kind FROM scored)
    SELECT audit_id, video_id, kind, CAST(rank AS INTEGER) AS rank, video_score, counted, upload_date, correct, partially_correct, incorrect
    FROM (SELECT * FROM best UNION ALL SELECT * FROM worst) WHERE rank <= 4""",
)
def top_strongest_weakest_query(spark, sf):
    return metrics.top_strongest_weakest(view(spark, sf, "score_rows"), ["audit_id"]).select(
        "audit_id", "video_id", "kind", "rank", "video_score", "counted", "upload_date", *fv.COUNTED_RESULTS
    )


@query(
    "diverse_examples",
    """SELECT result, claim_id, category, scoring_confidence, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY result ORDER BY scoring_confidence DESC, claim_id) AS rank
      FROM {judged} WHERE counts_in_final_score AND result IN ('correct', 'partially_correct', 'incorrect')) WHERE rank <= 2""",
)
def diverse_examples_query(spark, sf):
    return metrics.diverse_examples(view(spark, sf, "judged"), []).select(
        "result", "claim_id", "category", "scoring_confidence", "rank"
    )


@query(
    "examples_join",
    """SELECT s.claim_id, s.result, s.scoring_confidence, c.claim_type, v.n AS video_claims FROM (
      SELECT *, row_number() OVER (PARTITION BY result ORDER BY scoring_confidence DESC, claim_id) AS rank
      FROM {judged} WHERE counts_in_final_score AND result IN ('correct', 'partially_correct', 'incorrect')) s
      LEFT JOIN {claims} c ON c.claim_id = s.claim_id
      LEFT JOIN (SELECT video_id, count(*) AS n FROM {claims} GROUP BY 1) v ON v.video_id = s.video_id WHERE s.rank <= 2""",
)
def examples_join_query(spark, sf):
    claims = view(spark, sf, "claims")
    videos = claims.groupBy("video_id").agg(F.count(F.lit(1)).alias("video_claims"))
    examples = metrics.diverse_examples(view(spark, sf, "judged"), [])
    return (
        examples.join(claims.select("claim_id", "claim_type"), "claim_id", "left")
        .join(videos, "video_id", "left")
        .select("claim_id", "result", "scoring_confidence", "claim_type", "video_claims")
    )


def ledger(spark, sf):
    """Claims with scores and outcome status."""
    claims = view(spark, sf, "claims").select(
        "claim_id", "category", F.col("published_at").alias("upload_date"), "direction", "video_id"
    )
    scores = view(spark, sf, "judged").select("claim_id", "result", "score", "counts_in_final_score")
    status = resolve.precision_gate(view(spark, sf, "claims")).select("claim_id", "precise")
    return metrics.ledger_join(claims, scores, status)


@query(
    "ledger_join",
    """SELECT c.claim_id, c.category, c.published_at AS upload_date, c.direction, c.video_id, s.result, s.score, s.counts_in_final_score,
      c.published_at_source <> 'date_noon_fallback' AS precise FROM {claims} c LEFT JOIN {judged} s ON s.claim_id = c.claim_id""",
)
def ledger_join_query(spark, sf):
    return ledger(spark, sf)


@query(
    "ledger_page",
    """WITH rows AS (SELECT c.claim_id, c.published_at AS upload_date, c.category, s.result, s.score FROM {claims} c LEFT JOIN {judged} s ON s.claim_id = c.claim_id
      WHERE c.category = 'crypto' AND NOT coalesce(s.counts_in_final_score, FALSE))
      SELECT *, (SELECT count(*) FROM rows) AS total FROM (SELECT * FROM rows WHERE upload_date > TIMESTAMP '2024-01-03 12:00:00'
        OR (upload_date = TIMESTAMP '2024-01-03 12:00:00' AND claim_id > 50) ORDER BY upload_date, claim_id LIMIT 100)""",
)
def ledger_page_query(spark, sf):
    rows = metrics.ledger_filter(ledger(spark, sf), category="crypto", counted=False).select(
        "claim_id", "upload_date", "category", "result", "score"
    )
    return metrics.ledger_page(rows, limit=100, after=(datetime(2024, 1, 3, 12), 50))


# --- set operations and key comparison -----------------------------------------------------------


@query(
    "anti_missing_extra",
    """SELECT claim_id, 'missing' AS side FROM {claims} WHERE claim_id NOT IN (SELECT claim_id FROM {judged})
      UNION ALL SELECT claim_id, 'unexpected' FROM {judged} WHERE claim_id NOT IN (SELECT claim_id FROM {claims})""",
)
def anti_missing_extra_query(spark, sf):
    claims, judged = view(spark, sf, "claims").select("claim_id"), view(spark, sf, "judged").select("claim_id")
    missing = claims.join(judged, "claim_id", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(judged.join(claims, "claim_id", "left_anti").withColumn("side", F.lit("unexpected")))


@query(
    "set_union_all",
    "SELECT user_id AS id, 'events' AS origin FROM {events} UNION ALL SELECT o_custkey, 'orders' FROM {orders}",
)
def set_union_all_query(spark, sf):
    events = view(spark, sf, "events").select(F.col("user_id").alias("id"), F.lit("events").alias("origin"))
    return events.unionByName(view(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("orders").alias("origin")))


@query("set_except", "SELECT c_custkey * 2 AS id FROM {customer} EXCEPT ALL SELECT o_custkey FROM {orders}")
def set_except_query(spark, sf):
    buyers = view(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return view(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id")).exceptAll(buyers)


@query("set_intersect", "SELECT user_id AS id FROM {events} INTERSECT SELECT o_custkey FROM {orders}")
def set_intersect_query(spark, sf):
    buyers = view(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return view(spark, sf, "events").select(F.col("user_id").alias("id")).intersect(buyers)


@query("set_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}")
def set_distinct_query(spark, sf):
    return view(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    "filter_scope",
    "SELECT claim_id, category FROM {claims} WHERE category IN ('crypto', 'global_markets')",
)
def filter_scope_query(spark, sf):
    scope = ["crypto", "global_markets"]
    return view(spark, sf, "claims").filter(F.col("category").isin(scope)).select("claim_id", "category")


@query(
    "join_claim_video",
    """SELECT c.claim_id, v.video_id, v.published_at, v.published_at_source FROM (SELECT event_id AS claim_id, user_id AS video_id FROM {events}) c
      JOIN (SELECT o_custkey AS video_id, min(o_orderdate)::TIMESTAMP + INTERVAL 9 HOUR AS published_at, min(o_orderpriority) AS published_at_source FROM {orders} GROUP BY 1) v
        ON v.video_id = c.video_id""",
)
def join_claim_video_query(spark, sf):
    videos = view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(
        (F.min("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 9 HOUR")).alias("published_at"),
        F.min("o_orderpriority").alias("published_at_source"),
    )
    claims = view(spark, sf, "events").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("video_id"))
    return resolve.join_claim_video(claims, videos)
