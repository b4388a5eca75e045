"""Exclusions, contracts, roll-ups, verdicts and top-k."""

import random

import pytest
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.operators import metrics, scoring

SCORES = "audit_id int, video_id string, upload_date string, category string, claim_id string, result string, score double, counts_in_final_score boolean, scoring_confidence double"


def test_demo_collection_scores_75(spark):
    rows = [
        (1, "a", "2024-01-02", "crypto", "a-1", "correct", 1.0, True, 1.0), (1, "a", "2024-01-02", "crypto", "a-2", "not_triggered", 0.0, False, 1.0),
        (1, "b", "2024-01-03", "global_markets", "b-1", "partially_correct", 0.5, True, 1.0),
    ]
    out = {r.category: r for r in metrics.score_aggregate(spark.createDataFrame(rows, SCORES), ["audit_id"]).collect()}
    assert (out[None].final_score, out[None].total_claims, out[None].counted_claims, out[None].is_total) == (75.0, 3, 2, 1)
    assert out["crypto"].final_score == 100.0 and out["global_markets"].final_score == 50.0 and out["crypto"].not_triggered == 1


def test_no_counted_claim_has_no_score(spark):
    rows = [(1, "a", "d", "crypto", "x", "insufficient_data", 0.0, False, 1.0)]
    row = metrics.score_presentation(metrics.score_totals(spark.createDataFrame(rows, SCORES), ["audit_id"])).first()
    assert row.final_score is None and row.at_least_partial_percent == 0.0 and row.evidence_coverage_percent == 0.0


BASE = {"final_score": 48.41, "counted_claims": 347, "evidence_coverage_percent": 66.1, "at_least_partial_percent": 70.0, "incorrect": 104,
        "total_videos": 72, "explicit_condition_percent": 81.7, "level_claim_percent": 94.6}


@pytest.mark.parametrize(
    "change, verdict",
    [
        ({}, "supports_following"), ({"final_score": 44.9, "at_least_partial_percent": 59.9}, "mixed"), ({"final_score": 29.9, "at_least_partial_percent": 39.9}, "caution"),
        ({"counted_claims": 29}, "insufficient"), ({"evidence_coverage_percent": 49.9}, "insufficient"), ({"total_videos": 9}, "insufficient"),
        ({"explicit_condition_percent": 49.9}, "mixed"), ({"final_score": None}, "insufficient"), ({"total_videos": None}, None),
    ],
)
def test_verdicts(spark, change, verdict):
    row = {**BASE, **change}
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in BASE.items())
    got = metrics.hero_verdict(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert got.verdict == verdict
    if not change:
        assert got.missed_percent == 30.0 and got.tone == "qualified_positive"


def greedy(rows, limit):
    used, chosen = set(), []
    for row in sorted(rows, key=lambda r: (-r[2], r[0])):
        if row[1] not in used or len(chosen) + len(used) >= limit:
            chosen.append(row[0])
            used.add(row[1])
        if len(chosen) == limit:
            break
    return chosen


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 8])
def test_diverse_examples_follow_the_greedy_rule(spark, limit):
    rng = random.Random(limit)
    rows, want = [], {}
    for audit in range(25):
        group = [(f"c{i:02d}", rng.choice("abcdef"[: rng.randint(1, 6)]), rng.randint(0, 4) / 4) for i in range(rng.randint(1, 14))]
        want[audit] = greedy(group, limit)
        rows += [(audit, "v", "d", c, i, "correct", 1.0, True, p) for i, c, p in group]
    got = metrics.diverse_examples(spark.createDataFrame(rows, SCORES), ["audit_id"], limit).collect()
    for audit, ids in want.items():
        assert [r.claim_id for r in sorted((r for r in got if r.audit_id == audit), key=lambda r: r["rank"])] == ids


def test_cost(spark):
    schema = "k int, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, input_rate decimal(10,4), cached_rate decimal(10,4), output_rate decimal(10,4)"
    from decimal import Decimal as D

    rows = [(1, 1000000, 250000, 100000, D(2), D("0.5"), D(8)), (2, 100, 500, 10, D(2), None, D(8)), (2, 100, 0, 10, None, None, D(8)), (3, None, None, None, D(2), None, D(8))]
    out = {r.k: r.estimated_cost_usd for r in metrics.usage_cost_totals(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert out == {1: 2.425, 2: None, 3: 0.0}
    assert spark.createDataFrame([], "v int").agg(metrics.poisoned_sum(F.col("v"))).first()[0] == 0


def test_paging_bounds(spark):
    rows = spark.createDataFrame([(i, f"{i:03d}") for i in range(30)], "claim_id int, upload_date string")
    page = metrics.ledger_page(rows, limit=5, offset=27).collect()
    assert [(r.claim_id, r.total) for r in page] == [(27, 30), (28, 30), (29, 30)]
    for bad in ({"limit": 0}, {"limit": 2001}, {"offset": -1}):
        with pytest.raises(ValueError):
            metrics.ledger_page(rows, **bad)


CLAIM = "claim_id int, video_id string, scoreability string, required_window string, supported boolean, n_assets bigint, only_non_price boolean, only_unsupported boolean, any_available boolean, not_scoreable_reason string, has_outcome boolean"


@pytest.mark.parametrize(
    "claim, want",
    [
        (("not_scoreable", None, False, None, None, None, None, "vague"), ("not_scoreable", "not_scoreable", "sufficient", "not_applicable", None)),
        (("scoreable", None, True, 1, False, False, True, None), ("unsupported_horizon", "not_scoreable", "sufficient", "not_applicable", None)),
        (("scoreable", "24h", True, 1, False, False, True, None), None),
        (("conditional_scoreable", "24h", False, 1, True, False, False, None), ("non_price", "not_scoreable", "sufficient", "not_applicable", None)),
        (("conditional_scoreable", "48h", False, 2, False, True, False, None), ("unsupported_asset", "insufficient_data", "unsupported_asset", "unclear", "48h")),
        (("scoreable", "24h", False, 2, False, False, True, None), ("partial", "insufficient_data", "partial", "not_applicable", "24h")),
        (("scoreable", "24h", False, 2, False, False, False, None), ("no_series", "insufficient_data", "insufficient", "not_applicable", "24h")),
        (("scoreable", "24h", False, None, None, None, None, None), ("no_asset", "insufficient_data", "insufficient", "not_applicable", "24h")),
    ],
)
def test_exclusions(spark, claim, want):
    row = scoring.deterministic_exclusion(spark.createDataFrame([(1, "v", *claim, True)], CLAIM)).first()
    assert (row and (row.rule, row.result, row.data_sufficiency, row.trigger_status, row.evaluation_window)) == want
    if want and want[0] == "not_scoreable":
        assert row.reasoning == "vague"
    if want and want[0] == "partial":
        assert "required 24h outcome window" in row.evidence_summary


SCORE = "claim_id int, video_id string, result string, score double, counts_in_final_score boolean, trigger_status string, data_sufficiency string, evaluation_window string"


@pytest.mark.parametrize(
    "state, window, supported, score, want",
    [
        ("scoreable", "24h", True, ("correct", 1.0, True, "not_applicable", "sufficient", "24h"), []),
        ("scoreable", "24h", True, ("correct", 0.5, True, "triggered", "partial", "48h"), ["R05_direct_trigger", "R06_counted_score", "R07_counted_sufficiency", "R08_counted_window"]),
        ("conditional_scoreable", None, False, ("incorrect", 0.0, True, "unclear", "sufficient", None), ["R08_counted_window", "R09_counted_unsupported", "R10_counted_trigger"]),
        ("not_scoreable", "24h", True, ("insufficient_data", 0.5, False, "not_applicable", "sufficient", None), ["R04_not_scoreable_claim", "R11_uncounted_score", "R17_insufficient_sufficiency"]),
        ("scoreable", "24h", False, ("not_triggered", 0.0, False, "not_applicable", "partial", "48h"), ["R12_idle_trigger", "R13_idle_unconditional", "R14_idle_sufficiency", "R15_idle_window", "R16_idle_unsupported"]),
        ("not_scoreable", "24h", True, ("not_scoreable", 0.0, False, "not_applicable", "sufficient", "24h"), ["R18_not_scoreable_window"]),
    ],
)
def test_score_contract(spark, state, window, supported, score, want):
    claims = spark.createDataFrame([(1, "v", state, window, supported, 1, False, False, True, None, True)], CLAIM)
    scores = spark.createDataFrame([(1, "v", *score)], SCORE)
    assert scoring.score_contract_check(scores, claims).first().violations == want


def test_contract_covers_every_claim_once(spark):
    claims = spark.createDataFrame([(i, "v", "scoreable", "24h", True, 1, False, False, True, None, i != 3) for i in (1, 2, 3)], CLAIM)
    good = ("correct", 1.0, True, "not_applicable", "sufficient", "24h")
    scores = spark.createDataFrame([(1, "v", *good), (1, "v", *good), (3, "w", *good), (9, "v", *good)], SCORE)
    got = sorted((r.claim_id, tuple(r.violations)) for r in scoring.score_contract_check(scores, claims).collect())
    assert got == [
        (1, ("R02_repeated_score",)), (1, ("R02_repeated_score",)), (2, ("R02_missing_score",)),
        (3, ("R01_video_mismatch", "R03_no_outcome")), (9, ("R02_unexpected_score",)),
    ]


def test_closed_schema(spark):
    rows = spark.createDataFrame([('{"a":1,"z":2,"b":3}',), ('{"a":1}',)], "p string")
    assert [r.unknown_fields for r in scoring.unknown_fields(rows, "p", ["a"]).collect()] == [["b", "z"], []]
    assert set(fv.COUNTED_RESULTS) <= set(fv.RESULTS)
