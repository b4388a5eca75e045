"""Fingerprints, chains, caches and inventories."""

import random

import pytest
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions.hashing import row_fingerprint
from hindcast.operators import integrity


def prints(rows, **kw):
    return integrity.set_fingerprint(rows.select(row_fingerprint(["id", "v"]).alias("h")), "h", [], **kw).first().fingerprint


def test_set_fingerprint_ignores_order_and_partitions_but_not_content(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    base = prints(rows)
    assert base == prints(rows.repartition(13).orderBy(F.desc("v")))
    assert base != prints(rows.filter("id <> 4321")) and base != prints(rows.unionByName(rows.filter("id = 1")))
    assert base != prints(rows.withColumn("v", F.when(F.col("id") == 9, 99).otherwise(F.col("v"))))


def test_copies_do_not_gather_in_one_list(spark):
    rows = spark.range(200000).select(F.lit(1).cast("bigint").alias("id"), F.lit(2).alias("v"))
    assert integrity.set_fingerprint(rows.select(row_fingerprint(["id", "v"]).alias("h")), "h", []).first()["rows"] == 200000


def test_row_fingerprint_keeps_nulls_and_ignores_column_order(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    first = df.select(row_fingerprint(["a", "b"])).first()[0]
    assert first == df.select("b", "a").select(row_fingerprint(["b", "a"])).first()[0] != df.select(row_fingerprint(["a"])).first()[0]


CORE = ["action", "ledger_id", "position", "previous_event_sha256"]
EVENT = "ledger_id string, position int, sequence int, action string, previous_event_sha256 string, event_sha256 string"


def chain(spark, n=4):
    """A ledger whose hashes cover the predecessor, event by event."""
    events, before = [], None
    for i in range(1, n + 1):
        core = spark.createDataFrame([("l", i, "accepted", before)], "ledger_id string, position int, action string, previous_event_sha256 string")
        now = core.select(row_fingerprint(CORE)).first()[0]
        events.append(["l", i, i, "accepted", before, now])
        before = now
    return events, before


@pytest.fixture(scope="module")
def sound(spark):
    return chain(spark)


@pytest.mark.parametrize(
    "tamper, head, version, reason",
    [
        (None, None, "1", None), (("action", 1, "revoked"), None, "1", "event_hash_mismatch"), (("sequence", 2, 9), None, "1", "invalid_sequence"),
        (("previous", 2, "0"), None, "1", "broken_hash_chain"), (None, "0", "1", "head_hash_mismatch"), (None, None, "2", "unsupported_schema"), ("empty", None, "1", "empty_ledger"),
    ],
)
def test_chain(spark, sound, tamper, head, version, reason):
    events, last = [list(e) for e in sound[0]], sound[1]
    if isinstance(tamper, tuple):
        events[tamper[1]][{"sequence": 2, "action": 3, "previous": 4}[tamper[0]]] = tamper[2]
    rows = spark.createDataFrame([tuple(e) for e in events] if tamper != "empty" else [], EVENT)
    ledgers = spark.createDataFrame([("l", version, head or last)], "ledger_id string, schema_version string, head_event_sha256 string")
    got = integrity.hash_chain_verify(ledgers, rows, CORE, "1").first()
    assert got.reason == reason and got.valid == (reason is None)


def test_cache_needs_the_whole_contract(spark):
    work = spark.createDataFrame([("k1", "m1", "t1"), ("k2", "m1", "t2"), ("k3", "m1", "t3")], "cache_key string, model string, sha string")
    cache = spark.createDataFrame([("k1", "m1", "t1", "old", 5), ("k2", "m0", "t2", "old", 6)], "cache_key string, model string, sha string, collection_id string, n int")
    hits, misses = integrity.cache_lookup(work, cache, "cache_key", ["model", "sha"], "new")
    row = hits.collect()
    assert [(r.cache_key, r.collection_id, r.api_collection_id, r.n) for r in row] == [("k1", "new", "old", 5)]
    assert {r.cache_key for r in misses.collect()} == {"k2", "k3"}


def test_inventory_failures(spark):
    schema = "relative_path string, size_bytes bigint, sha256 string"
    expected = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y"), ("d", 1, "x"), ("e", 1, "x"), ("e", 1, "x"), ("../f", 1, "x")], schema)
    actual = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("e", 1, "x"), ("z", 1, "x")], schema)
    got = {r.relative_path: r.failure for r in integrity.inventory_verify(expected, actual, []).collect()}
    assert got == {"b": "size_mismatch", "c": "hash_mismatch", "d": "nonexistent", "e": "duplicate_path", "../f": "unsafe_path", "z": "untracked"}


@pytest.mark.parametrize(
    "row, status",
    [
        ((False, "complete", "complete", "public", True), "integrity_warning"), ((True, "complete", "complete", "public", True), "audit_complete"),
        ((True, "complete", "complete", "public", False), "human_review_pending"), ((True, "complete", "complete", "private", False), "private_preview"),
        ((True, "partial", "complete", "public", True), "claims_complete"), ((True, None, None, "public", True), "collection_verified"),
    ],
)
def test_audit_status(spark, row, status):
    df = spark.createDataFrame([row], "verified boolean, scores_status string, claims_status string, publication_mode string, review_accepted boolean")
    assert integrity.audit_status(df).first().status == status


def test_a_broken_cached_result_is_not_reused(spark):
    work = spark.createDataFrame([("k1", "m"), ("k2", "m"), ("k3", "m")], "cache_key string, model string")
    cache = spark.createDataFrame([("k1", "m", 1.0), ("k2", "m", 1.0), ("k2", "m", 7.0), ("k3", "old", 1.0)], "cache_key string, model string, score double")
    check = lambda rows: rows.withColumn("violations", F.array_compact(F.array(F.when(F.col("score") > 1, "score_range"))))
    hits, misses = integrity.cache_lookup(work, cache, "cache_key", ["model"], "new", check)
    assert [r.cache_key for r in hits.collect()] == ["k1"] and {r.cache_key for r in misses.collect()} == {"k2", "k3"}


LEDGER = "audit_id int, claim_id int, video_id int, scoreability string"
SCORED = "audit_id int, claim_id int, video_id int, result string, score double, counts_in_final_score boolean"


def plain_reconciliation(claims, claim_artifacts, outcomes, scores, score_artifacts):
    """Failures of the checks between ledgers, of one audit, by loops."""
    def by_key(rows):
        out = {}
        for k, r in enumerate(rows):
            out.setdefault(r[1] if r[1] is not None else ("null", id(rows), k), []).append(r)
        return out

    def by_key_once(rows):
        """Null ids of one ledger are one key of its own."""
        out = {}
        for r in rows:
            out.setdefault(r[1] if r[1] is not None else ("null", id(rows)), []).append(r)
        return out

    def differ(left, right):
        a, b = by_key_once(left), by_key_once(right)
        return sum(k not in a or k not in b or len(a[k]) > 1 or len(b[k]) > 1 or a[k][0][2:] != b[k][0][2:] for k in {*a, *b})

    def alone(left, right):
        a, b = by_key(left), by_key(right)
        return sum(len(v) for k, v in a.items() if k not in b) + sum(len(v) for k, v in b.items() if k not in a)

    pairs = [(s, c) for s in scores for c in claims if s[1] is not None and s[1] == c[1]]
    worth = {"correct": 1.0, "partially_correct": 0.5, "incorrect": 0.0}
    wrong = [s for s in scores if (s[4] is None or s[4] != worth.get(s[3]) if s[5] else s[4] is not None and s[4] != 0)]
    return {
        "claim_artifacts_equal_ledger": differ(claim_artifacts, claims), "outcomes_cover_claims": alone(outcomes, claims),
        "scores_cover_claims": alone(scores, claims), "score_artifacts_equal_ledger": differ(score_artifacts, scores),
        "score_video_binding": sum(s[2] != c[2] for s, c in pairs), "counted_score_contract": len(wrong),
    }


def test_reconciliation_of_random_ledgers(spark):
    """Missing, repeated and null keys, null videos, audits without rows, rows without an audit."""
    assert fv.COUNTED_RESULTS == {"correct": 1.0, "partially_correct": 0.5, "incorrect": 0.0}
    rng = random.Random(5)
    some = lambda rows: [r for r in rows for _ in range(rng.choice([0, 1, 1, 1, 1, 2]))]
    claim = lambda a, i: (a, i, rng.choice([1, 2, None]), rng.choice(["scoreable", "not_scoreable"]))
    score = lambda a, i: (a, i, rng.choice([1, 2, None]), rng.choice(["correct", "incorrect", "pending"]), rng.choice([0.0, 1.0, None]), rng.choice([True, False, None]))
    audits = [0, 1, 2, None]
    ids = [(a, i) for a in audits for i in [*range(30), None]]
    claims, scores = some([claim(*k) for k in ids]), some([score(*k) for k in ids])
    change = lambda r: r[:3] + ("changed", *r[4:]) if rng.random() < 0.2 else r
    ledgers = claims, [change(r) for r in some(claims)], some(claims), scores, [change(r) for r in some(scores)]
    names = "total_claims scoreable_claims conditional_scoreable_claims not_scoreable_claims total_scores counted_scores".split()
    told = []
    for a in [0, 1, 2, 7]:
        c, s = [r for r in claims if r[0] == a], [r for r in scores if r[0] == a]
        counted = [r for r in s if r[5]]
        points = [r[4] for r in counted if r[4] is not None]
        sums = [len(c), *[sum(r[3] == k for r in c) for k in ("scoreable", "conditional_scoreable", "not_scoreable")], len(s), len(counted)] if c else [None] * 6
        if a == 1:
            sums[0] += 1
        told.append((a, "x", "x", "x", "y" if a == 2 else "x", "complete", None if a == 0 else "partial", "s", "s", "s", *sums, sum(points) if points else None))
    schema = (
        "audit_id int, collection_id string, claims_collection_id string, outcomes_collection_id string, scores_collection_id string, "
        "claims_status string, scores_status string, scope string, claims_scope string, scores_scope string, "
        + ", ".join(f"recorded_{n} bigint" for n in names) + ", recorded_points double"
    )
    frames = [spark.createDataFrame(rows, LEDGER if k < 3 else SCORED) for k, rows in enumerate(ledgers)]
    out = integrity.reconcile_ledgers(
        spark.createDataFrame(told, schema), *frames, ["video_id", "scoreability"], ["video_id", "result", "score", "counts_in_final_score"]
    )
    got = {(r.audit_id, r.check): r.failures for r in out.collect()}
    assert len(got) == 4 * 11 and out.filter("ok <> (failures = 0)").count() == 0
    for a in [0, 1, 2, 7]:
        want = plain_reconciliation(*[[r for r in rows if r[0] == a] for rows in ledgers])
        assert {k: got[a, k] for k in want} == want
        assert got[a, "collection_id_equal"] == (a == 2) and got[a, "stages_complete"] == (a != 0) and got[a, "scope_equal"] == 0
        assert got[a, "extraction_counts_recomputed"] == (a == 1) and got[a, "score_aggregates_recomputed"] == 0


def test_reconciliation_of_empty_ledgers(spark):
    claims, scores = spark.createDataFrame([], LEDGER), spark.createDataFrame([], SCORED)
    schema = "audit_id int, " + ", ".join(
        f"{n} string" for n in ("collection_id claims_collection_id outcomes_collection_id scores_collection_id claims_status scores_status "
                                "scope claims_scope scores_scope").split()
    ) + ", " + ", ".join(
        f"recorded_{n} bigint" for n in ("total_claims scoreable_claims conditional_scoreable_claims not_scoreable_claims total_scores counted_scores").split()
    ) + ", recorded_points double"
    columns = ["video_id", "scoreability"], ["video_id", "result", "score", "counts_in_final_score"]
    none = integrity.reconcile_ledgers(spark.createDataFrame([], schema), claims, claims, claims, scores, scores, *columns)
    assert none.count() == 0
    one = spark.createDataFrame([(1, *["x"] * 4, "complete", "complete", *["s"] * 3, *[0] * 6, None)], schema)
    got = {r.check: r.ok for r in integrity.reconcile_ledgers(one, claims, claims, claims, scores, scores, *columns).collect()}
    # zeros were recorded where there is nothing to sum
    assert [k for k, ok in got.items() if not ok] == ["extraction_counts_recomputed", "score_aggregates_recomputed"]
