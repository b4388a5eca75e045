"""Fingerprints, inventories, hash chains, caches and reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions.hashing import row_fingerprint
from hindcast.operators.scoring import repeated_keys

# Prefix lengths of the hash tree: each step gathers at most 16**3 children.
TREE_LEVELS = (8, 5, 2)


def set_fingerprint(rows: DataFrame, row_hash: str, keys: list[str], levels: tuple[int, ...] = TREE_LEVELS) -> DataFrame:
    """One hash per key over a multiset of row hashes: (keys, fingerprint, rows).

    A hash tree over hash prefixes: equal rows collapse to a count first, then
    every level hashes a bounded number of sorted children. No key is ever
    gathered into one list, and the result does not depend on partitioning.
    """
    nodes = rows.groupBy(*keys, F.col(row_hash).alias("_node")).agg(F.count(F.lit(1)).alias("_rows"))
    nodes = nodes.withColumn("_text", F.concat_ws(":", "_node", F.col("_rows").cast("string")))
    for length in (*levels, 0):
        children = F.array_join(F.array_sort(F.collect_list("_text")), "\n")
        nodes = nodes.groupBy(*keys, F.substring("_node", 1, length).alias("_node")).agg(
            F.sha2(children, 256).alias("_hash"), F.sum("_rows").alias("_rows")
        )
        nodes = nodes.withColumn("_text", F.concat_ws(":", "_node", "_hash"))
    return nodes.select(*keys, F.col("_hash").alias("fingerprint"), F.col("_rows").alias("rows"))


def collection_id(start: str, end: str, fingerprint: Column) -> Column:
    return F.concat(F.lit(f"audit-{start}-{end}-"), F.substring(fingerprint, 1, 12))


def scoring_fingerprint(
    claims: DataFrame, outcomes: DataFrame, claim_columns: list[str], outcome_columns: list[str], **policy: str
) -> DataFrame:
    """Per video: hash of everything that decides its scores.

    Storage metadata and the collection id are simply not among the columns;
    schema, policy and model versions come in through ``policy``.
    """
    def hashed(rows: DataFrame, columns: list[str], part: str) -> DataFrame:
        return rows.select("video_id", row_fingerprint(columns, part=part, **policy).alias("_h"))

    both = hashed(claims, claim_columns, "claim").unionByName(hashed(outcomes, outcome_columns, "outcome"))
    return set_fingerprint(both, "_h", ["video_id"])


def cache_lookup(
    work: DataFrame, cache: DataFrame, key: str, contract: list[str], collection: str,
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reused rows stamped with the new collection, work still to be done).

    A cached result counts only when its key matches and every contract column
    (versions, model, hashes) equals the one of the work item. ``check`` adds ``violations`` to rows; a result of
    which any row has some is not reused.
    """
    ours = work.select(key, *[F.col(c).alias(f"_{c}") for c in contract])
    same = F.lit(True)
    for c in contract:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    hits = cache.join(ours, key).filter(same).drop(*[f"_{c}" for c in contract])
    if check is not None:
        broken = check(hits).filter(F.size("violations") > 0).select(key).distinct()
        hits = hits.join(broken, key, "left_anti")
    if "collection_id" in cache.columns:
        hits = hits.withColumn("api_collection_id", F.col("collection_id"))
    hits = hits.withColumn("collection_id", F.lit(collection))
    return hits, work.join(hits.select(key).distinct(), key, "left_anti")


def exact_artifact_semi(artifacts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts whose full binding is expected; look-alikes drop out."""
    return artifacts.join(expected.select(*keys).distinct(), keys, "left_semi")


def ledger_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that are missing, unexpected, repeated or different by row hash."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"_n_{name}"), F.min(row_fingerprint(columns)).alias(f"_h_{name}")
        )

    joined = side(left, "left").join(side(right, "right"), keys, "full_outer")
    status = (
        F.when(F.col("_n_left").isNull(), "missing_left")
        .when(F.col("_n_right").isNull(), "missing_right")
        .when((F.col("_n_left") > 1) | (F.col("_n_right") > 1), "repeated")
        .when(F.col("_h_left") != F.col("_h_right"), "different")
    )
    return joined.select(*keys, status.alias("difference")).filter("difference IS NOT NULL")


def inventory_verify(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Every path that fails, with its first reason; no rows = verified.

    Both sides carry keys, relative_path, size_bytes and sha256.
    """
    path = [*keys, "relative_path"]
    repeated = repeated_keys(expected, path).select(*path, F.lit(True).alias("_repeated"))
    ours = expected.select(*path, F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_expected"))
    found = actual.select(*path, "size_bytes", "sha256", F.lit(True).alias("_found"))
    joined = ours.join(found, path, "full_outer").join(repeated, path, "left")
    unsafe = F.col("relative_path").rlike(r"^/|^[A-Za-z]:[\\/]|(^|/)\.\.(/|$)")
    status = (
        F.when(F.col("_expected").isNull(), "untracked")
        .when(unsafe, "unsafe_path")
        .when(F.col("_repeated"), "duplicate_path")
        .when(F.col("_found").isNull(), "nonexistent")
        .when(~F.col("_size").eqNullSafe(F.col("size_bytes")), "size_mismatch")
        .when(~F.col("_sha").eqNullSafe(F.col("sha256")), "hash_mismatch")
    )
    return joined.select(*path, status.alias("failure")).filter("failure IS NOT NULL").distinct()


def inventory_summary(expected: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    totals = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("file_hash_count"))
    bad = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_file_hash_count"))
    return totals.join(bad, keys, "full_outer").select(
        *keys,
        F.coalesce("file_hash_count", F.lit(0)).alias("file_hash_count"),
        F.coalesce("failed_file_hash_count", F.lit(0)).alias("failed_file_hash_count"),
        F.col("failed_file_hash_count").isNull().alias("verified"),
    )


def market_hash_check(references: DataFrame, inventory: DataFrame) -> DataFrame:
    """(source_file, source_sha256, failure) for every distinct reference.

    Incomplete pairs, one path with two hashes, unknown files and changed files
    fail; sound references have a null failure.
    """
    used = references.filter("source_file IS NOT NULL OR source_sha256 IS NOT NULL").select("source_file", "source_sha256").distinct()
    conflicts = used.filter("source_sha256 IS NOT NULL").groupBy("source_file").agg(F.count(F.lit(1)).alias("_hashes"))
    files = inventory.select(F.col("relative_path").alias("source_file"), F.col("sha256").alias("_actual"))
    joined = used.join(conflicts, "source_file", "left").join(files, "source_file", "left")
    failure = (
        F.when(F.col("source_file").isNull() | F.col("source_sha256").isNull(), "incomplete_reference")
        .when(F.col("_hashes") > 1, "conflicting_hashes")
        .when(F.col("_actual").isNull(), "missing_file")
        .when(F.col("_actual") != F.col("source_sha256"), "hash_mismatch")
    )
    return joined.select("source_file", "source_sha256", failure.alias("failure"))


def snapshot_hash_check(recorded: DataFrame, rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Recorded against recomputed set fingerprints."""
    hashed = rows.select(*keys, row_fingerprint(columns).alias("_h"))
    recomputed = set_fingerprint(hashed, "_h", keys).drop("rows")
    return recorded.join(recomputed, keys, "left").select(
        *keys, "recorded_sha256", F.col("fingerprint").alias("recomputed_sha256"),
        F.col("recorded_sha256").eqNullSafe(F.col("fingerprint")).alias("matches"),
    )


def hash_chain_verify(ledgers: DataFrame, events: DataFrame, core: list[str], schema_version: str) -> DataFrame:
    """(ledger_id, event_count, valid, reason, latest_sha256) for every ledger.

    ``ledgers`` has ledger_id, schema_version and head_event_sha256; ``events`` has
    ledger_id, position, sequence, previous_event_sha256, event_sha256 and the
    hashed ``core`` columns. The predecessor is found by an equi-join on
    (ledger, position), so one huge ledger spreads over all tasks.
    """
    before = events.select(
        "ledger_id", (F.col("position") + 1).alias("position"), F.col("event_sha256").alias("_before")
    )
    checked = events.withColumn("_recomputed", row_fingerprint(core)).join(before, ["ledger_id", "position"], "left")
    fault = (
        F.when(~F.col("sequence").eqNullSafe(F.col("position")), "invalid_sequence")
        .when(~F.col("previous_event_sha256").eqNullSafe(F.col("_before")), "broken_hash_chain")
        .when(~F.col("event_sha256").eqNullSafe(F.col("_recomputed")), "event_hash_mismatch")
    )
    chain = checked.withColumn("_fault", fault).groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("position"))).alias("_fault"),
        F.max_by("event_sha256", "position").alias("latest_sha256"),
    )
    reason = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "unsupported_schema")
        .when(F.col("event_count").isNull(), "empty_ledger")
        .when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(~F.col("head_event_sha256").eqNullSafe(F.col("latest_sha256")), "head_hash_mismatch")
    )
    return ledgers.join(chain, "ledger_id", "left").select(
        "ledger_id", F.coalesce("event_count", F.lit(0)).alias("event_count"),
        reason.isNull().alias("valid"), reason.alias("reason"), "latest_sha256",
    )


def review_status(subjects: DataFrame, verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """Review state of each subject's current binding.

    ``subjects`` has ledger_id and current_binding; subjects without a ledger are
    not reviewed. Precedence: invalid, revoked, stale, accepted, not reviewed.
    """
    latest = events.groupBy("ledger_id").agg(F.max_by(F.struct("action", "binding"), "position").alias("_latest"))
    joined = subjects.join(verdicts.select("ledger_id", "valid", "reason"), "ledger_id", "left").join(latest, "ledger_id", "left")
    matches = F.col("_latest.binding").isNotNull() & F.col("_latest.binding").eqNullSafe(F.col("current_binding"))
    status = (
        F.when(F.col("valid").isNull(), "not_reviewed")
        .when(~F.col("valid"), "invalid")
        .when(F.col("_latest.action") == "revoked", "revoked")
        .when(~matches, "stale")
        .when(F.col("_latest.action") == "accepted", "accepted")
        .otherwise("not_reviewed")
    )
    return joined.select("ledger_id", status.alias("status"), F.when(F.col("valid") == False, F.col("reason")).alias("reason")).withColumn(  # noqa: E712
        "accepted_for_current_artifacts", F.col("status") == "accepted"
    )


def artifact_register_verify(register: DataFrame, inventory: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, failure) for every registered artifact; null = unchanged.

    ``register`` has role, path, expected_path, size_bytes, sha256; ``inventory``
    the current files; ``bindings`` the hash that the accepted review names for
    a role (absent roles are not bound).
    """
    actual = inventory.select(*keys, F.col("relative_path").alias("path"), F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    bound = bindings.select(*keys, "role", F.col("sha256").alias("_bound"))
    joined = register.join(actual, [*keys, "path"], "left").join(bound, [*keys, "role"], "left")
    failure = (
        F.when(~F.col("path").eqNullSafe(F.col("expected_path")), "unexpected_path")
        .when(F.col("sha256").isNull() | F.col("size_bytes").isNull(), "incomplete_record")
        .when(F.col("_bound").isNotNull() & (F.col("_bound") != F.col("sha256")), "not_the_reviewed_artifact")
        .when(F.col("_sha").isNull(), "missing_file")
        .when((F.col("_size") != F.col("size_bytes")) | (F.col("_sha") != F.col("sha256")), "changed_after_acceptance")
    )
    return joined.select(*keys, "role", failure.alias("failure"))


def publishable(verified: DataFrame, keys: list[str]) -> DataFrame:
    return verified.groupBy(*keys).agg(
        F.every(F.col("failure").isNull()).alias("publishable"), F.count("failure").alias("failures")
    )


def reconcile_ledgers(
    audits: DataFrame,
    claims: DataFrame,
    claim_artifacts: DataFrame,
    outcomes: DataFrame,
    scores: DataFrame,
    score_artifacts: DataFrame,
    claim_columns: list[str],
    score_columns: list[str],
) -> DataFrame:
    """Cross-stage checks as (audit_id, check, failures, ok) rows.

    ``audits`` has one row per audit: the collection id and scope of every stage
    summary, their status and recorded counts. All other inputs carry audit_id
    and claim_id; rows without an audit_id belong to none. A null claim_id equals no other.

    Every ledger is read once, with a tag of its own. Their rows are folded per (audit, claim, video), then per
    (audit, claim), where all differences between ledgers show, then per audit together with the summaries: three
    aggregations, each summed up before its shuffle, and no join.
    """
    fixed = F.coalesce(*[F.when(F.col("result") == k, F.lit(v)) for k, v in fv.COUNTED_RESULTS.items()])
    points_wrong = F.when(
        F.col("counts_in_final_score"), ~F.coalesce(F.col("score") == fixed, F.lit(False))
    ).otherwise(F.col("score") != 0)
    counted = F.col("counts_in_final_score")
    kinds = [f"{s}_claims" for s in fv.SCOREABILITY]
    counts = ["n_claims", "n_claim_artifacts", "n_outcomes", "n_scores", "n_score_artifacts", *kinds, "counted_scores", "wrong_scores"]
    hashes = ["h_claims", "h_claim_artifacts", "h_scores", "h_score_artifacts"]

    def tagged(rows: DataFrame, name: str, columns: list[str] | None = None, **own: Column) -> DataFrame:
        """Counts of ``name`` alone; what other ledgers bring is absent here."""
        facts = {f"n_{name}": F.lit(1)} | own
        if columns is not None:
            facts[f"h_{name}"] = row_fingerprint(columns)
        return rows.filter("audit_id IS NOT NULL").select("audit_id", "claim_id", *[c.alias(n) for n, c in facts.items()])

    ledgers = [
        tagged(
            claims, "claims", claim_columns, video=F.col("video_id"),
            **{k: (F.col("scoreability") == s).cast("int") for k, s in zip(kinds, fv.SCOREABILITY)},
        ),
        tagged(claim_artifacts, "claim_artifacts", claim_columns),
        tagged(outcomes, "outcomes"),
        tagged(
            scores, "scores", score_columns, video=F.col("video_id"), counted_scores=counted.cast("int"),
            points=F.when(counted, F.col("score")), wrong_scores=points_wrong.cast("int"),
        ),
        tagged(score_artifacts, "score_artifacts", score_columns),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)

    def folded(parts: DataFrame, by: list[str], *further: Column) -> DataFrame:
        return parts.groupBy(*by).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[F.min(c).alias(c) for c in hashes],
            F.sum("points").alias("points"), *further,
        )

    by_video = folded(rows, ["audit_id", "claim_id", "video"])
    by_claim = folded(by_video, ["audit_id", "claim_id"], F.sum(F.col("n_claims") * F.col("n_scores")).alias("_same_video"))
    known = F.col("claim_id").isNotNull()

    def ledgers_differ(a: str, b: str) -> Column:
        """Keys that are missing, repeated or different."""
        n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
        equal = (n == m) & (n <= 1) & (F.col(f"h_{a}").eqNullSafe(F.col(f"h_{b}")))
        return F.when(known, (~equal).cast("int")).otherwise((n > 0).cast("int") + (m > 0).cast("int"))

    def rows_alone(a: str, b: str) -> Column:
        """Rows whose key the other ledger does not have."""
        n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
        return F.when(~known | (n == 0) | (m == 0), n + m).otherwise(0)

    found = {
        "claim_artifacts_equal_ledger": ledgers_differ("claim_artifacts", "claims"),
        "outcomes_cover_claims": rows_alone("outcomes", "claims"),
        "scores_cover_claims": rows_alone("scores", "claims"),
        "score_artifacts_equal_ledger": ledgers_differ("score_artifacts", "scores"),
        "score_video_binding": F.when(known, F.col("n_claims") * F.col("n_scores") - F.col("_same_video")).otherwise(0),
        "counted_score_contract": F.col("wrong_scores"),
    }
    totals = {"total_claims": "n_claims", **{k: k for k in kinds}, "total_scores": "n_scores", "counted_scores": "counted_scores", "points": "points"}
    per_claim = by_claim.select(
        "audit_id", *[c.cast("bigint").alias(f"f_{n}") for n, c in found.items()], *[F.col(c).alias(f"t_{n}") for n, c in totals.items()]
    )
    stage_ids = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col("collection_id")) for c in ("claims_collection_id", "outcomes_collection_id", "scores_collection_id")])
    summaries = {
        "collection_id_equal": stage_ids,
        "stages_complete": (F.col("claims_status") != "complete") | (F.col("scores_status") != "complete"),
        "scope_equal": (F.col("claims_scope") != F.col("scope")) | (F.col("scores_scope") != F.col("scope")),
    }
    recorded = [f"recorded_{n}" for n in totals]
    per_audit = audits.select(
        "audit_id", F.lit(True).alias("_audit"), *recorded,
        *[F.coalesce(c, F.lit(False)).cast("bigint").alias(f"f_{n}") for n, c in summaries.items()],
    )
    audit = per_claim.unionByName(per_audit, allowMissingColumns=True).groupBy("audit_id").agg(
        F.count("_audit").alias("_audits"), *[F.any_value(c, True).alias(c) for c in recorded],
        *[F.coalesce(F.sum(f"f_{n}"), F.lit(0)).alias(f"f_{n}") for n in [*found, *summaries]],
        *[F.sum(f"t_{n}").alias(f"t_{n}") for n in totals],
    ).filter("_audits > 0")

    def sums_differ(names: list[str]) -> Column:
        """An audit without rows has no sums at all."""
        some = F.col(f"t_{names[0]}") > 0
        return reduce(lambda a, b: a | b, [~F.col(f"recorded_{n}").eqNullSafe(F.when(some, F.col(f"t_{n}"))) for n in names]).cast("bigint")

    failures = {n: F.col(f"f_{n}") for n in [*summaries, *found]} | {
        "extraction_counts_recomputed": sums_differ(["total_claims", *kinds]),
        "score_aggregates_recomputed": sums_differ(["total_scores", "counted_scores", "points"]),
    }
    checks = [F.struct(F.lit(n).alias("check"), c.alias("failures"), (c == 0).alias("ok")) for n, c in failures.items()]
    return audit.select("audit_id", F.inline_outer(F.array(*checks)))


def audit_status(audits: DataFrame) -> DataFrame:
    """Status ladder from verified, scores_status, claims_status, publication_mode, review_accepted."""
    public = F.col("publication_mode") == "public"
    status = (
        F.when(~F.coalesce("verified", F.lit(False)), "integrity_warning")
        .when(
            F.col("scores_status") == "complete",
            F.when(public & ~F.coalesce("review_accepted", F.lit(False)), "human_review_pending")
            .when(public, "audit_complete")
            .otherwise("private_preview"),
        )
        .when(F.col("claims_status") == "complete", "claims_complete")
        .otherwise("collection_verified")
    )
    return audits.withColumn("status", status)
