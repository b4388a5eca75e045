"""Integrity and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.hashing import row_fingerprint
from hindcast.operators import integrity, publish, scoring
from hindcast.plans.registry import query
from hindcast.plans.views import view

DOC_COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]
_DOC_HASH = "sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}) AS VARCHAR))"


def _tree_sql(rows: str, keys: str, name: str) -> str:
    """CTEs of the hash tree over ``rows`` (keys, h); the last one is ``name``."""
    parts = [f"{name}_leaf AS (SELECT {keys}, h AS node, count(*) AS n, h || ':' || count(*) AS txt FROM {rows} GROUP BY {keys}, h)"]
    before = f"{name}_leaf"
    for length in (*integrity.TREE_LEVELS, 0):
        now = f"{name}_{length}" if length else name
        parts.append(
            f"{now} AS (SELECT {keys}, substr(node, 1, {length}) AS node, sha256(string_agg(txt, chr(10) ORDER BY txt)) AS fingerprint, "
            f"CAST(sum(n) AS BIGINT) AS n, substr(node, 1, {length}) || ':' || sha256(string_agg(txt, chr(10) ORDER BY txt)) AS txt FROM {before} GROUP BY {keys}, substr(node, 1, {length}))"
        )
        before = now
    return ",\n".join(parts)


@query("row_fingerprint", f"SELECT doc_id, {_DOC_HASH} AS fingerprint FROM {{documents}}")
def row_fingerprint_query(spark, sf):
    return view(spark, sf, "documents").select("doc_id", row_fingerprint(DOC_COLUMNS).alias("fingerprint"))


@query(
    "set_fingerprint",
    f"""WITH hashed AS (SELECT source, {_DOC_HASH} AS h FROM {{documents}}), {_tree_sql('hashed', 'source', 'tree')}
      SELECT source, fingerprint, n AS rows FROM tree""",
)
def set_fingerprint_query(spark, sf):
    hashed = view(spark, sf, "documents").select("source", row_fingerprint(DOC_COLUMNS).alias("h"))
    return integrity.set_fingerprint(hashed, "h", ["source"])


@query(
    "collection_id",
    f"""WITH hashed AS (SELECT 1 AS k, {_DOC_HASH} AS h FROM {{documents}}), {_tree_sql('hashed', 'k', 'tree')}
      SELECT 'audit-20240101-20240131-' || substr(fingerprint, 1, 12) AS collection_id, n AS rows FROM tree""",
)
def collection_id_query(spark, sf):
    hashed = view(spark, sf, "documents").select(row_fingerprint(DOC_COLUMNS).alias("h"))
    return integrity.set_fingerprint(hashed, "h", []).select(
        integrity.collection_id("20240101", "20240131", F.col("fingerprint")).alias("collection_id"), "rows"
    )


_CLAIM_TEXT = "to_json({'claim_id': claim_id, 'direction': direction, 'model': 'm1', 'part': 'claim', 'policy': 'v3', 'scoreability': scoreability})"
_OUTCOME_TEXT = "to_json({'asset': asset, 'asset_pos': asset_pos, 'claim_id': claim_id, 'model': 'm1', 'part': 'outcome', 'policy': 'v3'})"


@query(
    "scoring_fingerprint",
    f"""WITH hashed AS (SELECT video_id, sha256(CAST({_CLAIM_TEXT} AS VARCHAR)) AS h FROM {{claims}}
        UNION ALL SELECT c.video_id, sha256(CAST({_OUTCOME_TEXT.replace("claim_id, 'model'", "a.claim_id, 'model'")} AS VARCHAR)) FROM {{claim_assets}} a JOIN {{claims}} c ON c.claim_id = a.claim_id),
      {_tree_sql('hashed', 'video_id', 'tree')} SELECT video_id, fingerprint, n AS rows FROM tree""",
)
def scoring_fingerprint_query(spark, sf):
    claims = view(spark, sf, "claims")
    outcomes = view(spark, sf, "claim_assets").join(claims.select("claim_id", "video_id"), "claim_id")
    return integrity.scoring_fingerprint(
        claims, outcomes, ["claim_id", "direction", "scoreability"], ["claim_id", "asset_pos", "asset"], policy="v3", model="m1"
    )


@query(
    "claim_cache_key",
    """SELECT video_id, sha256(CAST(to_json({'category': category, 'evidence_policy': 'p2', 'model': 'm1', 'reasoning_effort': 'low', 'schema_version': 'v4', 'title': title,
      'transcript_sha256': sha256(clean_text), 'upload_date_raw': upload_date_raw, 'video_id': video_id}) AS VARCHAR)) AS cache_key FROM {videos}""",
)
def claim_cache_key_query(spark, sf):
    videos = view(spark, sf, "videos").withColumn("transcript_sha256", F.sha2("clean_text", 256))
    columns = ["video_id", "upload_date_raw", "category", "title", "transcript_sha256"]
    key = row_fingerprint(columns, schema_version="v4", evidence_policy="p2", model="m1", reasoning_effort="low")
    return videos.select("video_id", key.alias("cache_key"))


@query(
    "cache_lookup",
    """SELECT doc_id, 'hit' AS outcome, 'new' AS collection_id FROM {documents} WHERE doc_id % 3 = 0 AND doc_id % 5 > 0 AND doc_id % 7 > 1
      UNION ALL SELECT doc_id, 'miss', NULL FROM {documents} WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 > 0 AND doc_id % 7 > 1)""",
)
def cache_lookup_query(spark, sf):
    docs = view(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("transcript_sha256"), row_fingerprint(DOC_COLUMNS).alias("cache_key"), F.lit("m1").alias("model")
    )
    # a third was scored before, a fifth of that with an older model; the others are known under foreign keys; two in
    # seven hold a score or a result that the contract does not allow
    cache = docs.select(
        F.when(F.col("doc_id") % 3 == 0, F.col("cache_key")).otherwise(F.concat(F.lit("x"), "cache_key")).alias("cache_key"),
        "transcript_sha256", F.when(F.col("doc_id") % 5 == 0, "m0").otherwise("m1").alias("model"),
        F.col("doc_id"), F.lit("old").alias("collection_id"), F.col("doc_id").cast("string").alias("claim_id"),
        F.when(F.col("doc_id") % 7 == 0, "right").otherwise("correct").alias("result"), F.when(F.col("doc_id") % 7 == 1, 1.5).otherwise(1.0).alias("score"),
        F.lit(True).alias("counts_in_final_score"), F.lit("not_applicable").alias("trigger_status"), F.lit("sufficient").alias("data_sufficiency"),
        F.lit("seen").alias("evidence_summary"), F.lit("judged").alias("reasoning"), F.lit("24h").alias("evaluation_window"), F.lit(0.5).alias("scoring_confidence"),
    )
    work = docs.drop("doc_id").join(docs.select("cache_key", "doc_id"), "cache_key")
    hits, misses = integrity.cache_lookup(work, cache, "cache_key", ["transcript_sha256", "model", "doc_id"], "new", scoring.score_row_contract)
    return hits.select("doc_id", F.lit("hit").alias("outcome"), "collection_id").unionByName(
        misses.select("doc_id", F.lit("miss").alias("outcome"), F.lit(None).cast("string").alias("collection_id"))
    )


@query(
    "exact_artifact_semi",
    """SELECT d.doc_id, d.source FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.quality = 1""",
)
def exact_artifact_semi_query(spark, sf):
    artifacts = view(spark, sf, "documents").withColumn("transcript_sha256", F.sha2("text", 256))
    labels = view(spark, sf, "labels")
    # the expected side names a stale transcript for documents of low quality
    expected = artifacts.join(labels, "doc_id").select(
        "doc_id", "source", F.when(F.col("quality") == 1, F.col("transcript_sha256")).otherwise(F.sha2(F.lit("stale"), 256)).alias("transcript_sha256")
    )
    return integrity.exact_artifact_semi(artifacts, expected, ["doc_id", "source", "transcript_sha256"]).select("doc_id", "source")


@query(
    "ledger_equal_by_hash",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'missing_right' ELSE 'different' END AS difference FROM {orders} WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0
      UNION ALL SELECT -1 - o_orderkey, 'missing_left' FROM {orders} WHERE o_orderkey % 13 = 0""",
)
def ledger_equal_by_hash_query(spark, sf):
    left = view(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    right = left.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "?").otherwise(F.col("o_orderstatus"))).withColumn(
        "o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    )
    return integrity.ledger_difference(left, right, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


# --- inventories ------------------------------------------------------------------------------

INVENTORY_CTE = """
expected AS (
  SELECT source AS scope, CASE WHEN doc_id % 41 = 0 THEN '../' ELSE '' END || 'raw/doc' || CASE WHEN doc_id % 37 = 36 THEN doc_id - 1 ELSE doc_id END || '.txt' AS relative_path,
    n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN doc_id % 23 = 0 THEN sha256('x') ELSE sha256(text) END AS sha256, doc_id FROM {documents}),
actual AS (SELECT source AS scope, 'raw/doc' || CASE WHEN doc_id % 29 = 0 THEN doc_id + 1000000 ELSE doc_id END || '.txt' AS relative_path, n_chars AS size_bytes, sha256(text) AS sha256 FROM {documents}),
failed AS (
  SELECT DISTINCT coalesce(e.scope, a.scope) AS scope, coalesce(e.relative_path, a.relative_path) AS relative_path,
    CASE WHEN e.relative_path IS NULL THEN 'untracked' WHEN e.relative_path LIKE '../%' THEN 'unsafe_path' WHEN d.n > 1 THEN 'duplicate_path'
      WHEN a.relative_path IS NULL THEN 'nonexistent' WHEN e.size_bytes <> a.size_bytes THEN 'size_mismatch' WHEN e.sha256 <> a.sha256 THEN 'hash_mismatch' END AS failure
  FROM expected e FULL JOIN actual a ON a.scope = e.scope AND a.relative_path = e.relative_path
  LEFT JOIN (SELECT scope, relative_path, count(*) AS n FROM expected GROUP BY 1, 2) d ON d.scope = e.scope AND d.relative_path = e.relative_path)"""


def inventories(spark, sf):
    """(expected, actual) file inventories with planted faults."""
    docs = view(spark, sf, "documents")
    i = F.col("doc_id")
    number = lambda c: F.concat(F.lit("raw/doc"), c.cast("string"), F.lit(".txt"))
    expected = docs.select(
        F.col("source").alias("scope"),
        F.concat(F.when(i % 41 == 0, "../").otherwise(""), number(F.when(i % 37 == 36, i - 1).otherwise(i))).alias("relative_path"),
        (F.col("n_chars") + F.when(i % 19 == 0, 1).otherwise(0)).alias("size_bytes"),
        F.when(i % 23 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
    )
    actual = docs.select(
        F.col("source").alias("scope"), number(F.when(i % 29 == 0, i + 1000000).otherwise(i)).alias("relative_path"),
        F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"),
    )
    return expected, actual


@query("inventory_verify", f"WITH {INVENTORY_CTE} SELECT scope, relative_path, failure FROM failed WHERE failure IS NOT NULL")
def inventory_verify_query(spark, sf):
    return integrity.inventory_verify(*inventories(spark, sf), ["scope"])


@query(
    "inventory_summary",
    f"""WITH {INVENTORY_CTE} SELECT coalesce(e.scope, f.scope) AS scope, coalesce(e.n, 0) AS file_hash_count, coalesce(f.n, 0) AS failed_file_hash_count, f.n IS NULL AS verified
      FROM (SELECT scope, count(*) AS n FROM expected GROUP BY 1) e FULL JOIN (SELECT scope, count(*) AS n FROM failed WHERE failure IS NOT NULL GROUP BY 1) f ON f.scope = e.scope""",
)
def inventory_summary_query(spark, sf):
    expected, actual = inventories(spark, sf)
    return integrity.inventory_summary(expected, integrity.inventory_verify(expected, actual, ["scope"]), ["scope"])


@query(
    "market_hash_check",
    """WITH refs AS (SELECT DISTINCT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'm/' || (o_custkey % 600) END AS f, CASE WHEN o_orderkey % 37 = 0 THEN NULL
          WHEN o_custkey % 600 = 5 AND o_orderkey % 2 = 0 THEN sha256('other') ELSE sha256('c' || (o_custkey % 600)) END AS h FROM {orders}),
      files AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'gone/' ELSE 'm/' END || c_custkey AS f, sha256(CASE WHEN c_custkey % 9 = 1 THEN 'd' ELSE 'c' END || c_custkey) AS h FROM {customer}),
      clash AS (SELECT f, count(*) AS n FROM refs WHERE h IS NOT NULL GROUP BY f)
      SELECT r.f AS source_file, r.h AS source_sha256, CASE WHEN r.f IS NULL OR r.h IS NULL THEN 'incomplete_reference' WHEN k.n > 1 THEN 'conflicting_hashes'
        WHEN i.f IS NULL THEN 'missing_file' WHEN i.h <> r.h THEN 'hash_mismatch' END AS failure
      FROM refs r LEFT JOIN clash k ON k.f = r.f LEFT JOIN files i ON i.f = r.f WHERE r.f IS NOT NULL OR r.h IS NOT NULL""",
)
def market_hash_check_query(spark, sf):
    slot = (F.col("o_custkey") % 600).cast("string")
    references = view(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 31 != 0, F.concat(F.lit("m/"), slot)).alias("source_file"),
        F.when(F.col("o_orderkey") % 37 == 0, F.lit(None).cast("string"))
        .when((F.col("o_custkey") % 600 == 5) & (F.col("o_orderkey") % 2 == 0), F.sha2(F.lit("other"), 256))
        .otherwise(F.sha2(F.concat(F.lit("c"), slot), 256))
        .alias("source_sha256"),
    )
    key = F.col("c_custkey").cast("string")
    files = view(spark, sf, "customer").select(
        F.concat(F.when(F.col("c_custkey") % 11 == 0, "gone/").otherwise("m/"), key).alias("relative_path"),
        F.sha2(F.concat(F.when(F.col("c_custkey") % 9 == 1, "d").otherwise("c"), key), 256).alias("sha256"),
    )
    return integrity.market_hash_check(references, files)


@query(
    "snapshot_hash_check",
    f"""WITH hashed AS (SELECT source, {_DOC_HASH} AS h FROM {{documents}}), {_tree_sql('hashed', 'source', 'tree')}
      SELECT source, CASE WHEN source LIKE '%7' THEN 'tampered' ELSE fingerprint END AS recorded_sha256, fingerprint AS recomputed_sha256, source NOT LIKE '%7' AS matches FROM tree""",
)
def snapshot_hash_check_query(spark, sf):
    docs = view(spark, sf, "documents")
    hashed = docs.select("source", row_fingerprint(DOC_COLUMNS).alias("h"))
    recorded = integrity.set_fingerprint(hashed, "h", ["source"]).select(
        "source", F.when(F.col("source").endswith("7"), "tampered").otherwise(F.col("fingerprint")).alias("recorded_sha256")
    )
    return integrity.snapshot_hash_check(recorded, docs, DOC_COLUMNS, ["source"])


# --- review ledgers -----------------------------------------------------------------------------

_EVENT_HASH = "sha256(CAST(to_json({'action': action, 'ledger_id': ledger_id, 'notes': notes, 'position': position}) AS VARCHAR))"
LEDGER_CTE = f"""
plain AS (SELECT conv_id AS ledger_id, turn + 1 AS position, CASE WHEN conv_id % 10 = 3 AND turn > 1 THEN turn + 2 ELSE turn + 1 END AS sequence,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 'revoked' WHEN (conv_id + turn) % 9 = 1 THEN 'noted' ELSE 'accepted' END AS action, text AS notes FROM {{conversations}}),
signed AS (SELECT *, {_EVENT_HASH} AS good FROM plain),
recorded AS (SELECT *, CASE WHEN ledger_id % 10 = 4 AND position = 2 THEN sha256('forged') ELSE good END AS event_sha256 FROM signed),
chained AS (SELECT r.*, CASE WHEN r.ledger_id % 10 = 5 AND r.position = 3 THEN sha256('gap') ELSE lag(event_sha256) OVER (PARTITION BY ledger_id ORDER BY position) END AS previous_event_sha256 FROM recorded r),
faults AS (SELECT *, CASE WHEN sequence <> position THEN 'invalid_sequence' WHEN ledger_id % 10 = 5 AND position = 3 THEN 'broken_hash_chain'
  WHEN event_sha256 <> good THEN 'event_hash_mismatch' END AS fault FROM chained),
chains AS (SELECT ledger_id, count(*) AS event_count, arg_min(fault, position) FILTER (WHERE fault IS NOT NULL) AS fault, arg_max(event_sha256, position) AS latest_sha256, arg_max(action, position) AS last_action FROM faults GROUP BY 1),
ledgers AS (SELECT DISTINCT conv_id AS ledger_id FROM {{conversations}} UNION SELECT -1 - c_custkey FROM {{customer}}),
verdicts AS (SELECT l.ledger_id, coalesce(c.event_count, 0) AS event_count, c.latest_sha256, c.last_action,
  CASE WHEN l.ledger_id % 10 = 6 THEN 'unsupported_schema' WHEN c.event_count IS NULL THEN 'empty_ledger' WHEN c.fault IS NOT NULL THEN c.fault
    WHEN l.ledger_id % 10 = 7 THEN 'head_hash_mismatch' END AS reason FROM ledgers l LEFT JOIN chains c ON c.ledger_id = l.ledger_id)"""


def ledger_frames(spark, sf):
    """(ledgers, events) with planted chain faults; customers are empty ledgers."""
    turns = view(spark, sf, "conversations")
    i, position = F.col("ledger_id"), F.col("position")
    events = turns.select(
        F.col("conv_id").alias("ledger_id"), (F.col("turn") + 1).alias("position"),
        F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") > 1), F.col("turn") + 2).otherwise(F.col("turn") + 1).alias("sequence"),
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "revoked").when((F.col("conv_id") + F.col("turn")) % 9 == 1, "noted").otherwise("accepted").alias("action"),
        F.col("text").alias("notes"),
    )
    events = events.withColumn(
        "event_sha256",
        F.when((i % 10 == 4) & (position == 2), F.sha2(F.lit("forged"), 256)).otherwise(row_fingerprint(["action", "ledger_id", "notes", "position"])),
    )
    before = events.select("ledger_id", (position + 1).alias("position"), F.col("event_sha256").alias("previous_event_sha256"))
    events = events.join(before, ["ledger_id", "position"], "left").withColumn(
        "previous_event_sha256", F.when((i % 10 == 5) & (position == 3), F.sha2(F.lit("gap"), 256)).otherwise(F.col("previous_event_sha256"))
    )
    ids = turns.select(F.col("conv_id").alias("ledger_id")).unionByName(
        view(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("ledger_id"))
    ).distinct()
    heads = events.groupBy("ledger_id").agg(F.max_by("event_sha256", "position").alias("_head"))
    ledgers = ids.join(heads, "ledger_id", "left").select(
        "ledger_id", F.when(i % 10 == 6, "0.9").otherwise("1.0").alias("schema_version"),
        F.when(i % 10 == 7, F.sha2(F.lit("head"), 256)).otherwise(F.col("_head")).alias("head_event_sha256"),
    )
    return ledgers, events


CORE = ["action", "ledger_id", "notes", "position"]


@query("hash_chain_verify", f"WITH {LEDGER_CTE} SELECT ledger_id, event_count, reason IS NULL AS valid, reason, latest_sha256 FROM verdicts")
def hash_chain_verify_query(spark, sf):
    return integrity.hash_chain_verify(*ledger_frames(spark, sf), CORE, "1.0")


@query(
    "review_status",
    f"""WITH {LEDGER_CTE}, subjects AS (SELECT ledger_id FROM ledgers UNION SELECT 1000000 + n_nationkey FROM {{nation}}),
      s AS (SELECT u.ledger_id, v.reason, CASE WHEN v.ledger_id IS NULL THEN 'not_reviewed' WHEN v.reason IS NOT NULL THEN 'invalid' WHEN v.last_action = 'revoked' THEN 'revoked'
        WHEN u.ledger_id % 6 = 2 THEN 'stale' WHEN v.last_action = 'accepted' THEN 'accepted' ELSE 'not_reviewed' END AS status
        FROM subjects u LEFT JOIN verdicts v ON v.ledger_id = u.ledger_id)
      SELECT ledger_id, status, reason, status = 'accepted' AS accepted_for_current_artifacts FROM s""",
)
def review_status_query(spark, sf):
    ledgers, events = ledger_frames(spark, sf)
    verdicts = integrity.hash_chain_verify(ledgers, events, CORE, "1.0")
    ids = ledgers.select("ledger_id").unionByName(
        view(spark, sf, "nation").select((F.col("n_nationkey") + 1000000).cast("bigint").alias("ledger_id"))
    )
    binding = F.concat(F.lit("b"), F.col("ledger_id").cast("string"))
    subjects = ids.withColumn("current_binding", F.when(F.col("ledger_id") % 6 == 2, "moved on").otherwise(binding))
    return integrity.review_status(subjects, verdicts, events.withColumn("binding", binding))


@query(
    "artifact_register_verify",
    """SELECT source, doc_id AS role, CASE WHEN doc_id % 13 = 0 THEN 'unexpected_path' WHEN doc_id % 17 = 0 THEN 'incomplete_record' WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 'not_the_reviewed_artifact'
      WHEN doc_id % 19 = 0 THEN 'missing_file' WHEN doc_id % 11 = 0 THEN 'changed_after_acceptance' END AS failure FROM {documents}""",
)
def artifact_register_verify_query(spark, sf):
    return integrity.artifact_register_verify(*register_frames(spark, sf), ["source"])


def register_frames(spark, sf):
    docs = view(spark, sf, "documents").withColumn("role", F.col("doc_id"))
    i = F.col("doc_id")
    path = F.concat(F.lit("public/"), i.cast("string"))
    register = docs.select(
        "source", "role", path.alias("path"), F.when(i % 13 == 0, "elsewhere").otherwise(path).alias("expected_path"),
        F.col("n_chars").alias("size_bytes"), F.when(i % 17 != 0, F.sha2("text", 256)).alias("sha256"),
    )
    inventory = docs.select(
        "source", F.when(i % 19 == 0, F.concat(F.lit("gone/"), path)).otherwise(path).alias("relative_path"), (F.col("n_chars") + F.when(i % 11 == 0, 1).otherwise(0)).alias("size_bytes"), F.sha2("text", 256).alias("sha256")
    )
    bindings = docs.select(
        "source", F.when(i % 2 == 0, i).otherwise(-1 - i).alias("role"), F.when(i % 7 == 0, F.sha2(F.lit("reviewed"), 256)).otherwise(F.sha2("text", 256)).alias("sha256")
    )
    return register, inventory, bindings


@query(
    "publishable",
    """WITH f AS (SELECT source, doc_id % 13 = 0 OR doc_id % 17 = 0 OR (doc_id % 7 = 0 AND doc_id % 2 = 0) OR doc_id % 19 = 0 OR doc_id % 11 = 0 AS bad FROM {documents})
      SELECT source, NOT bool_or(bad) AS publishable, count(*) FILTER (WHERE bad) AS failures FROM f GROUP BY 1""",
)
def publishable_query(spark, sf):
    return integrity.publishable(integrity.artifact_register_verify(*register_frames(spark, sf), ["source"]), ["source"])


# --- reconciliation ----------------------------------------------------------------------------------

AUDIT_CTE = """
c AS (SELECT *, user_id % 20 AS audit_id FROM {events}),
audits AS (SELECT audit_id, count(*) AS n FROM c GROUP BY 1)"""

RECONCILE_CHECK = f"""WITH {AUDIT_CTE},
checks AS (SELECT audit_id, unnest(['collection_id_equal', 'stages_complete', 'scope_equal', 'claim_artifacts_equal_ledger', 'extraction_counts_recomputed',
  'outcomes_cover_claims', 'scores_cover_claims', 'score_artifacts_equal_ledger', 'score_video_binding', 'counted_score_contract', 'score_aggregates_recomputed']) AS "check" FROM audits),
fails AS (
  SELECT audit_id, 'collection_id_equal' AS "check", 1 AS failures FROM audits WHERE audit_id = 1
  UNION ALL SELECT audit_id, 'stages_complete', 1 FROM audits WHERE audit_id IN (2, 3)
  UNION ALL SELECT audit_id, 'scope_equal', 1 FROM audits WHERE audit_id = 4
  UNION ALL SELECT audit_id, 'claim_artifacts_equal_ledger', count(*) FROM c WHERE audit_id = 5 AND event_id % 3 = 0 GROUP BY 1
  UNION ALL SELECT audit_id, 'extraction_counts_recomputed', 1 FROM audits WHERE audit_id = 6
  UNION ALL SELECT audit_id, 'outcomes_cover_claims', 2 * count(*) FROM c WHERE audit_id = 7 AND event_id % 4 = 0 GROUP BY 1
  UNION ALL SELECT audit_id, 'scores_cover_claims', 2 * count(*) FROM c WHERE audit_id = 8 AND event_id % 5 = 0 GROUP BY 1
  UNION ALL SELECT audit_id, 'score_artifacts_equal_ledger', count(*) FROM c WHERE audit_id = 9 AND event_id % 6 = 0 GROUP BY 1
  UNION ALL SELECT audit_id, 'score_video_binding', count(*) FROM c WHERE audit_id = 10 AND event_id % 7 = 0 GROUP BY 1
  UNION ALL SELECT audit_id, 'counted_score_contract', count(*) FROM c WHERE audit_id = 11 AND event_id % 2 = 0 GROUP BY 1
  UNION ALL SELECT audit_id, 'score_aggregates_recomputed', 1 FROM audits WHERE audit_id = 12)
SELECT k.audit_id, k."check", CAST(coalesce(f.failures, 0) AS BIGINT) AS failures, f.failures IS NULL AS ok
FROM checks k LEFT JOIN fails f ON f.audit_id = k.audit_id AND f."check" = k."check" """


def reconcile_rows(spark, sf):
    """Ledgers of twenty audits; audits 1 to 12 break one check each."""
    base = view(spark, sf, "events").withColumn("audit_id", F.col("user_id") % 20)
    a, e = F.col("audit_id"), F.col("event_id")
    claims = base.select(
        "audit_id", e.alias("claim_id"), F.col("user_id").alias("video_id"),
        F.when(e % 3 == 0, "scoreable").when(e % 3 == 1, "conditional_scoreable").otherwise("not_scoreable").alias("scoreability"),
    )
    artifacts = claims.withColumn(
        "scoreability", F.when((a == 5) & (F.col("claim_id") % 3 == 0), "changed").otherwise(F.col("scoreability"))
    )
    lost = (a == 7) & (F.col("claim_id") % 4 == 0)
    outcomes = claims.withColumn("claim_id", F.when(lost, -1 - F.col("claim_id")).otherwise(F.col("claim_id")))
    result = F.when(e % 2 == 0, "correct").otherwise("not_triggered")
    scores = base.select(
        "audit_id", F.when((a == 8) & (e % 5 == 0), -1 - e).otherwise(e).alias("claim_id"),
        (F.col("user_id") + F.when((a == 10) & (e % 7 == 0), 1).otherwise(0)).alias("video_id"), result.alias("result"),
        F.when(e % 2 == 0, F.when(a == 11, 0.5).otherwise(1.0)).otherwise(0.0).alias("score"), (e % 2 == 0).alias("counts_in_final_score"),
    )
    score_artifacts = scores.withColumn("result", F.when((a == 9) & (F.col("claim_id") % 6 == 0), "changed").otherwise(F.col("result")))
    sums = claims.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("recorded_total_claims"),
        *[F.count_if(F.col("scoreability") == s).alias(f"recorded_{s}_claims") for s in ("scoreable", "conditional_scoreable", "not_scoreable")],
    )
    points = scores.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("recorded_total_scores"), F.count_if("counts_in_final_score").alias("recorded_counted_scores"),
        F.sum(F.when(F.col("counts_in_final_score"), F.col("score"))).alias("recorded_points"),
    )
    one = lambda test, bad, good: F.when(test, bad).otherwise(good)
    audits = sums.join(points, "audit_id").withColumns(
        {
            "recorded_total_claims": F.col("recorded_total_claims") + one(a == 6, 1, 0),
            "recorded_counted_scores": F.col("recorded_counted_scores") + one(a == 12, 1, 0),
            "collection_id": F.lit("x"), "claims_collection_id": one(a == 1, "y", "x"), "outcomes_collection_id": F.lit("x"), "scores_collection_id": F.lit("x"),
            "claims_status": one(a == 2, "partial", "complete"), "scores_status": one(a == 3, "partial", "complete"),
            "scope": F.lit("crypto"), "claims_scope": F.lit("crypto"), "scores_scope": one(a == 4, "other", "crypto"),
        }
    )
    checks = integrity.reconcile_ledgers(
        audits, claims, artifacts, outcomes, scores, score_artifacts, ["video_id", "scoreability"], ["video_id", "result", "score", "counts_in_final_score"]
    )
    return audits, checks


@query("reconcile_ledgers", RECONCILE_CHECK)
def reconcile_ledgers_query(spark, sf):
    return reconcile_rows(spark, sf)[1]


@query(
    "audit_status",
    f"""WITH {AUDIT_CTE} SELECT audit_id, CASE WHEN audit_id IN (1, 4, 5, 6, 7, 8, 9, 10, 11, 12) THEN 'integrity_warning' WHEN audit_id IN (2, 3) THEN
        CASE WHEN audit_id = 2 THEN CASE audit_id % 3 WHEN 0 THEN 'audit_complete' WHEN 1 THEN 'human_review_pending' ELSE 'private_preview' END ELSE 'claims_complete' END
      ELSE CASE audit_id % 3 WHEN 0 THEN 'audit_complete' WHEN 1 THEN 'human_review_pending' ELSE 'private_preview' END END AS status FROM audits""",
)
def audit_status_query(spark, sf):
    audits, checks = reconcile_rows(spark, sf)
    # an incomplete stage is a state of its own, not an integrity failure
    sound = checks.filter("check <> 'stages_complete'").groupBy("audit_id").agg(F.every("ok").alias("verified"))
    ladder = audits.join(sound, "audit_id").withColumns(
        {
            "publication_mode": F.when(F.col("audit_id") % 3 == 2, "private").otherwise("public"),
            "review_accepted": F.col("audit_id") % 3 == 0,
        }
    )
    return integrity.audit_status(ladder).select("audit_id", "status")


@query(
    "stable_outcome",
    """SELECT claim_id, sha256(CAST(to_json({'asset': asset, 'asset_pos': asset_pos, 'claim_id': claim_id}) AS VARCHAR)) AS fingerprint FROM {claim_assets}""",
)
def stable_outcome_query(spark, sf):
    located = view(spark, sf, "claim_assets").withColumns(
        {"source_file": F.concat(F.lit("run/"), F.col("claim_id").cast("string")), "source_sha256": F.sha2("asset", 256)}
    )
    nested = located.select("claim_id", F.array(F.struct("asset", "asset_pos", "source_file", "source_sha256")).alias("assets"))
    flat = publish.stable_outcome(nested).select("claim_id", F.inline("assets"))
    return flat.select("claim_id", row_fingerprint(["asset", "asset_pos", "claim_id"]).alias("fingerprint"))
