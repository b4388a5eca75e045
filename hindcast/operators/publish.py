"""Publication view: allow-listed fields, redaction, secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import fixed_values as fv
from hindcast.functions import urls

PUBLIC_CLAIM = [
    "claim_id", "video_id", "upload_date", "category", "claim_text", "source_excerpt", "source_line_start",
    "source_line_end", "assets", "levels", "direction", "claim_type", "condition", "invalidation_condition",
    "time_horizon", "normalized_horizon_hours", "scoreability", "not_scoreable_reason", "extraction_confidence",
]
PUBLIC_SCORE = [
    "claim_id", "video_id", "upload_date", "category", "result", "score", "counts_in_final_score",
    "trigger_status", "data_sufficiency", "evidence_summary", "reasoning", "evaluation_window", "scoring_confidence",
]
PUBLIC_WINDOW = [
    "hours", "status", "complete", "bar_count", "open", "high", "low", "close", "return_pct", "max_up_pct",
    "max_down_pct", "level_events",
]
PUBLIC_OUTCOME = {
    "claim_id": None, "video_id": None, "category": None, "published_at_utc": None, "published_at_source": None,
    "status": None,
    "assets": {
        "asset": None, "series_key": None, "provider": None, "venue": None, "symbol": None, "interval": None,
        "proxy_note": None, "status": None,
        "window_24h": {name: None for name in PUBLIC_WINDOW},
        "window_48h": {name: None for name in PUBLIC_WINDOW},
    },
}


def allowlist_projection(rows: DataFrame, allowed: dict | list[str]) -> DataFrame:
    """Keeps only the listed fields, at every level; arrays of structs included.

    ``allowed`` is a list of names, or a dict whose values list the allowed
    fields of a struct (null keeps the field as it is).
    """
    tree = allowed if isinstance(allowed, dict) else {name: None for name in allowed}

    def pick(column, kind, wanted):
        if wanted is None:
            return column
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda item: pick(item, kind.elementType, wanted))
        fields = {f.name: f.dataType for f in kind.fields}
        kept = [pick(column[n], fields[n], sub).alias(n) for n, sub in wanted.items() if n in fields]
        return F.when(column.isNotNull(), F.struct(*kept))

    types = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[pick(F.col(n), types[n], sub).alias(n) for n, sub in tree.items() if n in types])


def drop_nested(rows: DataFrame, names: set[str]) -> DataFrame:
    """Removes fields by name at every level."""

    def keep(kind):
        if isinstance(kind, T.ArrayType):
            return keep(kind.elementType)
        if isinstance(kind, T.StructType):
            return {f.name: keep(f.dataType) for f in kind.fields if f.name not in names}
        return None

    return allowlist_projection(rows, keep(rows.schema))


VOLATILE_FIELDS = {"source_file", "source_sha256"}


def stable_outcome(outcomes: DataFrame) -> DataFrame:
    """Outcome rows without storage metadata, which must not change a hash."""
    return drop_nested(outcomes, VOLATILE_FIELDS)


def redact_strings(rows: DataFrame, workspace: str | None = None, home: str | None = None) -> DataFrame:
    """Applies redaction to every string, nested ones included."""

    def walk(column, kind):
        if isinstance(kind, T.StringType):
            return urls.redact_text(column, workspace, home)
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda item: walk(item, kind.elementType))
        if isinstance(kind, T.StructType):
            fields = [walk(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(column.isNotNull(), F.struct(*fields))
        return column

    return rows.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])


def secret_scan(texts: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, label) for every secret pattern found in a text.

    The pattern list is fixed and short, so each text is scanned once per
    pattern in place: no join.
    """
    found = [F.when(F.col(text).rlike(p), F.lit(label)) for label, p in (patterns or fv.SECRET_PATTERNS).items()]
    # outer: otherwise every pattern would run twice, once to drop texts without a hit
    return texts.select(key, F.explode_outer(F.array_compact(F.array(*found))).alias("label")).filter("label IS NOT NULL")
