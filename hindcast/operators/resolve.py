"""Dimension resolution: asset aliases, series and keyword categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import text as tx


def normalize_asset(alias: Column) -> Column:
    return F.translate(F.upper(alias), "–— /", "--")


def default_registry(spark: SparkSession) -> DataFrame:
    """The fixed alias table (a few dozen rows)."""
    rows = [(alias, key, note) for alias, (key, note) in fv.ASSET_SOURCES.items()]
    return spark.createDataFrame(rows, "alias string, series_key string, proxy_note string")


def asset_registry(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Operator entries win over defaults with the same normalized alias."""
    own = overrides.select(normalize_asset(F.col("alias")).alias("alias"), "series_key", "proxy_note")
    return own.unionByName(defaults.join(own, "alias", "left_anti"))


def explode_assets(claims: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (claim, asset position)."""
    return claims.select(*keep, F.posexplode("assets").alias("asset_pos", "asset"))


def resolve_asset(claim_assets: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``series_key`` and ``proxy_note``; null when no alias matches.

    The registry is configuration, a few hundred rows at most; AQE broadcasts
    it by its measured size.
    """
    return claim_assets.withColumn("alias", normalize_asset(F.col("asset"))).join(registry, "alias", "left")


def classify_unresolved(resolved: DataFrame) -> DataFrame:
    """Status and reason for assets without a series."""
    unresolved = F.col("series_key").isNull()
    reasons = F.create_map(*[F.lit(x) for item in fv.UNSUPPORTED_EXACT.items() for x in item])
    return resolved.withColumn(
        "unresolved_status",
        F.when(
            unresolved,
            F.when(F.col("alias").isin(fv.NON_PRICE_CONTEXT), "out_of_scope_non_price").otherwise(
                "unsupported_asset"
            ),
        ),
    ).withColumn(
        "unresolved_reason",
        F.when(unresolved, F.coalesce(F.try_element_at(reasons, F.col("alias")), F.lit(fv.UNMAPPED_REASON))),
    )


def join_series(resolved: DataFrame, series: DataFrame) -> DataFrame:
    """Left join to the series dimension; adds the asset status and reason."""
    dim = series.withColumnRenamed("status", "series_status").withColumnRenamed("error", "series_error")
    usable = F.col("series_status") == "available"
    return (
        resolved.join(dim, "series_key", "left")
        .withColumn(
            "asset_status",
            F.when(F.col("series_key").isNull(), F.col("unresolved_status"))
            .when(usable, "available")
            .otherwise("data_unavailable"),
        )
        .withColumn(
            "asset_reason",
            F.when(F.col("series_key").isNull(), F.col("unresolved_reason")).when(
                ~F.coalesce(usable, F.lit(False)),
                F.coalesce("series_error", F.lit(fv.UNAVAILABLE_REASON)),
            ),
        )
    )


def precision_gate(claims: DataFrame) -> DataFrame:
    """Date-only publication stamps cannot be aligned with intraday bars."""
    return claims.withColumn(
        "precise", ~F.col("published_at_source").eqNullSafe(F.lit("date_noon_fallback"))
    )


def prune_referenced_series(bars: DataFrame, resolved: DataFrame) -> DataFrame:
    """Only bars whose series some claim refers to."""
    wanted = resolved.select("series_key").filter("series_key IS NOT NULL").distinct()
    return bars.join(wanted, "series_key", "left_semi")


def join_claim_video(claims: DataFrame, videos: DataFrame) -> DataFrame:
    return claims.join(videos.select("video_id", "published_at", "published_at_source"), "video_id")


def category_expr(normalized: Column, rules: dict[str, list[str]]) -> Column:
    """First category in rule order with a whole-word keyword in search text."""
    return F.coalesce(
        *[F.when(normalized.rlike(tx.any_keyword_pattern(words)), F.lit(category)) for category, words in rules.items()]
    )


def merge_rules(custom: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Custom rules first, then the defaults they do not replace."""
    custom = custom or {}
    return {**custom, **{k: v for k, v in fv.CATEGORY_RULES.items() if k not in custom}}


def classify_category(
    videos: DataFrame, overrides: DataFrame | None = None, rules: dict[str, list[str]] | None = None
) -> DataFrame:
    """Explicit category, else override, else title rules, else description rules."""
    rules = rules or merge_rules()
    rows = videos
    if overrides is not None:
        rows = videos.join(overrides.withColumnRenamed("category", "_override"), "video_id", "left")
    known = [F.col("_override")] if overrides is not None else []
    if "audit_category" in videos.columns:
        known.insert(0, F.nullif(F.col("audit_category"), F.lit("")))
    # long descriptions are only normalized and scanned where nothing before them decides
    rows = rows.withColumn("_title", tx.search_text(F.col("title")))
    rows = rows.withColumn("_early", F.coalesce(*known, category_expr(F.col("_title"), rules)))
    rows = rows.withColumn("_body", F.when(F.col("_early").isNull(), tx.search_text(F.col("description"))))
    decided = F.coalesce(F.col("_early"), category_expr(F.col("_body"), rules), F.lit("unknown"))
    return rows.withColumn("category", decided).drop("_override", "_title", "_early", "_body")


def keyword_theta_join(texts: DataFrame, text: str, rules: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Every (text, category, keyword) match.

    The rule list is fixed configuration, so the theta condition is unrolled
    into one array per row instead of joining: no pair is ever materialised for
    a keyword that does not occur.
    """
    normalized = F.col("_normalized")
    hits = [
        F.when(
            normalized.contains(tx.python_search_text(word)) & normalized.rlike(tx.any_keyword_pattern([word])),
            F.struct(F.lit(order).alias("rule_order"), F.lit(category).alias("category"), F.lit(word).alias("keyword")),
        )
        for order, (category, words) in enumerate(rules.items())
        for word in words
    ]
    return texts.withColumn("_normalized", tx.search_text(F.col(text))).select(
        *keep, F.inline_outer(F.array_compact(F.array(*hits)))
    ).filter("keyword IS NOT NULL")


def keyword_dictionary_join(texts: DataFrame, text: str, rules: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """``keyword_theta_join`` for rule lists of any length.

    Keywords are a table, joined by equality with the token runs of each text that are as long as some keyword.
    A run counts once per text row. The plan does not grow with the rules, and the table is broadcast
    only while its size allows. Blank keywords name nothing; null texts match nothing.
    """
    rows, lengths = [], set()
    for order, (category, words) in enumerate(rules.items()):
        for word in words:
            if gram := tx.python_search_text(word):
                rows.append((gram, order, category, word))
                lengths.add(len(tx.python_tokens(gram)))
    dictionary = texts.sparkSession.createDataFrame(rows, "_gram string, rule_order int, category string, keyword string")
    tokens = texts.withColumn("_tokens", tx.tokens_of(tx.search_text(F.col(text))))
    tokens = tokens.withColumn("_words", tx.are_words(F.col("_tokens")))
    grams = tokens.select(*keep, F.explode_outer(tx.whole_word_grams(F.col("_tokens"), F.col("_words"), sorted(lengths))).alias("_gram"))
    return grams.join(dictionary, "_gram").drop("_gram")
