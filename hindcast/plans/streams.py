"""Streaming queries: each drains a file stream, then returns its sink table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.plans import outcomes as oc
from hindcast.plans.registry import query
from hindcast.plans.series import TICKS_CTE, typed_ticks
from hindcast.plans.views import view
from hindcast.session import shared_dir, use_utc
from hindcast.streaming import bars as bar_streams
from hindcast.streaming import outcomes as outcome_streams
from hindcast.streaming.tables import parquet_stream, read_batches


def _as_files(rows, spark, parts: int = 1, order: str | None = None) -> str:
    """A derived table as parquet files a stream can read, cut into parts along a column if several are asked for."""
    path = f"{shared_dir(spark)}/source"
    (rows.repartitionByRange(parts, order) if parts > 1 else rows).write.parquet(path)
    return path


def _parts_in_order(rows: DataFrame, order: str, parts: int) -> list[DataFrame]:
    """A table cut along a whole number, each part wholly before the next; rows without one come last."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return [rows]
    at, cuts = F.col(order), [low + (high - low + 1) * k // parts for k in range(1, parts)]
    inner = [rows.filter((at >= a) & (at < b)) for a, b in zip(cuts, cuts[1:])]
    return [rows.filter(at < cuts[0]), *inner, rows.filter((at >= cuts[-1]) | at.isNull())]


@query("stream_validate_bars", f"WITH {TICKS_CTE} SELECT series_key, row_no, rank, code FROM broken")
def stream_validate_bars_query(spark, sf):
    root = shared_dir(spark)
    # a file stream takes files as they were finished, not in the order of their rows, so each part comes after
    # the one before it has been read; every batch but the first meets carried state
    for part in _parts_in_order(typed_ticks(spark, sf), "row_no", 4):
        part.write.mode("append").parquet(f"{root}/source")
        bar_streams.stream_validate_bars(parquet_stream(spark, f"{root}/source"), root, f"{root}/checkpoint")
    return read_batches(spark, f"{root}/violations").drop("batch")


@query(
    "stream_gap_monitor",
    """WITH spaced AS (SELECT event_type AS series_key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) <= 3636000000 THEN 0 ELSE 1 END AS fresh FROM {events}),
      numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY series_key ORDER BY ts) AS stretch FROM spaced),
      stretches AS (SELECT series_key, count(*) AS bar_count, min(ts) AS first_ts, max(ts) AS last_ts FROM numbered GROUP BY series_key, stretch)
      SELECT * FROM stretches""",
)
def stream_gap_monitor_query(spark, sf):
    use_utc(spark)
    root = shared_dir(spark)
    events = parquet_stream(spark, f"{sf}/events.parquet")
    bars = events.select(
        F.col("event_type").alias("series_key"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(3600.0).alias("cadence_seconds"), F.lit(3600.0).alias("maximum_gap_seconds"),
    )
    bar_streams.stream_gap_monitor(bars, root, f"{root}/checkpoint", idle_seconds=2.0)
    rows = bar_streams.latest_stretches(read_batches(spark, f"{root}/stretches"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query(
    "stream_outcome_windows",
    f"""WITH {oc.WINDOW_CTE.replace("TIMESTAMP '2024-01-29 00:00:00'", "(SELECT max(ts) FROM {bars})")},
      settled AS (SELECT claim_id, asset_pos FROM outcomes GROUP BY ALL HAVING bool_and(status NOT IN ('window_not_elapsed', 'no_bar_after_publication')))
      SELECT o.claim_id, o.asset_pos, o.hours, o.status FROM outcomes o JOIN settled s ON s.claim_id = o.claim_id AND s.asset_pos = o.asset_pos""",
)
def stream_outcome_windows_query(spark, sf):
    root = shared_dir(spark)
    # one series after the other, two files a batch: every batch but the first meets carried state
    bars = parquet_stream(spark, _as_files(view(spark, sf, "bars"), spark, 4, "series_key"), 2)
    assets = oc.available_assets(spark, sf).select("claim_id", "asset_pos", "series_key", "anchor")
    outcome_streams.stream_outcome_windows(bars, assets, view(spark, sf, "series"), root, f"{root}/checkpoint")
    return read_batches(spark, f"{root}/settled").select("claim_id", "asset_pos", "hours", "status")


@query(
    "stream_score_rollup",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS total_claims, count(*) FILTER (WHERE event_id % 3 > 0) AS counted_claims,
      sum(CASE event_id % 3 WHEN 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) FILTER (WHERE event_id % 3 > 0) AS points FROM {events} GROUP BY ALL""",
)
def stream_score_rollup_query(spark, sf):
    use_utc(spark)
    root = shared_dir(spark)
    third = F.col("event_id") % 3
    scores = parquet_stream(spark, f"{sf}/events.parquet").select(
        "ts", "event_type", (third > 0).alias("counts_in_final_score"), F.when(third == 1, 1.0).otherwise(0.5).alias("score")
    )
    outcome_streams.stream_score_rollup(scores, root, f"{root}/checkpoint", ["event_type"])
    return outcome_streams.latest_rollup(read_batches(spark, f"{root}/rollup"), ["event_type"])
