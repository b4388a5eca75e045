"""Source and sink queries.

The given tables are written to the cluster's shared folder in the file formats
of the sources, then read back and checked against the original rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import numbers as nums
from hindcast.operators import quality
from hindcast.plans.registry import query
from hindcast.plans.series import POLICY_CHECK, TICKS_CTE
from hindcast.plans.views import view
from hindcast.session import materialize, shared_dir
from hindcast.sources import bars as bar_sources
from hindcast.sources import files as file_sources
from hindcast.sources import ledgers as ledger_sources

_OHLC = ["open", "high", "low", "close"]


def _kline_cells(bars):
    ms = F.floor(nums.micros(F.col("ts")) / 1000)
    cells = [ms, *[F.col(c) for c in _OHLC], F.lit(10), ms + 3599999, F.lit(1000), F.col("trade_count")]
    return F.array(*[c.cast("string") for c in cells])


def write_kline_archive(spark, sf) -> str:
    """One CSV per series and day; 'view' files have a header, the tenth of 'error' is cut short."""
    path = shared_dir(spark)
    bars = view(spark, sf, "bars").withColumn("day", F.to_date("ts")).withColumn("cells", _kline_cells(None))
    cut = (F.col("series_key") == "error") & (F.dayofmonth("day") == 10)
    lines = bars.select("series_key", "day", "row_no", F.array_join(F.when(cut, F.slice("cells", 1, 6)).otherwise(F.col("cells")), ",").alias("value"))
    heads = lines.filter("series_key = 'view'").select("series_key", "day").distinct().select(
        "series_key", "day", F.lit(-1).cast(lines.schema["row_no"].dataType).alias("row_no"),
        F.lit(",".join(bar_sources.KLINE_FIELDS)).alias("value"),
    )
    (
        lines.unionByName(heads)
        .repartition("series_key", "day")
        .sortWithinPartitions("series_key", "day", "row_no")
        .select("series_key", "day", "value")
        .write.partitionBy("series_key", "day")
        .text(path)
    )
    return path


@query(
    "scan_kline_csv",
    """SELECT series_key, ts, open, high, low, close, CAST(10 AS DOUBLE) AS volume, trade_count,
      row_number() OVER (PARTITION BY series_key, CAST(ts AS DATE) ORDER BY ts) AS place FROM {bars} WHERE NOT (series_key = 'error' AND extract(day FROM ts) = 10)""",
)
def scan_kline_csv_query(spark, sf):
    lines = bar_sources.scan_kline_csv(spark, write_kline_archive(spark, sf))
    bars = bar_sources.kline_bars(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    # place of the bar in its file, found from the file order alone
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("series_key", "source_file").orderBy("row_no"))
    return bars.withColumn("place", place).select("series_key", "ts", *_OHLC, "volume", "trade_count", "place")


@query(
    "kline_verdicts",
    """SELECT series_key, count(*) AS lines, CASE WHEN series_key = 'error' AND extract(day FROM any_value(ts)) = 10 THEN 'truncated_row' END AS reason
      FROM {bars} GROUP BY series_key, CAST(ts AS DATE)""",
)
def kline_verdicts_query(spark, sf):
    lines = bar_sources.scan_kline_csv(spark, write_kline_archive(spark, sf))
    return bar_sources.kline_verdicts(lines).select("series_key", "lines", "reason")


@query(
    "scan_kline_json",
    """SELECT series_key, ts, open, round(high, 8) AS high, low, close, trade_count, CASE WHEN series_key = 'click' AND extract(hour FROM ts) = 5 THEN 'truncated_row' END AS error
      FROM (SELECT * REPLACE (CASE WHEN series_key = 'click' AND extract(hour FROM ts) = 5 THEN NULL ELSE trade_count END AS trade_count) FROM {bars})""",
)
def scan_kline_json_query(spark, sf):
    cells = F.when(
        (F.col("series_key") == "click") & (F.hour("ts") == 5), F.slice("cells", 1, 8)
    ).otherwise(F.col("cells"))
    # a payload holds the bars of one day
    payloads = (
        view(spark, sf, "bars")
        .withColumn("cells", _kline_cells(None))
        .groupBy("series_key", F.to_date("ts").alias("day"))
        .agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row_no", cells.alias("cells")))), lambda r: r["cells"])).alias("payload"))
    )
    return bar_sources.scan_kline_json(payloads).select(
        "series_key", F.col("ts").cast("timestamp_ntz").alias("ts"), *_OHLC, "trade_count", "error"
    )


def write_series_csv(spark, sf) -> tuple[str, list[str]]:
    path, columns = shared_dir(spark), ["timestamp_utc", *_OHLC, "volume"]
    ticks = view(spark, sf, "ticks")
    (
        ticks.repartition("series_key")
        .sortWithinPartitions("series_key", "row_no")
        .select("series_key", *columns)
        .write.partitionBy("series_key")
        .option("header", True)
        .csv(path)
    )
    return path, columns


@query(
    "scan_series_csv",
    f"""WITH {TICKS_CTE} SELECT y.series_key, y.ts, y.ts_error, y.open, y.high, y.low, y.close,
      CASE WHEN y.fault IN (14, 18) THEN NULL WHEN y.fault = 15 THEN CAST(-1.5 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS volume, y.fault = 14 AS volume_invalid, FALSE AS extra_fields
      FROM (SELECT * REPLACE (substr(ts_error, 11) AS ts_error) FROM typed) y""",
)
def scan_series_csv_query(spark, sf):
    rows = bar_sources.scan_series_csv(spark, *write_series_csv(spark, sf))
    return rows.select(
        "series_key", F.col("ts").cast("timestamp_ntz").alias("ts"), "ts_error", *_OHLC, "volume", "volume_invalid", "extra_fields"
    )


@query(
    "scan_series_csv_verdicts",
    f"""WITH {TICKS_CTE}, no_counts AS (SELECT * FROM broken WHERE rank < 10),
      worst AS (SELECT series_key, count(*) AS violations, min(row_no) AS first_bad_row FROM no_counts GROUP BY 1)
    SELECT t.series_key, count(*) AS row_count, coalesce(any_value(w.violations), 0) AS violations,
      (SELECT arg_min(b.code, b.rank) FROM no_counts b WHERE b.series_key = t.series_key AND b.row_no = any_value(w.first_bad_row)) AS reason
    FROM typed t LEFT JOIN worst w ON w.series_key = t.series_key GROUP BY t.series_key""",
)
def scan_series_csv_verdicts_query(spark, sf):
    # the verdicts read their rows three times; files are parsed once
    rows = materialize(bar_sources.scan_series_csv(spark, *write_series_csv(spark, sf)))
    return quality.series_verdicts(rows).select("series_key", "row_count", "violations", "reason")


def _sidecar_payloads(spark, sf):
    """A metadata document per declared policy, with faults by part key."""
    p = view(spark, sf, "policies")
    k = F.col("series_key")
    name = k.cast("string")
    document = F.to_json(
        F.struct(
            F.when(k % 17 == 1, "0.9").otherwise("1.0").alias("schema_version"),
            F.when(k % 19 == 2, "other").otherwise(name).alias("series_key"),
            F.when(k % 23 == 3, F.repeat(F.lit("s"), 129)).otherwise("SYM").alias("symbol"),
            F.when(k % 29 == 4, "two\nlines").otherwise("venue").alias("venue"),
            F.when(k % 31 == 5, "Mars/Base").otherwise("Europe/Paris").alias("timezone"),
            F.lit("1h").alias("interval"),
            "cadence_seconds",
            F.when(k % 37 == 6, "close").otherwise("bar_close").alias("timestamp_semantics"),
            F.struct(F.col("session_type").alias("type"), "maximum_gap_seconds", "boundary_tolerance_seconds", "minimum_bars_per_24h").alias("session"),
            F.struct(
                F.when(k % 41 == 7, "").otherwise("Licence").alias("name"),
                F.when(k % 43 == 8, "maybe").otherwise("derived_only").alias("redistribution"),
                F.when(k % 47 == 9, "https://me@host/x").when(k % 2 == 0, "https://host/x").alias("source_url"),
            ).alias("license"),
        )
    )
    doubled = F.when(k % 53 == 10, F.regexp_replace(document, r"\}$", ',"venue":"again"}')).otherwise(document)
    return p.select(name.alias("series_key"), doubled.alias("payload"))


@query(
    "scan_series_sidecar",
    f"""WITH policy AS ({POLICY_CHECK})
      SELECT CAST(p.series_key AS VARCHAR) AS series_key, concat_ws(',', CASE WHEN p.series_key % 53 = 10 THEN 'duplicate_json_keys' END, CASE WHEN p.series_key % 17 = 1 THEN 'schema_version_unsupported' END,
        CASE WHEN p.series_key % 19 = 2 THEN 'series_key_mismatch' END, CASE WHEN p.series_key % 23 = 3 THEN 'symbol_missing_or_long' END,
        CASE WHEN p.series_key % 29 = 4 AND p.series_key % 53 <> 10 THEN 'venue_control_characters' END, CASE WHEN p.series_key % 31 = 5 THEN 'timezone_unknown' END,
        CASE WHEN p.series_key % 37 = 6 THEN 'timestamp_semantics_invalid' END, CASE WHEN p.policy_error IS NOT NULL THEN 'coverage_policy_invalid' END,
        CASE WHEN p.series_key % 41 = 7 THEN 'license_name_missing_or_long' END, CASE WHEN p.series_key % 43 = 8 THEN 'license_redistribution_invalid' END,
        CASE WHEN p.series_key % 47 = 9 THEN 'license_source_url_invalid' END) AS errors FROM policy p""",
)
def scan_series_sidecar_query(spark, sf):
    return bar_sources.scan_series_sidecar(_sidecar_payloads(spark, sf)).select(
        F.col("expected_key").alias("series_key"), F.array_join("errors", ",").alias("errors")
    )


@query(
    "series_dimension",
    f"""WITH policy AS ({POLICY_CHECK}),
      s AS (SELECT p.series_key AS k, CASE WHEN p.series_key % 53 = 10 THEN 'duplicate_json_keys' WHEN p.series_key % 17 = 1 THEN 'schema_version_unsupported'
        WHEN p.series_key % 19 = 2 THEN 'series_key_mismatch' WHEN p.series_key % 23 = 3 THEN 'symbol_missing_or_long' WHEN p.series_key % 29 = 4 THEN 'venue_control_characters'
        WHEN p.series_key % 31 = 5 THEN 'timezone_unknown' WHEN p.series_key % 37 = 6 THEN 'timestamp_semantics_invalid' WHEN p.policy_error IS NOT NULL THEN 'coverage_policy_invalid'
        WHEN p.series_key % 41 = 7 THEN 'license_name_missing_or_long' WHEN p.series_key % 43 = 8 THEN 'license_redistribution_invalid' WHEN p.series_key % 47 = 9 THEN 'license_source_url_invalid' END AS first_error FROM policy p),
      n AS (SELECT l_partkey, count(*) AS row_count FROM {{lineitem}} GROUP BY 1)
      SELECT CAST(k AS VARCHAR) AS series_key, CASE WHEN first_error IS NULL AND n.row_count > 0 THEN 'available' ELSE 'unavailable' END AS status, coalesce(n.row_count, 0) AS row_count,
        coalesce(first_error, CASE WHEN n.row_count IS NULL THEN 'CSV contains no rows inside the audit window' END) AS error FROM s LEFT JOIN n ON n.l_partkey = k""".replace("{{", "{").replace("}}", "}"),
)
def series_dimension_query(spark, sf):
    sidecars = bar_sources.scan_series_sidecar(_sidecar_payloads(spark, sf))
    inside = view(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("series_key"))
    verdicts = inside.distinct().withColumn("reason", F.lit(None).cast("string"))
    return bar_sources.series_dimension(sidecars, verdicts, inside).select("series_key", "status", "row_count", "error")


@query(
    "scan_hourly_history",
    "SELECT series_key, ts, open, round(high, 8) AS high, low, CASE WHEN trade_count % 7 = 2 THEN NULL ELSE close END AS close FROM {bars} WHERE trade_count % 7 <> 1",
)
def scan_hourly_history_query(spark, sf):
    n = F.col("trade_count") % 7
    bars = view(spark, sf, "bars")
    hide = lambda c, test: F.when(~test, F.col(c)).alias(c)
    frame = bars.select(
        "series_key", (F.col("ts") + F.expr("INTERVAL '2' HOUR")).cast("timestamp").alias("ts"),
        *[hide(c, n == 1) for c in ("open", "high", "low")], hide("close", (n == 1) | (n == 2)), F.lit(1.0).alias("volume"),
    )
    return bar_sources.scan_hourly_history(frame, "+02:00").select(
        "series_key", F.col("ts").cast("timestamp_ntz").alias("ts"), *_OHLC
    )


# --- ledgers ----------------------------------------------------------------------------------------


@query(
    "scan_source_ledger",
    """SELECT CASE WHEN doc_id % 7 = 3 THEN 'no id!' WHEN doc_id % 11 = 5 THEN NULL ELSE video_id END AS video_id, CASE WHEN doc_id % 11 <> 5 THEN upload_date_raw END AS upload_date,
      coalesce(doc_id % 11 <> 5 AND length(upload_date_raw) = 8 AND upload_date_raw BETWEEN '20240105' AND '20240120', FALSE) AS in_range,
      CASE WHEN doc_id % 11 = 5 THEN 'not_a_json_object' WHEN doc_id % 7 = 3 THEN 'video_id_unsafe' END AS error
      FROM (SELECT * REPLACE (CASE WHEN doc_id % 11 = 5 THEN NULL ELSE upload_date_raw END AS upload_date_raw) FROM {videos})
      QUALIFY TRUE""".replace("QUALIFY TRUE", "").replace(
        "CASE WHEN doc_id % 7 = 3 THEN 'no id!' WHEN doc_id % 11 = 5 THEN NULL ELSE video_id END AS video_id",
        "CASE WHEN doc_id % 11 = 5 THEN NULL WHEN doc_id % 7 = 3 THEN 'no id!' ELSE video_id END AS video_id",
    ),
)
def scan_source_ledger_query(spark, sf):
    i = F.col("doc_id")
    record = F.to_json(
        F.struct(
            F.when(i % 7 == 3, "no id!").otherwise(F.col("video_id")).alias("id"), "title",
            F.col("upload_date_raw").alias("upload_date"), "channel_id", "description",
        )
    )
    path = shared_dir(spark)
    view(spark, sf, "videos").select(F.when(i % 11 == 5, "{broken").otherwise(record).alias("value")).write.text(path)
    return ledger_sources.scan_source_ledger(spark, path, "20240105", "20240120").select("video_id", "upload_date", "in_range", "error")


@query(
    "scan_provided_sources",
    """SELECT CASE WHEN doc_id % 13 = 4 THEN 'a b' ELSE video_id END AS video_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled provided source' ELSE title END AS title,
      CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER) END AS upload_date,
      CASE WHEN doc_id % 19 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 08:30:00' END AS published_at, CASE WHEN doc_id % 23 = 0 THEN 0 ELSE CAST(doc_id % 100 + 1 AS DOUBLE) END AS duration_seconds,
      CASE WHEN doc_id % 29 = 0 THEN 'Bad Category' ELSE category END AS category, CASE doc_id % 3 WHEN 0 THEN 'und' WHEN 1 THEN 'en-US' ELSE 'x_y' END AS transcript_language, substr(description, 1, 500) AS description,
      CASE WHEN length(description) > 500 THEN 'description' ELSE '' END AS cuts,
      concat_ws(',', CASE WHEN channel_key <> 'src1' THEN 'channel_mismatch' END, CASE WHEN doc_id % 13 = 4 THEN 'video_id_unsafe' END, CASE WHEN doc_id % 13 = 4 AND n > 1 THEN 'video_id_repeated' END, CASE WHEN doc_id % 17 = 0 THEN 'upload_date_invalid' END,
        CASE WHEN doc_id % 19 = 0 THEN 'published_at_invalid' END, CASE WHEN doc_id % 37 = 0 THEN 'transcript_extension_unsupported' END, CASE WHEN doc_id % 29 = 0 THEN 'category_unsafe' END,
        CASE WHEN doc_id % 23 = 0 THEN 'duration_out_of_range' END) AS errors
      FROM (SELECT *, (SELECT count(*) FROM {documents} WHERE doc_id % 13 = 4) AS n FROM {videos})
      WHERE doc_id % 17 = 0 OR doc_id % 31 BETWEEN 4 AND 19
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', error FROM (VALUES ('not_a_json_object'), ('no_videos')) AS broken(error)""",
)
def scan_provided_sources_query(spark, sf):
    i = F.col("doc_id")
    video = F.struct(
        F.when(i % 13 == 4, "a b").otherwise(F.col("video_id")).alias("video_id"),
        F.when(i % 5 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(i % 17 == 0, "soon").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (i % 31).cast("int")).cast("string")).alias("upload_date"),
        F.when(i % 19 == 0, "2024-01-01T08:30:00").otherwise("2024-01-01T10:30:00+02:00").alias("published_at_utc"),
        F.when(i % 23 == 0, 0.0).otherwise((i % 100 + 1).cast("double")).alias("duration_seconds"),
        F.when(i % 29 == 0, "Bad Category").otherwise(F.col("category")).alias("category"),
        F.when(i % 3 == 1, "-en US-").when(i % 3 == 2, "x_y").alias("transcript_language"),
        F.when(i % 37 == 0, "t/file.doc").otherwise("t/file.SRT").alias("transcript_path"),
        "description",
    )
    # one file holds a bounded slice of a channel's videos
    path = shared_dir(spark)
    listed = view(spark, sf, "videos").groupBy(F.col("channel_key").alias("channel_id"), F.floor(i / 1000).alias("part")).agg(F.collect_list(video).alias("videos"))
    broken = spark.createDataFrame([('{"channel_id": ',), ('{"channel_id": "src1", "videos": []}',)], "value string")
    listed.select(F.to_json(F.struct("channel_id", "videos")).alias("value")).union(broken).write.text(path)
    rows = ledger_sources.scan_provided_sources(spark, path, "2024-01-05", "2024-01-20", channel_id="src1", max_description=500)
    return rows.withColumns({"errors": F.array_join("errors", ","), "cuts": F.array_join("cuts", ",")})


@query(
    "scan_jsonl",
    """SELECT CASE WHEN doc_id % 9 = 4 THEN NULL ELSE doc_id END AS doc_id, CASE WHEN doc_id % 9 = 4 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 9 = 4 THEN NULL ELSE lang END AS lang, doc_id % 9 = 4 AS corrupt
      FROM {documents}""",
)
def scan_jsonl_query(spark, sf):
    i = F.col("doc_id")
    path = shared_dir(spark)
    row = F.to_json(F.struct("doc_id", "text", "lang"))
    # every line is followed by a blank one now and then; some lines are cut off
    value = F.when(i % 9 == 4, F.lit('{"doc_id": ')).when(i % 6 == 0, F.concat(row, F.lit("\n\n"))).otherwise(row)
    view(spark, sf, "documents").select(value.alias("value")).write.text(path)
    rows = ledger_sources.scan_jsonl(spark, path, "doc_id bigint, text string, lang string")
    return rows.select("doc_id", "text", "lang", F.col(ledger_sources.CORRUPT).isNotNull().alias("corrupt"))


@query("sink_jsonl", "SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id % 3 > 0 THEN props END AS props FROM {events}")
def sink_jsonl_query(spark, sf):
    path = shared_dir(spark)
    events = view(spark, sf, "events").withColumn("props", F.when(F.col("event_id") % 3 > 0, F.col("props")))
    ledger_sources.sink_jsonl(events, path)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return ledger_sources.scan_jsonl(spark, path, schema).drop(ledger_sources.CORRUPT)


@query("sink_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders}")
def sink_csv_query(spark, sf):
    path = shared_dir(spark)
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    ledger_sources.sink_csv(view(spark, sf, "orders"), path, columns)
    return ledger_sources.scan_csv(
        spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    )


# --- whole files ---------------------------------------------------------------------------------------


def write_batches(spark, sf) -> str:
    """Documents as text files of fifty each, in id order."""
    path = shared_dir(spark)
    docs = view(spark, sf, "documents").withColumn("batch", F.floor(F.col("doc_id") / 50))
    (
        docs.repartition("batch")
        .sortWithinPartitions("batch", "doc_id")
        .select("batch", F.col("text").alias("value"))
        .write.partitionBy("batch")
        .text(path)
    )
    return path


_BATCHES = "SELECT CAST(floor(doc_id / 50) AS BIGINT) AS batch, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM {documents} GROUP BY 1"


@query("scan_transcripts", f"SELECT CAST(batch AS VARCHAR) AS video_id, body AS text, FALSE AS too_large FROM ({_BATCHES})")
def scan_transcripts_query(spark, sf):
    return file_sources.scan_transcripts(spark, write_batches(spark, sf), r"batch=(\d+)/")


@query(
    "scan_file_inventory",
    f"SELECT 'raw' AS scope, 'batch=' || batch AS folder, CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256 FROM ({_BATCHES})",
)
def scan_file_inventory_query(spark, sf):
    path = write_batches(spark, sf)
    files = file_sources.scan_file_inventory(spark, path, "raw").filter("relative_path LIKE '%.txt'")
    return files.select("scope", F.regexp_extract("relative_path", "^([^/]+)/", 1).alias("folder"), "size_bytes", "sha256")
