"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is planned and run to the end (all columns, no rows kept). The first
run of a small query warms the JVM up and is not counted. Beside each time stand a second
run (without first-time planning and code generation), the rows of the source tables it
reads per second, and what DuckDB takes for the checking SQL (null beyond ``DUCKDB_LIMIT`` seconds).
"""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hindcast.plans import catalog  # noqa: E402
from hindcast.plans.views import TABLES  # noqa: E402
from hindcast.session import build_session  # noqa: E402

HEADLINE = [
    "claim_outcomes",
    "level_events",
    "validate_ohlc",
    "window_supported",
    "deterministic_exclusion",
    "score_contract_check",
    "score_aggregate",
    "hero_verdict",
    "top_strongest_weakest",
    "diverse_examples",
    "canonicalize_subtitle",
    "evidence_coverage",
    "classify_category",
    "keyword_theta_join",
    "set_fingerprint",
    "inventory_verify",
    "hash_chain_verify",
    "reconcile_ledgers",
    "usage_cost",
]


DUCKDB_LIMIT = 20.0


def duckdb_seconds(con: duckdb.DuckDBPyConnection, sql: str) -> float | None:
    """Time of the checking SQL, or None where it is stopped."""
    stop = threading.Timer(DUCKDB_LIMIT, con.interrupt)
    stop.start()
    began = time.perf_counter()
    try:
        con.execute(f"CREATE OR REPLACE TEMP TABLE _bench AS SELECT * FROM ({sql})")
        return round(time.perf_counter() - began, 3)
    except duckdb.Error:
        return None
    finally:
        stop.cancel()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    plans = catalog.queries()
    chosen = sys.argv[1:] or HEADLINE
    plans["score_aggregate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    checks, con = catalog.oracle_sql(), duckdb.connect()
    con.execute(f"SET threads = {cpus}")
    rows = {}
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        rows[name] = con.execute(f"SELECT count(*) FROM {name}").fetchall()[0][0]
    times: dict[str, float] = {}
    second: dict[str, float] = {}
    speed: dict[str, int] = {}
    other: dict[str, float | None] = {}
    for name in chosen:
        for kept in (times, second):
            began = time.perf_counter()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            kept[name] = round(time.perf_counter() - began, 3)
        sql = checks.get(name, "")
        read = sum(n for table, n in rows.items() if re.search(rf"\b{table}\b", sql))
        speed[name] = round(read / second[name])
        other[name] = duckdb_seconds(con, sql) if sql else None
        print(f"{name} {times[name]} {second[name]} {other[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "second_run": second,
                "rows_per_second": speed,
                "duckdb": other,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
