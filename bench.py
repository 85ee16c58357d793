"""Benchmark: wall time of the headline plans at one scale factor.

Usage: BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is run to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver); the first run of the session
warms the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vitrine.plans import catalog  # noqa: E402
from vitrine.session import build_session  # noqa: E402

HEADLINE = (
    "l1_latest_wb_sales",          # latest-wins dedup over all sales versions
    "t12_stg_sales",               # both channels: dedup + left join + union
    "t2_t6_stg_orders",
    "t3_t7_stg_stocks",
    "m1_mrt_sales_daily",          # raw → stg → mart
    "m2_mrt_stock_daily",
    "m3_mrt_funnel_daily",
    "m4_mrt_ads_daily",
    "a1_api_sales_daily",          # flagship API read
    "a1_api_sales_daily_page",
    "a5_api_kpis",
    "d2_top_products_30d",
    "c6_quality_summary",          # all five checks, exact counts
    "r5_r7_alerts",
    "o5_p95_duration_15m",
    "p1_s9_wb_sales_from_json",    # JSON pages → raw rows
    "p5_s9_ozon_postings_from_json",
    "s10_postings_schema_merge",
)


def stored_path(spark, sf_dir: str, reads_n: int = 20) -> dict:
    """The production path, shaped like the reference's smoke: rebuild 14 days of
    staging and marts into stored tables, then page the sales API over them."""
    import datetime as dt
    import uuid

    from vitrine.operators import reads
    from vitrine.plans import rebuild
    from vitrine.session import checkpoint_dir
    from vitrine.sources import bindings as B
    from vitrine.sources import tables

    root = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    wh = B.Warehouse(spark, sf_dir)
    raw = {n: wh.raw(n) for n in ("raw_wb_sales", "raw_wb_orders", "raw_wb_stocks", "raw_wb_funnel_daily",
                                  "raw_ozon_postings", "raw_ozon_posting_items", "raw_ozon_stocks",
                                  "raw_ozon_ads_daily", "raw_ozon_finance_ops")}
    t0 = time.perf_counter()
    rebuild.rebuild_staging(spark, raw, f"{root}/stg", B.AS_OF, days=14, ingest_after_event=B.INGEST_AFTER_EVENT)
    t_stg = time.perf_counter() - t0
    t0 = time.perf_counter()
    rebuild.rebuild_marts(spark, f"{root}/stg", f"{root}/mrt", B.AS_OF, days=14)
    t_mrt = time.perf_counter() - t0
    page = reads.Page(B.AS_OF - dt.timedelta(days=14), B.AS_OF, limit=100)
    lat = []
    for _ in range(reads_n):
        t0 = time.perf_counter()
        mrt = tables.read_table(spark, f"{root}/mrt/mrt_sales_daily", day_from=page.date_from, day_to=page.date_to)
        reads.sales_daily(mrt, page, reaggregate=False).collect()  # at most limit + 1 rows reach the driver
        lat.append((time.perf_counter() - t0) * 1000)
    lat.sort()
    return {"stored_transform_backfill_14d_sec": round(t_stg, 3), "stored_marts_backfill_14d_sec": round(t_mrt, 3),
            "stored_api_sales_daily_p50_ms": round(lat[len(lat) // 2], 1),
            "stored_api_sales_daily_p95_ms": round(lat[min(len(lat) - 1, int(0.95 * len(lat)))], 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="vitrine-bench")
    spark.sparkContext.setLogLevel("ERROR")

    rows: dict[str, int] = {}

    def run(name: str) -> float:
        t0 = time.perf_counter()
        obs = Observation(f"bench_{name}_{time.time_ns()}")
        catalog.run(spark, sf_dir, name).observe(obs, F.count(F.lit(1)).alias("n")) \
            .write.format("noop").mode("overwrite").save()
        rows[name] = int(obs.get["n"])  # counted by the same job
        return time.perf_counter() - t0

    errors: dict[str, str] = {}

    def timed(name: str) -> float | None:
        try:
            return round(run(name), 3)
        except Exception as e:  # keep the record: one failed plan must not lose the line
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return None

    timed(names[0])  # warm-up (JIT, class loading, file listing caches)
    errors.clear()
    times = {n: t for n in names if (t := timed(n)) is not None}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    staged = [n for n in ("t12_stg_sales", "t2_t6_stg_orders", "t3_t7_stg_stocks") if n in times]
    marted = [n for n in ("m1_mrt_sales_daily", "m2_mrt_stock_daily", "m3_mrt_funnel_daily", "m4_mrt_ads_daily")
              if n in times]
    ingest = [n for n in ("p1_s9_wb_sales_from_json", "p5_s9_ozon_postings_from_json") if n in times]
    derived = {
        "ingest_rows_per_sec": round(sum(rows[n] for n in ingest) / max(1e-9, sum(times[n] for n in ingest)), 1)
        if ingest else None,
        "transform_backfill_sec": round(sum(times[n] for n in staged), 3) if staged else None,
        "marts_backfill_sec": round(sum(times[n] for n in marted), 3) if marted else None,
        "api_sales_daily_page_sec": times.get("a1_api_sales_daily_page"),
    }
    if os.environ.get("BENCH_STORED", "1") == "1":
        try:
            derived.update(stored_path(spark, sf_dir))
        except Exception as e:
            errors["stored_path"] = f"{type(e).__name__}: {str(e)[:200]}"
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "derived": derived, "errors": errors,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
