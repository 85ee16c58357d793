"""Materialise staging and marts with the windowed replace (K4).

``rebuild_staging`` recomputes the trailing window of every staging table
from the raw tables and replaces exactly those days; ``rebuild_marts`` does
the same for the marts from the *stored* staging tables (the plain scan L2),
so a marts run never re-reads raw history.  Each call returns the rows
written per table, counted while they are written (for ``dim_product``, which
is upserted by key (K7), the buckets written).

Staging rows are stored by ``part_day``: the row's day, or its ingest day
when it has none (an item without posting), so such rows are kept and
replaced with their window like every other row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import marts, staging
from vitrine.schemas import MART_KEYS, STG_KEYS
from vitrine.sources import tables

PART = "part_day"
DIM_KEY = ("marketplace", "account_id", "product_id")


def _with_part(df: DataFrame) -> DataFrame:
    return df.withColumn(PART, F.coalesce(F.col("day"), F.to_date("ingested_at")))


def staging_frames(raw: dict[str, DataFrame], as_of: dt.date, days: int,
                   run_ts: dt.datetime, ingest_after_event: bool = False,
                   orders: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """T1–T12 for one window (lazy).  ``ingest_after_event`` asserts that versions
    are ingested no earlier than their event, so history before the window is skipped.
    ``orders`` gives a raw table's version order, where ``ingested_at`` alone leaves ties."""
    d = staging.clamp_days(days)
    iae = ingest_after_event
    order = lambda name: (orders or {}).get(name, ("ingested_at",))
    return {
        "stg_sales": staging.stg_sales(
            staging.wb_sales(raw["raw_wb_sales"], as_of, d, order("raw_wb_sales"), ingest_after_event=iae),
            staging.ozon_sales(raw["raw_ozon_posting_items"], raw["raw_ozon_postings"], as_of, d,
                               order("raw_ozon_posting_items"), order("raw_ozon_postings"))),
        "stg_orders": staging.stg_orders(staging.wb_orders(raw["raw_wb_orders"], as_of, d, order("raw_wb_orders"),
                                                           ingest_after_event=iae),
                                         staging.ozon_orders(raw["raw_ozon_postings"], as_of, d, order("raw_ozon_postings"),
                                                             ingest_after_event=iae)),
        "stg_stocks": staging.stg_stocks(staging.wb_stocks(raw["raw_wb_stocks"], as_of, d),
                                         staging.ozon_stocks(raw["raw_ozon_stocks"], as_of, d)),
        "stg_funnel_daily": staging.wb_funnel(raw["raw_wb_funnel_daily"], as_of, d),
        "stg_ads_daily": staging.ozon_ads(raw["raw_ozon_ads_daily"], as_of, max(60, d)),
        "stg_finance_ops": staging.ozon_finance(raw["raw_ozon_finance_ops"], as_of, max(60, d)),
    }


def rebuild_staging(spark: SparkSession, raw: dict[str, DataFrame], root: str, as_of: dt.date, days: int = 14,
                    run_ts: dt.datetime | None = None, ingest_after_event: bool = False,
                    orders: dict[str, tuple[str, ...]] | None = None, only: tuple[str, ...] = ()) -> dict[str, int]:
    """Replace the days from ``as_of − days`` on of every staging table (or of ``only`` those) under ``root``."""
    d = staging.clamp_days(days)
    out = {}
    ts = run_ts or dt.datetime.combine(as_of, dt.time())
    for name, df in staging_frames(raw, as_of, d, ts, ingest_after_event, orders).items():
        if only and name not in only:
            continue
        window = max(60, d) if name in ("stg_ads_daily", "stg_finance_ops") else d
        cutoff = as_of - dt.timedelta(days=window)
        out[name] = tables.windowed_replace(spark, f"{root}/{name}", _with_part(df), cutoff, day_col=PART,
                                            sort_by=tuple(k for k in STG_KEYS[name] if k != "day"),
                                            merge_key=tuple(STG_KEYS[name]))
    if only and "dim_product" not in only:
        return out
    order = lambda name: (orders or {}).get(name, ("ingested_at",))
    dim = staging.dim_product(
        staging.wb_dim_product(raw["raw_wb_sales"], as_of, d, ts, order("raw_wb_sales"), ingest_after_event=ingest_after_event),
        staging.ozon_dim_product(raw["raw_ozon_posting_items"], as_of, d, ts, order("raw_ozon_posting_items")))
    out["dim_product"] = tables.upsert(spark, f"{root}/dim_product", dim, DIM_KEY, "updated_at")
    return out


def rebuild_marts(spark: SparkSession, stg_root: str, root: str, as_of: dt.date, days: int = 14,
                  run_ts: dt.datetime | None = None, only: tuple[str, ...] = ()) -> dict[str, int]:
    """M5: replace the marts' window (of ``only`` those, if given) from the stored staging tables
    (ads at least 60 days)."""
    d = staging.clamp_days(days)
    ts = run_ts or dt.datetime.combine(as_of, dt.time())
    builders = {
        "mrt_sales_daily": ("stg_sales", marts.sales_daily, d),
        "mrt_stock_daily": ("stg_stocks", marts.stock_daily, d),
        "mrt_funnel_daily": ("stg_funnel_daily", marts.funnel_daily, d),
        "mrt_ads_daily": ("stg_ads_daily", marts.ads_daily, max(60, d)),
    }
    out = {}
    for name, (src, build, window) in builders.items():
        if only and name not in only:
            continue
        cutoff = as_of - dt.timedelta(days=window)
        # only the window's staging days are listed and read: a row with day >= cutoff is
        # stored under part_day = day (NULL-day rows fall out of every mart window anyway)
        stg = tables.read_table(spark, f"{stg_root}/{src}", day_from=cutoff)
        rows = None if stg is None else build(stg, as_of, window, ts)  # an emptied window empties the mart's
        out[name] = tables.windowed_replace(spark, f"{root}/{name}", rows, cutoff,
                                            sort_by=tuple(k for k in MART_KEYS[name] if k != "day"))
    return out
