"""M1–M5 daily marts and the V1/V2 rolling 30-day KPI views.

Money stays DECIMAL through every sum (exact and order-independent under any
shuffle); ratios divide two exact sums once, as doubles.  All marts are
grouped aggregations, so Spark runs a partial (map-side) aggregate before the
shuffle: a hot product or account is combined inside each map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.staging import clamp_days, day_window


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 when ``den`` is 0 (the reference's ``if(den = 0, 0, …)``)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def _stamp(run_ts: dt.datetime) -> Column:
    return F.lit(run_ts).cast("timestamp_ntz").alias("updated_at")


def sales_daily(stg_sales: DataFrame, as_of: dt.date, days: int, run_ts: dt.datetime) -> DataFrame:
    """M1: net qty; revenue only over non-returns; returns_qty is negative (Q4)."""
    s = stg_sales.where(day_window(F.col("day"), as_of, clamp_days(days)))
    ret = F.col("is_return") == 1
    return s.groupBy("day", "marketplace", "account_id", "product_id").agg(
        F.sum("qty").alias("qty"),
        F.coalesce(F.sum(F.when(~ret, F.col("price_gross") * F.col("qty"))),
                   F.lit(0).cast("decimal(38,2)")).alias("revenue"),
        F.sum("payout").alias("payout"),
        F.coalesce(F.sum(F.when(ret, F.col("qty"))), F.lit(0).cast("bigint")).alias("returns_qty"),
    ).select("*", _stamp(run_ts))


def stock_daily(stg_stocks: DataFrame, as_of: dt.date, days: int, run_ts: dt.datetime) -> DataFrame:
    """M2: amount at the day's latest snapshot; NULL warehouses group together."""
    s = stg_stocks.where(day_window(F.col("day"), as_of, clamp_days(days)))
    return s.groupBy("day", "marketplace", "account_id", "product_id", "warehouse_id").agg(
        F.max_by(F.col("amount"), F.struct("snapshot_ts", "ingested_at")).cast("bigint").alias("stock_end"),
    ).select("*", _stamp(run_ts))


def funnel_daily(stg_funnel: DataFrame, as_of: dt.date, days: int, run_ts: dt.datetime) -> DataFrame:
    """M3: sums and the two conversion ratios (0 when there are no views)."""
    s = stg_funnel.where(day_window(F.col("day"), as_of, clamp_days(days)))
    g = s.groupBy("day", "marketplace", "account_id", "product_id").agg(
        F.sum("views").alias("views"), F.sum("adds_to_cart").alias("adds_to_cart"),
        F.sum("orders").alias("orders"))
    return g.select("*", ratio(F.col("orders"), F.col("views")).alias("cr_order"),
                    ratio(F.col("adds_to_cart"), F.col("views")).alias("cr_cart"), _stamp(run_ts))


def ads_daily(stg_ads: DataFrame, as_of: dt.date, days: int, run_ts: dt.datetime) -> DataFrame:
    """M4: sums; acos = cost/revenue, romi = (revenue − cost)/cost, 0 on a zero divisor."""
    s = stg_ads.where(day_window(F.col("day"), as_of, clamp_days(days)))
    g = s.groupBy("day", "marketplace", "account_id", "campaign_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("cost").alias("cost"), F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
    return g.select("*", ratio(F.col("cost"), F.col("revenue")).alias("acos"),
                    ratio(F.col("revenue") - F.col("cost"), F.col("cost")).alias("romi"), _stamp(run_ts))


def kpi_sales_30d(mrt_sales: DataFrame, as_of: dt.date) -> DataFrame:
    """V1: revenue, qty and returns per channel and account over 30 days."""
    s = mrt_sales.where(day_window(F.col("day"), as_of, 30))
    return s.groupBy("marketplace", "account_id").agg(
        F.sum("revenue").alias("revenue_30d"), F.sum("qty").alias("qty_30d"),
        F.sum("returns_qty").alias("returns_30d"))


def kpi_ads_30d(mrt_ads: DataFrame, as_of: dt.date) -> DataFrame:
    """V2: cost, revenue and guarded cost/revenue over 30 days."""
    s = mrt_ads.where(day_window(F.col("day"), as_of, 30))
    g = s.groupBy("marketplace", "account_id").agg(
        F.sum("cost").alias("cost_30d"), F.sum("revenue").alias("revenue_30d"))
    return g.select("*", ratio(F.col("cost_30d"), F.col("revenue_30d")).alias("acos_30d"))
