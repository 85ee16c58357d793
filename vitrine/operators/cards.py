"""The summary cards the web UI computes over API results.

Each card is one global aggregate (partial per task, a one-row final merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(c: str) -> Column:
    """Column total, NULL as 0."""
    return F.coalesce(F.sum(F.col(c)), F.lit(0))


def mean_ratio(c: str) -> Column:
    """Unweighted mean of row ratios, 0 for no rows.

    Rounded to 9 decimals: a double sum's last bit depends on the summation
    order, which a shuffle does not fix.
    """
    return F.round(F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)), 9)


def grouped_series(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Sum of ``value`` per label, sorted by label (NULL label → '')."""
    return (rows.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
            .agg(total(value).alias("value")).orderBy("label"))


def top_rows(rows: DataFrame, by: str = "revenue", k: int = 10, tie: tuple[str, ...] = ()) -> DataFrame:
    """U4: top-k rows by ``by`` (descending, then ``tie`` columns)."""
    return rows.orderBy(F.col(by).desc_nulls_last(), *tie).limit(k)


def overview(sales: DataFrame, ads: DataFrame, stocks: DataFrame) -> DataFrame:
    """Revenue, qty, ad cost, stock units and row counts in one row — one
    global aggregate over the three inputs stacked (no join)."""
    z = lambda t: F.lit(None).cast(t)
    one = F.lit(1)
    stacked = (sales.select(F.col("revenue").cast("decimal(38,2)").alias("revenue"), F.col("qty").cast("bigint").alias("qty"),
                            one.alias("s"), z("decimal(38,2)").alias("cost"), z("int").alias("a"),
                            z("bigint").alias("stock_end"), z("int").alias("k"))
               .unionByName(ads.select(z("decimal(38,2)").alias("revenue"), z("bigint").alias("qty"), z("int").alias("s"),
                                       F.col("cost").cast("decimal(38,2)").alias("cost"), one.alias("a"),
                                       z("bigint").alias("stock_end"), z("int").alias("k")))
               .unionByName(stocks.select(z("decimal(38,2)").alias("revenue"), z("bigint").alias("qty"),
                                          z("int").alias("s"), z("decimal(38,2)").alias("cost"), z("int").alias("a"),
                                          F.col("stock_end").cast("bigint").alias("stock_end"), one.alias("k"))))
    return stacked.agg(total("revenue").alias("revenue"), total("qty").alias("qty"),
                       F.count("s").alias("sales_rows"), total("cost").alias("ad_cost"), F.count("a").alias("ads_rows"),
                       total("stock_end").alias("stock_units"), F.count("k").alias("stock_rows"))


def sales_card(rows: DataFrame) -> DataFrame:
    """U6."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), total("revenue").alias("revenue"),
                    total("qty").alias("qty"), total("returns_qty").alias("returns"),
                    total("payout").alias("payout"))


def stock_card(rows: DataFrame, threshold: int = 5) -> DataFrame:
    """Rows and rows with stock_end at or below the threshold."""
    return rows.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.coalesce(F.col("stock_end"), F.lit(0)) <= threshold).alias("low_stock"))


def funnel_card(rows: DataFrame) -> DataFrame:
    """U8: totals and mean ratios in percent."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), total("views").alias("views"),
                    total("adds_to_cart").alias("adds_to_cart"), total("orders").alias("orders"),
                    F.round(mean_ratio("cr_order") * 100, 9).alias("avg_cr_order_pct"),
                    F.round(mean_ratio("cr_cart") * 100, 9).alias("avg_cr_cart_pct"))


def ads_card(rows: DataFrame) -> DataFrame:
    """U9."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), total("cost").alias("cost"),
                    total("revenue").alias("revenue"), total("clicks").alias("clicks"),
                    total("orders").alias("orders"),
                    F.round(mean_ratio("acos") * 100, 9).alias("avg_acos_pct"))


def kpi_card(rows: DataFrame) -> DataFrame:
    """Totals over the KPI page."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), total("revenue_30d").alias("revenue_30d"),
                    total("qty_30d").alias("qty_30d"), total("returns_30d").alias("returns_30d"),
                    total("cost_30d").alias("cost_30d"))


def watermark_card(rows: DataFrame) -> DataFrame:
    """Count distinct sources and accounts (exact; partial distinct per task)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_distinct("source").alias("distinct_sources"),
                    F.count_distinct("account_id").alias("distinct_accounts"))


def runs_card(rows: DataFrame) -> DataFrame:
    """Failed / success counts, status compared case-insensitively."""
    st = F.lower(F.coalesce(F.col("status"), F.lit("")))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(st == "failed").alias("failed"),
                    F.count_if(st == "success").alias("success"))
