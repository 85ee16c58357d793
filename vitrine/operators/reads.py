"""A1–A9 parameterised API reads and D1–D7 dashboard queries over the marts.

Parameters follow the API contract: a closed date range, optional channel and
account filters where ``''`` means "no filter" (A8; the predicate is only
added when set, so Catalyst sees no dead ``OR``), and a look-ahead page
``offset(n).limit(m + 1)``.  Every paged order is made total by appending the
grain (the survey's Q15); sorted pages plan as ``TakeOrderedAndProject``, i.e.
a per-task top-(offset+limit+1) and a small merge, never a global sort.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.marts import kpi_ads_30d, kpi_sales_30d, ratio

MAX_LIMIT = 2000
MAX_OFFSET = 50000
MAX_SPAN_DAYS = 92


@dataclass(frozen=True)
class Page:
    """Parameter contract of a list endpoint (validated on the driver)."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    marketplace: str = ""
    account_id: str = ""
    limit: int = 1000
    offset: int = 0

    def __post_init__(self):
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be within 1..{MAX_LIMIT}")
        if not 0 <= self.offset <= MAX_OFFSET:
            raise ValueError(f"offset must be within 0..{MAX_OFFSET}")
        if self.marketplace not in ("", "wb", "ozon"):
            raise ValueError("marketplace must be wb or ozon")
        if len(self.account_id) > 64:
            raise ValueError("account_id is at most 64 characters")
        if self.date_from and self.date_to:
            if self.date_from > self.date_to:
                raise ValueError("date_from must not be after date_to")
            if (self.date_to - self.date_from).days > MAX_SPAN_DAYS:
                raise ValueError(f"date range is limited to {MAX_SPAN_DAYS} days")


def date_range(as_of: dt.date, date_from: dt.date | None = None,
               date_to: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Default range: ``to`` = as_of, ``from`` = to − 30."""
    to = date_to or as_of
    return (date_from or to - dt.timedelta(days=30)), to


def optional_filters(df: DataFrame, p: Page, prefix: str = "") -> DataFrame:
    """``'' OR col = value`` — the predicate exists only when set."""
    if p.marketplace:
        df = df.where(F.col(prefix + "marketplace") == p.marketplace)
    if p.account_id:
        df = df.where(F.col(prefix + "account_id") == p.account_id)
    return df


def _in_range(df: DataFrame, p: Page) -> DataFrame:
    if p.date_from is not None:
        df = df.where(F.col("day") >= F.lit(p.date_from))
    if p.date_to is not None:
        df = df.where(F.col("day") <= F.lit(p.date_to))
    return df


def page(df: DataFrame, order: list[Column], p: Page | None) -> DataFrame:
    """A9 look-ahead page: ``limit + 1`` rows after ``offset`` in a total order."""
    s = df.orderBy(*order)
    if p is None:
        return s
    if p.offset:
        s = s.offset(p.offset)
    return s.limit(p.limit + 1)


def page_meta(page_rows: DataFrame, p: Page) -> DataFrame:
    """A9 metadata as a one-row frame: returned, next_offset, has_more."""
    n = F.count(F.lit(1))
    return page_rows.agg(
        F.least(n, F.lit(p.limit)).cast("bigint").alias("returned"),
        F.when(n > p.limit, F.lit(p.offset + p.limit)).cast("bigint").alias("next_offset"),
        (n > p.limit).alias("has_more"),
        F.lit(p.limit).cast("bigint").alias("limit"), F.lit(p.offset).cast("bigint").alias("offset"))


def trim(page_rows: DataFrame, order: list[Column], p: Page) -> DataFrame:
    """The visible items of a look-ahead page (drops the extra row)."""
    return page_rows.orderBy(*order).limit(p.limit)


# ------------------------------------------------------------------ API

SALES_ORDER = lambda: [F.col("day").asc(), F.col("revenue").desc(), F.col("marketplace"), F.col("account_id"),
               F.col("product_id")]


def sales_daily(mrt_sales: DataFrame, p: Page, paged: bool = True, reaggregate: bool = True) -> DataFrame:
    """A1: re-aggregate at the mart grain; NULL payout counts as 0.

    ``reaggregate=False`` is for marts already unique at their grain (tables
    kept by the windowed replace): the read is then one stage — scan, filter,
    per-task top-k — with no shuffle."""
    s = optional_filters(_in_range(mrt_sales, p), p)
    if reaggregate:
        g = s.groupBy("day", "marketplace", "account_id", "product_id").agg(
            F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"),
            F.sum("returns_qty").alias("returns_qty"),
            F.sum(F.coalesce(F.col("payout"), F.lit(0))).alias("payout"))
    else:
        g = s.select("day", "marketplace", "account_id", "product_id", "qty", "revenue", "returns_qty",
                     F.coalesce(F.col("payout"), F.lit(0).cast("decimal(38,4)")).alias("payout"))
    return page(g, SALES_ORDER(), p if paged else None)


STOCK_ORDER = lambda: [F.col("stock_end").asc(), F.col("marketplace"), F.col("account_id"),
               F.col("product_id"), F.col("warehouse_id").asc_nulls_last()]


def stocks_current(mrt_stock: DataFrame, p: Page, paged: bool = True) -> DataFrame:
    """A2: rows of the latest stock day only (a scalar subquery, planned once)."""
    latest_day = mrt_stock.select(F.max("day")).scalar()
    s = optional_filters(mrt_stock.where(F.col("day") == latest_day), p)
    g = s.groupBy("day", "marketplace", "account_id", "product_id", "warehouse_id").agg(
        F.sum("stock_end").alias("stock_end"))
    return page(g, STOCK_ORDER(), p if paged else None)


FUNNEL_ORDER = lambda: [F.col("day"), F.col("product_id"), F.col("marketplace"), F.col("account_id")]


def funnel_daily(mrt_funnel: DataFrame, p: Page, paged: bool = True) -> DataFrame:
    """A3: re-aggregate and recompute both ratios from the sums."""
    s = optional_filters(_in_range(mrt_funnel, p), p)
    g = s.groupBy("day", "marketplace", "account_id", "product_id").agg(
        F.sum("views").alias("views"), F.sum("adds_to_cart").alias("adds_to_cart"),
        F.sum("orders").alias("orders"))
    g = g.select("*", ratio(F.col("orders"), F.col("views")).alias("cr_order"),
                 ratio(F.col("adds_to_cart"), F.col("views")).alias("cr_cart"))
    return page(g, FUNNEL_ORDER(), p if paged else None)


ADS_ORDER = lambda: [F.col("day"), F.col("campaign_id"), F.col("marketplace"), F.col("account_id")]


def ads_daily(mrt_ads: DataFrame, p: Page, paged: bool = True) -> DataFrame:
    """A4: re-aggregate and recompute acos / romi."""
    s = optional_filters(_in_range(mrt_ads, p), p)
    g = s.groupBy("day", "marketplace", "account_id", "campaign_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("cost").alias("cost"), F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
    g = g.select("*", ratio(F.col("cost"), F.col("revenue")).alias("acos"),
                 ratio(F.col("revenue") - F.col("cost"), F.col("cost")).alias("romi"))
    return page(g, ADS_ORDER(), p if paged else None)


KPI_ORDER = lambda: [F.col("marketplace"), F.col("account_id")]


def kpis(mrt_sales: DataFrame, mrt_ads: DataFrame, as_of: dt.date, p: Page,
         paged: bool = True, full_outer: bool = False) -> DataFrame:
    """A5: V1 ⟕ V2 using (marketplace, account_id); missing ads → 0 (Q16:
    accounts with ads only are dropped unless ``full_outer``)."""
    s = optional_filters(kpi_sales_30d(mrt_sales, as_of), p)
    a = kpi_ads_30d(mrt_ads, as_of).select("marketplace", "account_id", "cost_30d", "acos_30d")
    j = s.join(a, on=["marketplace", "account_id"], how="full" if full_outer else "left")
    out = j.select(
        "marketplace", "account_id",
        F.coalesce("revenue_30d", F.lit(0).cast("decimal(38,2)")).alias("revenue_30d"),
        F.coalesce("qty_30d", F.lit(0).cast("bigint")).alias("qty_30d"),
        F.coalesce("returns_30d", F.lit(0).cast("bigint")).alias("returns_30d"),
        F.coalesce("cost_30d", F.lit(0).cast("decimal(38,2)")).alias("cost_30d"),
        F.coalesce("acos_30d", F.lit(0.0)).alias("acos_30d"))
    return page(out, KPI_ORDER(), p if paged else None)


RUNS_ORDER = lambda: [F.col("started_at").desc(), F.col("run_id").desc(), F.col("task_name")]


def task_runs(runs: DataFrame, limit: int = 200) -> DataFrame:
    """Newest runs first, ``limit`` within 1..2000."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be within 1..{MAX_LIMIT}")
    return runs.orderBy(*RUNS_ORDER()).limit(limit)


WATERMARK_ORDER = lambda: [F.col("source"), F.col("account_id"), F.col("updated_at").desc(),
                   F.col("watermark_ts").desc()]


def watermarks(wm: DataFrame, limit: int = 500) -> DataFrame:
    """All cursors by source, account, newest first; limit 500."""
    return wm.orderBy(*WATERMARK_ORDER()).limit(limit)


# ------------------------------------------------------------- dashboards

def sales_overview(mrt_sales: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """Per-day totals in a closed range."""
    s = mrt_sales.where(F.col("day").between(F.lit(date_from), F.lit(date_to)))
    return s.groupBy("day").agg(F.sum("revenue").alias("revenue"), F.sum("qty").alias("qty"),
                                F.sum("returns_qty").alias("returns")).orderBy("day")


def top_products_30d(mrt_sales: DataFrame, as_of: dt.date, k: int = 50) -> DataFrame:
    """Top-k products by 30-day revenue (product id breaks ties)."""
    s = mrt_sales.where(F.col("day").between(F.date_sub(F.lit(as_of), 30), F.lit(as_of)))
    g = s.groupBy("product_id").agg(F.sum("revenue").alias("revenue"), F.sum("qty").alias("qty"))
    return g.orderBy(F.col("revenue").desc(), F.col("product_id")).limit(k)


def funnel_list(mrt_funnel: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """D3: projection + range + sort."""
    return (mrt_funnel.where(F.col("day").between(F.lit(date_from), F.lit(date_to)))
            .select("day", "product_id", "views", "adds_to_cart", "orders", "cr_order", "cr_cart")
            .orderBy("day", "product_id"))


def stocks_yesterday(mrt_stock: DataFrame, as_of: dt.date) -> DataFrame:
    """yesterday's stock by channel and product, ascending."""
    s = mrt_stock.where(F.col("day") == F.date_sub(F.lit(as_of), 1))
    return (s.groupBy("marketplace", "product_id").agg(F.sum("stock_end").alias("stock_end"))
            .orderBy(F.col("stock_end").asc(), "marketplace", "product_id"))


def ads_list(mrt_ads: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """Projection + range + sort."""
    return (mrt_ads.where(F.col("day").between(F.lit(date_from), F.lit(date_to)))
            .select("day", "campaign_id", "cost", "revenue", "acos", "romi")
            .orderBy("day", "campaign_id"))


def kpi_30d(mrt_sales: DataFrame, as_of: dt.date) -> DataFrame:
    """All of V1."""
    return kpi_sales_30d(mrt_sales, as_of)


def finance_ops_daily(stg_finance: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """``round(sum(amount), 2)`` by day and type; the sum is exact DECIMAL."""
    s = stg_finance.where(F.col("day").between(F.lit(date_from), F.lit(date_to)))
    return (s.groupBy("day", "type").agg(F.round(F.sum("amount"), 2).alias("amount"))
            .orderBy("day", "type"))
