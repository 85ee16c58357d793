"""Bindings: the driver's tables re-expressed as the warehouse's raw tables.

The reference's raw tables (``raw_*``, ``sys_*``) do not exist in the test
data; these projections give every operator real, growing input.  Each one is
a narrow, shuffle-free projection (B5, B6 aggregate events by day) so column
pruning and predicate pushdown reach the Parquet scan.

Fixed values of the binding (must equal the oracle's CTEs in
``vitrine.plans.oracle``):

* accounts: ``'acc' || (id % 5)``
* lineitem / orders timestamps are shifted by +8430 days (2001-01-01 becomes
  2024-01-31) so that both channels and the events fall into one window;
* the reporting date ``AS_OF`` is 2024-01-31.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.schemas import MONEY

AS_OF = dt.date(2024, 1, 31)
RUN_TS = dt.datetime(2024, 1, 31, 0, 0, 0)
SHIFT_DAYS = 8430
PAYOUT = "decimal(18,4)"
# Every bound version is ingested at its event time, so event-day windows may
# skip history ingested before the window (see operators.latest.latest_in_window).
INGEST_AFTER_EVENT = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _acct(c: str) -> Column:
    return F.concat(F.lit("acc"), (F.col(c) % 5).cast("string")).alias("account_id")


def _shift(c: str) -> Column:
    return F.col(c) + F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")


def _bind_run() -> Column:
    return F.lit("bind").alias("run_id")


def _no_payload() -> Column:
    return F.lit(None).cast("string").alias("payload")


# ---------------------------------------------------------------- channel wb

def raw_wb_sales(lineitem: DataFrame) -> DataFrame:
    """B1: one sale line per lineitem; (orderkey, linenumber) repeats, so L1 has work."""
    ts = _shift("l_shipdate")
    price = F.col("l_extendedprice").cast(MONEY)
    return lineitem.select(
        ts.alias("ingested_at"), _bind_run(), _acct("l_orderkey"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("srid"),
        ts.alias("last_change_ts"), ts.alias("event_ts"),
        F.col("l_partkey").alias("nm_id"), F.col("l_suppkey").alias("chrt_id"),
        F.concat(F.lit("bc-"), F.col("l_partkey").cast("string")).alias("barcode"),
        F.col("l_quantity").cast("int").alias("quantity"),
        price.alias("price_rub"),
        (price * (F.lit(1) - F.col("l_discount").cast(MONEY))).cast(PAYOUT).alias("payout_rub"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_return"),
        _no_payload(),
    )


# Version order of B1 beyond ingested_at: makes the latest-wins order total.
WB_SALES_ORDER = ("ingested_at", "nm_id", "chrt_id", "price_rub")


def raw_wb_orders(lineitem: DataFrame) -> DataFrame:
    """wb orders from lineitem: same keys as B1, quantity at least 1."""
    ts = _shift("l_shipdate")
    return lineitem.select(
        ts.alias("ingested_at"), _bind_run(), _acct("l_orderkey"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("srid"),
        ts.alias("last_change_ts"), ts.alias("event_ts"),
        F.col("l_partkey").alias("nm_id"), F.col("l_suppkey").alias("chrt_id"),
        F.greatest(F.lit(1), F.col("l_quantity").cast("int")).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price_rub"),
        _no_payload(),
    )


WB_ORDERS_ORDER = ("ingested_at", "nm_id", "chrt_id", "price_rub")


def raw_wb_stocks(events: DataFrame) -> DataFrame:
    """B4 (wb half): even users' events are stock snapshots."""
    return events.where(F.col("user_id") % 2 == 0).select(
        F.col("ts").alias("ingested_at"), _bind_run(), _acct("user_id"),
        F.col("ts").alias("snapshot_ts"),
        F.col("user_id").alias("nm_id"), F.col("user_id").alias("chrt_id"),
        F.concat(F.lit("sku-"), F.col("user_id").cast("string")).alias("sku"),
        F.nullif(F.col("user_id") % 3, F.lit(0)).alias("warehouse_id"),
        F.floor("value").cast("int").alias("amount"),
        _no_payload(),
    )


def raw_wb_funnel_daily(events: DataFrame) -> DataFrame:
    """Events per (day, user) become funnel counts of product = user."""
    day = F.to_date("ts")
    is_ = lambda t: F.col("event_type") == t
    money = F.col("value").cast(MONEY)
    return (events.groupBy(_acct("user_id"), day.alias("day"), F.col("user_id").alias("nm_id"))
            .agg(F.count_if(is_("view")).alias("open_card_count"),
                 F.count_if(is_("click")).alias("add_to_cart_count"),
                 F.count_if(is_("purchase")).alias("orders_count"),
                 F.sum(F.when(is_("purchase"), money)).alias("orders_sum_rub"),
                 F.count_if(is_("signup")).alias("buyouts_count"),
                 F.count_if(is_("error")).alias("cancel_count"))
            .select(
                (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAYS")).alias("ingested_at"),
                _bind_run(), "account_id", "day", "nm_id",
                "open_card_count", "add_to_cart_count", "orders_count",
                F.coalesce("orders_sum_rub", F.lit(0).cast(MONEY)).cast(MONEY).alias("orders_sum_rub"),
                "buyouts_count", F.lit(0).cast(MONEY).alias("buyouts_sum_rub"),
                "cancel_count", F.lit(0).cast(MONEY).alias("cancel_sum_rub"),
                F.lit(0.0).alias("add_to_cart_conv"), F.lit(0.0).alias("cart_to_order_conv"),
                F.lit(0.0).alias("buyout_percent"), F.lit(0).cast("long").alias("add_to_wishlist"),
                F.lit("RUB").alias("currency"), _no_payload()))


# -------------------------------------------------------------- channel ozon

_POSTING_STATUS = {"F": "delivered", "O": "awaiting_deliver"}


def raw_ozon_postings(orders: DataFrame) -> DataFrame:
    """B2: orders not in status 'P' are postings (items of 'P' orders are orphans)."""
    created = _shift("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", F.lit(_POSTING_STATUS["F"])) \
        .otherwise(F.lit(_POSTING_STATUS["O"]))
    return orders.where(F.col("o_orderstatus") != "P").select(
        created.alias("ingested_at"), _bind_run(), _acct("o_orderkey"),
        F.col("o_orderkey").cast("string").alias("posting_number"),
        status.alias("status"),
        created.alias("created_at"),
        (created + F.expr("INTERVAL 1 HOURS")).alias("in_process_at"),
        (created + F.expr("INTERVAL 1 DAYS")).alias("shipped_at"),
        F.when(F.col("o_orderstatus") == "F", created + F.expr("INTERVAL 3 DAYS")).alias("delivered_at"),
        F.lit(None).cast("timestamp_ntz").alias("canceled_at"),
        (F.col("o_custkey") % 3).alias("ozon_warehouse_id"),
        _no_payload(),
    )


def raw_ozon_posting_items(lineitem: DataFrame) -> DataFrame:
    """Lineitems are posting items; key (posting, product) repeats."""
    ts = _shift("l_shipdate")
    price = F.col("l_extendedprice").cast(MONEY)
    return lineitem.select(
        ts.alias("ingested_at"), _bind_run(), _acct("l_orderkey"),
        F.col("l_orderkey").cast("string").alias("posting_number"),
        F.col("l_partkey").alias("ozon_product_id"),
        F.concat(F.lit("offer-"), F.col("l_partkey").cast("string")).alias("offer_id"),
        F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("name"),
        F.greatest(F.lit(1), F.col("l_quantity").cast("int")).alias("quantity"),
        price.alias("price"),
        (price * (F.lit(1) - F.col("l_tax").cast(MONEY))).cast(PAYOUT).alias("payout"),
        # insertion order of the feed: ties of ingested_at go to the later line
        F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supplier_id"),
        _no_payload(),
    )


OZON_ITEMS_ORDER = ("ingested_at", "line_no", "supplier_id", "price")


def raw_ozon_stocks(events: DataFrame) -> DataFrame:
    """B4 (ozon half): odd users' events are stock snapshots with reserve."""
    present = F.floor("value").cast("int")
    return events.where(F.col("user_id") % 2 == 1).select(
        F.col("ts").alias("ingested_at"), _bind_run(), _acct("user_id"),
        F.col("ts").alias("snapshot_ts"),
        F.col("user_id").alias("ozon_product_id"),
        F.concat(F.lit("offer-"), F.col("user_id").cast("string")).alias("offer_id"),
        F.nullif(F.col("user_id") % 3, F.lit(0)).alias("warehouse_id"),
        present.alias("present"),
        F.least(present, (F.col("event_id") % 3).cast("int")).alias("reserved"),
        _no_payload(),
    )


def raw_ozon_ads_daily(events: DataFrame) -> DataFrame:
    """Events by day and campaign (user % 20)."""
    is_ = lambda t: F.col("event_type") == t
    money = F.col("value").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return (events.groupBy(_acct("user_id"), F.to_date("ts").alias("day"),
                           F.concat(F.lit("camp-"), (F.col("user_id") % 20).cast("string")).alias("campaign_id"))
            .agg(F.count_if(is_("view")).alias("impressions"),
                 F.count_if(is_("click")).alias("clicks"),
                 F.coalesce(F.sum(F.when(is_("click"), money)), zero).cast(MONEY).alias("cost"),
                 F.count_if(is_("purchase")).alias("orders"),
                 F.coalesce(F.sum(F.when(is_("purchase"), money)), zero).cast(MONEY).alias("revenue"))
            .select((F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAYS")).alias("ingested_at"),
                    _bind_run(), "account_id", "day", "campaign_id", "impressions", "clicks",
                    "cost", "orders", "revenue", _no_payload()))


def raw_ozon_finance_ops(orders: DataFrame) -> DataFrame:
    """One ledger operation per order; refunds for orders not yet finished."""
    ts = _shift("o_orderdate")
    amt = F.col("o_totalprice").cast(MONEY)
    return orders.select(
        ts.alias("ingested_at"), _bind_run(), _acct("o_orderkey"),
        F.col("o_orderkey").cast("string").alias("operation_id"),
        ts.alias("operation_ts"),
        F.col("o_orderpriority").alias("type"),
        F.when(F.col("o_orderstatus") == "F", amt).otherwise(-amt).alias("amount"),
        F.lit("RUB").alias("currency"),
        _no_payload(),
    )


# ---------------------------------------------------------------- control

def sys_task_runs(events: DataFrame) -> DataFrame:
    """Every event is a task run; 'error' events failed."""
    return events.select(
        F.concat(F.lit("task_"), (F.col("user_id") % 10).cast("string")).alias("task_name"),
        F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.timestamp_add("SECOND", F.floor("value"), F.col("ts")).alias("finished_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.floor("value").cast("long").alias("rows_ingested"),
        F.col("event_type").alias("message"),
        F.col("props").alias("meta_json"),
    )


def sys_watermarks(events: DataFrame) -> DataFrame:
    """Cursor history; the stored value sometimes goes backwards."""
    return events.select(
        F.col("event_type").alias("source"), _acct("user_id"),
        F.timestamp_add("MINUTE", -F.floor("value"), F.col("ts")).alias("watermark_ts"),
        F.col("ts").alias("updated_at"),
    )


class Warehouse:
    """Lazy raw tables of one test-data folder (nothing is read until used)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        src = {
            "raw_wb_sales": (raw_wb_sales, "lineitem"),
            "raw_wb_orders": (raw_wb_orders, "lineitem"),
            "raw_wb_stocks": (raw_wb_stocks, "events"),
            "raw_wb_funnel_daily": (raw_wb_funnel_daily, "events"),
            "raw_ozon_postings": (raw_ozon_postings, "orders"),
            "raw_ozon_posting_items": (raw_ozon_posting_items, "lineitem"),
            "raw_ozon_stocks": (raw_ozon_stocks, "events"),
            "raw_ozon_ads_daily": (raw_ozon_ads_daily, "events"),
            "raw_ozon_finance_ops": (raw_ozon_finance_ops, "orders"),
            "sys_task_runs": (sys_task_runs, "events"),
            "sys_watermarks": (sys_watermarks, "events"),
        }[name]
        return src[0](self.t(src[1]))
