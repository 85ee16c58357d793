"""Canonical table contracts: keys, version columns and time columns.

Key = the columns that identify one logical record (the dedup key); version =
the ordered columns whose greatest value wins (latest-wins, operator L1).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(38, 2)

CHANNELS = ("wb", "ozon")

# (key columns, version columns in priority order, time column)
RAW_TABLES: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "raw_wb_sales": (("account_id", "srid"), ("ingested_at",), "event_ts"),
    "raw_wb_orders": (("account_id", "srid"), ("ingested_at",), "event_ts"),
    # The survey's Q2: the stock key includes warehouse_id by default.
    "raw_wb_stocks": (("account_id", "snapshot_ts", "chrt_id", "warehouse_id"), ("ingested_at",), "snapshot_ts"),
    "raw_wb_funnel_daily": (("account_id", "day", "nm_id"), ("ingested_at",), "day"),
    "raw_ozon_postings": (("account_id", "posting_number"), ("ingested_at",), "created_at"),
    "raw_ozon_posting_items": (("account_id", "posting_number", "ozon_product_id"), ("ingested_at",), "ingested_at"),
    "raw_ozon_stocks": (("account_id", "snapshot_ts", "ozon_product_id", "warehouse_id"), ("ingested_at",), "snapshot_ts"),
    "raw_ozon_ads_daily": (("account_id", "day", "campaign_id"), ("ingested_at",), "day"),
    "raw_ozon_finance_ops": (("account_id", "operation_ts", "operation_id"), ("ingested_at",), "operation_ts"),
}

STG_KEYS = {
    "stg_sales": ("marketplace", "account_id", "order_id", "product_id", "event_ts"),
    "stg_orders": ("marketplace", "account_id", "order_id", "event_ts"),
    "stg_stocks": ("marketplace", "account_id", "day", "product_id", "warehouse_id"),
    "stg_funnel_daily": ("marketplace", "account_id", "day", "product_id"),
    "stg_ads_daily": ("marketplace", "account_id", "day", "campaign_id"),
    "stg_finance_ops": ("marketplace", "account_id", "operation_id", "operation_ts"),
}

MART_KEYS = {
    "mrt_sales_daily": ("day", "marketplace", "account_id", "product_id"),
    "mrt_stock_daily": ("day", "marketplace", "account_id", "product_id", "warehouse_id"),
    "mrt_funnel_daily": ("day", "marketplace", "account_id", "product_id"),
    "mrt_ads_daily": ("day", "marketplace", "account_id", "campaign_id"),
}

TASK_RUNS = T.StructType([
    T.StructField("task_name", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()), T.StructField("rows_ingested", T.LongType()),
    T.StructField("message", T.StringType()), T.StructField("meta_json", T.StringType()),
])

WATERMARKS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("account_id", T.StringType()),
    T.StructField("watermark_ts", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()),
])
