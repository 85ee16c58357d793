"""The warehouse as one lazy plan graph over a test-data folder.

``Stages`` wires bindings → latest-wins staging → marts exactly as the
reference's rebuild does (raw → stg → mrt), but as lazy DataFrames: nothing
runs until a query's result is consumed, and Catalyst prunes every column and
branch that query does not need.  A production job would materialise stg and
marts through ``vitrine.sources.tables.windowed_replace`` instead.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from vitrine.operators import marts, staging
from vitrine.session import checkpoint_dir
from vitrine.sources import bindings as B

# Fixed parameters of the registered plans (mirrored by the oracle SQL).
AS_OF = B.AS_OF
RUN_TS = B.RUN_TS
STG_DAYS = 365      # the reference's upper clamp: the widest rebuild it allows
MART_DAYS = 365


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF,
                 stg_days: int = STG_DAYS, mart_days: int = MART_DAYS, run_ts: dt.datetime = RUN_TS):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of, self.stg_days, self.mart_days, self.run_ts = as_of, stg_days, mart_days, run_ts
        self.wh = B.Warehouse(spark, sf_dir)

    def raw(self, name: str) -> DataFrame:
        return self.wh.raw(name)

    SHARED = ("stg_sales", "stg_orders", "stg_stocks", "stg_funnel", "stg_ads", "stg_finance",
              "mrt_sales", "mrt_stock", "mrt_funnel", "mrt_ads")

    def materialize(self, names=SHARED) -> "Stages":
        """Compute the shared staging and mart frames once for a query that reads
        each of them many times (the quality report): Parquet in the cluster's shared
        ``spark.checkpoint.dir`` cuts the lineage, so every consumer scans only its
        columns of the stored result and a lost executor does not recompute from raw."""
        base = f"{checkpoint_dir(self.spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
        for name in names:  # staging first: the marts are then built from the stored staging
            df = getattr(self, name)
            df.write.parquet(f"{base}/{name}")
            self.__dict__[name] = self.spark.read.schema(df.schema).parquet(f"{base}/{name}")
        return self

    def table(self, name: str) -> DataFrame:
        return self.wh.t(name)

    # ------------------------------------------------------------ staging
    @cached_property
    def stg_sales_wb(self) -> DataFrame:
        return staging.wb_sales(self.raw("raw_wb_sales"), self.as_of, self.stg_days, order=B.WB_SALES_ORDER,
                                ingest_after_event=B.INGEST_AFTER_EVENT)

    @cached_property
    def stg_sales_ozon(self) -> DataFrame:
        return staging.ozon_sales(self.raw("raw_ozon_posting_items"), self.raw("raw_ozon_postings"),
                                  self.as_of, self.stg_days, items_order=B.OZON_ITEMS_ORDER)

    @cached_property
    def stg_sales(self) -> DataFrame:
        return staging.stg_sales(self.stg_sales_wb, self.stg_sales_ozon)

    @cached_property
    def stg_orders_wb(self) -> DataFrame:
        return staging.wb_orders(self.raw("raw_wb_orders"), self.as_of, self.stg_days, order=B.WB_ORDERS_ORDER,
                                 ingest_after_event=B.INGEST_AFTER_EVENT)

    @cached_property
    def stg_orders_ozon(self) -> DataFrame:
        return staging.ozon_orders(self.raw("raw_ozon_postings"), self.as_of, self.stg_days,
                                   ingest_after_event=B.INGEST_AFTER_EVENT)

    @cached_property
    def stg_orders(self) -> DataFrame:
        return staging.stg_orders(self.stg_orders_wb, self.stg_orders_ozon)

    @cached_property
    def stg_stocks_wb(self) -> DataFrame:
        return staging.wb_stocks(self.raw("raw_wb_stocks"), self.as_of, self.stg_days)

    @cached_property
    def stg_stocks_ozon(self) -> DataFrame:
        return staging.ozon_stocks(self.raw("raw_ozon_stocks"), self.as_of, self.stg_days)

    @cached_property
    def stg_stocks(self) -> DataFrame:
        return staging.stg_stocks(self.stg_stocks_wb, self.stg_stocks_ozon)

    @cached_property
    def stg_funnel(self) -> DataFrame:
        return staging.wb_funnel(self.raw("raw_wb_funnel_daily"), self.as_of, self.stg_days)

    @cached_property
    def stg_ads(self) -> DataFrame:
        return staging.ozon_ads(self.raw("raw_ozon_ads_daily"), self.as_of, max(60, self.stg_days))

    @cached_property
    def stg_finance(self) -> DataFrame:
        return staging.ozon_finance(self.raw("raw_ozon_finance_ops"), self.as_of, max(60, self.stg_days))

    @cached_property
    def dim_product(self) -> DataFrame:
        wb = staging.wb_dim_product(self.raw("raw_wb_sales"), self.as_of, self.stg_days, self.run_ts,
                                    order=B.WB_SALES_ORDER, ingest_after_event=B.INGEST_AFTER_EVENT)
        oz = staging.ozon_dim_product(self.raw("raw_ozon_posting_items"), self.as_of, self.stg_days,
                                      self.run_ts, order=B.OZON_ITEMS_ORDER)
        return staging.dim_product(wb, oz)

    # -------------------------------------------------------------- marts
    @cached_property
    def mrt_sales(self) -> DataFrame:
        return marts.sales_daily(self.stg_sales, self.as_of, self.mart_days, self.run_ts)

    @cached_property
    def mrt_stock(self) -> DataFrame:
        return marts.stock_daily(self.stg_stocks, self.as_of, self.mart_days, self.run_ts)

    @cached_property
    def mrt_funnel(self) -> DataFrame:
        return marts.funnel_daily(self.stg_funnel, self.as_of, self.mart_days, self.run_ts)

    @cached_property
    def mrt_ads(self) -> DataFrame:
        return marts.ads_daily(self.stg_ads, self.as_of, max(60, self.mart_days), self.run_ts)

    # ------------------------------------------------------------ control
    @cached_property
    def task_runs(self) -> DataFrame:
        return self.raw("sys_task_runs")

    @cached_property
    def watermarks(self) -> DataFrame:
        return self.raw("sys_watermarks")
