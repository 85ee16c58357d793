"""Registered queries: name → (Spark plan over a test-data folder, oracle SQL).

Every query reads the driver's tables (through the bindings) in full, so its
work grows with the data.  Money leaves a query as DOUBLE, converted once from
the exact DECIMAL result, so Spark and the oracle agree bit for bit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators import reads
from vitrine.plans import oracle as O
from vitrine.plans.stages import AS_OF, Stages
from vitrine.sources import bindings as B


@dataclass
class Query:
    name: str
    build: Callable[[Stages], DataFrame]
    oracle: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def finalize(df: DataFrame) -> DataFrame:
    """Cast DECIMAL outputs to DOUBLE (exact sum → one rounding)."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def register(name: str, oracle_final: str | None, note: str = ""):
    def deco(fn: Callable[[Stages], DataFrame]):
        REGISTRY[name] = Query(name, fn, O.sql(oracle_final) if oracle_final else None, note)
        return fn
    return deco


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return finalize(REGISTRY[name].build(Stages(spark, sf_dir)))


def _d(days_back: int) -> dt.date:
    return AS_OF - dt.timedelta(days=days_back)


def _sqld(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


# Output columns of stg_sales (without meta_json: the bindings carry no payload).
_STG_SALES_SQL = ("day, marketplace, account_id, event_ts, order_id, posting_number, srid, product_id, nm_id, "
                  "ozon_product_id, offer_id, qty, CAST(price_gross AS DOUBLE) AS price_gross, "
                  "CAST(payout AS DOUBLE) AS payout, is_return, last_change_ts, ingested_at")


def _drop_meta(df: DataFrame) -> DataFrame:
    return df.drop("meta_json")


# ================================================================ L1 / staging

@register("l1_latest_wb_sales",
          "SELECT account_id, srid, ingested_at, nm_id, chrt_id, quantity, CAST(price_rub AS DOUBLE) AS price_rub, "
          "CAST(payout_rub AS DOUBLE) AS payout_rub, is_return FROM (SELECT *, ROW_NUMBER() OVER "
          "(PARTITION BY account_id, srid ORDER BY ingested_at DESC, nm_id DESC, chrt_id DESC, price_rub DESC) AS rn "
          "FROM raw_wb_sales) WHERE rn = 1")
def l1_latest_wb_sales(p: Stages) -> DataFrame:
    from vitrine.operators.latest import latest_wins
    from vitrine.sources.bindings import WB_SALES_ORDER
    return latest_wins(p.raw("raw_wb_sales"), ("account_id", "srid"), WB_SALES_ORDER).select(
        "account_id", "srid", "ingested_at", "nm_id", "chrt_id", "quantity", "price_rub", "payout_rub",
        "is_return")


@register("t1_stg_sales_wb", f"SELECT {_STG_SALES_SQL} FROM stg_sales_wb")
def t1(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_sales_wb)


@register("t5_stg_sales_ozon", f"SELECT {_STG_SALES_SQL} FROM stg_sales_ozon")
def t5(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_sales_ozon)


@register("t12_stg_sales", f"SELECT {_STG_SALES_SQL} FROM stg_sales")
def t12(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_sales)


@register("t2_t6_stg_orders",
          "SELECT day, marketplace, account_id, event_ts, order_id, status, product_id, qty, "
          "CAST(price_gross AS DOUBLE) AS price_gross, last_change_ts, ingested_at FROM stg_orders")
def t2_t6(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_orders)


@register("t3_t7_stg_stocks",
          "SELECT day, marketplace, account_id, snapshot_ts, product_id, nm_id, ozon_product_id, offer_id, "
          "warehouse_id, amount, reserved, present, ingested_at FROM stg_stocks")
def t3_t7(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_stocks)


@register("t4_stg_funnel",
          "SELECT day, marketplace, account_id, product_id, nm_id, views, adds_to_cart, orders, "
          "CAST(orders_sum AS DOUBLE) AS orders_sum, buyouts, cancels, add_to_cart_conv, cart_to_order_conv, "
          "buyout_percent, wishlist, currency, ingested_at FROM stg_funnel")
def t4(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_funnel)


@register("t8_stg_ads",
          "SELECT day, marketplace, account_id, campaign_id, impressions, clicks, CAST(cost AS DOUBLE) AS cost, "
          "orders, CAST(revenue AS DOUBLE) AS revenue, ingested_at FROM stg_ads")
def t8(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_ads)


@register("t9_stg_finance",
          "SELECT day, marketplace, account_id, operation_ts, operation_id, type, "
          "CAST(amount AS DOUBLE) AS amount, currency, ingested_at FROM stg_finance")
def t9(p: Stages) -> DataFrame:
    return _drop_meta(p.stg_finance)


@register("t10_t11_dim_product", "SELECT * FROM dim_product")
def t10_t11(p: Stages) -> DataFrame:
    return p.dim_product


# ===================================================================== marts

_M1_SQL = ("SELECT day, marketplace, account_id, product_id, qty, CAST(revenue AS DOUBLE) AS revenue, "
           "CAST(payout AS DOUBLE) AS payout, returns_qty, updated_at FROM mrt_sales")


@register("m1_mrt_sales_daily", _M1_SQL)
def m1(p: Stages) -> DataFrame:
    return p.mrt_sales


@register("m2_mrt_stock_daily", "SELECT * FROM mrt_stock")
def m2(p: Stages) -> DataFrame:
    return p.mrt_stock


@register("m3_mrt_funnel_daily", "SELECT * FROM mrt_funnel")
def m3(p: Stages) -> DataFrame:
    return p.mrt_funnel


@register("m4_mrt_ads_daily",
          "SELECT day, marketplace, account_id, campaign_id, impressions, clicks, CAST(cost AS DOUBLE) AS cost, "
          "orders, CAST(revenue AS DOUBLE) AS revenue, acos, romi, updated_at FROM mrt_ads")
def m4(p: Stages) -> DataFrame:
    return p.mrt_ads


@register("v1_kpi_sales_30d",
          "SELECT marketplace, account_id, CAST(revenue_30d AS DOUBLE) AS revenue_30d, qty_30d, returns_30d "
          "FROM kpi_sales_30d")
def v1(p: Stages) -> DataFrame:
    from vitrine.operators.marts import kpi_sales_30d
    return kpi_sales_30d(p.mrt_sales, p.as_of)


@register("v2_kpi_ads_30d",
          "SELECT marketplace, account_id, CAST(cost_30d AS DOUBLE) AS cost_30d, "
          "CAST(revenue_30d AS DOUBLE) AS revenue_30d, acos_30d FROM kpi_ads_30d")
def v2(p: Stages) -> DataFrame:
    from vitrine.operators.marts import kpi_ads_30d
    return kpi_ads_30d(p.mrt_ads, p.as_of)


# ====================================================================== API

_A_FROM, _A_TO = _d(30), AS_OF
_A_RANGE = f"day BETWEEN {_sqld(_A_FROM)} AND {_sqld(_A_TO)}"

_A1_SQL = (f"SELECT day, marketplace, account_id, product_id, CAST(SUM(qty) AS BIGINT) AS qty, "
           f"CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(returns_qty) AS BIGINT) AS returns_qty, "
           f"CAST(SUM(COALESCE(payout, 0)) AS DOUBLE) AS payout FROM mrt_sales WHERE {_A_RANGE} "
           f"GROUP BY day, marketplace, account_id, product_id")


@register("a1_api_sales_daily", _A1_SQL)
def a1(p: Stages) -> DataFrame:
    return reads.sales_daily(p.mrt_sales, reads.Page(_A_FROM, _A_TO), paged=False)


@register("a1_api_sales_daily_page",
          f"SELECT * FROM ({_A1_SQL}) ORDER BY day, revenue DESC, marketplace, account_id, product_id "
          f"LIMIT 51 OFFSET 100")
def a1_page(p: Stages) -> DataFrame:
    return reads.sales_daily(p.mrt_sales, reads.Page(_A_FROM, _A_TO, limit=50, offset=100))


@register("a8_api_sales_daily_filtered",
          f"SELECT day, marketplace, account_id, product_id, CAST(SUM(qty) AS BIGINT) AS qty, "
          f"CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(returns_qty) AS BIGINT) AS returns_qty, "
          f"CAST(SUM(COALESCE(payout, 0)) AS DOUBLE) AS payout FROM mrt_sales WHERE {_A_RANGE} "
          f"AND ('ozon' = '' OR marketplace = 'ozon') AND ('acc2' = '' OR account_id = 'acc2') "
          f"GROUP BY day, marketplace, account_id, product_id")
def a8(p: Stages) -> DataFrame:
    return reads.sales_daily(p.mrt_sales, reads.Page(_A_FROM, _A_TO, marketplace="ozon", account_id="acc2"),
                             paged=False)


@register("a9_api_page_meta",
          f"SELECT CAST(LEAST(count(*), 50) AS BIGINT) AS returned, "
          f"CAST(CASE WHEN count(*) > 50 THEN 150 END AS BIGINT) AS next_offset, count(*) > 50 AS has_more, "
          f"CAST(50 AS BIGINT) AS \"limit\", CAST(100 AS BIGINT) AS \"offset\" FROM ("
          f"SELECT * FROM ({_A1_SQL}) ORDER BY day, revenue DESC, marketplace, account_id, product_id "
          f"LIMIT 51 OFFSET 100)")
def a9(p: Stages) -> DataFrame:
    pg = reads.Page(_A_FROM, _A_TO, limit=50, offset=100)
    return reads.page_meta(reads.sales_daily(p.mrt_sales, pg), pg)


@register("a2_api_stocks_current",
          "SELECT s.day, s.marketplace, s.account_id, s.product_id, s.warehouse_id, "
          "CAST(SUM(s.stock_end) AS BIGINT) AS stock_end FROM mrt_stock s "
          "WHERE s.day = (SELECT max(day) FROM mrt_stock) "
          "GROUP BY s.day, s.marketplace, s.account_id, s.product_id, s.warehouse_id")
def a2(p: Stages) -> DataFrame:
    return reads.stocks_current(p.mrt_stock, reads.Page(), paged=False)


@register("a3_api_funnel_daily",
          f"SELECT *, {O.ratio('orders', 'views')} AS cr_order, {O.ratio('adds_to_cart', 'views')} AS cr_cart FROM ("
          f"SELECT day, marketplace, account_id, product_id, CAST(SUM(views) AS BIGINT) AS views, "
          f"CAST(SUM(adds_to_cart) AS BIGINT) AS adds_to_cart, CAST(SUM(orders) AS BIGINT) AS orders "
          f"FROM mrt_funnel WHERE {_A_RANGE} GROUP BY day, marketplace, account_id, product_id)")
def a3(p: Stages) -> DataFrame:
    return reads.funnel_daily(p.mrt_funnel, reads.Page(_A_FROM, _A_TO), paged=False)


@register("a4_api_ads_daily",
          f"SELECT day, marketplace, account_id, campaign_id, impressions, clicks, CAST(cost AS DOUBLE) AS cost, "
          f"orders, CAST(revenue AS DOUBLE) AS revenue, {O.ratio('cost', 'revenue')} AS acos, "
          f"{O.ratio('revenue - cost', 'cost')} AS romi FROM ("
          f"SELECT day, marketplace, account_id, campaign_id, CAST(SUM(impressions) AS BIGINT) AS impressions, "
          f"CAST(SUM(clicks) AS BIGINT) AS clicks, SUM(cost) AS cost, CAST(SUM(orders) AS BIGINT) AS orders, "
          f"SUM(revenue) AS revenue FROM mrt_ads WHERE {_A_RANGE} GROUP BY day, marketplace, account_id, campaign_id)")
def a4(p: Stages) -> DataFrame:
    return reads.ads_daily(p.mrt_ads, reads.Page(_A_FROM, _A_TO), paged=False)


@register("a5_api_kpis",
          "SELECT s.marketplace, s.account_id, CAST(s.revenue_30d AS DOUBLE) AS revenue_30d, s.qty_30d, "
          "s.returns_30d, CAST(COALESCE(a.cost_30d, 0) AS DOUBLE) AS cost_30d, COALESCE(a.acos_30d, 0) AS acos_30d "
          "FROM kpi_sales_30d s LEFT JOIN kpi_ads_30d a USING (marketplace, account_id)")
def a5(p: Stages) -> DataFrame:
    return reads.kpis(p.mrt_sales, p.mrt_ads, p.as_of, reads.Page(), paged=False)


@register("a6_api_task_runs",
          "SELECT * FROM sys_task_runs ORDER BY started_at DESC, run_id DESC, task_name LIMIT 200")
def a6(p: Stages) -> DataFrame:
    return reads.task_runs(p.task_runs, 200)


@register("a7_api_watermarks",
          "SELECT * FROM sys_watermarks ORDER BY source, account_id, updated_at DESC, watermark_ts DESC LIMIT 500")
def a7(p: Stages) -> DataFrame:
    return reads.watermarks(p.watermarks, 500)


# ================================================================ dashboards

_D_FROM, _D_TO = _d(60), AS_OF
_D_RANGE = f"day BETWEEN {_sqld(_D_FROM)} AND {_sqld(_D_TO)}"


@register("d1_sales_overview",
          f"SELECT day, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(qty) AS BIGINT) AS qty, "
          f"CAST(SUM(returns_qty) AS BIGINT) AS returns FROM mrt_sales WHERE {_D_RANGE} GROUP BY day")
def d1(p: Stages) -> DataFrame:
    return reads.sales_overview(p.mrt_sales, _D_FROM, _D_TO)


@register("d2_top_products_30d",
          f"SELECT product_id, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(qty) AS BIGINT) AS qty "
          f"FROM mrt_sales WHERE day BETWEEN {_sqld(_d(30))} AND {_sqld(AS_OF)} GROUP BY product_id "
          f"ORDER BY SUM(revenue) DESC, product_id LIMIT 50")
def d2(p: Stages) -> DataFrame:
    return reads.top_products_30d(p.mrt_sales, p.as_of, 50)


@register("d3_funnel_list",
          f"SELECT day, product_id, views, adds_to_cart, orders, cr_order, cr_cart FROM mrt_funnel WHERE {_D_RANGE}")
def d3(p: Stages) -> DataFrame:
    return reads.funnel_list(p.mrt_funnel, _D_FROM, _D_TO)


@register("d4_stocks_yesterday",
          f"SELECT marketplace, product_id, CAST(SUM(stock_end) AS BIGINT) AS stock_end FROM mrt_stock "
          f"WHERE day = {_sqld(_d(1))} GROUP BY marketplace, product_id")
def d4(p: Stages) -> DataFrame:
    return reads.stocks_yesterday(p.mrt_stock, p.as_of)


@register("d5_ads_list",
          f"SELECT day, campaign_id, CAST(cost AS DOUBLE) AS cost, CAST(revenue AS DOUBLE) AS revenue, acos, romi "
          f"FROM mrt_ads WHERE {_D_RANGE}")
def d5(p: Stages) -> DataFrame:
    return reads.ads_list(p.mrt_ads, _D_FROM, _D_TO)


@register("d6_kpi_30d",
          "SELECT marketplace, account_id, CAST(revenue_30d AS DOUBLE) AS revenue_30d, qty_30d, returns_30d "
          "FROM kpi_sales_30d")
def d6(p: Stages) -> DataFrame:
    return reads.kpi_30d(p.mrt_sales, p.as_of)


@register("d7_finance_ops_daily",
          f"SELECT day, type, CAST(ROUND(SUM(amount), 2) AS DOUBLE) AS amount FROM stg_finance "
          f"WHERE {_D_RANGE} GROUP BY day, type")
def d7(p: Stages) -> DataFrame:
    return reads.finance_ops_daily(p.stg_finance, _D_FROM, _D_TO)


# ===================================================================== cards

from vitrine.operators import cards, ops, quality, redaction, rules  # noqa: E402

NOW = dt.datetime(2024, 1, 31, 3, 0, 0)  # evaluation time of checks and lags: as_of + 3 h


def _api(p: Stages):
    rng = reads.Page(_A_FROM, _A_TO)
    return {"sales": reads.sales_daily(p.mrt_sales, rng, paged=False),
            "ads": reads.ads_daily(p.mrt_ads, rng, paged=False),
            "funnel": reads.funnel_daily(p.mrt_funnel, rng, paged=False),
            "stocks": reads.stocks_current(p.mrt_stock, reads.Page(), paged=False),
            "kpis": reads.kpis(p.mrt_sales, p.mrt_ads, p.as_of, reads.Page(), paged=False)}


def _tot(c: str, t: str = "DOUBLE") -> str:
    return f"CAST(COALESCE(SUM({c}), 0) AS {t}) AS {c}"


def _mean_pct(c: str, alias: str) -> str:
    return f"ROUND(ROUND(COALESCE(AVG(COALESCE({c}, 0.0)), 0.0), 9) * 100, 9) AS {alias}"


@register("u6_sales_card",
          "SELECT count(*) AS rows, CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS revenue, "
          "CAST(COALESCE(SUM(qty), 0) AS BIGINT) AS qty, CAST(COALESCE(SUM(returns_qty), 0) AS BIGINT) AS returns, "
          "CAST(COALESCE(SUM(payout), 0) AS DOUBLE) AS payout FROM api_sales")
def u6(p: Stages) -> DataFrame:
    return cards.sales_card(_api(p)["sales"])


@register("u3_revenue_series",
          "SELECT COALESCE(CAST(day AS VARCHAR), '') AS label, CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS value "
          "FROM api_sales GROUP BY 1")
def u3(p: Stages) -> DataFrame:
    return cards.grouped_series(_api(p)["sales"], "day", "revenue")


@register("u4_top10_sales_rows",
          "SELECT day, marketplace, account_id, product_id, qty, CAST(revenue AS DOUBLE) AS revenue, returns_qty, "
          "CAST(payout AS DOUBLE) AS payout FROM api_sales "
          "ORDER BY revenue DESC, day, marketplace, account_id, product_id LIMIT 10")
def u4(p: Stages) -> DataFrame:
    return cards.top_rows(_api(p)["sales"], "revenue", 10, ("day", "marketplace", "account_id", "product_id"))


@register("u5_overview",
          "SELECT * FROM (SELECT CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS revenue, "
          "CAST(COALESCE(SUM(qty), 0) AS BIGINT) AS qty, count(*) AS sales_rows FROM api_sales) "
          "CROSS JOIN (SELECT CAST(COALESCE(SUM(cost), 0) AS DOUBLE) AS ad_cost, count(*) AS ads_rows FROM api_ads) "
          "CROSS JOIN (SELECT CAST(COALESCE(SUM(stock_end), 0) AS BIGINT) AS stock_units, count(*) AS stock_rows "
          "FROM api_stocks)")
def u5(p: Stages) -> DataFrame:
    a = _api(p)
    return cards.overview(a["sales"], a["ads"], a["stocks"])


@register("u7_stock_card",
          "SELECT count(*) AS rows, count(*) FILTER (WHERE COALESCE(stock_end, 0) <= 5) AS low_stock FROM api_stocks")
def u7(p: Stages) -> DataFrame:
    return cards.stock_card(_api(p)["stocks"])


@register("u8_funnel_card",
          f"SELECT count(*) AS rows, {_tot('views', 'BIGINT')}, {_tot('adds_to_cart', 'BIGINT')}, "
          f"{_tot('orders', 'BIGINT')}, {_mean_pct('cr_order', 'avg_cr_order_pct')}, "
          f"{_mean_pct('cr_cart', 'avg_cr_cart_pct')} FROM api_funnel")
def u8(p: Stages) -> DataFrame:
    return cards.funnel_card(_api(p)["funnel"])


@register("u9_ads_card",
          f"SELECT count(*) AS rows, {_tot('cost')}, {_tot('revenue')}, {_tot('clicks', 'BIGINT')}, "
          f"{_tot('orders', 'BIGINT')}, {_mean_pct('acos', 'avg_acos_pct')} FROM api_ads")
def u9(p: Stages) -> DataFrame:
    return cards.ads_card(_api(p)["ads"])


@register("u10_kpi_card",
          f"SELECT count(*) AS rows, {_tot('revenue_30d')}, {_tot('qty_30d', 'BIGINT')}, "
          f"{_tot('returns_30d', 'BIGINT')}, {_tot('cost_30d')} FROM api_kpis")
def u10(p: Stages) -> DataFrame:
    return cards.kpi_card(_api(p)["kpis"])


@register("u11_watermark_card",
          "SELECT count(*) AS rows, count(DISTINCT source) AS distinct_sources, "
          "count(DISTINCT account_id) AS distinct_accounts FROM sys_watermarks")
def u11(p: Stages) -> DataFrame:
    return cards.watermark_card(p.watermarks)


@register("u12_runs_card",
          "SELECT count(*) AS rows, count(*) FILTER (WHERE lower(COALESCE(status, '')) = 'failed') AS failed, "
          "count(*) FILTER (WHERE lower(COALESCE(status, '')) = 'success') AS success FROM sys_task_runs")
def u12(p: Stages) -> DataFrame:
    return cards.runs_card(p.task_runs)


# =================================================================== quality

def _marts(p: Stages) -> dict[str, DataFrame]:
    return {"mrt_sales_daily": p.mrt_sales, "mrt_stock_daily": p.mrt_stock,
            "mrt_funnel_daily": p.mrt_funnel, "mrt_ads_daily": p.mrt_ads}


def _dup_tables(p: Stages):
    frames = {"stg_sales": p.stg_sales, "stg_orders": p.stg_orders, "stg_stocks": p.stg_stocks,
              "stg_funnel_daily": p.stg_funnel, "stg_ads_daily": p.stg_ads, "stg_finance_ops": p.stg_finance,
              **_marts(p)}
    t = {name: (frames[name], key) for name, key in quality.DUPLICATE_SPECS}
    t["raw_wb_sales"] = (p.raw("raw_wb_sales"), ("account_id", "srid"))
    return t


# frames read by several checks, or by a check and a mart: computed once, then scanned
_CHECK_SHARED = ("stg_sales", "stg_stocks", "stg_funnel", "stg_ads", "mrt_sales", "mrt_stock", "mrt_funnel", "mrt_ads")


def _violations(p: Stages) -> DataFrame:
    return quality._union([
        quality.stale_marts(p.task_runs, _marts(p), NOW, task_prefix="task_1"),
        quality.watermark_monotonicity(p.watermarks),
        quality.duplicate_grains(_dup_tables(p)),
        quality.impossible_timestamps(p.raw("raw_wb_sales"), p.raw("raw_wb_orders"), p.raw("raw_ozon_postings"),
                                      p.stg_sales, NOW),
        quality.invalid_values(p.mrt_stock, p.mrt_ads, p.mrt_funnel)])


@register("c1_stale_marts", "SELECT * FROM dq_c1")
def c1(p: Stages) -> DataFrame:
    return quality.stale_marts(p.task_runs, _marts(p), NOW, task_prefix="task_1")


@register("c2_watermark_backward_steps", "SELECT * FROM wm_backward")
def c2(p: Stages) -> DataFrame:
    return quality.watermark_backward_steps(p.watermarks)


@register("c3_duplicate_grains", "SELECT * FROM dq_c3")
def c3(p: Stages) -> DataFrame:
    return quality.duplicate_grains(_dup_tables(p))


@register("c3_worst_duplicates",
          "SELECT table_name, CAST(rank AS INTEGER) AS rank, account_id, entity_id, duplicate_count FROM (SELECT table_name, "
          "account_id, entity_id, CAST(detail AS BIGINT) AS duplicate_count, ROW_NUMBER() OVER (PARTITION BY table_name "
          "ORDER BY CAST(detail AS BIGINT) DESC, entity_id) AS rank FROM dq_c3) WHERE rank <= 3")
def c3_worst(p: Stages) -> DataFrame:
    return quality.worst_duplicates(quality.duplicate_grains(_dup_tables(p)))


@register("c4_impossible_timestamps", "SELECT * FROM dq_c4")
def c4(p: Stages) -> DataFrame:
    return quality.impossible_timestamps(p.raw("raw_wb_sales"), p.raw("raw_wb_orders"),
                                         p.raw("raw_ozon_postings"), p.stg_sales, NOW)


@register("c5_invalid_values", "SELECT * FROM dq_c5")
def c5(p: Stages) -> DataFrame:
    return quality.invalid_values(p.mrt_stock, p.mrt_ads, p.mrt_funnel)


@register("c6_quality_summary", "SELECT * FROM dq_summary")
def c6(p: Stages) -> DataFrame:
    return quality.summarize(_violations(p.materialize(_CHECK_SHARED)))


@register("c6_quality_report",
          "SELECT CASE WHEN count(*) > 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS issues, "
          "COALESCE(string_agg(\"check\" || '=' || CAST(failures AS VARCHAR), '; ' ORDER BY CASE \"check\" "
          "WHEN 'stale_marts' THEN 0 WHEN 'watermark_monotonicity' THEN 1 WHEN 'duplicate_grains' THEN 2 "
          "WHEN 'impossible_timestamps' THEN 3 ELSE 4 END), '') AS message FROM dq_summary")
def c6_report(p: Stages) -> DataFrame:
    return quality.report(quality.summarize(_violations(p.materialize(_CHECK_SHARED))))


_CHECK_RANK = ("CASE \"check\" WHEN 'stale_marts' THEN 0 WHEN 'watermark_monotonicity' THEN 1 "
               "WHEN 'duplicate_grains' THEN 2 WHEN 'impossible_timestamps' THEN 3 ELSE 4 END")


@register("c6_quality_audit_row",
          f"SELECT 'quality' AS task_name, 'run-1' AS run_id, TIMESTAMP '{NOW}' AS started_at, TIMESTAMP '{NOW}' AS finished_at, "
          f"CASE WHEN n > 0 THEN 'failed' ELSE 'success' END AS status, CAST(0 AS BIGINT) AS rows_ingested, "
          f"CASE WHEN n > 0 THEN 'data quality failures detected: ' || m ELSE 'data quality checks passed' END AS message, "
          f"CAST(to_json({{'status': CASE WHEN n > 0 THEN 'failed' ELSE 'success' END, 'issue_count': n, "
          f"'issues': COALESCE(issues, [])}}) AS VARCHAR) AS meta_json FROM (SELECT count(*) AS n, "
          f"string_agg(\"check\" || '=' || CAST(failures AS VARCHAR), '; ' ORDER BY {_CHECK_RANK}) AS m, "
          f"list({{'check': \"check\", 'summary': summary, 'failures': failures, 'samples': string_split(samples, ';')}} "
          f"ORDER BY {_CHECK_RANK}) AS issues FROM dq_summary)")
def c6_audit(p: Stages) -> DataFrame:
    summary = quality.summarize(_violations(p.materialize(_CHECK_SHARED)))
    return quality.audit_row(summary, "quality", "run-1", NOW, NOW)


# ===================================================================== rules

def _rule_tables(p: Stages) -> dict[str, DataFrame]:
    return {"mrt_ads_daily": p.mrt_ads, "mrt_stock_daily": p.mrt_stock, "mrt_sales_daily": p.mrt_sales}


@register("r1_bad_acos_hits",
          f"SELECT day, marketplace, account_id, campaign_id, acos, CAST(revenue AS DOUBLE) AS revenue, "
          f"CAST(cost AS DOUBLE) AS cost FROM mrt_ads WHERE day = {_sqld(_d(1))} AND revenue > 0 AND acos > 0.3")
def r1(p: Stages) -> DataFrame:
    rule = rules.BUILTIN_RULES[0]
    df = rules.rule_frame(p.spark, rule, _rule_tables(p), p.as_of)
    return df.where(rules.compile_condition(rule.condition, df.schema, rule.params))


@register("r2_low_stock_alerts",
          f"SELECT 'low_stock' AS rule, 'telegram' AS action, m AS message, '[low_stock] ' || m AS text FROM ("
          f"SELECT 'Low stock: ' || marketplace || '/' || account_id || '/' || product_id || ', stock=' || "
          f"CAST(SUM(stock_end) AS VARCHAR) AS m, SUM(stock_end) AS s FROM mrt_stock WHERE day = {_sqld(_d(1))} "
          f"GROUP BY marketplace, account_id, product_id) WHERE s < 5")
def r2(p: Stages) -> DataFrame:
    return rules.alerts(p.spark, [rules.BUILTIN_RULES[1]], _rule_tables(p), p.as_of)


@register("r3_no_sales_alerts",
          f"SELECT 'no_sales_7d' AS rule, 'telegram' AS action, m AS message, '[no_sales_7d] ' || m AS text FROM ("
          f"SELECT 'No sales in 7d: ' || marketplace || '/' || account_id || '/' || product_id AS m, SUM(qty) AS q "
          f"FROM mrt_sales WHERE day BETWEEN {_sqld(_d(7))} AND {_sqld(AS_OF)} "
          f"GROUP BY marketplace, account_id, product_id) WHERE q <= 0")
def r3(p: Stages) -> DataFrame:
    return rules.alerts(p.spark, [rules.BUILTIN_RULES[2]], _rule_tables(p), p.as_of)


@register("r5_rule_report",
          f"SELECT 0 AS ord, 'bad_acos' AS name, count(*) AS rows, count(*) FILTER (WHERE revenue > 0 AND acos > 0.3) "
          f"AS triggered FROM mrt_ads WHERE day = {_sqld(_d(1))} "
          f"UNION ALL SELECT 1, 'low_stock', count(*), count(*) FILTER (WHERE s < 5) FROM (SELECT SUM(stock_end) AS s "
          f"FROM mrt_stock WHERE day = {_sqld(_d(1))} GROUP BY marketplace, account_id, product_id) "
          f"UNION ALL SELECT 2, 'no_sales_7d', count(*), count(*) FILTER (WHERE q <= 0) FROM (SELECT SUM(qty) AS q "
          f"FROM mrt_sales WHERE day BETWEEN {_sqld(_d(7))} AND {_sqld(AS_OF)} GROUP BY marketplace, account_id, product_id)")
def r5_report(p: Stages) -> DataFrame:
    return rules.rule_report(p.spark, rules.BUILTIN_RULES, _rule_tables(p), p.as_of)


_BAD_ACOS_SQL = f"FROM mrt_ads WHERE day = {_sqld(_d(1))} AND revenue > 0 AND acos > 0.3"


@register("r5_r7_alerts",
          f"SELECT rule, 'telegram' AS action, m AS message, '[' || rule || '] ' || m AS text FROM ("
          f"SELECT 'bad_acos' AS rule, 'High ACOS: ' || CAST(campaign_id AS VARCHAR) || ' acos=' || CAST(acos AS VARCHAR) || "
          f"' revenue=' || CAST(revenue AS VARCHAR) || ' cost=' || CAST(cost AS VARCHAR) AS m {_BAD_ACOS_SQL} "
          f"UNION ALL SELECT 'low_stock', 'Low stock: ' || marketplace || '/' || account_id || '/' || product_id || "
          f"', stock=' || CAST(SUM(stock_end) AS VARCHAR) FROM mrt_stock WHERE day = {_sqld(_d(1))} "
          f"GROUP BY marketplace, account_id, product_id HAVING SUM(stock_end) < 5 "
          f"UNION ALL SELECT 'no_sales_7d', 'No sales in 7d: ' || marketplace || '/' || account_id || '/' || product_id "
          f"FROM mrt_sales WHERE day BETWEEN {_sqld(_d(7))} AND {_sqld(AS_OF)} "
          f"GROUP BY marketplace, account_id, product_id HAVING SUM(qty) <= 0)")
def r5_alerts(p: Stages) -> DataFrame:
    return rules.alerts(p.spark, rules.BUILTIN_RULES, _rule_tables(p), p.as_of)


@register("r4_rule_files_report",
          f"SELECT *, CAST(SUM(triggered) OVER () AS BIGINT) AS total_triggered FROM ("
          f"SELECT 0 AS ord, 'bad_acos' AS name, count(*) AS rows, count(*) FILTER (WHERE revenue > 0 AND acos > 0.3) "
          f"AS triggered FROM mrt_ads WHERE day = {_sqld(_d(1))} "
          f"UNION ALL SELECT 1, 'low_stock', count(*), count(*) FILTER (WHERE s < 5) FROM (SELECT SUM(stock_end) AS s "
          f"FROM mrt_stock WHERE day = {_sqld(_d(1))} GROUP BY marketplace, account_id, product_id) "
          f"UNION ALL SELECT 2, 'no_sales_7d', count(*), count(*) FILTER (WHERE q <= 0) FROM (SELECT SUM(qty) AS q "
          f"FROM mrt_sales WHERE day BETWEEN {_sqld(_d(7))} AND {_sqld(AS_OF)} GROUP BY marketplace, account_id, product_id))")
def r4_report(p: Stages) -> DataFrame:
    """The shipped rules stored as files in another order, loaded by path, reported with the total."""
    folder, _ = _stream_dirs(p.spark, "rules")
    rules.store_rules(p.spark, rules.BUILTIN_RULES[::-1], folder)
    return rules.run_report(p.spark, rules.load_rules(p.spark, folder), _rule_tables(p), p.as_of)


_AD_LINES = rules.Rule(
    "ad_lines", "SELECT campaign_id, acos, clicks FROM {mrt_ads_daily}",
    'row["clicks"] % 7 in [1, "2", 3] and (row["clicks"] + 3) // 4 >= params["least"]',
    [rules.RuleAction("log", "{campaign_id:>8}|{acos:.{digits}f}|{acos:.1%}|{clicks:,d}")], {"least": 2, "digits": 4})


@register("r6_r8_formatted_alerts",
          "SELECT 'ad_lines' AS rule, 'log' AS action, m AS message, '[ad_lines] ' || m AS text FROM ("
          "SELECT lpad(CAST(campaign_id AS VARCHAR), CAST(GREATEST(8, length(CAST(campaign_id AS VARCHAR))) AS INTEGER), ' ') || '|' || "
          "COALESCE(printf('%.4f', acos), 'None') || '|' || COALESCE(printf('%.1f', acos * 100) || '%', 'None') || '|' || "
          "format('{:,}', clicks) AS m FROM mrt_ads WHERE clicks % 7 IN (1, 3) AND (clicks + 3) // 4 >= 2)")
def r6_alerts(p: Stages) -> DataFrame:
    return rules.alerts(p.spark, [_AD_LINES], _rule_tables(p), p.as_of)


# ======================================================================= ops

def _wstart(ts: str, minutes: int) -> str:
    us = minutes * 60_000_000
    return f"make_timestamp((epoch_us({ts}) // {us}) * {us})"


_DUR = ("GREATEST(CAST(epoch_us(finished_at) - epoch_us(started_at) AS DOUBLE) / 1e6, 0.0)")


@register("o1_failed_runs_15m",
          "SELECT date_trunc('minute', finished_at) - to_minutes(k) AS window_start, "
          "date_trunc('minute', finished_at) - to_minutes(k) + INTERVAL 15 MINUTE AS window_end, task_name, "
          "count(*) FILTER (WHERE status = 'failed') AS failed_runs "
          "FROM sys_task_runs, range(15) t(k) GROUP BY 1, 2, 3")
def o1(p: Stages) -> DataFrame:
    return ops.failed_runs(p.task_runs)


@register("o2_cursor_lag",
          "SELECT source, account_id, watermark_ts, "
          "GREATEST(0, (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(watermark_ts)) // 1000000) AS lag_seconds, "
          "GREATEST(0, (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(watermark_ts)) // 1000000) > 21600 AS stale "
          "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, account_id ORDER BY updated_at DESC, "
          "watermark_ts DESC) AS rn FROM sys_watermarks) WHERE rn = 1")
def o2(p: Stages) -> DataFrame:
    return ops.cursor_lag(p.watermarks, NOW)


@register("o3_empty_responses_1h",
          f"SELECT {_wstart('finished_at', 5)} - to_minutes(5 * k) AS window_start, "
          f"{_wstart('finished_at', 5)} - to_minutes(5 * k) + INTERVAL 1 HOUR AS window_end, task_name, "
          f"count(*) AS empty_responses, count(*) > 20 AS anomaly "
          f"FROM sys_task_runs, range(12) t(k) WHERE rows_ingested = 0 GROUP BY 1, 2, 3")
def o3(p: Stages) -> DataFrame:
    return ops.empty_responses(p.task_runs)


@register("o4_runs_by_status_1h",
          "SELECT date_trunc('hour', started_at) AS window_start, task_name, status, count(*) AS runs "
          "FROM sys_task_runs GROUP BY 1, 2, 3")
def o4(p: Stages) -> DataFrame:
    return ops.runs_by_status(p.task_runs)


def _pct_sql(group: str, src: str, pct: int) -> str:
    return (f"SELECT {group}, min(duration) AS p{pct} FROM (SELECT {group}, duration, "
            f"SUM(n) OVER (PARTITION BY {group} ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
            f"SUM(n) OVER (PARTITION BY {group}) AS total FROM (SELECT {group}, duration, count(*) AS n FROM ({src}) "
            f"GROUP BY {group}, duration)) WHERE cum >= (total * {pct} + 99) // 100 GROUP BY {group}")


@register("o5_p95_duration_15m",
          _pct_sql("window_start, task_name",
                   f"SELECT {_wstart('finished_at', 15)} AS window_start, task_name, {_DUR} AS duration "
                   f"FROM sys_task_runs", 95))
def o5(p: Stages) -> DataFrame:
    return ops.p95_duration(p.task_runs)


_BOUNDS = "[0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0, 300.0, 600.0]"


@register("o6_duration_histogram",
          f"SELECT task_name, status, bucket, le, runs, CAST(SUM(runs) OVER (PARTITION BY task_name, status "
          f"ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative FROM ("
          f"SELECT task_name, status, CAST(len(list_filter({_BOUNDS}::DOUBLE[], lambda b: b < {_DUR})) AS INTEGER) AS bucket, "
          f"CASE WHEN len(list_filter({_BOUNDS}::DOUBLE[], lambda b: b < {_DUR})) < 12 THEN CAST(({_BOUNDS}::DOUBLE[])"
          f"[len(list_filter({_BOUNDS}::DOUBLE[], lambda b: b < {_DUR})) + 1] AS VARCHAR) ELSE '+Inf' END AS le, "
          f"count(*) AS runs FROM sys_task_runs GROUP BY 1, 2, 3, 4)")
def o6(p: Stages) -> DataFrame:
    return ops.duration_histogram(p.task_runs)


@register("o7_failure_alert_hold_5m",
          "SELECT task_name, minute AS firing_at, since FROM (SELECT *, min(minute) OVER (PARTITION BY task_name, island) "
          "AS since FROM (SELECT task_name, minute, minute - to_minutes(ROW_NUMBER() OVER (PARTITION BY task_name "
          "ORDER BY minute)) AS island FROM (SELECT date_trunc('minute', finished_at) - to_minutes(k) + "
          "INTERVAL 15 MINUTE AS minute, task_name, count(*) FILTER (WHERE status = 'failed') AS f "
          "FROM sys_task_runs, range(15) t(k) GROUP BY 1, 2) WHERE f > 0)) WHERE minute >= since + INTERVAL 5 MINUTE")
def o7(p: Stages) -> DataFrame:
    return ops.failure_alert(p.task_runs, 5)


@register("o8_rows_ingested",
          "SELECT task_name, CAST(SUM(rows_ingested) AS BIGINT) AS rows_ingested FROM sys_task_runs GROUP BY 1")
def o8(p: Stages) -> DataFrame:
    return ops.rows_ingested(p.task_runs)


@register("o9_latency_summary",
          f"SELECT t.runs, a.p50, b.p95, t.max_duration, CASE WHEN t.secs > 0 THEN t.runs / t.secs ELSE 0.0 END "
          f"AS runs_per_second FROM (SELECT 1 AS g, count(*) AS runs, max({_DUR}) AS max_duration, "
          f"CAST(epoch_us(max(finished_at)) - epoch_us(min(started_at)) AS DOUBLE) / 1e6 AS secs FROM sys_task_runs) t "
          f"JOIN ({_pct_sql('g', f'SELECT 1 AS g, {_DUR} AS duration FROM sys_task_runs', 50)}) a USING (g) "
          f"JOIN ({_pct_sql('g', f'SELECT 1 AS g, {_DUR} AS duration FROM sys_task_runs', 95)}) b USING (g)")
def o9(p: Stages) -> DataFrame:
    return ops.latency_summary(p.task_runs)


_RAW9 = ("raw_wb_sales", "raw_wb_orders", "raw_wb_stocks", "raw_wb_funnel_daily", "raw_ozon_postings",
         "raw_ozon_posting_items", "raw_ozon_stocks", "raw_ozon_ads_daily", "raw_ozon_finance_ops")


@register("o10_stored_rows",
          "WITH per AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _RAW9)
          + ") SELECT * FROM per UNION ALL SELECT '*', CAST(SUM(rows) AS BIGINT) FROM per")
def o10(p: Stages) -> DataFrame:
    return ops.stored_rows({t: p.raw(t) for t in _RAW9})


# ============================================================ K9, W9

_K9_KEYS = ("ref", "utm_source", "token", "api_key", "authorization", "password", "secret")


@register("k9_redact_page_params",
          "SELECT page_id, pos, CASE WHEN strpos(kv, '=') > 0 THEN split_part(kv, '=', 1) ELSE kv END AS key, "
          "CASE WHEN " + " OR ".join(f"strpos(lower(CASE WHEN strpos(kv, '=') > 0 THEN split_part(kv, '=', 1) ELSE kv END), '{k}') > 0" for k in _K9_KEYS)
          + " THEN (CASE WHEN v IS NULL OR length(v) = 0 THEN '' WHEN length(v) <= 8 THEN repeat('*', length(v)) "
          "ELSE left(v, 4) || '***' || right(v, 4) END) ELSE v END AS value FROM ("
          "SELECT page_id, pos, kv, CASE WHEN strpos(kv, '=') > 0 THEN substr(kv, strpos(kv, '=') + 1) END AS v FROM ("
          "SELECT page_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS kv FROM ("
          "SELECT page_id, string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS parts FROM pages "
          "WHERE strpos(url, '?') > 0)) WHERE length(kv) > 0)")
def k9(p: Stages) -> DataFrame:
    return redaction.redact_page_params(p.table("pages"), _K9_KEYS)


@register("w9_event_date_windows",
          "SELECT DATE '2024-01-01' + 7 * CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS INTEGER) AS window_start, "
          "LEAST(DATE '2024-01-01' + 7 * CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS INTEGER) + 6, DATE '2024-01-30') "
          "AS window_end, count(*) AS events FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' "
          "GROUP BY 1, 2")
def w9(p: Stages) -> DataFrame:
    ev = p.table("events").withColumn("day", F.to_date("ts"))
    a = redaction.assign_date_window(ev, "day", dt.date(2024, 1, 1), dt.date(2024, 1, 30), 7)
    return a.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("events"))


# ============================================================ JSON sources

from vitrine.operators import normalize  # noqa: E402
from vitrine.sources import feeds, landing  # noqa: E402

_RUN, _ACC = "landing", "acc-landing"
_LI_SHIFT = "l_shipdate + INTERVAL 8430 DAY"
_META_SQL = f"'{_RUN}' AS run_id, '{_ACC}' AS account_id"


def _recs(lines: DataFrame) -> DataFrame:
    return feeds.unwrap(lines, keep=["ingested_at"])


@register("p1_s9_wb_sales_from_json",
          f"SELECT {_LI_SHIFT} AS ingested_at, {_META_SQL}, "
          f"CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS srid, "
          f"{_LI_SHIFT} AS last_change_ts, {_LI_SHIFT} AS event_ts, l_partkey AS nm_id, l_suppkey AS chrt_id, "
          f"'bc-' || CAST(l_partkey AS VARCHAR) AS barcode, CAST(l_quantity AS INTEGER) AS quantity, "
          f"CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price_rub, "
          f"CASE WHEN l_linenumber <> 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 0.0 END "
          f"AS payout_rub, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return FROM lineitem")
def p1(p: Stages) -> DataFrame:
    recs = _recs(landing.wb_sales_pages(p.table("lineitem")))
    return normalize.wb_sales(recs, _RUN, _ACC).drop("payload")


_POSTING_NO = ("CASE WHEN l_linenumber <> 6 OR l_returnflag <> 'N' THEN CAST(l_orderkey AS VARCHAR) || '-' || "
               "CAST(l_linenumber AS VARCHAR) ELSE '' END")


@register("p5_s9_ozon_postings_from_json",
          f"SELECT {_LI_SHIFT} AS ingested_at, {_META_SQL}, {_POSTING_NO} AS posting_number, "
          f"CASE WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'awaiting_packaging' END AS status, "
          f"{_LI_SHIFT} AS created_at, {_LI_SHIFT} + INTERVAL 1 HOUR AS in_process_at, "
          f"CASE WHEN l_linenumber % 2 = 0 THEN {_LI_SHIFT} + INTERVAL 5 HOUR END AS shipped_at, "
          f"CASE WHEN l_linestatus = 'F' THEN {_LI_SHIFT} + INTERVAL 2 DAY END AS delivered_at, "
          f"CASE WHEN l_returnflag = 'R' THEN {_LI_SHIFT} + INTERVAL 1 DAY END AS canceled_at, "
          f"NULLIF(l_suppkey % 4, 0) AS ozon_warehouse_id FROM lineitem")
def p5(p: Stages) -> DataFrame:
    recs = _recs(landing.ozon_posting_pages(p.table("lineitem")))
    return normalize.ozon_postings(recs, _RUN, _ACC).drop("payload")


@register("p6_ozon_items_from_json",
          f"SELECT {_LI_SHIFT} AS ingested_at, {_META_SQL}, {_POSTING_NO} AS posting_number, "
          f"l_partkey AS ozon_product_id, 'offer-' || CAST(l_partkey AS VARCHAR) AS offer_id, "
          f"'item ' || CAST(l_partkey AS VARCHAR) AS name, GREATEST(1, CAST(l_quantity AS INTEGER)) AS quantity, "
          f"CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price, "
          f"CAST(CASE WHEN l_linenumber <> 3 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.9 AS DECIMAL(18,2)) "
          f"ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DOUBLE) AS payout FROM lineitem WHERE l_linenumber <> 7")
def p6(p: Stages) -> DataFrame:
    recs = _recs(landing.ozon_posting_pages(p.table("lineitem")))
    return normalize.ozon_posting_items(recs, _RUN, _ACC).drop("payload")


@register("p7_ozon_stocks_from_json",
          f"SELECT ts AS ingested_at, {_META_SQL}, ts AS snapshot_ts, user_id AS ozon_product_id, "
          f"'offer-' || CAST(user_id AS VARCHAR) AS offer_id, NULLIF(user_id % 3, 0) AS warehouse_id, "
          f"CAST(FLOOR(value) AS INTEGER) AS present, CAST(event_id % 3 AS INTEGER) AS reserved "
          f"FROM events WHERE user_id % 2 = 1")
def p7(p: Stages) -> DataFrame:
    recs = _recs(landing.ozon_stock_pages(p.table("events")))
    return normalize.ozon_stocks(recs, _RUN, _ACC, F.col("ingested_at")).drop("payload")


@register("p8_ozon_ads_from_json",
          f"SELECT ingested_at, {_META_SQL}, day, campaign_id, impressions, clicks, CAST(cost AS DOUBLE) AS cost, "
          f"orders, CAST(revenue AS DOUBLE) AS revenue FROM raw_ozon_ads_daily")
def p8(p: Stages) -> DataFrame:
    recs = _recs(landing.ozon_ads_pages(p.raw("raw_ozon_ads_daily")))
    return normalize.ozon_ads(recs, _RUN, _ACC).drop("payload")


@register("p9_finance_from_json",
          f"SELECT o_orderdate + INTERVAL 8430 DAY AS ingested_at, {_META_SQL}, CAST(o_orderkey AS VARCHAR) AS operation_id, "
          f"o_orderdate + INTERVAL 8430 DAY AS operation_ts, o_orderpriority AS type, "
          f"CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) "
          f"ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount, 'RUB' AS currency FROM orders")
def p9(p: Stages) -> DataFrame:
    recs = _recs(landing.ozon_finance_pages(p.table("orders")).drop("account_id"))
    return normalize.ozon_finance(recs, _RUN, _ACC).drop("payload")


@register("s10_postings_schema_merge",
          f"SELECT posting_key, CASE WHEN bool_or(s = 'fbo') THEN 'fbo' ELSE 'fbs' END AS schema FROM ("
          f"SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS posting_key, 'fbs' AS s "
          f"FROM lineitem WHERE l_linenumber <> 6 OR l_returnflag <> 'N' UNION ALL "
          f"SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 'fbo' FROM lineitem "
          f"WHERE l_returnflag = 'A') GROUP BY posting_key "
          f"UNION ALL SELECT NULL, 'fbs' FROM lineitem WHERE l_linenumber = 6 AND l_returnflag = 'N'")
def s10(p: Stages) -> DataFrame:
    li = p.table("lineitem")
    fbs = _recs(landing.ozon_posting_pages(li))
    fbo = _recs(landing.ozon_posting_pages(li.where(F.col("l_returnflag") == "A"), status="fbo_override"))
    merged = feeds.merge_schemas([("fbs", fbs), ("fbo", fbo)], order_cols=("ingested_at", "pos"))
    return merged.select("posting_key", "schema")


@register("p2_wb_orders_from_json",
          f"SELECT {_LI_SHIFT} AS ingested_at, {_META_SQL}, "
          f"CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS srid, "
          f"{_LI_SHIFT} AS last_change_ts, {_LI_SHIFT} AS event_ts, l_partkey AS nm_id, l_suppkey AS chrt_id, "
          f"CASE WHEN l_linenumber = 4 THEN 1 ELSE GREATEST(1, CAST(l_quantity AS INTEGER)) END AS quantity, "
          f"CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price_rub FROM lineitem")
def p2(p: Stages) -> DataFrame:
    recs = _recs(landing.wb_order_pages(p.table("lineitem")))
    return normalize.wb_orders(recs, _RUN, _ACC).drop("payload")


@register("p3_wb_stocks_from_json",
          f"SELECT ts AS ingested_at, {_META_SQL}, ts AS snapshot_ts, NULLIF(user_id, 0) AS nm_id, "
          f"user_id AS chrt_id, 'sku-' || CAST(user_id AS VARCHAR) AS sku, NULLIF(user_id % 3, 0) AS warehouse_id, "
          f"CAST(FLOOR(value) AS INTEGER) AS amount FROM events WHERE user_id % 2 = 0")
def p3(p: Stages) -> DataFrame:
    recs = _recs(landing.wb_stock_pages(p.table("events")))
    return normalize.wb_stocks(recs, _RUN, _ACC, F.col("ingested_at")).drop("payload")


@register("p4_wb_funnel_from_json",
          f"SELECT ingested_at, {_META_SQL}, day, nm_id, open_card_count, add_to_cart_count, orders_count, "
          f"CAST(orders_sum_rub AS DOUBLE) AS orders_sum_rub, buyouts_count, 0.0::DOUBLE AS buyouts_sum_rub, "
          f"cancel_count, 0.0::DOUBLE AS cancel_sum_rub, 0.0::DOUBLE AS add_to_cart_conv, "
          f"0.0::DOUBLE AS cart_to_order_conv, 0.0::DOUBLE AS buyout_percent, CAST(0 AS BIGINT) AS add_to_wishlist, "
          f"'RUB' AS currency FROM raw_wb_funnel_daily")
def p4(p: Stages) -> DataFrame:
    recs = _recs(landing.wb_funnel_pages(p.raw("raw_wb_funnel_daily")))
    return normalize.wb_funnel(recs, _RUN, _ACC).drop("payload")


# ======================================================== W1/W2 cursor reads

_CURSOR_SOURCE = "purchase"  # the bound cursor history's source used as the sales cursor


_NEW_ACCOUNT = "acc4"  # has sales, but its cursor is not in the history that is read


@register("w1_w2_sales_since_cursor",
          f"WITH known AS (SELECT account_id, watermark_ts FROM ("
          f"SELECT *, ROW_NUMBER() OVER (PARTITION BY source, account_id ORDER BY updated_at DESC, watermark_ts DESC) "
          f"AS rn FROM sys_watermarks WHERE source = '{_CURSOR_SOURCE}' AND account_id <> '{_NEW_ACCOUNT}') WHERE rn = 1), "
          f"s AS (SELECT 'acc' || CAST(l_orderkey % 5 AS VARCHAR) AS account_id, {_LI_SHIFT} AS last_change_ts "
          f"FROM lineitem), "
          f"cur AS (SELECT account_id, COALESCE(watermark_ts, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR) AS cursor "
          f"FROM (SELECT DISTINCT account_id FROM s) LEFT JOIN known USING (account_id)) "
          f"SELECT s.account_id, count(*) AS rows, max(s.last_change_ts) AS new_cursor "
          f"FROM s JOIN cur ON s.account_id = cur.account_id WHERE s.last_change_ts > cur.cursor GROUP BY s.account_id")
def w1_w2(p: Stages) -> DataFrame:
    """W1 + W2 as one batch job: the stored cursor of each account with sales (else
    now − 48 h), the normalised sales changed after it, and the cursor they advance to."""
    from vitrine.sources import tables as K
    now = dt.datetime(2024, 1, 31, 0, 0)
    li = p.table("lineitem")
    accounts = li.select(F.lit(_CURSOR_SOURCE).alias("source"),
                         F.concat(F.lit("acc"), (F.col("l_orderkey") % 5).cast("string")).alias("account_id"))
    history = p.watermarks.where((F.col("source") == _CURSOR_SOURCE) & (F.col("account_id") != _NEW_ACCOUNT))
    cur = K.read_cursor(history, now, accounts=accounts).select("account_id", "cursor")
    sales = normalize.wb_sales(_recs(landing.wb_sales_pages(li)), _RUN, _ACC)
    # the landed pages carry no account; it is the binding's rule on the order key in srid
    acct = F.concat(F.lit("acc"), (F.split("srid", "-").getItem(0).cast("bigint") % 5).cast("string"))
    # a generated row each: the join's conditions compare the values, not their whole expressions again
    s = sales.select(F.inline(F.array(F.struct(acct.alias("account_id"), "last_change_ts"))))
    # Spark takes the parsed sales for the smaller side; the cursors are, one row an account
    j = s.join(F.broadcast(cur), "account_id").where(F.col("last_change_ts") > F.col("cursor"))
    return j.groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"), F.max("last_change_ts").alias("new_cursor"))


# ================================================ S1–S9 read from landed files

_SINCE, _UNTIL = dt.datetime(2020, 3, 1), dt.datetime(2023, 9, 1)  # the changes that are asked for


def _landed(p: Stages) -> str:
    """Sales landed as text files of several records a page, read back and stored with their rejects."""
    files, _ = _stream_dirs(p.spark, "landed")
    landing.wb_sales_order_pages(p.table("lineitem")).write.option("compression", "lz4").text(files)
    stored, _ = _stream_dirs(p.spark, "landed-records")
    feeds.store_pages(feeds.parse_pages(feeds.read_lines(p.spark, files), keep=["ingested_at"]), stored)
    return stored


@register("s1_landed_sales",
          f"SELECT {_META_SQL}, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS srid, "
          f"{_LI_SHIFT} AS last_change_ts, {_LI_SHIFT} AS event_ts, l_partkey AS nm_id, "
          f"CAST(l_quantity AS INTEGER) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price_rub, "
          f"CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return FROM lineitem "
          f"WHERE {_LI_SHIFT} >= TIMESTAMP '{_SINCE}' AND {_LI_SHIFT} < TIMESTAMP '{_UNTIL}'")
def s1(p: Stages) -> DataFrame:
    recs = feeds.in_time(feeds.stored_records(p.spark, _landed(p)), normalize.WB_CHANGE_TIME, _SINCE, _UNTIL)
    return normalize.wb_sales(recs, _RUN, _ACC).select(
        "run_id", "account_id", "srid", "last_change_ts", "event_ts", "nm_id", "quantity", "price_rub", "is_return")


@register("s9_landed_rejects",
          "SELECT CASE l_orderkey % 10 WHEN 3 THEN 'not JSON' WHEN 5 THEN 'no records' ELSE 'not an object' END AS reject, "
          "count(DISTINCT l_orderkey) AS rows FROM lineitem WHERE l_orderkey % 10 IN (3, 5, 7) GROUP BY 1")
def s9_rejects(p: Stages) -> DataFrame:
    return feeds.stored_rejects(p.spark, _landed(p)).groupBy("reject").agg(F.count(F.lit(1)).alias("rows"))


# ================================================== W12/W13 as running streams

def _stream_dirs(spark: SparkSession, tag: str) -> tuple[str, str]:
    import uuid
    from vitrine.session import checkpoint_dir
    base = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _event_stream(p: Stages) -> DataFrame:
    """The events table as a file stream (schema from the batch read)."""
    path = f"{p.sf_dir}/events*.parquet"  # a glob: the file source needs a directory or a pattern
    return p.spark.readStream.schema(p.table("events").schema).parquet(path)


@register("w12_stream_daily_event_counts",
          "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, "
          "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def w12(p: Stages) -> DataFrame:
    from vitrine.streaming import ingest as S
    out, ck = _stream_dirs(p.spark, "w12")
    S.run_update_stream(S.event_counts_stream(_event_stream(p)), out, ck).awaitTermination()
    return S.read_update_table(p.spark, out, ["day", "event_type"])


@register("w13_stream_latest_stock",
          "SELECT CAST(snapshot_ts AS DATE) AS day, 'wb' AS marketplace, account_id, "
          "CAST(chrt_id AS VARCHAR) AS product_id, warehouse_id, CAST(arg_max(amount, snapshot_ts) AS BIGINT) AS stock_end "
          "FROM raw_wb_stocks GROUP BY 1, 2, 3, 4, 5")
def w13(p: Stages) -> DataFrame:
    from vitrine.sources import bindings as Bd
    from vitrine.streaming import ingest as S
    raw = Bd.raw_wb_stocks(_event_stream(p))
    stg = raw.select("ingested_at", "account_id", "snapshot_ts", "warehouse_id", "amount",
                     F.lit("wb").alias("marketplace"), F.col("chrt_id").cast("string").alias("product_id"))
    out, ck = _stream_dirs(p.spark, "w13")
    S.run_update_stream(S.latest_stock_stream(stg), out, ck).awaitTermination()
    return S.read_update_table(p.spark, out, ["day", "marketplace", "account_id", "product_id", "warehouse_id"])


@register("w12_stream_mrt_sales",
          "SELECT CAST(event_ts AS DATE) AS day, 'wb' AS marketplace, account_id, CAST(nm_id AS VARCHAR) AS product_id, "
          "CAST(SUM(CASE WHEN is_return = 1 THEN -quantity ELSE quantity END) AS BIGINT) AS qty, "
          "CAST(SUM(CASE WHEN is_return = 0 THEN price_rub * quantity END) AS DOUBLE) AS revenue, "
          "CAST(SUM(payout_rub) AS DOUBLE) AS payout, "
          "CAST(SUM(CASE WHEN is_return = 1 THEN -quantity END) AS BIGINT) AS returns_qty FROM raw_wb_sales GROUP BY 1, 2, 3, 4")
def w12_mart(p: Stages) -> DataFrame:
    """W12 at M1's grain: the sales lines as a file stream, one row per day, account and product."""
    from vitrine.streaming import ingest as S
    lines = p.spark.readStream.schema(p.table("lineitem").schema).parquet(f"{p.sf_dir}/lineitem*.parquet")
    qty = F.when(F.col("is_return") == 1, -F.col("quantity")).otherwise(F.col("quantity"))
    stg = B.raw_wb_sales(lines).select("event_ts", F.lit("wb").alias("marketplace"), "account_id",
                                       F.col("nm_id").cast("string").alias("product_id"), "is_return", qty.alias("qty"),
                                       F.col("price_rub").alias("price_gross"), F.col("payout_rub").alias("payout"))
    out, ck = _stream_dirs(p.spark, "w12-mart")
    months = S.daily_sales_stream(stg).withColumn("month", F.to_date(F.date_trunc("month", "day")))  # years of days: fewer files
    S.run_update_stream(months, out, ck, day_col="month").awaitTermination()
    return S.read_update_table(p.spark, out, ["day", "marketplace", "account_id", "product_id"]).drop("month")


# =============================================== W3–W8: cursors and re-reads

_NOW = dt.datetime(2024, 1, 31, 6, 30)  # the runs' time
_NOW_SQL = f"TIMESTAMP '{_NOW}'"


def _landed_lines(spark: SparkSession, tag: str, lines: DataFrame) -> str:
    """Pages landed as text files, for a file stream: compressed, and so, as one task reads
    such a file, of some pages each."""
    files, _ = _stream_dirs(spark, tag)
    lines.select("line").write.option("compression", "gzip").option("zlib.compress.level", "FIVE") \
        .option("maxRecordsPerFile", 50_000).text(files)
    return files


@register("w3_postings_ingest",
          f"SELECT 'posting' AS part, {_POSTING_NO} AS posting_number, CAST(NULL AS BIGINT) AS ozon_product_id, "
          f"CAST(NULL AS INTEGER) AS quantity, {_LI_SHIFT} AS at FROM lineitem "
          f"UNION ALL SELECT 'item', {_POSTING_NO}, l_partkey, GREATEST(1, CAST(l_quantity AS INTEGER)), NULL "
          f"FROM lineitem WHERE l_linenumber <> 7 UNION ALL SELECT 'cursor', NULL, NULL, NULL, {_NOW_SQL}")
def w3(p: Stages) -> DataFrame:
    """Posting headers and their items from one read of each micro-batch; the cursor becomes the run's time."""
    from vitrine.sources import tables as K
    from vitrine.streaming import ingest as S
    files = _landed_lines(p.spark, "w3-pages", landing.ozon_posting_pages(p.table("lineitem")))
    out, ck = _stream_dirs(p.spark, "w3")
    targets = {"postings": (lambda r: normalize.ozon_postings(r, _RUN, _ACC), f"{out}/postings", "ingested_at"),
               "items": (lambda r: normalize.ozon_posting_items(r, _RUN, _ACC), f"{out}/items", "ingested_at")}
    S.ingest(p.spark, files, targets, ck, "ozon_postings", cursor=("ozon_postings", _ACC, "created_at"),
             watermarks_root=f"{out}/cursors", cursor_rule="now", now=_NOW).awaitTermination()
    none = {"posting_number": "string", "ozon_product_id": "bigint", "quantity": "int", "at": "timestamp_ntz"}

    def part(name: str, df: DataFrame, **given) -> DataFrame:
        return df.select(F.lit(name).alias("part"), *[F.col(given[c]).alias(c) if c in given else F.lit(None).cast(t).alias(c)
                                                      for c, t in none.items()])

    cursors = K.read_cursor(K.read_table(p.spark, f"{out}/cursors"), _NOW)
    return part("posting", K.read_table(p.spark, f"{out}/postings"), posting_number="posting_number", at="created_at") \
        .unionByName(part("item", K.read_table(p.spark, f"{out}/items"), posting_number="posting_number",
                          ozon_product_id="ozon_product_id", quantity="quantity")) \
        .unionByName(part("cursor", cursors, at="cursor"))


@register("w4_finance_cursors",
          f"SELECT 'acc-ledger' AS account_id, count(*) AS rows, max(o_orderdate + INTERVAL 8430 DAY) AS cursor FROM orders "
          f"UNION ALL SELECT 'acc-quiet', 0, {_NOW_SQL}")
def w4(p: Stages) -> DataFrame:
    """The ledgers of two accounts in one table; the cursor of the one with operations
    becomes their greatest time, that of the one with an empty response the run's time."""
    from vitrine.sources import tables as K
    from vitrine.streaming import ingest as S
    out, ck = _stream_dirs(p.spark, "w4")
    full = landing.ozon_finance_pages(p.table("orders"))
    empty = p.spark.range(1).select(F.lit('{"result":{"operations":[]}}').alias("line"))
    for account, pages in (("acc-ledger", full), ("acc-quiet", empty)):
        files = _landed_lines(p.spark, f"w4-{account}", pages)
        target = (lambda r, a=account: normalize.ozon_finance(r, _RUN, a), f"{out}/ops", "ingested_at")
        S.ingest(p.spark, files, {"ops": target}, f"{ck}-{account}", "ozon_finance",
                 cursor=("ozon_finance", account, "operation_ts"), watermarks_root=f"{out}/cursors",
                 cursor_rule="greatest_or_now", now=_NOW).awaitTermination()
    rows = K.read_table(p.spark, f"{out}/ops").groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"))
    cursors = K.read_cursor(K.read_table(p.spark, f"{out}/cursors"), _NOW)
    return cursors.join(rows, "account_id", "left").select("account_id", F.coalesce("rows", F.lit(0)).alias("rows"), "cursor")


@register("w5_stock_snapshot",
          f"SELECT {_NOW_SQL} AS snapshot_ts, {_META_SQL}, NULLIF(user_id, 0) AS nm_id, user_id AS chrt_id, "
          f"'sku-' || CAST(user_id AS VARCHAR) AS sku, NULLIF(user_id % 3, 0) AS warehouse_id, "
          f"CAST(FLOOR(value) AS INTEGER) AS amount FROM events WHERE user_id % 2 = 0")
def w5(p: Stages) -> DataFrame:
    """A snapshot job stamps its own time on every stock row and appends them."""
    from vitrine.sources import tables as K
    from vitrine.streaming import ingest as S
    files = _landed_lines(p.spark, "w5-pages", landing.wb_stock_pages(p.table("events")))
    out, ck = _stream_dirs(p.spark, "w5")
    stamp = F.lit(_NOW).cast("timestamp_ntz")
    S.ingest(p.spark, files, {"stocks": (lambda r: normalize.wb_stocks(r, _RUN, _ACC, stamp), out, "snapshot_ts")},
             ck, "wb_stocks").awaitTermination()
    return K.read_table(p.spark, out).drop("payload", "ingested_at", "day")


@register("w6_funnel_reread",
          f"SELECT {_META_SQL}, day, nm_id, open_card_count, add_to_cart_count, orders_count, buyouts_count, cancel_count "
          f"FROM raw_wb_funnel_daily WHERE day BETWEEN {_sqld(_d(8))} AND {_sqld(AS_OF)}")
def w6(p: Stages) -> DataFrame:
    """The last seven days' funnel asked for on two days running, one job each; the
    days that both have stored count once (L1)."""
    from vitrine.operators.latest import latest_wins
    from vitrine.sources import tables as K
    from vitrine.streaming.ingest import in_range, last_days
    out, _ = _stream_dirs(p.spark, "w6")
    for run_day in (_d(1), AS_OF):
        asked = in_range(p.raw("raw_wb_funnel_daily"), "day", *last_days(run_day))
        K.append(p.spark, out, normalize.wb_funnel(_recs(landing.wb_funnel_pages(asked)), _RUN, _ACC))
    now = latest_wins(K.read_table(p.spark, out), ["nm_id", "day"], ("ingested_at",))
    return now.select("run_id", "account_id", "day", "nm_id", "open_card_count", "add_to_cart_count", "orders_count",
                      "buyouts_count", "cancel_count")


_BACKFILL = (AS_OF - dt.timedelta(days=feeds.clamp_backfill_days("sales", 365)), AS_OF)


@register("w8_sales_backfill",
          f"WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS srid, "
          f"{_LI_SHIFT} AS at, l_partkey AS nm_id, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem "
          f"WHERE CAST({_LI_SHIFT} AS DATE) BETWEEN {_sqld(_BACKFILL[0])} AND {_sqld(_BACKFILL[1])}) "
          f"SELECT 'sale' AS part, * FROM s UNION ALL SELECT 'cursor', NULL, max(s.at), NULL, NULL FROM s HAVING count(*) > 0")
def w8(p: Stages) -> DataFrame:
    """The last days' sales (the feed's most) in chunks of 30 days: a run that is ended
    after two chunks, one that goes on behind them, one that finds nothing to do; then the
    cursor stands at the greatest change time."""
    from vitrine.sources import tables as K
    from vitrine.streaming import ingest as S
    out, _ = _stream_dirs(p.spark, "w8")

    def read(lo: dt.date, hi: dt.date) -> DataFrame:
        shift = dt.timedelta(days=B.SHIFT_DAYS)
        days = p.table("lineitem").where(F.to_date("l_shipdate").between(F.lit(lo - shift), F.lit(hi - shift)))
        return _recs(landing.wb_sales_pages(days))

    for most in (2, None, None):
        S.backfill(p.spark, "wb_sales", read, lambda r: normalize.wb_sales(r, _RUN, _ACC), f"{out}/sales", "event_ts",
                   *_BACKFILL, chunk_days=30, cursor=("wb_sales", _ACC, "last_change_ts"), watermarks_root=f"{out}/cursors",
                   now=_NOW, max_chunks=most)
    sales = K.read_table(p.spark, f"{out}/sales").select(F.lit("sale").alias("part"), "srid", F.col("last_change_ts").alias("at"),
                                                        "nm_id", "quantity")
    cursors = K.read_table(p.spark, f"{out}/cursors").select(
        F.lit("cursor").alias("part"), F.lit(None).cast("string").alias("srid"), F.col("watermark_ts").alias("at"),
        F.lit(None).cast("bigint").alias("nm_id"), F.lit(None).cast("int").alias("quantity"))
    return sales.unionByName(cursors)


# ====================================================== K4/K5 on stored tables

_K4_GONE = AS_OF - dt.timedelta(days=3)      # a day whose raw rows vanish before the second rebuild
_K5_CUTOFF = AS_OF - dt.timedelta(days=20)   # retention cutoff applied afterwards


@register("k4_k5_funnel_table",
          f"SELECT day, marketplace, account_id, product_id, nm_id, views, adds_to_cart, orders, "
          f"CAST(orders_sum AS DOUBLE) AS orders_sum, buyouts, cancels, add_to_cart_conv, cart_to_order_conv, "
          f"buyout_percent, wishlist, currency, ingested_at FROM stg_funnel "
          f"WHERE day >= {_sqld(_K5_CUTOFF)} AND day <> {_sqld(_K4_GONE)}")
def k4_k5(p: Stages) -> DataFrame:
    """K4 twice + K5 on a real table: a full rebuild, a 14-day rebuild after one
    day's raw rows vanished (that day disappears, older days stay), then
    retention drops whole days before the cutoff."""
    from vitrine.operators import staging as St
    from vitrine.sources import tables as K
    root, _ = _stream_dirs(p.spark, "k4")
    K.windowed_replace(p.spark, root, p.stg_funnel, AS_OF - dt.timedelta(days=p.stg_days))
    raw = p.raw("raw_wb_funnel_daily").where(F.col("day") != F.lit(_K4_GONE))
    K.windowed_replace(p.spark, root, St.wb_funnel(raw, AS_OF, 14), AS_OF - dt.timedelta(days=14))
    K.retain(p.spark, root, _K5_CUTOFF)
    return K.read_table(p.spark, root).drop("meta_json")


_STORED_DAYS = 30  # the window that is rebuilt
_STORED_FROM = AS_OF - dt.timedelta(days=_STORED_DAYS)
_ORDERS = {"raw_wb_sales": B.WB_SALES_ORDER, "raw_wb_orders": B.WB_ORDERS_ORDER,
           "raw_ozon_posting_items": B.OZON_ITEMS_ORDER}


def _stored_sales(p: Stages, root: str) -> None:
    """stg_sales stored by two rebuilds: a week earlier, when a part of the items had
    not landed yet, and on the reporting date, which merges them into their days."""
    from vitrine.plans import rebuild
    raw = {n: p.raw(n) for n in ("raw_wb_sales", "raw_ozon_posting_items", "raw_ozon_postings", "raw_wb_orders",
                                 "raw_wb_stocks", "raw_ozon_stocks", "raw_wb_funnel_daily", "raw_ozon_ads_daily",
                                 "raw_ozon_finance_ops")}
    landed = F.pmod(F.xxhash64("posting_number"), F.lit(7)) != 0
    early = {**raw, "raw_ozon_posting_items": raw["raw_ozon_posting_items"].where(landed)}
    for rows, as_of in ((early, AS_OF - dt.timedelta(days=7)), (raw, AS_OF)):
        rebuild.rebuild_staging(p.spark, rows, root, as_of, _STORED_DAYS, p.run_ts, B.INGEST_AFTER_EVENT, _ORDERS, ("stg_sales",))


# What a rebuild of the window reads: channel sales by their day, posting items by their ingest day.
_STORED_SALES_SQL = (f"SELECT * FROM stg_sales WHERE COALESCE(CAST(day AS DATE), CAST(ingested_at AS DATE)) >= {_sqld(_STORED_FROM)} "
                     f"AND (marketplace <> 'ozon' OR CAST(ingested_at AS DATE) >= {_sqld(_STORED_FROM)})")


@register("t14_stored_stg_sales", f"SELECT {_STG_SALES_SQL} FROM ({_STORED_SALES_SQL})")
def t14(p: Stages) -> DataFrame:
    """T14 + K4 on a real table: the window's stored rows equal the lazy plan's,
    after an earlier rebuild that lacked late items."""
    from vitrine.plans import rebuild
    from vitrine.sources import tables as K
    root, _ = _stream_dirs(p.spark, "t14")
    _stored_sales(p, root)
    rows = K.read_table(p.spark, f"{root}/stg_sales", day_from=_STORED_FROM)
    return _drop_meta(rows.drop(rebuild.PART))


@register("m5_stored_mrt_sales",
          f"WITH stored AS ({_STORED_SALES_SQL}), mart AS ({O.CTES['mrt_sales'].replace('FROM stg_sales', 'FROM stored')}) "
          f"{_M1_SQL.replace('FROM mrt_sales', 'FROM mart')} WHERE day >= {_sqld(_STORED_FROM)}")
def m5(p: Stages) -> DataFrame:
    """M5 + K4: the sales mart built from stored staging, over a mart that an
    earlier run and a run without any staging rows have left."""
    from vitrine.plans import rebuild
    from vitrine.sources import tables as K
    root, _ = _stream_dirs(p.spark, "m5")
    _stored_sales(p, f"{root}/stg")
    mart = ("mrt_sales_daily",)
    rebuild.rebuild_marts(p.spark, f"{root}/stg", f"{root}/mrt", AS_OF - dt.timedelta(days=3), _STORED_DAYS, p.run_ts, mart)
    rebuild.rebuild_marts(p.spark, f"{root}/none", f"{root}/mrt", AS_OF, _STORED_DAYS, p.run_ts, mart)  # empties it
    rebuild.rebuild_marts(p.spark, f"{root}/stg", f"{root}/mrt", AS_OF, _STORED_DAYS, p.run_ts, mart)
    return K.read_table(p.spark, f"{root}/mrt/mrt_sales_daily", day_from=_STORED_FROM)


_DIM_NEW = "marketplace = 'ozon' OR nm_id % 2 = 0"


@register("k7_dim_product_upsert",
          f"WITH old AS (SELECT * REPLACE ('before' AS title, updated_at - INTERVAL 1 DAY AS updated_at) FROM dim_product), "
          f"new AS (SELECT * FROM dim_product WHERE {_DIM_NEW}) "
          f"SELECT * FROM new UNION ALL SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n "
          f"WHERE n.marketplace = o.marketplace AND n.account_id = o.account_id AND n.product_id = o.product_id) "
          f"UNION ALL SELECT * REPLACE (product_id || '-gone' AS product_id) FROM old")
def k7(p: Stages) -> DataFrame:
    """K7: products of both channels upserted into an existing dimension that
    holds older rows of them and products that are gone; stale rows change nothing."""
    from vitrine.plans import rebuild
    from vitrine.sources import tables as K
    root, _ = _stream_dirs(p.spark, "k7")
    now, key = p.materialize(("dim_product",)).dim_product, rebuild.DIM_KEY  # read four times below
    old = now.withColumns({"title": F.lit("before"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 DAY")})
    K.upsert(p.spark, root, old.unionByName(old.withColumn("product_id", F.concat("product_id", F.lit("-gone")))), key, "updated_at")
    K.upsert(p.spark, root, now.where(_DIM_NEW), key, "updated_at")
    stale = now.withColumns({"title": F.lit("stale"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 9 DAYS")})
    K.upsert(p.spark, root, stale, key, "updated_at")
    return K.read_upserted(p.spark, root, now.schema)


# ============================================================= W6–W8 ranges

@register("w7_ads_target_day",
          f"SELECT ingested_at, {_META_SQL}, day, campaign_id, impressions, clicks, CAST(cost AS DOUBLE) AS cost, "
          f"orders, CAST(revenue AS DOUBLE) AS revenue FROM raw_ozon_ads_daily WHERE day = {_sqld(_d(1))}")
def w7(p: Stages) -> DataFrame:
    """W7 (and the W6/W8 range form): one job over the target day's landed ads
    pages — default yesterday — normalised with P8."""
    from vitrine.streaming.ingest import in_range
    recs = _recs(landing.ozon_ads_pages(p.raw("raw_ozon_ads_daily")))
    day = _d(1)
    return in_range(normalize.ozon_ads(recs, _RUN, _ACC).drop("payload"), "day", day, day)
