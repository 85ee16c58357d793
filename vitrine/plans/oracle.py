"""The same warehouse stated independently in DuckDB SQL (the oracle).

Each CTE mirrors one binding, staging table or mart; ``sql(final)`` prefixes a
final SELECT with exactly the CTEs it needs (transitively).  Money is DECIMAL
until the final projection casts it to DOUBLE, integer sums are cast back to
BIGINT (DuckDB widens them to HUGEINT), windows are the closed day ranges the
Spark plans use.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2024-01-31'"
RUN_TS = "TIMESTAMP '2024-01-31 00:00:00'"
SHIFT = "INTERVAL 8430 DAY"
STG_DAYS = 365
MART_DAYS = 365


def win(day_expr: str, days: int) -> str:
    return f"({day_expr} BETWEEN {AS_OF} - {days} AND {AS_OF})"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


ACC = "'acc' || CAST({} % 5 AS VARCHAR)"

CTES: dict[str, str] = {}

# ------------------------------------------------------------------ bindings
CTES["raw_wb_sales"] = f"""
SELECT l_shipdate + {SHIFT} AS ingested_at, 'bind' AS run_id, {ACC.format('l_orderkey')} AS account_id,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS srid,
       l_shipdate + {SHIFT} AS last_change_ts, l_shipdate + {SHIFT} AS event_ts,
       l_partkey AS nm_id, l_suppkey AS chrt_id, 'bc-' || CAST(l_partkey AS VARCHAR) AS barcode,
       CAST(l_quantity AS INTEGER) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price_rub,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS payout_rub,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return, CAST(NULL AS VARCHAR) AS payload
FROM lineitem"""

CTES["raw_wb_orders"] = f"""
SELECT l_shipdate + {SHIFT} AS ingested_at, {ACC.format('l_orderkey')} AS account_id,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS srid,
       l_shipdate + {SHIFT} AS last_change_ts, l_shipdate + {SHIFT} AS event_ts,
       l_partkey AS nm_id, l_suppkey AS chrt_id, GREATEST(1, CAST(l_quantity AS INTEGER)) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price_rub
FROM lineitem"""

CTES["raw_wb_stocks"] = f"""
SELECT ts AS ingested_at, {ACC.format('user_id')} AS account_id, ts AS snapshot_ts,
       user_id AS nm_id, user_id AS chrt_id, 'sku-' || CAST(user_id AS VARCHAR) AS sku,
       NULLIF(user_id % 3, 0) AS warehouse_id, CAST(FLOOR(value) AS INTEGER) AS amount
FROM events WHERE user_id % 2 = 0"""

CTES["raw_wb_funnel_daily"] = f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS ingested_at,
       {ACC.format('user_id')} AS account_id, CAST(ts AS DATE) AS day, user_id AS nm_id,
       CAST(count_if(event_type = 'view') AS BIGINT) AS open_card_count, CAST(count_if(event_type = 'click') AS BIGINT) AS add_to_cart_count,
       CAST(count_if(event_type = 'purchase') AS BIGINT) AS orders_count,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS orders_sum_rub,
       CAST(count_if(event_type = 'signup') AS BIGINT) AS buyouts_count, CAST(count_if(event_type = 'error') AS BIGINT) AS cancel_count,
       CAST(0 AS DOUBLE) AS add_to_cart_conv, CAST(0 AS DOUBLE) AS cart_to_order_conv,
       CAST(0 AS DOUBLE) AS buyout_percent,
       CAST(0 AS BIGINT) AS add_to_wishlist, 'RUB' AS currency
FROM events GROUP BY 2, 3, 4"""

CTES["raw_ozon_postings"] = f"""
SELECT o_orderdate + {SHIFT} AS ingested_at, {ACC.format('o_orderkey')} AS account_id,
       CAST(o_orderkey AS VARCHAR) AS posting_number,
       CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'awaiting_deliver' END AS status,
       o_orderdate + {SHIFT} AS created_at, o_orderdate + {SHIFT} + INTERVAL 1 HOUR AS in_process_at,
       o_orderdate + {SHIFT} + INTERVAL 1 DAY AS shipped_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + {SHIFT} + INTERVAL 3 DAY END AS delivered_at,
       CAST(NULL AS TIMESTAMP) AS canceled_at, o_custkey % 3 AS ozon_warehouse_id
FROM orders WHERE o_orderstatus <> 'P'"""

CTES["raw_ozon_posting_items"] = f"""
SELECT l_shipdate + {SHIFT} AS ingested_at, {ACC.format('l_orderkey')} AS account_id,
       CAST(l_orderkey AS VARCHAR) AS posting_number, l_partkey AS ozon_product_id,
       'offer-' || CAST(l_partkey AS VARCHAR) AS offer_id, 'item ' || CAST(l_partkey AS VARCHAR) AS name,
       GREATEST(1, CAST(l_quantity AS INTEGER)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_tax AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS payout,
       l_linenumber AS line_no, l_suppkey AS supplier_id
FROM lineitem"""

CTES["raw_ozon_stocks"] = f"""
SELECT ts AS ingested_at, {ACC.format('user_id')} AS account_id, ts AS snapshot_ts,
       user_id AS ozon_product_id, 'offer-' || CAST(user_id AS VARCHAR) AS offer_id,
       NULLIF(user_id % 3, 0) AS warehouse_id, CAST(FLOOR(value) AS INTEGER) AS present,
       LEAST(CAST(FLOOR(value) AS INTEGER), CAST(event_id % 3 AS INTEGER)) AS reserved
FROM events WHERE user_id % 2 = 1"""

CTES["raw_ozon_ads_daily"] = f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS ingested_at,
       {ACC.format('user_id')} AS account_id, CAST(ts AS DATE) AS day,
       'camp-' || CAST(user_id % 20 AS VARCHAR) AS campaign_id,
       CAST(count_if(event_type = 'view') AS BIGINT) AS impressions, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS cost,
       CAST(count_if(event_type = 'purchase') AS BIGINT) AS orders,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS revenue
FROM events GROUP BY 2, 3, 4"""

CTES["raw_ozon_finance_ops"] = f"""
SELECT o_orderdate + {SHIFT} AS ingested_at, {ACC.format('o_orderkey')} AS account_id,
       CAST(o_orderkey AS VARCHAR) AS operation_id, o_orderdate + {SHIFT} AS operation_ts,
       o_orderpriority AS type,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2))
            ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END AS amount, 'RUB' AS currency
FROM orders"""

CTES["sys_task_runs"] = """
SELECT 'task_' || CAST(user_id % 10 AS VARCHAR) AS task_name, CAST(event_id AS VARCHAR) AS run_id,
       ts AS started_at, ts + to_seconds(CAST(FLOOR(value) AS BIGINT)) AS finished_at,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CAST(FLOOR(value) AS BIGINT) AS rows_ingested, event_type AS message, props AS meta_json
FROM events"""

CTES["sys_watermarks"] = f"""
SELECT event_type AS source, {ACC.format('user_id')} AS account_id,
       ts - to_minutes(CAST(FLOOR(value) AS BIGINT)) AS watermark_ts, ts AS updated_at
FROM events"""

# ------------------------------------------------------------------- staging
CTES["stg_sales_wb"] = f"""
SELECT CAST(event_ts AS DATE) AS day, 'wb' AS marketplace, account_id, event_ts, srid AS order_id,
       CAST(NULL AS VARCHAR) AS posting_number, srid, CAST(nm_id AS VARCHAR) AS product_id, nm_id,
       CAST(NULL AS BIGINT) AS ozon_product_id, CAST(NULL AS VARCHAR) AS offer_id,
       CASE WHEN is_return = 1 THEN -quantity ELSE quantity END AS qty, price_rub AS price_gross,
       payout_rub AS payout, is_return, last_change_ts, ingested_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, srid
        ORDER BY ingested_at DESC, nm_id DESC, chrt_id DESC, price_rub DESC) AS rn FROM raw_wb_sales)
WHERE rn = 1 AND {win('CAST(event_ts AS DATE)', STG_DAYS)}"""

CTES["items_latest"] = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, posting_number, ozon_product_id
        ORDER BY ingested_at DESC, line_no DESC, supplier_id DESC, price DESC) AS rn
      FROM raw_ozon_posting_items) WHERE rn = 1"""

CTES["postings_latest"] = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, posting_number
        ORDER BY ingested_at DESC) AS rn FROM raw_ozon_postings) WHERE rn = 1"""

CTES["stg_sales_ozon"] = f"""
SELECT CAST(p.created_at AS DATE) AS day, 'ozon' AS marketplace, i.account_id, p.created_at AS event_ts,
       i.posting_number AS order_id, i.posting_number, CAST(NULL AS VARCHAR) AS srid,
       CAST(i.ozon_product_id AS VARCHAR) AS product_id, CAST(NULL AS BIGINT) AS nm_id, i.ozon_product_id,
       i.offer_id, i.quantity AS qty, i.price AS price_gross, i.payout, 0 AS is_return,
       p.created_at AS last_change_ts, i.ingested_at
FROM items_latest i LEFT JOIN postings_latest p
  ON i.account_id = p.account_id AND i.posting_number = p.posting_number
WHERE {win('CAST(i.ingested_at AS DATE)', STG_DAYS)}"""

CTES["stg_sales"] = "SELECT * FROM stg_sales_wb UNION ALL BY NAME SELECT * FROM stg_sales_ozon"

CTES["stg_orders_wb"] = f"""
SELECT CAST(event_ts AS DATE) AS day, 'wb' AS marketplace, account_id, event_ts, srid AS order_id,
       'new' AS status, CAST(nm_id AS VARCHAR) AS product_id, quantity AS qty, price_rub AS price_gross,
       last_change_ts, ingested_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, srid
        ORDER BY ingested_at DESC, nm_id DESC, chrt_id DESC, price_rub DESC) AS rn FROM raw_wb_orders)
WHERE rn = 1 AND {win('CAST(event_ts AS DATE)', STG_DAYS)}"""

CTES["stg_orders_ozon"] = f"""
SELECT CAST(created_at AS DATE) AS day, 'ozon' AS marketplace, account_id, created_at AS event_ts,
       posting_number AS order_id, status, CAST(NULL AS VARCHAR) AS product_id, CAST(NULL AS INTEGER) AS qty,
       CAST(NULL AS DECIMAL(18,2)) AS price_gross, in_process_at AS last_change_ts, ingested_at
FROM postings_latest WHERE {win('CAST(created_at AS DATE)', STG_DAYS)}"""

CTES["stg_orders"] = "SELECT * FROM stg_orders_wb UNION ALL BY NAME SELECT * FROM stg_orders_ozon"

_STOCK_DAY_LATEST = """ROW_NUMBER() OVER (PARTITION BY marketplace, account_id, day, product_id, warehouse_id
        ORDER BY snapshot_ts DESC, ingested_at DESC)"""

CTES["stg_stocks_wb"] = f"""
SELECT * EXCLUDE (rn2) FROM (
  SELECT *, {_STOCK_DAY_LATEST} AS rn2 FROM (
    SELECT CAST(snapshot_ts AS DATE) AS day, 'wb' AS marketplace, account_id, snapshot_ts,
           CAST(chrt_id AS VARCHAR) AS product_id, nm_id, CAST(NULL AS BIGINT) AS ozon_product_id,
           sku AS offer_id, warehouse_id, amount, CAST(NULL AS INTEGER) AS reserved,
           CAST(NULL AS INTEGER) AS present, ingested_at
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, snapshot_ts, chrt_id, warehouse_id
            ORDER BY ingested_at DESC) AS rn FROM raw_wb_stocks
          WHERE {win('CAST(snapshot_ts AS DATE)', STG_DAYS)}) WHERE rn = 1))
WHERE rn2 = 1"""

CTES["stg_stocks_ozon"] = f"""
SELECT * EXCLUDE (rn2) FROM (
  SELECT *, {_STOCK_DAY_LATEST} AS rn2 FROM (
    SELECT CAST(snapshot_ts AS DATE) AS day, 'ozon' AS marketplace, account_id, snapshot_ts,
           CAST(ozon_product_id AS VARCHAR) AS product_id, CAST(NULL AS BIGINT) AS nm_id, ozon_product_id,
           offer_id, warehouse_id, present - reserved AS amount, reserved, present, ingested_at
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, snapshot_ts, ozon_product_id, warehouse_id
            ORDER BY ingested_at DESC) AS rn FROM raw_ozon_stocks
          WHERE {win('CAST(snapshot_ts AS DATE)', STG_DAYS)}) WHERE rn = 1))
WHERE rn2 = 1"""

CTES["stg_stocks"] = "SELECT * FROM stg_stocks_wb UNION ALL BY NAME SELECT * FROM stg_stocks_ozon"

CTES["stg_funnel"] = f"""
SELECT day, 'wb' AS marketplace, account_id, CAST(nm_id AS VARCHAR) AS product_id, nm_id,
       open_card_count AS views, add_to_cart_count AS adds_to_cart, orders_count AS orders,
       orders_sum_rub AS orders_sum, buyouts_count AS buyouts, cancel_count AS cancels,
       add_to_cart_conv, cart_to_order_conv, buyout_percent, add_to_wishlist AS wishlist, currency, ingested_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, day, nm_id ORDER BY ingested_at DESC) AS rn
      FROM raw_wb_funnel_daily WHERE {win('day', STG_DAYS)}) WHERE rn = 1"""

CTES["stg_ads"] = f"""
SELECT day, 'ozon' AS marketplace, account_id, campaign_id, impressions, clicks, cost, orders, revenue, ingested_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, day, campaign_id ORDER BY ingested_at DESC) AS rn
      FROM raw_ozon_ads_daily WHERE {win('day', max(60, STG_DAYS))}) WHERE rn = 1"""

CTES["stg_finance"] = f"""
SELECT CAST(operation_ts AS DATE) AS day, 'ozon' AS marketplace, account_id, operation_ts, operation_id,
       type, amount, currency, ingested_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, operation_ts, operation_id ORDER BY ingested_at DESC) AS rn
      FROM raw_ozon_finance_ops WHERE {win('CAST(operation_ts AS DATE)', max(60, STG_DAYS))}) WHERE rn = 1"""

CTES["dim_product"] = f"""
SELECT 'wb' AS marketplace, account_id, CAST(nm_id AS VARCHAR) AS product_id, nm_id,
       min(struct_pack(c := chrt_id, b := barcode)).c AS chrt_id,
       min(struct_pack(c := chrt_id, b := barcode)).b AS sku,
       CAST(NULL AS VARCHAR) AS offer_id, CAST(NULL AS BIGINT) AS ozon_product_id, CAST(NULL AS VARCHAR) AS title,
       CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS category, {RUN_TS} AS updated_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id, srid
        ORDER BY ingested_at DESC, nm_id DESC, chrt_id DESC, price_rub DESC) AS rn FROM raw_wb_sales)
WHERE rn = 1 AND {win('CAST(event_ts AS DATE)', max(30, STG_DAYS))}
GROUP BY account_id, nm_id
UNION ALL
SELECT 'ozon', account_id, CAST(ozon_product_id AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
       CAST(NULL AS VARCHAR), min(offer_id), ozon_product_id, min(name), CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR), {RUN_TS}
FROM items_latest WHERE {win('CAST(ingested_at AS DATE)', max(30, STG_DAYS))}
GROUP BY account_id, ozon_product_id"""

# --------------------------------------------------------------------- marts
CTES["mrt_sales"] = f"""
SELECT day, marketplace, account_id, product_id, CAST(SUM(qty) AS BIGINT) AS qty,
       COALESCE(SUM(price_gross * qty) FILTER (WHERE is_return = 0), 0) AS revenue,
       SUM(payout) AS payout,
       CAST(COALESCE(SUM(qty) FILTER (WHERE is_return = 1), 0) AS BIGINT) AS returns_qty,
       {RUN_TS} AS updated_at
FROM stg_sales WHERE {win('day', MART_DAYS)}
GROUP BY day, marketplace, account_id, product_id"""

CTES["mrt_stock"] = f"""
SELECT day, marketplace, account_id, product_id, warehouse_id,
       CAST(arg_max(amount, snapshot_ts) AS BIGINT) AS stock_end, {RUN_TS} AS updated_at
FROM stg_stocks WHERE {win('day', MART_DAYS)}
GROUP BY day, marketplace, account_id, product_id, warehouse_id"""

CTES["mrt_funnel"] = f"""
SELECT *, {ratio('orders', 'views')} AS cr_order, {ratio('adds_to_cart', 'views')} AS cr_cart,
       {RUN_TS} AS updated_at
FROM (SELECT day, marketplace, account_id, product_id, CAST(SUM(views) AS BIGINT) AS views,
             CAST(SUM(adds_to_cart) AS BIGINT) AS adds_to_cart, CAST(SUM(orders) AS BIGINT) AS orders
      FROM stg_funnel WHERE {win('day', MART_DAYS)}
      GROUP BY day, marketplace, account_id, product_id)"""

CTES["mrt_ads"] = f"""
SELECT *, {ratio('cost', 'revenue')} AS acos, {ratio('revenue - cost', 'cost')} AS romi,
       {RUN_TS} AS updated_at
FROM (SELECT day, marketplace, account_id, campaign_id, CAST(SUM(impressions) AS BIGINT) AS impressions,
             CAST(SUM(clicks) AS BIGINT) AS clicks, SUM(cost) AS cost, CAST(SUM(orders) AS BIGINT) AS orders,
             SUM(revenue) AS revenue
      FROM stg_ads WHERE {win('day', max(60, MART_DAYS))}
      GROUP BY day, marketplace, account_id, campaign_id)"""

CTES["kpi_sales_30d"] = f"""
SELECT marketplace, account_id, SUM(revenue) AS revenue_30d, CAST(SUM(qty) AS BIGINT) AS qty_30d,
       CAST(SUM(returns_qty) AS BIGINT) AS returns_30d
FROM mrt_sales WHERE {win('day', 30)} GROUP BY marketplace, account_id"""

CTES["kpi_ads_30d"] = f"""
SELECT marketplace, account_id, SUM(cost) AS cost_30d, SUM(revenue) AS revenue_30d,
       {ratio('SUM(cost)', 'SUM(revenue)')} AS acos_30d
FROM mrt_ads WHERE {win('day', 30)} GROUP BY marketplace, account_id"""


def _deps(text: str, seen: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            _deps(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def sql(final: str) -> str:
    """``WITH <needed CTEs in dependency order> <final>``."""
    order: list[str] = []
    _deps(final, order)
    if not order:
        return final.strip()
    body = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    final = final.strip()
    if final[:5].upper() == "WITH ":  # merge the final query's own CTEs
        return f"WITH {body},\n{final[5:]}"
    return f"WITH {body}\n{final}"


# ------------------------------------------------------------- API results
CTES["api_sales"] = f"""
SELECT day, marketplace, account_id, product_id, CAST(SUM(qty) AS BIGINT) AS qty, SUM(revenue) AS revenue,
       CAST(SUM(returns_qty) AS BIGINT) AS returns_qty, SUM(COALESCE(payout, 0)) AS payout
FROM mrt_sales WHERE day BETWEEN {AS_OF} - 30 AND {AS_OF} GROUP BY day, marketplace, account_id, product_id"""

CTES["api_ads"] = f"""
SELECT *, {ratio('cost', 'revenue')} AS acos, {ratio('revenue - cost', 'cost')} AS romi FROM (
  SELECT day, marketplace, account_id, campaign_id, CAST(SUM(impressions) AS BIGINT) AS impressions,
         CAST(SUM(clicks) AS BIGINT) AS clicks, SUM(cost) AS cost, CAST(SUM(orders) AS BIGINT) AS orders,
         SUM(revenue) AS revenue
  FROM mrt_ads WHERE day BETWEEN {AS_OF} - 30 AND {AS_OF} GROUP BY day, marketplace, account_id, campaign_id)"""

CTES["api_funnel"] = f"""
SELECT *, {ratio('orders', 'views')} AS cr_order, {ratio('adds_to_cart', 'views')} AS cr_cart FROM (
  SELECT day, marketplace, account_id, product_id, CAST(SUM(views) AS BIGINT) AS views,
         CAST(SUM(adds_to_cart) AS BIGINT) AS adds_to_cart, CAST(SUM(orders) AS BIGINT) AS orders
  FROM mrt_funnel WHERE day BETWEEN {AS_OF} - 30 AND {AS_OF} GROUP BY day, marketplace, account_id, product_id)"""

CTES["api_stocks"] = """
SELECT s.day, s.marketplace, s.account_id, s.product_id, s.warehouse_id, CAST(SUM(s.stock_end) AS BIGINT) AS stock_end
FROM mrt_stock s WHERE s.day = (SELECT max(day) FROM mrt_stock)
GROUP BY s.day, s.marketplace, s.account_id, s.product_id, s.warehouse_id"""

CTES["api_kpis"] = """
SELECT s.marketplace, s.account_id, s.revenue_30d, s.qty_30d, s.returns_30d,
       COALESCE(a.cost_30d, 0) AS cost_30d, COALESCE(a.acos_30d, 0) AS acos_30d
FROM kpi_sales_30d s LEFT JOIN kpi_ads_30d a USING (marketplace, account_id)"""

# --------------------------------------------------------------- quality
NOW = "TIMESTAMP '2024-01-31 03:00:00'"
TSF = "'%Y-%m-%d %H:%M:%S.%f'"

CTES["dq_c1"] = f"""
SELECT 'stale_marts' AS "check", t AS table_name, CAST(NULL AS VARCHAR) AS account_id, t AS entity_id,
       COALESCE(strftime(last_updated, {TSF}), 'empty') AS detail
FROM (SELECT 'mrt_sales_daily' AS t, (SELECT max(updated_at) FROM mrt_sales) AS last_updated
      UNION ALL SELECT 'mrt_stock_daily', (SELECT max(updated_at) FROM mrt_stock)
      UNION ALL SELECT 'mrt_funnel_daily', (SELECT max(updated_at) FROM mrt_funnel)
      UNION ALL SELECT 'mrt_ads_daily', (SELECT max(updated_at) FROM mrt_ads))
WHERE (last_updated IS NULL OR last_updated < {NOW} - INTERVAL 2 HOUR)
  AND EXISTS (SELECT 1 FROM sys_task_runs WHERE task_name LIKE 'task_1%' AND status = 'success')"""

CTES["wm_backward"] = """
SELECT source, account_id, prev AS previous_watermark, watermark_ts, updated_at FROM (
  SELECT *, LAG(watermark_ts) OVER (PARTITION BY source, account_id ORDER BY updated_at, watermark_ts) AS prev
  FROM sys_watermarks WHERE watermark_ts IS NOT NULL) WHERE watermark_ts < prev"""

CTES["dq_c2"] = f"""
SELECT 'watermark_monotonicity' AS "check", 'sys_watermarks' AS table_name, account_id, source AS entity_id,
       strftime(watermark_ts, {TSF}) || ' < ' || strftime(previous_watermark, {TSF}) AS detail
FROM wm_backward"""

_DUP = (("stg_sales", "stg_sales", ("marketplace", "account_id", "order_id", "product_id", "event_ts")),
        ("stg_orders", "stg_orders", ("marketplace", "account_id", "order_id", "event_ts")),
        ("stg_stocks", "stg_stocks", ("marketplace", "account_id", "day", "product_id", "warehouse_id")),
        ("stg_funnel_daily", "stg_funnel", ("marketplace", "account_id", "day", "product_id")),
        ("stg_ads_daily", "stg_ads", ("marketplace", "account_id", "day", "campaign_id")),
        ("stg_finance_ops", "stg_finance", ("marketplace", "account_id", "operation_id", "operation_ts")),
        ("mrt_sales_daily", "mrt_sales", ("marketplace", "account_id", "day", "product_id")),
        ("mrt_stock_daily", "mrt_stock", ("marketplace", "account_id", "day", "product_id", "warehouse_id")),
        ("mrt_funnel_daily", "mrt_funnel", ("marketplace", "account_id", "day", "product_id")),
        ("mrt_ads_daily", "mrt_ads", ("marketplace", "account_id", "day", "campaign_id")),
        ("raw_wb_sales", "raw_wb_sales", ("account_id", "srid")))
_TS_COLS = ("event_ts", "operation_ts")


def _dup_sql(label: str, cte: str, key) -> str:
    parts = ", ".join(f"COALESCE(strftime({k}, {TSF}), '')" if k in _TS_COLS else f"COALESCE(CAST({k} AS VARCHAR), '')"
                      for k in key)
    return (f"SELECT 'duplicate_grains' AS \"check\", '{label}' AS table_name, account_id, "
            f"concat_ws('|', {parts}) AS entity_id, CAST(count(*) AS VARCHAR) AS detail "
            f"FROM {cte} GROUP BY {', '.join(key)} HAVING count(*) > 1")


CTES["dq_c3"] = "\nUNION ALL ".join(_dup_sql(*s) for s in _DUP)

CTES["dq_c4"] = f"""
SELECT 'impossible_timestamps' AS "check", 'raw_wb_sales' AS table_name, account_id, srid AS entity_id,
       strftime(event_ts, {TSF}) AS detail FROM raw_wb_sales WHERE event_ts > {NOW} + INTERVAL 5 MINUTE
UNION ALL
SELECT 'impossible_timestamps', 'raw_wb_orders', account_id, srid, strftime(event_ts, {TSF})
FROM raw_wb_orders WHERE event_ts > {NOW} + INTERVAL 5 MINUTE
UNION ALL
SELECT 'impossible_timestamps', 'raw_ozon_postings', account_id, posting_number, strftime(created_at, {TSF})
FROM raw_ozon_postings WHERE created_at > {NOW} + INTERVAL 5 MINUTE
   OR (delivered_at IS NOT NULL AND delivered_at < created_at) OR (canceled_at IS NOT NULL AND canceled_at < created_at)
UNION ALL
SELECT 'impossible_timestamps', 'stg_sales', account_id, order_id, strftime(event_ts, {TSF})
FROM stg_sales WHERE event_ts > {NOW} + INTERVAL 5 MINUTE"""

CTES["dq_c5"] = """
SELECT 'invalid_values' AS "check", 'mrt_stock_daily_negative' AS table_name, account_id, product_id AS entity_id,
       CAST(stock_end AS VARCHAR) AS detail FROM mrt_stock WHERE stock_end < 0
UNION ALL
SELECT 'invalid_values', 'mrt_ads_daily_negative_cost', account_id, campaign_id, CAST(cost AS VARCHAR)
FROM mrt_ads WHERE cost < 0 OR revenue < 0
UNION ALL
SELECT 'invalid_values', 'mrt_funnel_daily_impossible_counts', account_id, product_id,
       CAST(views AS VARCHAR) || '/' || CAST(adds_to_cart AS VARCHAR) || '/' || CAST(orders AS VARCHAR)
FROM mrt_funnel WHERE adds_to_cart > views OR orders > adds_to_cart"""

CTES["dq_all"] = """
SELECT * FROM dq_c1 UNION ALL SELECT * FROM dq_c2 UNION ALL SELECT * FROM dq_c3
UNION ALL SELECT * FROM dq_c4 UNION ALL SELECT * FROM dq_c5"""

CTES["dq_summary"] = """
SELECT c."check", CASE c."check"
         WHEN 'stale_marts' THEN 'mart tables are stale or empty after successful marts runs'
         WHEN 'watermark_monotonicity' THEN 'watermarks moved backwards for one or more source/account pairs'
         WHEN 'duplicate_grains' THEN 'canonical stg/mrt tables contain duplicate rows on expected grain'
         WHEN 'impossible_timestamps' THEN 'future or chronologically impossible timestamps were detected'
         WHEN 'invalid_values' THEN 'negative or impossible aggregate values were detected' END AS summary,
       c.failures, s.samples
FROM (SELECT "check", count(*) AS failures FROM dq_all GROUP BY "check") c
JOIN (SELECT "check", string_agg(sample, ';' ORDER BY rn) AS samples FROM (
        SELECT "check", table_name || ':' || COALESCE(account_id, '') || ':' || entity_id AS sample,
               ROW_NUMBER() OVER (PARTITION BY "check" ORDER BY table_name, account_id NULLS FIRST, entity_id, detail) AS rn
        FROM dq_all) WHERE rn <= 3 GROUP BY "check") s USING ("check")"""
