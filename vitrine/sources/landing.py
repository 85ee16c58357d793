"""Landed JSON pages derived from the driver's tables.

Every row of a source table becomes one response page (one line) in the
shape a channel API sends, with field aliases, envelopes and encodings varied
by row so that every normaliser path runs.  The oracle states the expected
raw rows directly from the same tables.  One page per row keeps the landing a
pure projection — no grouping, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.schemas import MONEY
from vitrine.sources.bindings import SHIFT_DAYS


def _iso(ts: Column, offset_hours: int = 0) -> Column:
    """ISO-8601 text of a UTC wall time, written with the given offset."""
    if offset_hours == 0:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    local = ts + F.make_dt_interval(hours=F.lit(offset_hours))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{offset_hours:02d}:00"))


def _shift(c: str) -> Column:
    return F.col(c) + F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")


def _page(rec_json: Column, kind: Column) -> Column:
    """Wrap one record: 0 → bare list, 1 → ``{result: […]}``, 2 → ``{data: […]}``,
    3 → ``{result: {postings: […]}}``."""
    arr = F.concat(F.lit("["), rec_json, F.lit("]"))
    return (F.when(kind == 0, arr)
            .when(kind == 1, F.concat(F.lit('{"result":'), arr, F.lit("}")))
            .when(kind == 2, F.concat(F.lit('{"data":'), arr, F.lit("}")))
            .otherwise(F.concat(F.lit('{"result":{"postings":'), arr, F.lit(',"has_next":false}}'))))


def _wb_sale() -> Column:
    """wb sales: id under srid / saleID / gNumber; returns as a negative
    quantity or by operation name; price under three aliases (one as text).
    One struct with conditional fields: ``to_json`` leaves NULL fields out."""
    ts = _shift("l_shipdate")
    ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
    srid = F.concat_ws("-", ok.cast("string"), ln.cast("string"))
    price = F.col("l_extendedprice").cast(MONEY)
    qty = F.col("l_quantity").cast("int")
    is_r = F.col("l_returnflag") == "R"
    neg = is_r & (ln % 2 == 0)
    return F.struct(
        F.when(ln % 3 == 0, srid).alias("srid"), F.when(ln % 3 == 1, srid).alias("saleID"),
        F.when(ln % 3 == 2, srid).alias("gNumber"),
        _iso(ts).alias("lastChangeDate"), _iso(ts, 3).alias("date"),
        F.col("l_partkey").alias("nmId"), F.col("l_suppkey").cast("string").alias("chrtId"),
        F.concat(F.lit("bc-"), F.col("l_partkey")).alias("barcode"),
        F.when(neg, -qty).otherwise(qty).alias("quantity"),
        F.when(is_r & ~neg, F.lit("Возврат покупателя")).otherwise(F.lit("Продажа")).alias("supplierOperName"),
        F.when(ok % 3 == 0, price).alias("forPay"), F.when(ok % 3 == 1, price.cast("string")).alias("totalPrice"),
        F.when(ok % 3 == 2, price).alias("priceWithDisc"),
        F.when(ln != 1, price).alias("ppvzForPay"))


def wb_sales_pages(lineitem: DataFrame) -> DataFrame:
    """One sale a page, with the sale's time as its ingest time."""
    return lineitem.select(_shift("l_shipdate").alias("ingested_at"),
                           _page(F.to_json(_wb_sale()), F.col("l_linenumber") % 3).alias("line"))


def wb_sales_order_pages(lineitem: DataFrame) -> DataFrame:
    """All sales of an order on one page.  Orders that end in 7 hold a number among their
    records; those that end in 3 are followed by a copy that was cut off, and those that
    end in 5 by an error response."""
    ok = F.col("l_orderkey")
    orders = lineitem.groupBy("l_orderkey").agg(
        F.concat_ws(",", F.sort_array(F.collect_list(F.to_json(_wb_sale())))).alias("recs"))
    recs = F.when(ok % 10 == 7, F.concat(F.col("recs"), F.lit(",7"))).otherwise(F.col("recs"))
    page = _page(recs, ok % 4)
    pages = F.when(ok % 10 == 3, F.array(page, F.substring(page, F.lit(1), F.length(page) - 1))) \
        .when(ok % 10 == 5, F.array(page, F.lit('{"error":"too many requests"}'))).otherwise(F.array(page))
    return orders.select(F.explode(pages).alias("line"))


def ozon_posting_pages(lineitem: DataFrame, status: str | None = None) -> DataFrame:
    """ozon postings: one posting per lineitem with one product; cancel time at
    the top level or nested; line 7 has no products; line 6 of 'N' lines has no
    posting number; envelopes vary.  ``status`` overrides the status text."""
    created = _shift("l_shipdate")
    ln = F.col("l_linenumber")
    is_r = F.col("l_returnflag") == "R"
    price = F.col("l_extendedprice").cast(MONEY)
    cancel = _iso(created + F.expr("INTERVAL 1 DAYS"))
    product = F.struct(F.col("l_partkey").alias("product_id"),
                       F.concat(F.lit("offer-"), F.col("l_partkey")).alias("offer_id"),
                       F.concat(F.lit("item "), F.col("l_partkey")).alias("name"),
                       F.col("l_quantity").cast("int").alias("quantity"),
                       price.cast("string").alias("price"),
                       F.when(ln != 3, (price * F.lit(0.9).cast("decimal(2,1)")).cast(MONEY).cast("string"))
                       .alias("payout"))
    rec = F.struct(
        F.when((ln != 6) | (F.col("l_returnflag") != "N"),
               F.concat_ws("-", F.col("l_orderkey").cast("string"), ln.cast("string"))).alias("posting_number"),
        (F.lit(status) if status else
         F.when(F.col("l_linestatus") == "F", "delivered").otherwise("awaiting_packaging")).alias("status"),
        _iso(created).alias("created_at"), _iso(created + F.expr("INTERVAL 1 HOURS"), 3).alias("in_process_at"),
        F.when(ln % 2 == 0, _iso(created + F.expr("INTERVAL 5 HOURS"))).alias("shipment_date"),
        F.when(F.col("l_linestatus") == "F", _iso(created + F.expr("INTERVAL 2 DAYS"))).alias("delivering_date"),
        F.when(is_r & (ln % 2 == 1), cancel).alias("cancelled_at"),
        F.when(is_r & (ln % 2 == 0), F.struct(cancel.alias("cancelled_at"),
                                              F.lit(352).alias("cancel_reason_id"))).alias("cancellation"),
        (F.col("l_suppkey") % 4).alias("warehouse_id"),
        F.when(ln != 7, F.array(product)).alias("products"))
    kind = F.when(ln % 3 == 0, 3).when(ln % 3 == 1, 1).otherwise(0)
    return lineitem.select(created.alias("ingested_at"), _page(F.to_json(rec), kind).alias("line"))


def ozon_stock_pages(events: DataFrame) -> DataFrame:
    """ozon stocks (odd users): nested ``stocks[]`` on even events, flat otherwise."""
    e = events.where(F.col("user_id") % 2 == 1)
    present = F.floor("value").cast("int")
    reserved = (F.col("event_id") % 3).cast("int")
    wh = F.col("user_id") % 3
    nested = F.to_json(F.struct(F.col("user_id").alias("product_id"),
                                F.concat(F.lit("offer-"), F.col("user_id")).alias("offer_id"),
                                F.array(F.struct(wh.alias("warehouse_id"), present.alias("present"),
                                                 reserved.alias("reserved"))).alias("stocks")))
    flat = F.to_json(F.struct(F.col("user_id").alias("product_id"),
                              F.concat(F.lit("offer-"), F.col("user_id")).alias("offer_id"),
                              wh.alias("warehouse_id"), present.alias("present"), reserved.alias("reserved")))
    rec = F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat)
    return e.select(F.col("ts").alias("ingested_at"), _page(rec, F.lit(1)).alias("line"))


def ozon_ads_pages(raw_ads: DataFrame) -> DataFrame:
    """ozon ads from the B6 binding, measures under either alias."""
    alt = F.hash("campaign_id", "day") % 2 == 0
    rec = F.when(alt, F.to_json(F.struct(
        F.col("day").cast("string").alias("date"), F.col("campaign_id").alias("campaign_id"),
        "impressions", "clicks", F.col("cost").alias("cost"), "orders", F.col("revenue").alias("revenue")))) \
        .otherwise(F.to_json(F.struct(
            F.col("day").cast("string").alias("day"), F.col("campaign_id").alias("id"),
            "impressions", "clicks", F.col("cost").cast("string").alias("money_spent"),
            F.col("orders").alias("attributed_orders"), F.col("revenue").alias("attributed_revenue"))))
    return raw_ads.select("ingested_at", "account_id", _page(rec, F.lit(0)).alias("line"))


def ozon_finance_pages(orders: DataFrame) -> DataFrame:
    """ozon finance: id and type under several aliases, amount as an object
    (with currency) or a flat number under an alias (one struct, NULL fields
    omitted by ``to_json``)."""
    ts = _shift("o_orderdate")
    ok = F.col("o_orderkey")
    amt = F.col("o_totalprice").cast(MONEY)
    signed = F.when(F.col("o_orderstatus") == "F", amt).otherwise(-amt)
    flat = F.floor(ok / 8) % 2 == 1
    rec = F.struct(
        F.when(ok % 4 == 0, ok.cast("string")).alias("operation_id"),
        F.when(ok % 4 == 1, ok.cast("string")).alias("operationId"),
        F.when(ok % 4 == 2, ok.cast("string")).alias("transaction_id"),
        F.when(ok % 4 == 3, ok).alias("id"),
        _iso(ts).alias("operation_date"),
        F.when(ok % 2 == 0, F.col("o_orderpriority")).alias("type"),
        F.when(ok % 2 == 1, F.col("o_orderpriority")).alias("operation_type"),
        F.when(~flat, F.struct(signed.cast("string").alias("value"),
                               F.lit("RUB").alias("currency_code"))).alias("amount"),
        F.when(flat, signed).alias("accruals_for_sale"),
        F.when(flat, F.lit("RUB")).alias("currency"))
    kind = F.when(ok % 3 == 0, 1).otherwise(0)
    wrapped = F.when(ok % 5 == 0, F.concat(F.lit('{"result":{"operations":['), F.to_json(rec), F.lit("]}}"))) \
        .otherwise(_page(F.to_json(rec), kind))
    return orders.select(ts.alias("ingested_at"), _acct_col("o_orderkey"), wrapped.alias("line"))


def _acct_col(c: str) -> Column:
    return F.concat(F.lit("acc"), (F.col(c) % 5).cast("string")).alias("account_id")


def wb_order_pages(lineitem: DataFrame) -> DataFrame:
    """wb orders: id under srid / odid / gNumber, quantity missing on line 4,
    price under three aliases."""
    ts = _shift("l_shipdate")
    ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
    srid = F.concat_ws("-", ok.cast("string"), ln.cast("string"))
    price = F.col("l_extendedprice").cast(MONEY)
    rec = F.struct(
        F.when(ln % 3 == 0, srid).alias("srid"), F.when(ln % 3 == 1, srid).alias("odid"),
        F.when(ln % 3 == 2, srid).alias("gNumber"),
        F.when(ok % 2 == 0, _iso(ts)).alias("lastChangeDate"), F.when(ok % 2 == 1, _iso(ts)).alias("lastChangeDt"),
        _iso(ts, 5).alias("date"), F.col("l_partkey").alias("nmId"), F.col("l_suppkey").alias("chrtId"),
        F.when(ln != 4, F.col("l_quantity").cast("int")).alias("quantity"),
        F.when(ok % 3 == 0, price).alias("totalPrice"), F.when(ok % 3 == 1, price).alias("priceWithDisc"),
        F.when(ok % 3 == 2, price.cast("string")).alias("price"))
    return lineitem.select(ts.alias("ingested_at"), _page(F.to_json(rec), F.lit(0)).alias("line"))


def wb_stock_pages(events: DataFrame) -> DataFrame:
    """wb stocks (even users): amount under quantity / quantityFull / inWayToClient."""
    e = events.where(F.col("user_id") % 2 == 0)
    amount = F.floor("value").cast("int")
    k = F.col("event_id") % 3
    rec = F.struct(F.col("user_id").alias("nmId"), F.col("user_id").alias("chrtId"),
                   F.concat(F.lit("sku-"), F.col("user_id")).alias("sku"),
                   (F.col("user_id") % 3).alias("warehouseId"),
                   F.when(k == 0, amount).alias("quantity"), F.when(k == 1, amount).alias("quantityFull"),
                   F.when(k == 2, amount).alias("inWayToClient"))
    return e.select(F.col("ts").alias("ingested_at"), _page(F.to_json(rec), F.lit(2)).alias("line"))


def wb_funnel_pages(raw_funnel: DataFrame) -> DataFrame:
    """wb funnel from the B5 binding, each measure under one of its aliases."""
    alt = F.abs(F.hash("nm_id", "day")) % 2 == 1
    pick = lambda a, b, c: [F.when(~alt, c).alias(a), F.when(alt, c).alias(b)]
    rec = F.struct(
        *pick("date", "day", F.col("day").cast("string")), *pick("nmId", "nm_id", F.col("nm_id")),
        *pick("openCardCount", "views", F.col("open_card_count")),
        *pick("addToCartCount", "addsToCart", F.col("add_to_cart_count")),
        *pick("ordersCount", "orders", F.col("orders_count")),
        *pick("ordersSumRub", "ordersRevenue", F.col("orders_sum_rub").cast("string")),
        *pick("buyoutsCount", "buyouts", F.col("buyouts_count")),
        *pick("cancelCount", "cancels", F.col("cancel_count")))
    return raw_funnel.select("ingested_at", _page(F.to_json(rec), F.lit(2)).alias("line"))
