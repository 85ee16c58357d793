"""Channel records (one VARIANT per record) → raw table rows.

Each normaliser is a few narrow projections of column expressions over the
record — the per-row mapping of the reference re-expressed as Catalyst
expressions, so it runs vectorised inside whole-stage codegen on every
executor.  Inputs are frames with ``rec`` (VARIANT), ``payload`` (the
record's JSON text) and ``ingested_at``; ``run_id`` and ``account_id`` are
parameters.  A missing event time falls back to the batch's ingest time (the
survey's Q10), never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.values import Fields, as_text, is_object, parse_ts, safe_float, safe_int, safe_money
from vitrine.schemas import MONEY

# Field aliases in the order they are tried (first truthy wins).
WB_SALES_SRID = ("srid", "saleID", "gNumber")
WB_ORDERS_SRID = ("srid", "odid", "gNumber")
WB_CHANGE_TIME = ("lastChangeDate", "lastChangeDt")
WB_SALES_QTY = ("quantity", "saleQty")
WB_SALES_PRICE = ("forPay", "totalPrice", "priceWithDisc")
WB_SALES_PAYOUT = ("ppvzForPay",)
WB_SALES_PAYOUT_LEGACY = ("ppvzForPay", "incomeID")  # the reference's list; incomeID is an id (Q8)
WB_ORDERS_PRICE = ("totalPrice", "priceWithDisc", "price")
WB_STOCK_AMOUNT = ("quantity", "quantityFull", "inWayToClient")
RETURN_MARKER = "[Вв][Оо][Зз][Вв][Рр][Аа][Тт]"  # either case; lower() of Cyrillic text is slow
WB_FUNNEL = (  # raw column, aliases, kind
    ("open_card_count", ("openCardCount", "views"), "int"),
    ("add_to_cart_count", ("addToCartCount", "addsToCart"), "int"),
    ("orders_count", ("ordersCount", "orders"), "int"),
    ("orders_sum_rub", ("ordersSumRub", "ordersSum", "ordersRevenue"), "money"),
    ("buyouts_count", ("buyoutsCount", "buyouts"), "int"),
    ("buyouts_sum_rub", ("buyoutsSumRub", "buyoutsSum"), "money"),
    ("cancel_count", ("cancelCount", "cancels"), "int"),
    ("cancel_sum_rub", ("cancelSumRub", "cancelSum"), "money"),
    ("add_to_cart_conv", ("addToCartConv", "addToCartCR"), "float"),
    ("cart_to_order_conv", ("cartToOrderConv", "cartToOrderCR"), "float"),
    ("buyout_percent", ("buyoutPercent", "buyoutCR"), "float"),
    ("add_to_wishlist", ("addToWishlist", "wishlist"), "int"),
)
OZON_CANCEL_TIME = ("canceled_at", "cancelled_at", "cancellation.canceled_at", "cancellation.cancelled_at")
OZON_ADS = (
    ("impressions", ("impressions",), "int"),
    ("clicks", ("clicks",), "int"),
    ("cost", ("cost", "money_spent"), "money"),
    ("orders", ("orders", "attributed_orders"), "int"),
    ("revenue", ("revenue", "attributed_revenue"), "money"),
)
FIN_ID = ("operation_id", "operationId", "transaction_id", "id")
FIN_TIME = ("operation_date", "operation_time", "created_at", "date")
FIN_AMOUNT_OBJ = ("amount.amount", "amount.value", "amount.price")
FIN_AMOUNT_FLAT = ("amount", "accruals_for_sale", "sale_commission", "services")
FIN_CURRENCY_OBJ = ("amount.currency_code", "amount.currency")
FIN_CURRENCY = ("currency_code", "currency")
FIN_TYPE = ("type", "operation_type", "transaction_type")
DEFAULT_CURRENCY = "RUB"


def _meta(run_id: str, account_id: str) -> list[Column]:
    return [F.col("ingested_at"), F.lit(run_id).alias("run_id"), F.lit(account_id).alias("account_id")]


def _text_or(f: Fields, keys, default: str) -> Column:
    return F.coalesce(as_text(f.first(keys)), F.lit(default))


def _measure(f: Fields, keys, kind: str) -> Column:
    x = f.first(keys)
    if kind == "int":
        return safe_int(x)
    if kind == "money":
        return safe_money(x)
    return safe_float(x)


# ------------------------------------------------------------------- wb

def wb_sales(recs: DataFrame, run_id: str, account_id: str, payout_aliases=WB_SALES_PAYOUT) -> DataFrame:
    """Returns by negative quantity or a return operation name; quantity stored absolute."""
    f = Fields()
    op = F.coalesce(as_text(f.get("supplierOperName")), F.lit(""))
    exprs = [
        *_meta(run_id, account_id),
        _text_or(f, WB_SALES_SRID, "").alias("srid"),
        F.coalesce(parse_ts(f.first(WB_CHANGE_TIME)), F.col("ingested_at")).alias("last_change_ts"),
        parse_ts(f.get("date")).alias("_event"),
        safe_int(f.get("nmId")).alias("nm_id"), safe_int(f.get("chrtId")).alias("chrt_id"),
        as_text(f.get("barcode")).alias("barcode"),
        safe_int(f.first(WB_SALES_QTY), 1).alias("_qty"),
        safe_money(f.first(WB_SALES_PRICE)).alias("price_rub"),
        safe_money(f.first(payout_aliases)).cast("decimal(18,4)").alias("payout_rub"),
        op.rlike(RETURN_MARKER).alias("_op_return"),
        F.col("payload")]
    x = f.stage(recs).select(*exprs)
    return x.select(
        "ingested_at", "run_id", "account_id", "srid", "last_change_ts",
        F.coalesce("_event", "last_change_ts").alias("event_ts"), "nm_id", "chrt_id", "barcode",
        F.when(F.col("_qty") < 0, F.try_subtract(F.lit(0), F.col("_qty"))).otherwise(F.col("_qty"))
        .try_cast("int").alias("quantity"), "price_rub", "payout_rub",
        F.when((F.col("_qty") < 0) | F.col("_op_return"), 1).otherwise(0).alias("is_return"), "payload")


def wb_orders(recs: DataFrame, run_id: str, account_id: str) -> DataFrame:
    """Quantity at least 1."""
    f = Fields()
    exprs = [
        *_meta(run_id, account_id),
        _text_or(f, WB_ORDERS_SRID, "").alias("srid"),
        F.coalesce(parse_ts(f.first(WB_CHANGE_TIME)), F.col("ingested_at")).alias("last_change_ts"),
        parse_ts(f.get("date")).alias("_event"),
        safe_int(f.get("nmId")).alias("nm_id"), safe_int(f.get("chrtId")).alias("chrt_id"),
        F.greatest(F.lit(1), safe_int(f.get("quantity"), 1)).try_cast("int").alias("quantity"),
        safe_money(f.first(WB_ORDERS_PRICE)).alias("price_rub"),
        F.col("payload")]
    x = f.stage(recs).select(*exprs)
    return x.select("ingested_at", "run_id", "account_id", "srid", "last_change_ts",
                    F.coalesce("_event", "last_change_ts").alias("event_ts"), "nm_id", "chrt_id", "quantity",
                    "price_rub", "payload")


def _snap(snapshot_ts) -> Column:
    return (snapshot_ts if isinstance(snapshot_ts, Column) else F.lit(snapshot_ts)).cast("timestamp_ntz")


def wb_stocks(recs: DataFrame, run_id: str, account_id: str, snapshot_ts) -> DataFrame:
    """Stamp the snapshot time; 0 ids become NULL."""
    f = Fields()
    exprs = [
        *_meta(run_id, account_id), _snap(snapshot_ts).alias("snapshot_ts"),
        F.nullif(safe_int(f.get("nmId")), F.lit(0)).alias("nm_id"),
        safe_int(f.get("chrtId")).alias("chrt_id"),
        as_text(f.get("sku")).alias("sku"),
        F.nullif(safe_int(f.get("warehouseId")), F.lit(0)).alias("warehouse_id"),
        safe_int(f.first(WB_STOCK_AMOUNT)).try_cast("int").alias("amount"),
        F.col("payload")]
    return f.stage(recs).select(*exprs)


def wb_funnel(recs: DataFrame, run_id: str, account_id: str) -> DataFrame:
    """Twelve alias-mapped measures; default currency RUB."""
    f = Fields()
    day = F.to_date(F.coalesce(parse_ts(f.first(("date", "day"))), F.col("ingested_at")))
    exprs = [
        *_meta(run_id, account_id), day.alias("day"),
        safe_int(f.first(("nmId", "nm_id"))).alias("nm_id"),
        *[_measure(f, keys, kind).alias(name) for name, keys, kind in WB_FUNNEL],
        _text_or(f, ("currency",), DEFAULT_CURRENCY).alias("currency"),
        F.col("payload")]
    return f.stage(recs).select(*exprs)


# ----------------------------------------------------------------- ozon

def ozon_postings(recs: DataFrame, run_id: str, account_id: str) -> DataFrame:
    """P5: posting header; cancel time = first parseable of four paths."""
    f = Fields()
    exprs = [
        *_meta(run_id, account_id),
        _text_or(f, ("posting_number",), "").alias("posting_number"),
        _text_or(f, ("status",), "unknown").alias("status"),
        F.coalesce(parse_ts(f.get("created_at")), F.col("ingested_at")).alias("created_at"),
        parse_ts(f.get("in_process_at")).alias("in_process_at"),
        parse_ts(f.get("shipment_date")).alias("shipped_at"),
        parse_ts(f.get("delivering_date")).alias("delivered_at"),
        F.coalesce(*[parse_ts(f.get(p)) for p in OZON_CANCEL_TIME]).alias("canceled_at"),
        F.nullif(safe_int(f.get("warehouse_id")), F.lit(0)).alias("ozon_warehouse_id"),
        F.col("payload")]
    return f.stage(recs).select(*exprs)


def ozon_posting_items(recs: DataFrame, run_id: str, account_id: str) -> DataFrame:
    """One row per product; a missing or non-list ``products`` yields none
    (``explode``, not ``explode_outer``); payout falls back to price."""
    h = Fields(prefix="_h")
    number = _text_or(h, ("posting_number",), "").alias("posting_number")
    prods = h.stage(recs).select(
        "ingested_at", number, F.try_variant_get(F.col("rec"), "$.products", "array<variant>").alias("products"))
    prods = prods.select("ingested_at", "posting_number", F.explode(F.when(F.col("products").isNotNull(), F.col("products"))).alias("p"))
    prods = prods.where(is_object(F.col("p")))
    f = Fields(rec="p")
    exprs = [
        *_meta(run_id, account_id), "posting_number",
        safe_int(f.get("product_id")).alias("ozon_product_id"),
        as_text(f.get("offer_id")).alias("offer_id"), as_text(f.get("name")).alias("name"),
        F.greatest(F.lit(1), safe_int(f.get("quantity"), 1)).try_cast("int").alias("quantity"),
        safe_money(f.get("price")).alias("price"),
        safe_money(f.first(("payout", "price"))).cast("decimal(18,4)").alias("payout"),
        F.to_json("p").alias("payload")]
    return f.stage(prods).select(*exprs)


def ozon_stocks(recs: DataFrame, run_id: str, account_id: str, snapshot_ts) -> DataFrame:
    """One row per nested stock; the item itself when ``stocks`` is empty or absent."""
    v = F.col("rec")
    stocks = F.try_variant_get(v, "$.stocks", "array<variant>")
    nested = F.coalesce(F.array_size(stocks), F.lit(0)) > 0
    x = recs.select("ingested_at", "rec", "payload", nested.alias("nested"),
                    F.explode(F.when(nested, stocks).otherwise(F.array(v))).alias("s"))
    it, st = Fields(prefix="_i"), Fields(rec="s", prefix="_s")
    exprs = [
        *_meta(run_id, account_id), _snap(snapshot_ts).alias("snapshot_ts"),
        safe_int(it.get("product_id")).alias("ozon_product_id"),
        as_text(it.get("offer_id")).alias("offer_id"),
        F.nullif(safe_int(st.get("warehouse_id")), F.lit(0)).alias("warehouse_id"),
        safe_int(st.get("present")).try_cast("int").alias("present"),
        safe_int(st.get("reserved")).try_cast("int").alias("reserved"),
        F.when(F.col("nested"), F.to_json(F.struct(v.alias("item"), F.col("s").alias("stock"))))
        .otherwise(F.col("payload")).alias("payload")]
    return st.stage(it.stage(x)).select(*exprs)


def ozon_ads(recs: DataFrame, run_id: str, account_id: str) -> DataFrame:
    """Campaign defaults to ``unknown``."""
    f = Fields()
    day = F.to_date(F.coalesce(parse_ts(f.first(("date", "day"))), F.col("ingested_at")))
    exprs = [
        *_meta(run_id, account_id), day.alias("day"),
        _text_or(f, ("campaign_id", "id"), "unknown").alias("campaign_id"),
        *[_measure(f, keys, kind).alias(name) for name, keys, kind in OZON_ADS],
        F.col("payload")]
    return f.stage(recs).select(*exprs)


def ozon_finance(recs: DataFrame, run_id: str, account_id: str) -> DataFrame:
    """Amount is a scalar or an object; a record without an id gets a
    content hash (stable across re-reads, the survey's Q11)."""
    f = Fields()
    obj = f.get("amount").t.startswith("OBJECT")
    amount = F.when(obj, safe_money(f.first(FIN_AMOUNT_OBJ))).otherwise(safe_money(f.first(FIN_AMOUNT_FLAT)))
    item_cur = as_text(f.first(FIN_CURRENCY))
    currency = F.when(obj, F.coalesce(as_text(f.first(FIN_CURRENCY_OBJ)), item_cur)).otherwise(item_cur)
    exprs = [
        *_meta(run_id, account_id),
        F.coalesce(as_text(f.first(FIN_ID)), F.sha2(F.col("payload"), 256)).alias("operation_id"),
        F.coalesce(parse_ts(f.first(FIN_TIME)), F.col("ingested_at")).alias("operation_ts"),
        _text_or(f, FIN_TYPE, "unknown").alias("type"),
        amount.cast(MONEY).alias("amount"),
        F.coalesce(currency, F.lit(DEFAULT_CURRENCY)).alias("currency"),
        F.col("payload")]
    return f.stage(recs).select(*exprs)
