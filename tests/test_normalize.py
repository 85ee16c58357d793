"""Normalisers: aliases, defaults and fallbacks of every feed (field names are the feeds' contract)."""
import datetime as dt
from decimal import Decimal

from conftest import recs
from vitrine.operators import normalize as N

RUN, ACC = "run-1", "default"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_wb_sale_and_return(spark):
    feed = [
        {"srid": "A/17", "date": "2025-07-04T23:59:59Z", "lastChangeDate": "2025-07-05T00:00:01Z", "nmId": 90210,
         "chrtId": 3, "barcode": "4600", "quantity": 5, "forPay": "12.34", "ppvzForPay": 9},
        {"saleID": "B/18", "lastChangeDate": "2025-07-05T06:30:00Z", "quantity": -3, "totalPrice": 1000},
        {"gNumber": "C/19", "quantity": 2, "supplierOperName": "Частичный возврат товара"},
        {"srid": "D/20", "date": "2025-07-06T01:00:00Z", "supplierOperName": "Продажа"}]
    rows = {r["srid"]: r.asDict() for r in N.wb_sales(recs(spark, feed), RUN, ACC).collect()}
    assert {k: (r["quantity"], r["is_return"]) for k, r in rows.items()} == \
        {"A/17": (5, 0), "B/18": (3, 1), "C/19": (2, 1), "D/20": (1, 0)}
    assert (rows["A/17"]["nm_id"], rows["A/17"]["chrt_id"], rows["A/17"]["barcode"]) == (90210, 3, "4600")
    assert (rows["A/17"]["price_rub"], rows["A/17"]["payout_rub"]) == (Decimal("12.34"), Decimal("9.0000"))
    assert rows["B/18"]["price_rub"] == Decimal("1000.00")
    day = {k: (r["event_ts"], r["last_change_ts"]) for k, r in rows.items()}
    landed = dt.datetime(2026, 3, 2, 12)  # what a record without times gets
    assert day["A/17"] == (dt.datetime(2025, 7, 4, 23, 59, 59), dt.datetime(2025, 7, 5, 0, 0, 1))
    assert day["B/18"] == (dt.datetime(2025, 7, 5, 6, 30),) * 2 and day["C/19"] == (landed, landed)
    assert day["D/20"][0] == dt.datetime(2025, 7, 6, 1)


def test_wb_order_aliases_and_minimum_quantity(spark):
    feed = [{"odid": "order-a", "date": "2025-07-04T10:00:00Z", "nmId": 17, "quantity": 6, "totalPrice": "310"},
            {"odid": "order-b", "date": "2025-07-04T11:00:00Z", "nmId": 18, "quantity": 0, "priceWithDisc": 0.99}]
    rows = {r["srid"]: (r["quantity"], r["price_rub"]) for r in N.wb_orders(recs(spark, feed), RUN, ACC).collect()}
    assert rows == {"order-a": (6, Decimal("310.00")), "order-b": (1, Decimal("0.99"))}


def test_wb_stock_zero_ids_become_null(spark):
    s = {"nmId": 0, "chrtId": 222, "sku": "wb-sku-111", "warehouseId": 0, "quantityFull": 7}
    r = one(N.wb_stocks(recs(spark, [s]), RUN, ACC, dt.datetime(2026, 3, 2)))
    assert (r["nm_id"], r["warehouse_id"], r["amount"], r["snapshot_ts"]) == (None, None, 7, dt.datetime(2026, 3, 2))


def test_wb_funnel_aliases(spark):
    feed = [{"day": "2025-07-04", "nm_id": 8, "openCardCount": 3, "addToCartCount": 2, "ordersCount": 1,
             "ordersSumRub": "19.9", "buyoutsCount": 0, "currency": "BYN"},
            {"date": "2025-07-05", "nmId": 9, "addsToCart": 11, "orders": 6, "ordersRevenue": 84.5, "buyouts": 2,
             "addToCartCR": 0.5, "buyoutCR": 0.25, "wishlist": 1}]
    plain, other = sorted(N.wb_funnel(recs(spark, feed), RUN, ACC).collect(), key=lambda r: r["nm_id"])
    counts = lambda r: (r["nm_id"], r["day"].day, r["open_card_count"], r["add_to_cart_count"], r["orders_count"],
                        r["buyouts_count"], r["orders_sum_rub"], r["currency"])
    assert counts(plain) == (8, 4, 3, 2, 1, 0, Decimal("19.90"), "BYN")
    assert counts(other) == (9, 5, 0, 11, 6, 2, Decimal("84.50"), "RUB")
    assert other["buyouts_sum_rub"] == Decimal("0.00")
    assert (other["add_to_cart_conv"], other["buyout_percent"], other["add_to_wishlist"]) == (0.5, 0.25, 1)


def test_ozon_cancelled_posting_nested_and_top_level(spark):
    tin = {"product_id": 31, "offer_id": "tin", "quantity": 3, "price": "7.77", "payout": "6.50"}
    box = {"product_id": 32, "offer_id": "box", "price": 40}
    feed = [{"posting_number": "N-in", "status": "cancelled", "cancellation": {"cancelled_at": "2025-07-08T23:00:05Z"},
             "products": [tin, box]},
            {"posting_number": "N-top", "status": "cancelled", "cancelled_at": "2025-07-09T04:05:06Z", "cancellation": None,
             "products": [box]},
            {"posting_number": "N-open", "status": "delivering", "created_at": "2025-07-01T00:00:00Z", "products": []},
            {"posting_number": "N-bare", "products": {"product_id": 33}}]
    heads = {r["posting_number"]: r for r in N.ozon_postings(recs(spark, feed), RUN, ACC).collect()}
    assert {k: r["canceled_at"] for k, r in heads.items()} == {
        "N-in": dt.datetime(2025, 7, 8, 23, 0, 5), "N-top": dt.datetime(2025, 7, 9, 4, 5, 6), "N-open": None, "N-bare": None}
    assert {k: r["status"] for k, r in heads.items()} == {
        "N-in": "cancelled", "N-top": "cancelled", "N-open": "delivering", "N-bare": "unknown"}
    items = sorted((r["posting_number"], r["ozon_product_id"], r["quantity"], r["price"], r["payout"])
                   for r in N.ozon_posting_items(recs(spark, feed), RUN, ACC).collect())
    assert items == [("N-in", 31, 3, Decimal("7.77"), Decimal("6.5000")), ("N-in", 32, 1, Decimal("40.00"), Decimal("40.0000")),
                     ("N-top", 32, 1, Decimal("40.00"), Decimal("40.0000"))]


def test_ozon_item_payout_falls_back_to_price(spark):
    p = {"posting_number": "P", "products": [{"product_id": 1, "price": "10.00"}, 5, {"product_id": 2,
                                                                                     "price": "3", "quantity": 4}]}
    rows = sorted(N.ozon_posting_items(recs(spark, [p]), RUN, ACC).collect(), key=lambda r: r["ozon_product_id"])
    assert [(r["ozon_product_id"], r["quantity"], r["payout"]) for r in rows] == \
        [(1, 1, Decimal("10.0000")), (2, 4, Decimal("3.0000"))]


def test_ozon_stocks_nested_and_flat(spark):
    nested = {"product_id": 100500, "offer_id": "offer-1", "stocks": [{"warehouse_id": 2, "present": 9, "reserved": 2},
                                                                     {"warehouse_id": 3, "present": 1, "reserved": 0}]}
    flat = {"product_id": 7, "offer_id": "o7", "warehouse_id": 12, "present": 9, "reserved": 2, "stocks": []}
    rows = N.ozon_stocks(recs(spark, [nested, flat]), RUN, ACC, dt.datetime(2026, 3, 2)).collect()
    got = sorted((r["ozon_product_id"], r["warehouse_id"], r["present"], r["reserved"]) for r in rows)
    assert got == [(7, 12, 9, 2), (100500, 2, 9, 2), (100500, 3, 1, 0)]


def test_ozon_ads_aliases(spark):
    a = {"date": "2026-03-01", "id": "camp-1", "impressions": 1000, "clicks": 50, "money_spent": "25.0",
         "attributed_orders": 3, "attributed_revenue": 300.0}
    r = one(N.ozon_ads(recs(spark, [a, ]), RUN, ACC))
    assert (r["campaign_id"], r["cost"], r["orders"], r["revenue"]) == ("camp-1", Decimal("25.00"), 3, Decimal("300.00"))
    r = one(N.ozon_ads(recs(spark, [{"day": "2026-03-01"}]), RUN, ACC))
    assert r["campaign_id"] == "unknown"


def test_ozon_finance_object_flat_and_missing_id(spark):
    feed = [{"operation_id": "fee/5", "operation_date": "2025-07-10T08:00:00Z", "type": "storage",
             "amount": {"amount": "-0.07", "currency_code": "EUR"}},
            {"transactionId": None, "transaction_id": "t/6", "created_at": "2025-07-10T09:00:00Z",
             "transaction_type": "refund", "amount": 88, "currency": "KZT"},
            {"date": "2025-07-11T00:00:00Z", "accruals_for_sale": 3.5}, {"date": "2025-07-11T00:00:00Z", "accruals_for_sale": 4.5}]
    rows = {r["operation_id"]: (r["type"], r["amount"], r["currency"])
            for r in N.ozon_finance(recs(spark, feed + feed[2:3]), RUN, ACC).collect()}
    assert rows.pop("fee/5") == ("storage", Decimal("-0.07"), "EUR")
    assert rows.pop("t/6") == ("refund", Decimal("88.00"), "KZT")
    # records without an id are named by their content: a repeat gets the same name
    assert all(len(k) == 64 for k in rows)
    assert sorted(v[:2] for v in rows.values()) == [("unknown", Decimal("3.50")), ("unknown", Decimal("4.50"))]


def test_envelopes_and_schema_merge(spark):
    from vitrine.sources import feeds
    lines = spark.createDataFrame([
        ('[{"a": 1}, 5, {"a": 2}]',), ('{"result": [{"a": 3}]}',), ('{"result": {"postings": [{"a": 4}]}}',),
        ('{"result": {"operations": [{"a": 5}]}}',), ('{"result": {"items": [{"a": 6}]}}',),
        ('{"data": [{"a": 7}]}',), ('{"other": [{"a": 8}]}',), ('not json',), ('{"a": 9}',)], "line string")
    got = sorted(r[0] for r in feeds.unwrap(lines).selectExpr("try_variant_get(rec, '$.a', 'int')").collect())
    assert got == [1, 2, 3, 4, 5, 6, 7]
    assert feeds.rejects(lines).count() == 3
    fbs = spark.createDataFrame([('[{"posting_number": "P1", "s": "fbs"}, {"s": "nokey"}]',),
                                 ('[{"posting_number": "P2", "s": "fbs"}]',)], "line string")
    fbo = spark.createDataFrame([('[{"posting_number": "P1", "s": "fbo"}, {"s": "nokey2"}]',)], "line string")
    m = feeds.merge_schemas([("fbs", feeds.unwrap(fbs)), ("fbo", feeds.unwrap(fbo))])
    got = sorted((r["posting_key"] or "", r["schema"]) for r in m.collect())
    assert got == [("", "fbo"), ("", "fbs"), ("P1", "fbo"), ("P2", "fbs")]


def test_parameter_contracts():
    from vitrine.sources import feeds
    assert feeds.parse_schemas() == ("fbs", "fbo")
    assert feeds.parse_schemas(" FBO, fbs ,fbo,xyz") == ("fbo", "fbs")
    assert feeds.parse_schemas("nope,") == ("fbs",)
    assert feeds.clamp_backfill_days("sales", 400) == 90 and feeds.clamp_backfill_days("finance", 0) == 1
    assert feeds.clamp_backfill_days("funnel", 200) == 200 and feeds.clamp_backfill_days("funnel_admin", 200) == 90
