"""Golden rows of a small tea shop: eight feeds landed twice, raw to staging,
marts and the KPI page.  Expected rows are worked out by hand from the rules
and a later stock snapshot."""
import datetime as dt
from decimal import Decimal

import pytest

from conftest import recs
from vitrine.operators import marts, normalize as N, reads, staging

AS_OF = dt.date(2025, 11, 20)
RUN_TS = dt.datetime(2025, 11, 20, 2, 30)
LANDED = (dt.datetime(2025, 11, 18, 6, 0), dt.datetime(2025, 11, 19, 6, 0))
D17, D18 = dt.date(2025, 11, 17), dt.date(2025, 11, 18)


def sale(srid, time, nm, size, quantity, price, payout):
    return {"srid": srid, "date": time, "lastChangeDate": time, "nmId": nm, "chrtId": size, "barcode": f"b{size}",
            "quantity": quantity, "forPay": price, "ppvzForPay": payout}


SALES = ([sale("k-1", "2025-11-17T08:15:00Z", 5031, 61, 3, 149.9, 120.25),
          sale("k-2", "2025-11-17T12:00:00Z", 5031, 60, 1, 152.4, 119)],
         [sale("k-1", "2025-11-17T08:15:00Z", 5031, 61, 2, 149.9, 120.25),
          sale("k-3", "2025-11-18T21:40:00Z", 5031, 61, -1, 149.9, 120.25),
          sale("k-4", "2025-11-18T09:00:00Z", 7440, 75, 4, 80, 61.5)])
ORDERS = ([{"odid": "o-1", "date": "2025-11-17T07:00:00Z", "nmId": 5031, "quantity": 3, "totalPrice": 449.7}],
          [{"odid": "o-2", "date": "2025-11-18T08:30:00Z", "nmId": 7440, "quantity": 4, "totalPrice": 320}])
POSTINGS = ([{"posting_number": "Z-900", "status": "awaiting_packaging", "created_at": "2025-11-18T05:00:00Z", "warehouse_id": 4,
              "products": [{"product_id": 81, "offer_id": "tea-81", "name": "Oolong", "quantity": 2, "price": "310.5", "payout": "280"},
                           {"product_id": 82, "offer_id": "tea-82", "name": "Puer", "quantity": 1, "price": "95"}]}],
            [{"posting_number": "Z-900", "status": "delivering", "created_at": "2025-11-18T05:00:00Z", "warehouse_id": 4,
              "products": [{"product_id": 81, "offer_id": "tea-81", "name": "Oolong", "quantity": 1, "price": "310.5", "payout": "280"}]}])
FUNNEL = [{"date": "2025-11-17", "nmId": 5031, "openCardCount": 40, "addToCartCount": 8, "ordersCount": 2},
          {"date": "2025-11-18", "nmId": 5031, "openCardCount": 0, "addToCartCount": 0, "ordersCount": 0}]
ADS = [{"date": "2025-11-17", "campaign_id": "winter", "impressions": 300, "clicks": 4, "cost": 12.4, "orders": 0, "revenue": 0},
       {"date": "2025-11-18", "campaign_id": "winter", "impressions": 800, "clicks": 20, "cost": 30, "orders": 1, "revenue": 120}]
LEDGER = [{"operation_id": "f-77", "operation_date": "2025-11-18T10:00:00Z", "type": "return_fee", "amount": "-19.95"},
          {"operation_id": "f-78", "operation_date": "2025-11-18T11:00:00Z", "type": "bonus", "amount": 5, "currency": "KZT"}]


@pytest.fixture(scope="module")
def warehouse(spark):
    def both(normalise, landings):
        first, second = (normalise(recs(spark, docs, ts), "run", "north") for docs, ts in zip(landings, LANDED))
        return first.unionByName(second)

    def stocks(normalise, *snapshots):
        out = None
        for docs, ts in snapshots:
            one = normalise(recs(spark, docs, ts), "run", "north", ts)
            out = one if out is None else out.unionByName(one)
        return out

    late = dt.datetime(2025, 11, 18, 20, 0)
    wb_stock = lambda n: [{"nmId": 5031, "chrtId": 61, "sku": "b61", "warehouseId": 3, "quantityFull": n}]
    ozon_stock = [{"product_id": 81, "offer_id": "tea-81", "stocks": [{"warehouse_id": 4, "present": 15, "reserved": 6},
                                                                      {"warehouse_id": 5, "present": 2, "reserved": 0}]}]
    sales, orders = both(N.wb_sales, SALES), both(N.wb_orders, ORDERS)
    posts, items = both(N.ozon_postings, POSTINGS), both(N.ozon_posting_items, POSTINGS)
    one = lambda normalise, docs: normalise(recs(spark, docs, LANDED[1]), "run", "north")
    days = 14
    w = {
        "stg_sales": staging.stg_sales(staging.wb_sales(sales, AS_OF, days), staging.ozon_sales(items, posts, AS_OF, days)),
        "stg_orders": staging.stg_orders(staging.wb_orders(orders, AS_OF, days), staging.ozon_orders(posts, AS_OF, days)),
        "stg_stocks": staging.stg_stocks(
            staging.wb_stocks(stocks(N.wb_stocks, (wb_stock(12), LANDED[0]), (wb_stock(9), late)), AS_OF, days),
            staging.ozon_stocks(stocks(N.ozon_stocks, (ozon_stock, LANDED[0])), AS_OF, days)),
        "stg_funnel": staging.wb_funnel(one(N.wb_funnel, FUNNEL), AS_OF, days),
        "stg_ads": staging.ozon_ads(one(N.ozon_ads, ADS), AS_OF, 60),
        "stg_fin": staging.ozon_finance(one(N.ozon_finance, LEDGER), AS_OF, 60),
        "dim": staging.dim_product(staging.wb_dim_product(sales, AS_OF, days, RUN_TS),
                                   staging.ozon_dim_product(items, AS_OF, days, RUN_TS)),
    }
    w["mrt_sales"] = marts.sales_daily(w["stg_sales"], AS_OF, days, RUN_TS)
    w["mrt_stock"] = marts.stock_daily(w["stg_stocks"], AS_OF, days, RUN_TS)
    w["mrt_funnel"] = marts.funnel_daily(w["stg_funnel"], AS_OF, days, RUN_TS)
    w["mrt_ads"] = marts.ads_daily(w["stg_ads"], AS_OF, 60, RUN_TS)
    return w


def test_staging(warehouse):
    got = sorted((r.order_id, r.product_id, r.day, r.qty, r.price_gross, r.is_return) for r in warehouse["stg_sales"].collect())
    assert got == [("Z-900", "81", D18, 1, Decimal("310.50"), 0), ("Z-900", "82", D18, 1, Decimal("95.00"), 0),
                   ("k-1", "5031", D17, 2, Decimal("149.90"), 0), ("k-2", "5031", D17, 1, Decimal("152.40"), 0),
                   ("k-3", "5031", D18, -1, Decimal("149.90"), 1), ("k-4", "7440", D18, 4, Decimal("80.00"), 0)]
    orders = {r.order_id: (r.status, r.qty) for r in warehouse["stg_orders"].collect()}
    assert orders == {"o-1": ("new", 3), "o-2": ("new", 4), "Z-900": ("delivering", None)}
    fin = sorted((r.operation_id, r.type, r.amount, r.currency) for r in warehouse["stg_fin"].collect())
    assert fin == [("f-77", "return_fee", Decimal("-19.95"), "RUB"), ("f-78", "bonus", Decimal("5.00"), "KZT")]


def test_dimension(warehouse):
    got = sorted((r.marketplace, r.product_id, r.chrt_id, r.sku, r.title) for r in warehouse["dim"].collect())
    assert got == [("ozon", "81", None, None, "Oolong"), ("ozon", "82", None, None, "Puer"),
                   ("wb", "5031", 60, "b60", None), ("wb", "7440", 75, "b75", None)]


def test_marts(warehouse):
    got = sorted((r.day, r.product_id, r.qty, float(r.revenue), float(r.payout), r.returns_qty) for r in warehouse["mrt_sales"].collect())
    assert got == [(D17, "5031", 3, 452.2, 239.25, 0), (D18, "5031", -1, 0.0, 120.25, -1), (D18, "7440", 4, 320.0, 61.5, 0),
                   (D18, "81", 1, 310.5, 280.0, 0), (D18, "82", 1, 95.0, 95.0, 0)]
    stock = sorted((r.marketplace, r.product_id, r.stock_end) for r in warehouse["mrt_stock"].collect())
    assert stock == [("ozon", "81", 2), ("ozon", "81", 9), ("wb", "61", 9)]
    funnel = sorted((r.day, r.views, r.cr_order, r.cr_cart) for r in warehouse["mrt_funnel"].collect())
    assert funnel == [(D17, 40, 0.05, 0.2), (D18, 0, 0.0, 0.0)]
    ads = sorted((r.day, r.cost, r.acos, r.romi) for r in warehouse["mrt_ads"].collect())
    assert ads == [(D17, Decimal("12.40"), 0.0, -1.0), (D18, Decimal("30.00"), 0.25, 3.0)]


def test_kpi_page(warehouse):
    def page(marketplace):
        rows = reads.kpis(warehouse["mrt_sales"], warehouse["mrt_ads"], AS_OF, reads.Page(marketplace=marketplace)).collect()
        assert len(rows) == 1
        r = rows[0]
        return float(r.revenue_30d), r.qty_30d, r.returns_30d, float(r.cost_30d), round(r.acos_30d, 9)

    assert page("ozon") == (405.5, 2, 0, 42.4, round(42.4 / 120, 9))
    assert page("wb") == (772.2, 6, -1, 0.0, 0.0)   # no ads: zeros, not NULL


def test_item_without_posting_kept_with_null_time(spark):
    items = N.ozon_posting_items(recs(spark, [{"posting_number": "Z-1", "products": [{"product_id": 9, "price": "7"}]}], LANDED[1]),
                                 "run", "north")
    posts = N.ozon_postings(recs(spark, [{"posting_number": "Z-2"}], LANDED[1]), "run", "north")
    rows = staging.ozon_sales(items, posts, AS_OF, 14).collect()
    assert [(r.product_id, r.event_ts, r.day) for r in rows] == [("9", None, None)]
