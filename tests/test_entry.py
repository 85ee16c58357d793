"""The driver contract: entry() on sf0.001, queries() and oracle_sql() agree."""
import __spark_entry__ as E
from vitrine.plans import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["day", "marketplace", "account_id", "product_id", "qty", "revenue", "returns_qty", "payout"]


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
    assert set(catalog.REGISTRY) <= set(q)
    assert set(catalog.REGISTRY) <= set(o)  # every warehouse query has its SQL
