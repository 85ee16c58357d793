import datetime as dt

import pytest

from vitrine.operators import reads


def test_page_contract():
    with pytest.raises(ValueError):
        reads.Page(limit=0)
    with pytest.raises(ValueError):
        reads.Page(limit=2001)
    with pytest.raises(ValueError):
        reads.Page(offset=50001)
    with pytest.raises(ValueError):
        reads.Page(marketplace="amazon")
    with pytest.raises(ValueError):
        reads.Page(date_from=dt.date(2026, 1, 1), date_to=dt.date(2026, 4, 4))  # 93 days > 92
    with pytest.raises(ValueError):
        reads.Page(date_from=dt.date(2026, 2, 1), date_to=dt.date(2026, 1, 1))
    reads.Page(date_from=dt.date(2026, 1, 1), date_to=dt.date(2026, 4, 3))  # exactly 92


def test_look_ahead_page_and_meta(spark):
    df = spark.range(25).selectExpr("date_add(DATE '2026-01-01', CAST(id AS INT)) AS day", "'wb' AS marketplace",
                                    "'a' AS account_id", "CAST(id AS STRING) AS product_id", "id AS qty",
                                    "CAST(id AS DECIMAL(38,2)) AS revenue", "0L AS returns_qty",
                                    "CAST(NULL AS DECIMAL(38,4)) AS payout")
    p = reads.Page(limit=10, offset=20)
    page = reads.sales_daily(df, p)
    assert page.count() == 5
    m = reads.page_meta(page, p).collect()[0]
    assert (m.returned, m.next_offset, m.has_more) == (5, None, False)
    p = reads.Page(limit=10, offset=0)
    page = reads.sales_daily(df, p)
    assert page.count() == 11  # limit + 1 look-ahead
    m = reads.page_meta(page, p).collect()[0]
    assert (m.returned, m.next_offset, m.has_more) == (10, 10, True)
    assert [r.product_id for r in reads.trim(page, reads.SALES_ORDER(), p).collect()] == [str(i) for i in range(10)]
    assert reads.sales_daily(df, reads.Page(limit=5), paged=True).where("payout IS NULL").count() == 0


def test_cluster_settings_scale_with_input():
    from vitrine.session import cluster_settings
    big = cluster_settings(100 * 2**40, executor_cores=8, executors=1000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    small = cluster_settings(10 << 20, executor_cores=8, executors=1)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_unique_grain_read_equals_reaggregated(spark):
    df = spark.range(30).selectExpr("date_add(DATE '2026-01-01', CAST(id % 7 AS INT)) AS day", "'wb' AS marketplace",
                                    "'a' AS account_id", "CAST(id AS STRING) AS product_id", "id AS qty",
                                    "CAST(id * 3 AS DECIMAL(38,2)) AS revenue", "0L AS returns_qty",
                                    "CASE WHEN id % 2 = 0 THEN CAST(id AS DECIMAL(38,4)) END AS payout")
    p = reads.Page(limit=7, offset=3)
    a = [tuple(r) for r in reads.sales_daily(df, p).collect()]
    b = [tuple(r) for r in reads.sales_daily(df, p, reaggregate=False).collect()]
    assert a == b and len(a) == 8
