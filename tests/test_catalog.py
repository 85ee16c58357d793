"""Registered plans against their DuckDB oracles on the smallest test data
(the full set runs in scripts/oracle_check.py at sf0.01)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from oracle_check import TABLES, rows  # noqa: E402
from vitrine.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
SUBSET = ["l1_latest_wb_sales", "t12_stg_sales", "t3_t7_stg_stocks", "m1_mrt_sales_daily", "m4_mrt_ads_daily",
          "a1_api_sales_daily_page", "a5_api_kpis", "d7_finance_ops_daily", "u8_funnel_card", "c2_watermark_backward_steps",
          "c6_quality_summary", "r2_low_stock_alerts", "o5_p95_duration_15m", "k9_redact_page_params",
          "p9_finance_from_json", "s1_landed_sales", "s9_landed_rejects", "r4_rule_files_report", "r5_r7_alerts",
          "r6_r8_formatted_alerts", "c3_worst_duplicates"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_a_reason():
    for q in catalog.REGISTRY.values():
        assert q.oracle or q.note, q.name


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, con, name):
    got = rows(catalog.run(spark, SF, name).toArrow())
    want = rows(con.sql(catalog.REGISTRY[name].oracle).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
