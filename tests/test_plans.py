"""Plan shape guards: no cartesian or nested-loop joins and no Python UDFs in
representative registered plans (scripts/plan_lint.py checks all of them)."""
import re

import pytest

from vitrine.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["t12_stg_sales", "a2_api_stocks_current", "u5_overview", "c1_stale_marts", "o9_latency_summary",
         "p1_s9_wb_sales_from_json"]
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_unscalable_nodes(spark, name):
    plan = catalog.run(spark, SF, name)._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BAD if re.search(rf"\b{b}\b", plan)], name


def test_latest_wins_limits_before_the_shuffle(spark):
    plan = catalog.run(spark, SF, "l1_latest_wb_sales")._jdf.queryExecution().executedPlan().toString()
    # a partial WindowGroupLimit sits below the exchange that feeds the final one
    assert plan.count("WindowGroupLimit") >= 2 and "Exchange" in plan


def test_shared_stages_are_stored_by_column(spark):
    """Stages that several checks read are files of columns, each computed once."""
    from vitrine.plans import catalog
    from vitrine.plans.stages import Stages
    p = Stages(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, p.stg_funnel.collect()))
    p.materialize(catalog._CHECK_SHARED)
    for name in ("stg_stocks", "stg_funnel", "stg_ads", "mrt_sales"):
        files = getattr(p, name).inputFiles()
        assert files and all(f"/{name}/" in f for f in files), name
    assert sorted(map(str, p.stg_funnel.collect())) == want


def test_products_are_computed_once_for_the_upserts(spark, monkeypatch):
    from vitrine.plans import catalog
    from vitrine.plans.stages import Stages
    from vitrine.sources import tables
    read, upsert = [], tables.upsert
    monkeypatch.setattr(tables, "upsert", lambda s, root, rows, *a, **k: read.extend(rows.inputFiles()) or upsert(s, root, rows, *a, **k))
    rows = catalog.k7(Stages(spark, "/root/testdata/sf0.001")).count()
    assert rows and read and all("/dim_product/" in f for f in read)
