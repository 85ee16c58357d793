"""Quality checks: a clean warehouse has no issues; each injected fault trips its check."""
import datetime as dt
import random

from vitrine.operators import quality as Q

NOW = dt.datetime(2026, 3, 2, 12, 0)


def frames(spark, fault=None):
    fresh = NOW - dt.timedelta(minutes=10)
    runs = spark.createDataFrame([("tasks.marts.rebuild", "success")], "task_name string, status string")
    mart = lambda extra="": spark.createDataFrame(
        [("wb", "a", dt.date(2026, 3, 1), "p", "c", None, 5, 10, 5, 3, 1.0, 2.0,
          fresh - (dt.timedelta(hours=6) if fault == "stale" else dt.timedelta()))],
        "marketplace string, account_id string, day date, product_id string, campaign_id string, warehouse_id bigint, "
        "stock_end bigint, views bigint, adds_to_cart bigint, orders bigint, cost double, revenue double, "
        "updated_at timestamp_ntz")
    marts = {m: mart() for m in ("mrt_sales_daily", "mrt_stock_daily", "mrt_funnel_daily", "mrt_ads_daily")}
    wm_rows = [("wb_sales", "default", NOW - dt.timedelta(minutes=20), NOW - dt.timedelta(minutes=3)),
               ("wb_sales", "default", NOW - dt.timedelta(minutes=10), NOW - dt.timedelta(minutes=2))]
    if fault == "watermark":
        wm_rows.append(("wb_sales", "default", NOW - dt.timedelta(minutes=30), NOW - dt.timedelta(minutes=1)))
    wm = spark.createDataFrame(wm_rows, "source string, account_id string, watermark_ts timestamp_ntz, "
                                        "updated_at timestamp_ntz")
    sale = ("wb", "a", "o1", "p", NOW - dt.timedelta(hours=1))
    stg = spark.createDataFrame([sale] * (2 if fault == "dup" else 1),
                                "marketplace string, account_id string, order_id string, product_id string, "
                                "event_ts timestamp_ntz")
    created = NOW - dt.timedelta(hours=2)
    post = spark.createDataFrame(
        [("a", "P1", created, created - dt.timedelta(hours=1) if fault == "time" else created, None)],
        "account_id string, posting_number string, created_at timestamp_ntz, delivered_at timestamp_ntz, "
        "canceled_at timestamp_ntz")
    raw = spark.createDataFrame([("a", "s1", NOW)], "account_id string, srid string, event_ts timestamp_ntz")
    stock = marts["mrt_stock_daily"]
    if fault == "invalid":
        stock = stock.withColumn("stock_end", stock.stock_end * 0 - 5)
    viol = Q._union([
        Q.stale_marts(runs, marts, NOW),
        Q.watermark_monotonicity(wm),
        Q.duplicate_grains({"stg_sales": (stg, ("marketplace", "account_id", "order_id", "product_id", "event_ts"))}),
        Q.impossible_timestamps(raw, raw, post, stg.withColumnRenamed("order_id", "order_id"), NOW),
        Q.invalid_values(stock, marts["mrt_ads_daily"], marts["mrt_funnel_daily"])])
    return viol


def test_clean_warehouse_passes(spark):
    rep = Q.report(Q.summarize(frames(spark))).collect()[0]
    assert (rep.status, rep.issues, rep.message) == ("success", 0, "")


def test_each_fault_trips_its_check(spark):
    expect = {"stale": "stale_marts", "watermark": "watermark_monotonicity", "dup": "duplicate_grains",
              "time": "impossible_timestamps", "invalid": "invalid_values"}
    for fault, check in expect.items():
        s = {r.check: r for r in Q.summarize(frames(spark, fault)).collect()}
        assert set(s) == {check}, (fault, set(s))
        assert s[check].failures >= 1 and s[check].samples


def test_report_message_lists_checks_in_order(spark):
    v = frames(spark, "stale").unionByName(frames(spark, "dup"))
    rep = Q.report(Q.summarize(v)).collect()[0]
    assert rep.status == "failed" and rep.message.startswith("stale_marts=4; duplicate_grains=1")


def test_segmented_backward_steps_equal_plain_lag(spark):
    """C2 split into day segments gives exactly the rows of an unsplit scan."""
    rnd = random.Random(7)
    rows, t0 = [], dt.datetime(2026, 1, 1)
    for i in range(600):
        src = rnd.choice(["a", "b"])
        up = t0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 5))
        wmv = None if rnd.random() < 0.05 else up - dt.timedelta(minutes=rnd.randrange(0, 300))
        rows.append((src, "acc", wmv, up))
    df = spark.createDataFrame(rows, "source string, account_id string, watermark_ts timestamp_ntz, "
                                     "updated_at timestamp_ntz")
    got = sorted((r.source, r.watermark_ts, r.previous_watermark, r.updated_at)
                 for r in Q.watermark_backward_steps(df, segment="hour").collect())
    want = []
    for src in ("a", "b"):
        seq = sorted((u, w) for s, _, w, u in rows if s == src and w is not None)
        prev = None
        for u, w in seq:
            if prev is not None and w < prev:
                want.append((src, w, prev, u))
            prev = w
    assert got == sorted(want)


def test_backward_steps_of_a_busy_cursor(spark):
    """One cursor with most rows, many of them in one second or at one instant, keys that are
    null, and every choice of segments: the rows of an unsplit scan."""
    rnd = random.Random(21)
    rows, t0 = [], dt.datetime(2026, 1, 31, 23, 59, 59)
    for i in range(400):
        src = rnd.choice(["busy"] * 8 + ["calm", None])
        up = t0 + dt.timedelta(microseconds=rnd.randrange(0, 40) * 50_000, seconds=rnd.choice((0, 0, 0, 7200, 10**7)))
        rows.append((src, "acc", rnd.choice((None, t0 + dt.timedelta(seconds=rnd.randrange(0, 9)))), up))
    rows += [("busy", "acc", t0, None)]
    df = spark.createDataFrame(rows, "source string, account_id string, watermark_ts timestamp_ntz, updated_at timestamp_ntz")
    want = []
    for src in ("busy", "calm", None):
        seq = sorted((u, w) for s, _, w, u in rows if s == src and w is not None and u is not None)
        want += [(str(src), w, prev, u) for (_, prev), (u, w) in zip(seq, seq[1:]) if w < prev]
    for segment in Q.SEGMENTS:
        got = Q.watermark_backward_steps(df, segment).collect()
        assert sorted((str(r.source), r.watermark_ts, r.previous_watermark, r.updated_at) for r in got) == sorted(want)
    assert len(want) > 20


def test_raise_if_failed(spark):
    import pytest
    ok = Q.raise_if_failed(Q.report(Q.summarize(frames(spark))))
    assert ok["status"] == "success"
    with pytest.raises(Q.DataQualityError, match="invalid_values=1"):
        Q.raise_if_failed(Q.report(Q.summarize(frames(spark, "invalid"))))


def test_worst_duplicates_come_first(spark):
    rows = [(f"g{i}",) for i in range(6) for _ in range({0: 2, 1: 5, 2: 3, 3: 3, 4: 1, 5: 2}[i])]
    df = spark.createDataFrame([("a", g) for g, in rows], "account_id string, id string")
    got = Q.worst_duplicates(Q.duplicate_grains({"t": (df, ("account_id", "id")), "u": (df, ("id",))})).collect()
    assert sorted((r.table_name, r.rank, r.entity_id, r.duplicate_count) for r in got) == \
        [("t", 1, "a|g1", 5), ("t", 2, "a|g2", 3), ("t", 3, "a|g3", 3), ("u", 1, "g1", 5), ("u", 2, "g2", 3), ("u", 3, "g3", 3)]


def test_audit_row_holds_the_issues_as_json(spark):
    import json
    row = Q.audit_row(Q.summarize(frames(spark, "dup")), "quality", "r1", NOW, NOW).collect()[0]
    meta = json.loads(row.meta_json)
    assert (row.status, row.message) == ("failed", "data quality failures detected: duplicate_grains=1")
    assert meta["issue_count"] == 1 and meta["issues"][0]["check"] == "duplicate_grains" and meta["issues"][0]["samples"]
    clean = Q.audit_row(Q.summarize(frames(spark)), "quality", "r2", NOW, NOW).collect()[0]
    assert (clean.status, clean.message) == ("success", "data quality checks passed")
    assert json.loads(clean.meta_json) == {"status": "success", "issue_count": 0, "issues": []}
