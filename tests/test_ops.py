import datetime as dt
import random

import numpy as np

from vitrine.operators import ops, redaction


def test_exact_percentile_matches_inverted_cdf(spark):
    rnd = random.Random(3)
    rows = [(g, float(rnd.randrange(0, 50))) for g in ("a", "b", "c") for _ in range(rnd.randrange(1, 200))]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (50, 95):
        got = {r.g: r[f"p{p}"] for r in ops.exact_percentile(df, ["g"], "x", p).collect()}
        for g in ("a", "b", "c"):
            xs = np.array([x for gg, x in rows if gg == g])
            assert got[g] == float(np.percentile(xs, p, method="inverted_cdf")), (g, p)


def test_duration_histogram_buckets(spark):
    t = dt.datetime(2026, 3, 1)
    runs = spark.createDataFrame(
        [("t", "success", t, t + dt.timedelta(seconds=s)) for s in (0, 1, 3, 700)],
        "task_name string, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = [(r.le, r.runs, r.cumulative) for r in ops.duration_histogram(runs).orderBy("bucket").collect()]
    assert got == [("0.1", 1, 1), ("1.0", 1, 2), ("5.0", 1, 3), ("+Inf", 1, 4)]


def test_hold_for_fires_after_five_minutes(spark):
    t = dt.datetime(2026, 3, 1, 10)
    sig = spark.createDataFrame([("t", t + dt.timedelta(minutes=m), m not in (3,)) for m in range(0, 12)],
                                "task string, minute timestamp_ntz, active boolean")
    got = [r.firing_at.minute for r in ops.hold_for(sig, ["task"], "minute", "active", 5).orderBy("firing_at").collect()]
    assert got == [9, 10, 11]  # island 4..11 fires from 4 + 5


def test_redaction(spark):
    pages = spark.createDataFrame([(1, "https://x.example/p?token=abcdefghijkl&page=2&api_key=short&x"),
                                   (2, "https://x.example/p"), (3, "https://x.example/p?Authorization=")],
                                  "page_id long, url string")
    got = [(r.page_id, r.pos, r.key, r.value) for r in redaction.redact_page_params(pages).orderBy("page_id", "pos").collect()]
    assert got == [(1, 1, "token", "abcd***ijkl"), (1, 2, "page", "2"), (1, 3, "api_key", "*****"),
                   (1, 4, "x", None), (3, 1, "Authorization", "")]


def test_date_windows(spark):
    w = [(r.window_start, r.window_end) for r in
         redaction.date_windows(spark, dt.date(2026, 3, 1), dt.date(2026, 3, 8), 3).collect()]
    assert w == [(dt.date(2026, 3, 1), dt.date(2026, 3, 3)), (dt.date(2026, 3, 4), dt.date(2026, 3, 6)),
                 (dt.date(2026, 3, 7), dt.date(2026, 3, 8))]
    df = spark.createDataFrame([(dt.date(2026, 3, d),) for d in range(1, 10)], "day date")
    a = redaction.assign_date_window(df, "day", dt.date(2026, 3, 1), dt.date(2026, 3, 8), 3)
    assert sorted({(r.window_start, r.window_end) for r in a.collect()}) == w


def test_percentile_of_hot_groups_negative_and_fractional_values(spark):
    rnd = random.Random(9)
    rows = [("hot", rnd.choice([float(i % 500), -3.25, 5e4 + rnd.random()])) for i in range(5000)]
    rows += [("cold", float(i)) for i in range(7)] + [(None, 1.5), (None, 0.5), ("one", 4096.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (1, 50, 95, 100):
        got = {r.g: r[f"p{p}"] for r in ops.exact_percentile(df, ["g"], "x", p).collect()}
        for g in ("hot", "cold", None, "one"):
            xs = np.array([x for gg, x in rows if gg == g])
            assert got[g] == float(np.percentile(xs, p, method="inverted_cdf")), (g, p)


def test_percentiles_do_not_depend_on_exchange_reuse(spark):
    from vitrine.sources import bindings as B
    runs = B.Warehouse(spark, "/root/testdata/sf0.01").raw("sys_task_runs")
    found = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            found.append((sorted(map(tuple, ops.p95_duration(runs).collect())), ops.latency_summary(runs).collect()))
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
    assert found[0] == found[1] and len(found[0][0]) > 8000


def test_hold_for_segments_equal_a_single_scan(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2026, 3, 1, 20)
    rows = [(task, t0 + dt.timedelta(minutes=m), rnd.random() < 0.8) for task in ("a", "b") for m in range(0, 600)]
    sig = spark.createDataFrame(rows, "task string, minute timestamp_ntz, active boolean")
    got = sorted((r.task, r.firing_at, r.since) for r in ops.hold_for(sig, ["task"], "minute", "active", 5,
                                                                          segment="hour").collect())
    want = []
    for task in ("a", "b"):
        since = prev = None
        for tk, m, act in rows:
            if tk != task or not act:
                continue
            if prev is None or m - prev > dt.timedelta(minutes=1):
                since = m
            prev = m
            if m >= since + dt.timedelta(minutes=5):
                want.append((task, m, since))
    assert got == sorted(want)


def test_redact_map_column(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([({"Api_Key_Main": "0123456789ab", "x-api-key": "0123456789ab", "Authorization": "Bearer 1", "page": "2"},)],
                               "m map<string,string>")
    got = df.select(redaction.redact_map(F.col("m")).alias("m")).collect()[0].m
    assert got == {"Api_Key_Main": "0123***89ab", "x-api-key": "0123456789ab", "Authorization": "*" * 8, "page": "2"}


def test_sliding_sums_equal_windows_of_single_rows(spark):
    """Panes give what expanding every row to its windows gives, also on window borders."""
    from pyspark.sql import functions as F
    rnd = random.Random(12)
    t0 = dt.datetime(2026, 3, 1, 23, 50)
    at = lambda: t0 + dt.timedelta(minutes=rnd.randrange(0, 40), microseconds=rnd.choice((0, 1, 999_999)))
    rows = [("hot" if i % 3 else f"t{i % 4}", at(), rnd.choice(("failed", "success"))) for i in range(900)]
    runs = spark.createDataFrame(rows + [("none", None, "failed")], "task_name string, finished_at timestamp_ntz, status string")
    for length, slide in (("15 minutes", "1 minute"), ("1 hour", "5 minutes"), ("5 minutes", "5 minutes")):
        got = ops.sliding_sums(runs, "finished_at", length, slide, ["task_name"], F.count_if(F.col("status") == "failed"), "n")
        want = runs.groupBy(F.window("finished_at", length, slide).alias("w"), "task_name") \
            .agg(F.count_if(F.col("status") == "failed").alias("n"))
        rows_of = lambda d: sorted((r.w.start, r.w.end, r.task_name, r.n) for r in d.collect())
        assert rows_of(got) == rows_of(want)


def test_hold_for_over_gaps_repeats_and_nulls(spark):
    """A run over several segments keeps its start; a segment without minutes ends it."""
    t0 = dt.datetime(2026, 3, 1, 22, 58)
    minutes = [t0 + dt.timedelta(minutes=m) for m in [*range(0, 130), *range(260, 268)]]
    rows = [("a", m, True) for m in minutes] * 2 + [("a", None, True), (None, t0, True), ("b", t0, False)]
    sig = spark.createDataFrame(rows, "task string, minute timestamp_ntz, active boolean")
    out = ops.hold_for(sig, ["task"], "minute", "active", 5, segment="hour")
    got = sorted((r.task, r.firing_at, r.since) for r in out.collect())
    assert got == [("a", m, t0 if m < minutes[130] else minutes[130]) for m in minutes
                   if m >= t0 + dt.timedelta(minutes=5) and not minutes[130] <= m < minutes[135]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # one scan: the signal is not read again for what is carried
