"""K1/K4/K5 on real Parquet directories: rebuilds are repeatable and an emptied day disappears."""
import datetime as dt

from pyspark.sql import functions as F

from vitrine.sources import tables as K

D = dt.date(2026, 3, 1)


def rows(spark, spec):
    return spark.createDataFrame([(D + dt.timedelta(days=d), k, v) for d, k, v in spec],
                                 "day date, k string, v bigint")


def snapshot(spark, root):
    df = K.read_table(spark, root)
    return [] if df is None else sorted((r.day, r.k, r.v) for r in df.collect())


def test_append_counts_and_reads_back(spark, tmp_root):
    n = K.append(spark, tmp_root, rows(spark, [(0, "a", 1), (1, "b", 2)]))
    assert n == 2
    assert K.append(spark, tmp_root, rows(spark, [(1, "c", 3)]), batch_id=("s", 0)) == 1
    assert K.append(spark, tmp_root, rows(spark, [(1, "c", 3)]), batch_id=("s", 0)) == 0  # retried epoch
    assert snapshot(spark, tmp_root) == [(D, "a", 1), (D + dt.timedelta(days=1), "b", 2),
                                         (D + dt.timedelta(days=1), "c", 3)]


def test_windowed_replace_is_repeatable_and_drops_emptied_days(spark, tmp_root):
    K.append(spark, tmp_root, rows(spark, [(0, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", 4)]))
    new = rows(spark, [(2, "c", 30), (0, "old", 0)])  # day 3 has no new rows; day 0 is before the cutoff
    cutoff = D + dt.timedelta(days=2)
    K.windowed_replace(spark, tmp_root, new, cutoff)
    first = snapshot(spark, tmp_root)
    K.windowed_replace(spark, tmp_root, new, cutoff)
    assert snapshot(spark, tmp_root) == first == [(D, "a", 1), (D + dt.timedelta(days=1), "b", 2),
                                                  (D + dt.timedelta(days=2), "c", 30)]
    K.vacuum(spark, tmp_root, older_than_hours=0)
    assert snapshot(spark, tmp_root) == first


def test_retention_drops_whole_days(spark, tmp_root):
    K.append(spark, tmp_root, rows(spark, [(0, "a", 1), (40, "b", 2)]))
    cutoff = K.retention_cutoff(D + dt.timedelta(days=45), 10)  # clamped to 30 days
    assert cutoff == D + dt.timedelta(days=15)
    assert K.retain(spark, tmp_root, cutoff) == [D.isoformat()]
    assert snapshot(spark, tmp_root) == [(D + dt.timedelta(days=40), "b", 2)]


def test_cursor_only_moves_forward(spark):
    t = dt.datetime(2026, 3, 1, 12)
    hist = spark.createDataFrame([("wb_sales", "default", t, t)],
                                 "source string, account_id string, watermark_ts timestamp_ntz, updated_at timestamp_ntz")
    upd = spark.createDataFrame([("wb_sales", "default", t - dt.timedelta(hours=1), t + dt.timedelta(hours=1)),
                                 ("ozon", "default", t, t)], hist.schema)
    got = sorted(r.source for r in K.advance_cursor(hist, upd).collect())
    assert got == ["ozon"]
    cur = K.read_cursor(hist, t + dt.timedelta(days=5)).collect()[0]
    assert cur.cursor == t


def test_seeds(spark):
    mk, acc = K.seed_dimensions(spark, dt.datetime(2026, 1, 1))
    assert sorted(r.marketplace for r in mk.collect()) == ["ozon", "wb"]
    assert acc.where(F.col("account_id") == "default").count() == 2


def test_dim_product_upsert_keeps_newest(spark):
    from vitrine.operators import staging
    cols = ", ".join(f"{c} string" for c in staging.DIM_PRODUCT_COLS[:-1]) + ", updated_at timestamp_ntz"
    t0, t1 = dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 2)
    row = lambda pid, title, ts: ("wb", "a", pid, None, None, None, None, None, title, None, None, ts)
    old = spark.createDataFrame([row("1", "old", t0), row("2", "keep", t0)], cols)
    new = spark.createDataFrame([row("1", "new", t1)], cols)
    got = sorted((r.product_id, r.title) for r in staging.dim_product(new, new.limit(0), existing=old).collect())
    assert got == [("1", "new"), ("2", "keep")]


def test_failed_attempt_leftovers_do_not_block_a_retry(spark, tmp_root):
    import os
    K.append(spark, tmp_root, rows(spark, [(0, "a", 1)]))
    left = os.path.join(tmp_root, ".spark-staging-deadbeef", "write_batch=window", "day=2026-03-01")
    os.makedirs(left)
    K.append(spark, tmp_root, rows(spark, [(0, "b", 2)]))
    assert snapshot(spark, tmp_root) == [(D, "a", 1), (D, "b", 2)]
    assert K.vacuum(spark, tmp_root) == [] and os.path.isdir(left)  # may still be at work
    assert K.vacuum(spark, tmp_root, older_than_hours=0) == [".spark-staging-deadbeef"]


def test_alert_sink(spark, tmp_root):
    from vitrine.operators import rules
    alerts = spark.createDataFrame([("r", "telegram", "m", "[r] m")], "rule string, action string, message string, text string")
    assert rules.store_alerts(spark, alerts, tmp_root, D) == 1
    assert [r.text for r in K.read_table(spark, tmp_root).collect()] == ["[r] m"]


def test_account_without_a_cursor_starts_two_days_back(spark):
    t = dt.datetime(2026, 3, 1, 12)
    hist = spark.createDataFrame([("wb_sales", "default", t, t)],
                                 "source string, account_id string, watermark_ts timestamp_ntz, updated_at timestamp_ntz")
    accounts = spark.createDataFrame([("wb_sales", "default"), ("wb_sales", "new")], "source string, account_id string")
    now = t + dt.timedelta(days=5)
    cur = {r.account_id: r.cursor for r in K.read_cursor(hist, now, accounts=accounts).collect()}
    assert cur == {"default": t, "new": now - dt.timedelta(hours=48)}
    assert K.read_cursor(None, now, accounts=accounts).count() == 2


def test_late_rows_merge_into_their_days(spark, tmp_root):
    K.append(spark, tmp_root, rows(spark, [(0, "a", 1), (0, "b", 2), (5, "c", 3)]))
    new = rows(spark, [(0, "b", 20), (0, "late", 9), (1, "later", 8), (5, "d", 4)])
    K.windowed_replace(spark, tmp_root, new, D + dt.timedelta(days=4), merge_key=("k",))
    day = lambda n: D + dt.timedelta(days=n)
    assert snapshot(spark, tmp_root) == [(day(0), "a", 1), (day(0), "b", 20), (day(0), "late", 9), (day(1), "later", 8), (day(5), "d", 4)]


def test_replace_keeps_days_after_the_window_and_rows_without_a_day(spark, tmp_root):
    some = rows(spark, [(0, "a", 1), (2, "b", 2), (9, "z", 3)])
    K.append(spark, tmp_root, some.union(spark.sql("SELECT CAST(NULL AS DATE), 'n', 7L")))
    K.windowed_replace(spark, tmp_root, rows(spark, [(2, "b", 20)]), D + dt.timedelta(days=1), until=D + dt.timedelta(days=3))
    assert sorted((r.k, r.v) for r in K.read_table(spark, tmp_root).collect()) == [("a", 1), ("b", 20), ("n", 7), ("z", 3)]
    K.windowed_replace(spark, tmp_root, None, D + dt.timedelta(days=1), until=D + dt.timedelta(days=3))
    assert sorted(r.k for r in K.read_table(spark, tmp_root).collect()) == ["a", "n", "z"]
    K.retain(spark, tmp_root, D + dt.timedelta(days=5))
    assert sorted(r.k for r in K.read_table(spark, tmp_root).collect()) == ["n", "z"]


def test_streams_keep_their_own_epochs(spark, tmp_root):
    for stream in ("s", "t"):
        assert K.append(spark, tmp_root, rows(spark, [(0, stream, 1)]), batch_id=(stream, 0)) == 1
    assert K.append(spark, tmp_root, rows(spark, [(0, "s", 2)]), batch_id=("s", 5000)) == 1
    assert K.append(spark, tmp_root, rows(spark, [(0, "s", 2)]), batch_id=("s", 3)) == 0
    assert len(snapshot(spark, tmp_root)) == 3


def test_epoch_whose_first_attempt_died_is_written_again(spark, tmp_root):
    import os
    K.append(spark, tmp_root, rows(spark, [(0, "a", 1), (1, "b", 2)]), batch_id=("s", 4))
    os.remove(os.path.join(tmp_root, "write_batch=s-s-000000000004", "_committed"))
    assert K.append(spark, tmp_root, rows(spark, [(0, "a", 1), (1, "b", 2)]), batch_id=("s", 4)) == 2
    assert len(snapshot(spark, tmp_root)) == 2


def test_writers_at_the_same_time_lose_nothing(spark, tmp_root):
    from concurrent.futures import ThreadPoolExecutor
    K.append(spark, tmp_root, rows(spark, [(0, "a", 0)]))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: K.append(spark, tmp_root, rows(spark, [(0, f"k{i}", i), (1, f"k{i}", i)])), range(6)))
    assert len(snapshot(spark, tmp_root)) == 13


def test_append_during_a_replace_stays(spark, tmp_root, monkeypatch):
    K.append(spark, tmp_root, rows(spark, [(2, "a", 1), (3, "gone", 2)]))
    write = K._write

    def write_and_append(df, *args):
        write(df, *args)
        monkeypatch.setattr(K, "_write", write)
        K.append(spark, tmp_root, rows(spark, [(2, "meanwhile", 3)]))

    monkeypatch.setattr(K, "_write", write_and_append)
    K.windowed_replace(spark, tmp_root, rows(spark, [(2, "a", 10)]), D + dt.timedelta(days=1))
    assert [r[1:] for r in snapshot(spark, tmp_root)] == [("a", 10), ("meanwhile", 3)]


def test_replace_counts_while_writing(spark, tmp_root):
    new = rows(spark, [(5, "a", 1), (6, "b", 2), (0, "early", 3)])
    assert K.windowed_replace(spark, tmp_root, new, D + dt.timedelta(days=4)) == 2


def test_upsert_rewrites_only_touched_buckets(spark, tmp_root):
    import glob
    t = [dt.datetime(2026, 3, d) for d in (1, 2, 3)]
    schema = "k string, v string, updated_at timestamp_ntz"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    assert K.read_upserted(spark, tmp_root) is None
    K.upsert(spark, tmp_root, make(*[(f"k{i}", "old", t[1]) for i in range(40)]), ("k",), "updated_at", buckets=8)
    before = set(glob.glob(f"{tmp_root}/*/*.parquet"))
    new = make(("k1", "new", t[2]), ("k1", "older", t[0]), ("k2", "stale", t[0]), ("k3", "same time", t[1]))
    written = K.upsert(spark, tmp_root, new, ("k",), "updated_at", buckets=8)
    got = {r.k: r.v for r in K.read_upserted(spark, tmp_root).collect()}
    assert len(got) == 40 and (got["k1"], got["k2"], got["k3"], got["k4"]) == ("new", "old", "same time", "old")
    kept = {f.rsplit("/", 2)[1] for f in before & set(glob.glob(f"{tmp_root}/*/*.parquet"))}
    assert written <= 3 and len(kept) == len({f.rsplit("/", 2)[1] for f in before}) - written
    assert K.upsert(spark, tmp_root, new.limit(0), ("k",), "updated_at", buckets=8) == 0
