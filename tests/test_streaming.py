"""Streaming ingest equals the batch path; re-runs and late repeats add nothing."""
import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from vitrine.operators import normalize as N
from vitrine.sources import feeds, tables as K
from vitrine.streaming import ingest as S


def _land(d, name, pages):
    with open(os.path.join(d, name), "w") as fh:
        for p in pages:
            fh.write(json.dumps(p) + "\n")


def sale(i, day="2026-03-01"):
    return {"srid": f"s{i}", "lastChangeDate": f"{day}T10:00:00Z", "nmId": i, "quantity": 1, "forPay": 10}


def test_stream_equals_batch_and_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="vitrine-stream-")
    land, raw, runs, wm, ck = (os.path.join(base, x) for x in ("land", "raw", "runs", "wm", "ck"))
    os.makedirs(land)
    _land(land, "p1.json", [[sale(1), sale(2)], {"result": [sale(3)]}])
    norm = lambda r: N.wb_sales(r, "stream", "default")
    targets = {"sales": (norm, raw, "event_ts")}
    q = S.ingest(spark, land, targets, ck, "wb_sales", runs_root=runs, cursor=("wb_sales", "default", "last_change_ts"),
                 watermarks_root=wm)
    q.awaitTermination()
    got = sorted(r.srid for r in K.read_table(spark, raw).collect())
    batch = norm(feeds.unwrap(spark.read.text(land).withColumnRenamed("value", "line")
                              .withColumn("ingested_at", F.lit(dt.datetime(2026, 3, 1)).cast("timestamp_ntz")),
                              keep=["ingested_at"]))
    assert got == sorted(r.srid for r in batch.collect()) == ["s1", "s2", "s3"]
    # nothing new: a second run appends nothing (the checkpoint is the cursor)
    S.ingest(spark, land, targets, ck, "wb_sales", runs_root=runs).awaitTermination()
    assert K.read_table(spark, raw).count() == 3
    _land(land, "p2.json", [[sale(4, "2026-03-02")]])
    S.ingest(spark, land, targets, ck, "wb_sales", runs_root=runs, cursor=("wb_sales", "default", "last_change_ts"),
             watermarks_root=wm).awaitTermination()
    assert K.read_table(spark, raw).count() == 4
    cursors = sorted(r.watermark_ts for r in K.read_table(spark, wm).collect())
    assert cursors[-1] == dt.datetime(2026, 3, 2, 10)
    assert K.read_table(spark, runs).count() >= 2


def test_late_repeats_dropped_within_watermark(spark):
    base = tempfile.mkdtemp(prefix="vitrine-late-")
    land = os.path.join(base, "land")
    os.makedirs(land)
    t = "2026-03-01T10:00:00"
    rows = [{"k": "a", "ts": t}, {"k": "a", "ts": t}, {"k": "b", "ts": t}]
    _land(land, "x.json", rows)
    stream = spark.readStream.schema("k string, ts timestamp_ntz").json(land)
    ded = S.dedup_late(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["k"], "ts", "48 hours")
    q = (ded.writeStream.format("memory").queryName("late_dedup").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.k for r in spark.sql("SELECT k FROM late_dedup").collect()) == ["a", "b"]


def test_daily_stream_aggregate_equals_batch_mart(spark):
    from vitrine.operators import marts
    base = tempfile.mkdtemp(prefix="vitrine-w12-")
    land = os.path.join(base, "land")
    os.makedirs(land)
    recs = [{"day": "2026-03-01", "marketplace": "wb", "account_id": "a", "product_id": "p", "is_return": r,
             "qty": q, "price_gross": "10.00", "payout": "1.0000", "event_ts": f"2026-03-01T{h:02d}:00:00"}
            for h, q, r in ((1, 2, 0), (5, -1, 1), (7, 3, 0))]
    _land(land, "s.json", recs)
    schema = ("day date, marketplace string, account_id string, product_id string, is_return int, qty int, "
              "price_gross decimal(18,2), payout decimal(18,4), event_ts timestamp")
    stream = spark.readStream.schema(schema).json(land)
    q = (S.daily_sales_stream(stream).writeStream.format("memory").queryName("w12").outputMode("update")
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT qty, revenue, returns_qty FROM w12").collect()[-1]
    batch = marts.sales_daily(spark.read.schema(schema).json(land), dt.date(2026, 3, 2), 14,
                              dt.datetime(2026, 3, 2)).collect()[0]
    assert (got.qty, got.revenue, got.returns_qty) == (batch.qty, batch.revenue, batch.returns_qty)


def test_postings_two_tables_and_empty_marker(spark):
    base = tempfile.mkdtemp(prefix="vitrine-w3-")
    land, heads, items, runs, ck = (os.path.join(base, x) for x in ("land", "heads", "items", "runs", "ck"))
    os.makedirs(land)
    post = {"posting_number": "P1", "status": "delivered", "created_at": "2026-03-01T10:00:00Z",
            "products": [{"product_id": 1, "price": "5"}, {"product_id": 2, "price": "7"}]}
    _land(land, "a.json", [{"result": {"postings": [post], "has_next": False}}])
    targets = {"postings": (lambda r: N.ozon_postings(r, "s", "default"), heads, "created_at"),
               "items": (lambda r: N.ozon_posting_items(r, "s", "default"), items, "ingested_at")}
    S.ingest(spark, land, targets, ck, "ozon_postings", runs_root=runs).awaitTermination()
    assert [r.posting_number for r in K.read_table(spark, heads).collect()] == ["P1"]
    assert sorted(r.ozon_product_id for r in K.read_table(spark, items).collect()) == [1, 2]
    _land(land, "b.json", [{"result": {"postings": [], "has_next": False}}])  # an empty response
    S.ingest(spark, land, targets, ck, "ozon_postings", runs_root=runs).awaitTermination()
    msgs = sorted((r.rows_ingested, r.message) for r in K.read_table(spark, runs).collect())
    assert msgs == [(0, "empty"), (3, "")]


def test_w1_w2_starts_accounts_without_a_cursor(spark):
    """An account with sales and no stored cursor starts 48 hours back; the others' rows stay as they are."""
    from vitrine.plans import catalog
    from vitrine.plans.stages import Stages
    sf = "/root/testdata/sf0.001"
    start = dt.datetime(2024, 1, 29)
    whole, without, back = Stages(spark, sf), Stages(spark, sf), Stages(spark, sf)
    history = whole.watermarks
    without.__dict__["watermarks"] = history.where(F.col("account_id") != "acc3")
    # the same start as a stored cursor
    back.__dict__["watermarks"] = without.watermarks.unionByName(
        history.where(F.col("account_id") == "acc3").withColumn("watermark_ts", F.lit(start).cast("timestamp_ntz")))
    rows = lambda p: sorted(map(tuple, catalog.w1_w2(p).collect()))
    got = rows(without)
    assert got == rows(back) and "acc3" in [r[0] for r in got]
    assert [r for r in got if r[0] != "acc3"] == [r for r in rows(whole) if r[0] != "acc3"]


def test_cursor_rules(spark):
    t, now = dt.datetime(2026, 3, 1, 10), dt.datetime(2026, 3, 2)
    rows = spark.createDataFrame([(t,), (None,)], "at timestamp_ntz")
    found = lambda df, rule: [r[0] for r in S.next_cursor(df, "at", rule, now).collect()]
    assert [found(rows, r) for r in S.CURSOR_RULES] == [[t], [t], [now]]
    assert [found(rows.limit(0), r) for r in S.CURSOR_RULES] == [[], [now], [now]]
    try:
        S.next_cursor(rows, "at", "newest", now)
        raise AssertionError("an unknown rule must be refused")
    except ValueError:
        pass


def test_backfill_goes_on_after_a_failure(spark, tmp_root):
    """A chunk whose read fails leaves the finished ones and no cursor; the next run reads
    only what is left, and the cursor becomes the greatest change time of all chunks."""
    root, cursors = f"{tmp_root}/sales", f"{tmp_root}/cursors"
    asked, broken = [], {dt.date(2026, 3, 5)}

    def read(lo, hi):
        asked.append((lo, hi))
        if lo in broken:
            raise OSError("feed is down")
        days = [lo + dt.timedelta(days=d) for d in range(-1, (hi - lo).days + 2)]  # a feed that answers with too much
        return spark.createDataFrame([(f"s{d}", d, dt.datetime(2026, 4, 30 - d.day)) for d in days if d.day != 3],
                                     "srid string, sold date, changed timestamp_ntz")

    def run():
        return S.backfill(spark, "sales", read, lambda r: r, root, "sold", dt.date(2026, 3, 1), dt.date(2026, 3, 9), chunk_days=2,
                          cursor=("sales", "a", "changed"), watermarks_root=cursors, now=dt.datetime(2026, 5, 1))
    try:
        run()
        raise AssertionError("the failure must be seen")
    except OSError:
        pass
    assert [lo.day for lo, _ in asked] == [1, 3, 5] and K.read_table(spark, cursors) is None
    broken.clear()
    asked.clear()
    assert run() == 0 and [(lo.day, hi.day) for lo, hi in asked] == [(5, 6), (7, 8), (9, 9)]
    assert run() == 0 and len(asked) == 3
    assert sorted(r.sold.day for r in K.read_table(spark, root).collect()) == [1, 2, 4, 5, 6, 7, 8, 9]
    assert [r.watermark_ts for r in K.read_table(spark, cursors).collect()] == [dt.datetime(2026, 4, 29)]


def test_retried_batch_counts_its_stored_rows(spark, tmp_root):
    rows = spark.createDataFrame([("a", dt.date(2026, 3, 1)), ("b", dt.date(2026, 3, 1))], "k string, day date")
    assert K.append(spark, tmp_root, rows, batch_id=("s", 0)) == 2
    assert K.append(spark, tmp_root, rows, batch_id=("s", 0)) == 0 and K.batch_rows(spark, tmp_root, ("s", 0)) == 2
    assert K.batch_rows(spark, tmp_root, ("s", 1)) == 0 and not K.batch_done(spark, tmp_root, ("s", 1))


def test_w1_w2_never_broadcasts_the_sales(spark):
    """The cursors are the side that goes to every task, whatever sizes Spark estimates for the parsed sales."""
    from vitrine.plans import catalog
    from vitrine.plans.stages import Stages
    plan = catalog.w1_w2(Stages(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line and "cursor" in line)
    assert "BuildRight" in join


def test_ingest_keeps_no_records_and_takes_the_cursor_from_what_is_stored(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="vitrine-two-")
    land, ck, wm = (os.path.join(base, x) for x in ("land", "ck", "wm"))
    os.makedirs(land)
    _land(land, "p.json", [[{"posting_number": f"n{i}", "created_at": f"2026-03-0{i}T10:00:00Z",
                             "products": [{"product_id": i}] * i} for i in (1, 2)], {"error": "none"}])
    targets = {"postings": (lambda r: N.ozon_postings(r, "s", "a"), f"{base}/postings", "ingested_at"),
               "items": (lambda r: N.ozon_posting_items(r, "s", "a"), f"{base}/items", "ingested_at")}
    kept = []
    frame = type(spark.range(1))
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: kept.append(self) or persist(self, *a))
    S.ingest(spark, land, targets, ck, "ozon_postings", cursor=("ozon_postings", "a", "created_at"),
             watermarks_root=wm).awaitTermination()
    assert not kept
    assert K.read_table(spark, f"{base}/postings").count() == 2 and K.read_table(spark, f"{base}/items").count() == 3
    assert [r.watermark_ts for r in K.read_table(spark, wm).collect()] == [dt.datetime(2026, 3, 2, 10)]
    assert K.read_batch(spark, f"{base}/items", ("no-such", 0), "x int").count() == 0


def test_update_table_of_one_epoch_is_read_without_a_shuffle(spark, tmp_path):
    """Rows of one epoch are the result; with a second one the latest row of each key is."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "ts timestamp, event_type string, value double"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        S.run_update_stream(S.event_counts_stream(spark.readStream.schema(schema).parquet(src)), out, ck).awaitTermination()
        return S.read_update_table(spark, out, ["day", "event_type"])

    def found(df):
        return sorted(((str(r.day), r.event_type, r.events, float(r.value)) for r in df.collect()), key=str)

    day = dt.datetime(2024, 1, 5, 3)
    one = run([(day, "a", 1.0), (day, "a", 2.0), (day, None, 4.0)])
    assert found(one) == [("2024-01-05", "a", 2, 3.0), ("2024-01-05", None, 1, 4.0)]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert found(run([(day, "a", 5.0)])) == [("2024-01-05", "a", 3, 8.0), ("2024-01-05", None, 1, 4.0)]


def _shuffle_files(spark):
    """The files that shuffles have on the session's disks."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_landed_rows_go_to_their_table_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Rows dated by their file are written by the task that reads them, for any number of days: a
    repeated key, a null one and a page without records included; the conf of the write is put back."""
    monkeypatch.setattr(K, "_rows_of", lambda *a: 7)  # a count shuffles a number a task
    land, ck = str(tmp_path / "land"), str(tmp_path / "ck")
    os.makedirs(land)
    days = [dt.date(2026, 3, d) for d in (1, 2, 3, 5)]  # more than a task keeps open
    for n, day in enumerate(days):
        _land(land, f"p{n}.json", [[{"posting_number": None if i == 0 else f"n{i % 3}", "products": [{"product_id": i}] * (i % 3)}
                                    for i in range(7)], {"error": "none"}])
        at = dt.datetime.combine(day, dt.time(12), dt.UTC).timestamp()
        os.utime(os.path.join(land, f"p{n}.json"), (at, at))
    targets = {"postings": (lambda r: N.ozon_postings(r, "s", "a"), str(tmp_path / "postings"), "ingested_at"),
               "items": (lambda r: N.ozon_posting_items(r, "s", "a"), str(tmp_path / "items"), "ingested_at")}
    key = "spark.sql.maxConcurrentOutputFileWriters"
    conf, before = spark.conf.get(key), _shuffle_files(spark)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)  # one task reads all days
    try:
        for _ in range(2):  # the second run finds nothing new
            S.ingest(spark, land, targets, ck, "ozon_postings").awaitTermination()
            assert not _shuffle_files(spark) - before
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert spark.conf.get(key) == conf
    assert len(list((tmp_path / "postings").rglob("*.parquet"))) == len(days)
    rows = {n: K.read_table(spark, root) for n, (_, root, _) in targets.items()}
    found = sorted((r.day, r.posting_number) for r in rows["postings"].collect())
    assert found == sorted((d, "" if i == 0 else f"n{i % 3}") for d in days for i in range(7))
    items = sorted((r.day, r.posting_number, r.ozon_product_id) for r in rows["items"].collect())
    assert items == sorted((d, f"n{i % 3}", i) for d in days for i in range(7) for _ in range(i % 3))


def test_landed_lines_are_compressed_in_files_of_some_pages(spark, monkeypatch, tmp_path):
    """A compressed file is read by one task: many lines are cut into several files, all of them read back."""
    from vitrine.plans import catalog
    monkeypatch.setattr(catalog, "_stream_dirs", lambda s, tag: (str(tmp_path / tag), ""))
    lines = spark.range(0, 120_001, 1, 1).select(F.format_string('[{"id":%d}]', "id").alias("line")) \
        .unionByName(spark.sql("SELECT '' AS line"))
    files = catalog._landed_lines(spark, "pages", lines)
    names = [x for x in os.listdir(files) if x.startswith("part-")]
    assert len(names) >= 3 and all(x.endswith(".gz") for x in names)
    back = spark.read.text(files)
    assert back.exceptAll(lines).count() == 0 and back.count() == 120_002
