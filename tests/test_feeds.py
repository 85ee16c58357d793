"""Landed files read in batch: windows of files, records of every envelope, rejects, time filters."""

import datetime as dt
import os

from pyspark.sql import functions as F

from vitrine.sources import feeds

PAGES = ['[{"id":1},{"id":2}]', '{"result":{"postings":[{"id":3}],"has_next":true}}', '{"data":[{"id":4},5,null,"x"]}',
         '{"result":[]}', "", "   ", '{"id":', '{"error":"limit"}', "17", '[{"id":6,"deep":{"a":[1,{"b":"\u00e9"}]}}]']


def _land(folder, name, lines, when):
    folder.mkdir(exist_ok=True)
    f = folder / name
    f.write_text("\n".join(lines) + "\n", encoding="utf-8")
    os.utime(f, (when.timestamp(),) * 2)


def _utc(*a):
    return dt.datetime(*a, tzinfo=dt.UTC)


def test_files_outside_the_window_are_not_listed(spark, tmp_path):
    for day in (1, 2, 3):
        _land(tmp_path / "in", f"p{day}.json", [f'[{{"id":{day}}}]'], _utc(2024, 1, day, 12))
    read = lambda *w: sorted(r.line for r in feeds.read_lines(spark, str(tmp_path / "in"), *w).collect())
    assert len(read()) == 3
    assert read(dt.datetime(2024, 1, 1, 12, 30)) == ['[{"id":2}]', '[{"id":3}]']
    assert read(dt.datetime(2024, 1, 1, 12, 30), dt.datetime(2024, 1, 2, 13)) == ['[{"id":2}]']
    row = feeds.read_lines(spark, str(tmp_path / "in" / "p2.json")).collect()[0]
    assert row.ingested_at == dt.datetime(2024, 1, 2, 12) and row.file.endswith("p2.json")


def test_each_page_gives_its_records_and_rejects_in_one_pass(spark, tmp_path):
    _land(tmp_path / "in", "p.json", PAGES, _utc(2024, 1, 1))
    lines = feeds.read_lines(spark, str(tmp_path / "in"))
    feeds.store_pages(feeds.parse_pages(lines, keep=["ingested_at"]), str(tmp_path / "out"))
    recs = feeds.stored_records(spark, str(tmp_path / "out"))
    got = {(r.id, r.pos) for r in recs.select(F.expr("try_variant_get(rec, '$.id', 'int')").alias("id"), "pos").collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (4, 0), (6, 0)}
    rej = [(r.reject, r.pos, r.payload) for r in feeds.stored_rejects(spark, str(tmp_path / "out")).collect()]
    assert len(rej) == 6 and set(rej) == {
        ("not an object", 1, "5"), ("not an object", 2, "null"), ("not an object", 3, '"x"'),
        ("not JSON", None, '{"id":'), ("no records", None, '{"error":"limit"}'), ("no records", None, "17")}
    same = sorted((r.pos, r.payload) for r in feeds.unwrap(lines).select("pos", "payload").collect())
    assert sorted((r.pos, r.payload) for r in recs.select("pos", "payload").collect()) == same


def test_a_folder_without_records_reads_back_empty(spark, tmp_path):
    lines = spark.createDataFrame([(None, None), ("", None)], "line string, ingested_at timestamp_ntz")
    feeds.store_pages(feeds.parse_pages(lines, keep=["ingested_at"]), str(tmp_path / "none"))
    assert feeds.stored_records(spark, str(tmp_path / "none")).count() == 0
    assert feeds.stored_rejects(spark, str(tmp_path / "none")).count() == 0


def test_time_filter_is_half_open_and_keeps_records_without_a_time(spark):
    recs = ['{"id":1,"lastChangeDate":"2024-01-01T00:00:00Z"}', '{"id":2,"lastChangeDate":"2024-01-02T00:00:00Z"}',
            '{"id":3,"lastChangeDate":"2024-01-02T02:30:00+03:00"}', '{"id":4}', '{"id":5,"lastChangeDate":"soon"}',
            '{"id":6,"date":"2024-01-01"}', '{"id":7,"date":"2023-12-31T23:59:59"}']
    df = feeds.unwrap(spark.createDataFrame([("[" + ",".join(recs) + "]",)], "line string"))
    one_day = feeds.in_time(df, ("lastChangeDate", "date"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    ids = lambda d: sorted(r[0] for r in d.select(F.expr("variant_get(rec, '$.id', 'int')")).collect())
    assert ids(one_day) == [1, 3, 4, 5, 6]
    assert ids(feeds.in_time(df, ("lastChangeDate", "date"), since=dt.datetime(2024, 1, 1))) == [1, 2, 3, 4, 5, 6]
    assert one_day.columns == df.columns


def test_each_page_is_parsed_once(spark):
    """The envelope's paths share one parsed page, and no inferred filter parses it a second time."""
    from pyspark.sql import functions as F
    from vitrine.sources import feeds
    lines = spark.range(3).select(F.concat(F.lit('{"result":[{"a":'), F.col("id").cast("string"), F.lit("}]}")).alias("line"))
    got = feeds.unwrap(lines)
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert sorted(r.payload for r in got.collect()) == ['{"a":0}', '{"a":1}', '{"a":2}']


def test_merge_schemas_keeps_every_record_without_a_number_in_one_pass(spark):
    from pyspark.sql import functions as F
    from vitrine.sources import feeds
    def recs(docs):
        return spark.createDataFrame([(d, 0) for d in docs], "payload string, pos int").withColumn("rec", F.parse_json("payload"))
    fbs = recs(['{"posting_number":"p"}', '{"status":"x"}', '{"status":"x"}', '{"order_id":7}'])
    fbo = recs(['{"postingNumber":"p"}', '{}'])
    merged = feeds.merge_schemas([("fbs", fbs), ("fbo", fbo)])
    rows = sorted((r.posting_key or "", r.schema) for r in merged.collect())
    assert rows == [("", "fbo"), ("", "fbs"), ("", "fbs"), ("7", "fbs"), ("p", "fbo")]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # each input is read once, not again for the records without a number


def test_landed_pages_are_kept_compressed(spark, monkeypatch):
    from pathlib import Path
    from vitrine.plans import catalog
    from vitrine.plans.stages import Stages
    dirs, plain = [], catalog._stream_dirs
    monkeypatch.setattr(catalog, "_stream_dirs", lambda s, tag: dirs.append(plain(s, tag)) or dirs[-1])
    catalog._landed(Stages(spark, "/root/testdata/sf0.001"))
    files = [x.name for x in Path(dirs[0][0].removeprefix("file:")).glob("part-*")]
    assert files and all(x.endswith(".lz4") for x in files)
