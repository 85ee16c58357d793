import datetime as dt
import random

from pyspark.sql import functions as F

from vitrine.operators.latest import latest_in_window, latest_wins
from vitrine.operators.staging import day_window, ingest_floor


def test_version_floor_is_exact_when_ingest_follows_event(spark):
    rnd = random.Random(9)
    base = dt.datetime(2026, 1, 1)
    rows = []
    for k in range(300):
        for v in range(rnd.randrange(1, 6)):
            ev = base + dt.timedelta(days=rnd.randrange(0, 60), hours=rnd.randrange(24))
            ing = ev + dt.timedelta(days=rnd.randrange(0, 20), minutes=v)
            rows.append((f"k{k}", ev, ing, v))
    df = spark.createDataFrame(rows, "k string, event_ts timestamp_ntz, ingested_at timestamp_ntz, v int")
    as_of, days = dt.date(2026, 2, 20), 14
    win = day_window(F.to_date("event_ts"), as_of, days)
    plain = latest_wins(df, ["k"], ["ingested_at", "v"]).where(win)
    floored = latest_in_window(df, ["k"], ["ingested_at", "v"], win, ingest_floor(as_of, days))
    a, b = sorted(map(tuple, plain.collect())), sorted(map(tuple, floored.collect()))
    assert a == b and len(a) > 20


def test_latest_wins_keeps_one_row_per_key_with_greatest_version(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 0), ("a", 3, 2), ("b", 2, 0)], "k string, ver int, tie int")
    got = sorted((r.k, r.ver, r.tie) for r in latest_wins(df, ["k"], ["ver", "tie"]).collect())
    assert got == [("a", 3, 2), ("b", 2, 0)]
