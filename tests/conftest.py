import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="vitrine-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="vitrine-test-")


def recs(spark, docs, ingested_at=None):
    """Records as the normalisers take them: rec (VARIANT), payload, ingested_at."""
    import datetime as dt
    import json
    from pyspark.sql import functions as F
    ts = ingested_at or dt.datetime(2026, 3, 2, 12, 0, 0)
    df = spark.createDataFrame([(json.dumps(d, ensure_ascii=False), ts) for d in docs],
                               "payload string, ingested_at timestamp_ntz")
    return df.select(F.parse_json("payload").alias("rec"), "payload", "ingested_at")
