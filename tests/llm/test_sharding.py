"""Sharding: jump hashing's law, balance and gapless slots."""

import zlib

import numpy as np

from vitrine.llm import sharding


def one(key, shards):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_plain_loop():
    keys = [0, 1, 5, 2**63, 2**64 - 1, *range(1000, 3000)]
    for n in (1, 2, 40, 41):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [one(k, n) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(200_000, dtype=np.uint64)
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    moved = a != b
    assert (b[moved] == 40).all() and abs(moved.mean() - 1 / 41) < 0.003
    assert np.bincount(a).min() > 4500


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SEGMENT_ROWS", 5)
    rows = [(i % 300, f"té{i % 7}" * (i % 5), i) for i in range(900)] + [(None, None, 0), (7, None, 1), (7, None, 2), (-3, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot bigint").repartition(3)
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), one(d or 0, 4), one(d or 0, 5)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(docs.limit(0), 4).count() == 0
