"""Sharding by jump consistent hashing (law ``key``).

The shard follows from the document's id and the number of shards alone; no
ring or table is kept, and adding a shard moves rows only into the new one.

Slots number a shard's rows without gaps.  Equal rows (id, size, checksum) are
first counted together, so a hot id is one row a task; segments of each shard,
by a hash of those columns, are numbered on their own and shifted by a prefix
sum over the segments' counts.  No shard passes through one task.

Defined results: null text has no bytes; a null id hashes as 0; repeated rows
get a slot each; an empty table gives no rows; columns beside id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import id_text, saved

OVERHEAD = 16          # bytes of a row besides its text
SEGMENT_ROWS = 50_000  # distinct rows that one segment numbers
# Fixed value: the multiplier of the published algorithm.
STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    here, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while (go := ahead < shards).any():
            here = np.where(go, ahead, here)
            key = np.where(go, key * np.uint64(STEP) + np.uint64(1), key)
            far = (here + 1) * ((1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))
            ahead = np.where(go, far.astype(np.int64), ahead)
    return here


def shard_of(shards: int):
    @F.pandas_udf("int")
    def f(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(ids.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")
    return f(F.coalesce("doc_id", F.lit(0)))


def shard(docs: DataFrame, shards: int, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    keys = ["doc_id", "size", "text_crc32"]
    counted = saved(
        id_text(docs).select("doc_id", (F.octet_length(text) + overhead).cast("bigint").alias("size"),
                             F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
        .groupBy(*keys).agg(F.count("*").alias("copies")), "shard-rows")
    segments = max(1, -(-counted.count() // (SEGMENT_ROWS * shards)))
    placed = counted.withColumn("shard", shard_of(shards)).withColumn("grown_shard", shard_of(shards + 1)) \
        .withColumn("segment", F.pmod(F.xxhash64(*keys), F.lit(segments)).cast("int"))
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "segment").agg(F.sum("copies").alias("rows")) \
        .select("shard", "segment", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "segment").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0))) \
        .join(base, ["shard", "segment"]) \
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
                F.explode(F.sequence(F.col("base") + F.col("first"), F.col("base") + F.col("first") + F.col("copies") - 1)).alias("slot"))
