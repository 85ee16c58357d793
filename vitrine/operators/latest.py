"""L1 latest-wins scan, L3 newest control-table value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__latest_rn"


def latest_wins(df: DataFrame, key: Sequence[str], order: Sequence[str],
                keep_seq: bool = False) -> DataFrame:
    """Per ``key`` keep the row with the greatest ``order`` tuple (all descending).

    ``order`` must make the choice total (the version column first, then
    tie-breakers standing for insertion order).  Planned as
    ``row_number() == 1``: Spark adds a partial ``WindowGroupLimit`` below the
    shuffle, so each map task forwards at most one row per key and a key with
    a third of all versions costs one row per map task, not a third of the data.
    Filters on non-key columns must be applied to the result, never before.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    out = df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)
    return out


def latest_in_window(df: DataFrame, key: Sequence[str], order: Sequence[str],
                     in_window: Column, version_floor: Column | None = None) -> DataFrame:
    """Latest version per key, kept only when that version satisfies ``in_window``.

    Always equal to ``latest_wins(df).where(in_window)``.  ``version_floor`` is
    a predicate on the version column that every candidate latest version
    satisfies (e.g. "ingested on or after the window start"); it is applied
    *before* the dedup so the scan and the shuffle skip older history (on
    day-partitioned raw tables it prunes whole partitions).  It is exact
    because any version it drops is older than a kept one: when the window is
    on the ingest day itself it always holds; for an event-day window it holds
    when versions are ingested no earlier than their event (callers assert it).
    """
    cand = df.where(version_floor) if version_floor is not None else df
    return latest_wins(cand, key, order).where(in_window)


def newest_value(df: DataFrame, group: Sequence[str], value: str, version: str,
                 alias: str | None = None) -> DataFrame:
    """L3: per group, the value at the newest version (ties: greatest value)."""
    return df.groupBy(*group).agg(
        F.max_by(F.col(value), F.struct(F.col(version), F.col(value))).alias(alias or value))
