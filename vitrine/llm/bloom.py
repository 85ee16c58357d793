"""A Bloom filter of fixed size over 64-bit values, built by Spark, small enough for every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import unused

BITS = 1 << 24  # 2 MB, whatever the number of values; a full filter only lets more rows through


def build(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Two places for each value; the driver gets at most bits / 64 words."""
    v = F.col(column)
    place = F.explode(F.array(F.pmod(v, F.lit(bits)), F.pmod(F.shiftrightunsigned(v, 32), F.lit(bits))))
    words = values.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return out


def hits(held: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the unsigned values may be held."""
    m = np.uint64(len(held) * 64 - 1)
    words = held.view(np.uint64)

    def at(p):
        return (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1

    out = at(v & m)
    some = np.flatnonzero(out)
    out[some] = at((v[some] >> np.uint64(32)) & m)
    return out


def held(df: DataFrame, column: str, found: np.ndarray, negate: bool = False) -> DataFrame:
    """The rows whose value the filter may hold, or with ``negate`` those whose value it surely doesn't."""
    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        yes = hits(found, values.to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array(~yes if negate else yes)
    return df.filter(test(column))


def without(df: DataFrame, gone: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of ``df`` that have no equal in ``gone`` by ``key`` (bigint) and, null-safe, ``more``.

    Only rows that the filter may hold are shuffled for the join.
    """
    found = build(gone, key)
    names = {c: unused(f"gone_{i}", df) for i, c in enumerate((key, *more))}
    g = gone.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    some = held(df, key, found)
    on = F.col(key) == F.col(names[key])
    for c in more:
        on = on & F.col(c).eqNullSafe(F.col(names[c]))
    return held(df, key, found, negate=True).union(some.join(g, on, "left_anti"))
