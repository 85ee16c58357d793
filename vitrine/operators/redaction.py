"""K9 key-based redaction and W9 fixed-length date windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key fragments that mark a value as sensitive, and how many
# characters stay visible at each end.
SENSITIVE_KEYS = ("token", "api_key", "authorization", "password", "secret")
VISIBLE = 4


def redact_value(v: Column, visible: int = VISIBLE) -> Column:
    """Empty → ''; up to 2·visible chars → all '*'; else first/last ``visible`` around '***'."""
    n = F.length(v)
    return (F.when(v.isNull() | (n == 0), F.lit(""))
            .when(n <= 2 * visible, F.repeat(F.lit("*"), n))
            .otherwise(F.concat(F.left(v, F.lit(visible)), F.lit("***"), F.right(v, F.lit(visible)))))


def is_sensitive(k: Column, keys=SENSITIVE_KEYS) -> Column:
    low = F.lower(k)
    out = F.lit(False)
    for s in keys:
        out = out | low.contains(s)
    return out


def redact_map(m: Column, keys=SENSITIVE_KEYS, visible: int = VISIBLE) -> Column:
    """Mask the values of a ``map<string,string>`` whose key contains a sensitive fragment."""
    return F.transform_values(m, lambda k, v: F.when(is_sensitive(k, keys), redact_value(v, visible))
                              .otherwise(v))


def url_query_map(url: Column) -> Column:
    """The query string of a URL as a map (``a=1&b=2``); NULL without a query."""
    q = F.try_parse_url(url, F.lit("QUERY"))
    return F.when(q.isNotNull() & (F.length(q) > 0), F.str_to_map(q, F.lit("&"), F.lit("=")))


def redact_page_params(pages: DataFrame, keys=SENSITIVE_KEYS) -> DataFrame:
    """K9 over ``pages``: one row per URL query parameter (position, key,
    redacted value).  Pairs, not a map, so repeated keys survive."""
    q = F.try_parse_url(F.col("url"), F.lit("QUERY"))
    pairs = pages.select("page_id", F.posexplode(F.split(q, "&")).alias("pos", "kv")).where(F.length("kv") > 0)
    eq = F.instr(F.col("kv"), "=")
    key = F.when(eq > 0, F.substring_index(F.col("kv"), "=", 1)).otherwise(F.col("kv"))
    val = F.when(eq > 0, F.expr("substr(kv, instr(kv, '=') + 1)"))
    out = pairs.select("page_id", (F.col("pos") + 1).alias("pos"), key.alias("key"), val.alias("raw"))
    return out.select("page_id", "pos", "key",
                      F.when(is_sensitive(F.col("key"), keys), redact_value(F.col("raw")))
                      .otherwise(F.col("raw")).alias("value"))


# --------------------------------------------------------------------- W9

def assign_date_window(df: DataFrame, day: str, start: dt.date, end: dt.date, n_days: int) -> DataFrame:
    """Rows with ``day`` in [start, end] get their closed n-day window
    ``[start + k·n, min(start + k·n + n − 1, end)]`` (the last one clipped);
    computed arithmetically per row, no join or explode."""
    n = max(1, int(n_days))
    d = F.col(day)
    k = F.floor(F.date_diff(d, F.lit(start)) / n).cast("int")
    ws = F.date_add(F.lit(start), k * n)
    we = F.least(F.date_add(ws, n - 1), F.lit(end))
    return df.where(d.between(F.lit(start), F.lit(end))) \
        .withColumn("window_start", ws).withColumn("window_end", we)


def date_windows(spark, start: dt.date, end: dt.date, n_days: int) -> DataFrame:
    """W9 as the list of windows (one row each), generated by ``sequence``."""
    n = max(1, int(n_days))
    s = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr(f"INTERVAL {n} DAYS")))
                              .alias("window_start"))
    return s.select("window_start", F.least(F.date_add("window_start", n - 1), F.lit(end)).alias("window_end"))
