"""C1–C6 data-quality checks as distributed violation tables.

Every check yields a DataFrame of violations with one schema
(``check, table_name, account_id, entity_id, detail``); the report counts
*all* violations exactly (the survey's Q14) and keeps three samples per check
in a fixed order.  Samples come from ``row_number() <= 3`` per check, which
Spark plans with a partial ``WindowGroupLimit`` before the shuffle, so a check
with a billion violations moves three rows per map task, never the set.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the checks.
MAX_MART_STALENESS = dt.timedelta(hours=2)
MAX_FUTURE_SKEW = dt.timedelta(minutes=5)
MAX_SAMPLE_ROWS = 3
CHECK_ORDER = ("stale_marts", "watermark_monotonicity", "duplicate_grains", "impossible_timestamps",
               "invalid_values")
SUMMARIES = {
    "stale_marts": "mart tables are stale or empty after successful marts runs",
    "watermark_monotonicity": "watermarks moved backwards for one or more source/account pairs",
    "duplicate_grains": "canonical stg/mrt tables contain duplicate rows on expected grain",
    "impossible_timestamps": "future or chronologically impossible timestamps were detected",
    "invalid_values": "negative or impossible aggregate values were detected",
}
DUPLICATE_SPECS = (
    ("stg_sales", ("marketplace", "account_id", "order_id", "product_id", "event_ts")),
    ("stg_orders", ("marketplace", "account_id", "order_id", "event_ts")),
    ("stg_stocks", ("marketplace", "account_id", "day", "product_id", "warehouse_id")),
    ("stg_funnel_daily", ("marketplace", "account_id", "day", "product_id")),
    ("stg_ads_daily", ("marketplace", "account_id", "day", "campaign_id")),
    ("stg_finance_ops", ("marketplace", "account_id", "operation_id", "operation_ts")),
    ("mrt_sales_daily", ("marketplace", "account_id", "day", "product_id")),
    ("mrt_stock_daily", ("marketplace", "account_id", "day", "product_id", "warehouse_id")),
    ("mrt_funnel_daily", ("marketplace", "account_id", "day", "product_id")),
    ("mrt_ads_daily", ("marketplace", "account_id", "day", "campaign_id")),
)

VIOLATION_COLS = ("check", "table_name", "account_id", "entity_id", "detail")


TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts_text(c: Column) -> Column:
    """Timestamps in check details: fixed 6-digit fraction, engine-independent."""
    return F.date_format(c, TS_FORMAT)


def _v(df: DataFrame, check: str, table: str, account: Column, entity: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(table).alias("table_name"),
                     account.cast("string").alias("account_id"), entity.cast("string").alias("entity_id"),
                     detail.cast("string").alias("detail"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------- C1

def stale_marts(task_runs: DataFrame, marts: dict[str, DataFrame], now: dt.datetime,
                task_prefix: str = "tasks.marts.") -> DataFrame:
    """Only after a successful marts run; each mart whose newest
    ``updated_at`` is older than now − 2 h, or which is empty."""
    cutoff = now - MAX_MART_STALENESS
    gate = task_runs.where(F.col("task_name").startswith(task_prefix) & (F.col("status") == "success"))
    parts = []
    for name, df in marts.items():
        last = df.agg(F.max("updated_at").alias("last_updated"))
        parts.append(_v(last.where(F.col("last_updated").isNull()
                                   | (F.col("last_updated") < F.lit(cutoff).cast("timestamp_ntz"))),
                        "stale_marts", name, F.lit(None), F.lit(name),
                        F.coalesce(ts_text(F.col("last_updated")), F.lit("empty"))))
    # gate: an EXISTS subquery (planned as a semi-join / scalar check, no join of rows)
    return _union(parts).where(gate.exists())


# --------------------------------------------------------------------- C2

# Calendar units, fine to coarse: an instant's second, the seconds of an hour, the hours of a
# month and the months of a history are at most 10**6, 3600, 744 and a few hundred rows.
SEGMENTS = ("second", "hour", "month")


def previous_value(rows: DataFrame, key: Sequence[str], at: str, value: str, segments: Sequence[str], out: str) -> DataFrame:
    """``rows`` (one row per key and instant) with ``out``, the value at the instant before.

    The row before is looked up inside the instant's finest segment; a segment's first
    row takes the last value of the segment before it, which is found in the same way
    among the segments' last values, one unit coarser.  So a window group holds what
    one unit can hold of the next finer one, however many rows a key has."""
    if not segments:
        return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*key).orderBy(at)))
    unit, coarser = segments[0], segments[1:]
    seg, last, carried = (f"{name}_{unit}" for name in ("seg", "last", "carried"))
    x = rows.withColumn(seg, F.date_trunc(unit, at).cast("timestamp_ntz"))
    x = x.withColumn(out, F.lag(value).over(Window.partitionBy(*key, seg).orderBy(at)))
    ends = x.groupBy(*key, seg).agg(F.max_by(value, at).alias(last))
    ends = previous_value(ends, key, seg, last, coarser, carried).drop(last)
    on = F.lit(True)
    for k in (*key, seg):
        on = on & F.col(f"x.`{k}`").eqNullSafe(F.col(f"e.`{k}`"))
    j = x.alias("x").join(ends.alias("e"), on)
    return j.select(*[F.col(f"x.`{c}`") for c in rows.columns], F.coalesce(F.col(f"x.`{out}`"), F.col(f"e.`{carried}`")).alias(out))


def watermark_backward_steps(wm: DataFrame, segment: str = "second") -> DataFrame:
    """Rows whose cursor is below the previous one of (source, account),
    ordered by updated_at (then value); rows without a value or a time are skipped.

    Of the rows of one instant only the first, the lowest, can step back, and the row
    after them is compared with the highest; so both are taken with a partial
    aggregate, and instants are compared segment by segment (``segment`` is the finest
    of ``SEGMENTS`` used).  A cursor with a third of all rows is spread by its seconds."""
    key = ["source", "account_id"]
    instants = wm.where(F.col("watermark_ts").isNotNull() & F.col("updated_at").isNotNull()) \
        .groupBy(*key, "updated_at").agg(F.min("watermark_ts").alias("watermark_ts"), F.max("watermark_ts").alias("highest"))
    steps = previous_value(instants, key, "updated_at", "highest", SEGMENTS[SEGMENTS.index(segment):], "previous_watermark")
    return steps.where(F.col("watermark_ts") < F.col("previous_watermark")) \
        .select(*key, "previous_watermark", "watermark_ts", "updated_at")


def watermark_monotonicity(wm: DataFrame) -> DataFrame:
    b = watermark_backward_steps(wm)
    return _v(b, "watermark_monotonicity", "sys_watermarks", F.col("account_id"), F.col("source"),
              F.concat_ws(" < ", ts_text(F.col("watermark_ts")), ts_text(F.col("previous_watermark"))))


# --------------------------------------------------------------------- C3

def duplicate_grains(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per (table, grain) the key groups with more than one row.
    ``group by … having count > 1`` runs a partial count per task first."""
    parts = []
    for name, (df, key) in tables.items():
        g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("duplicate_count")) \
            .where(F.col("duplicate_count") > 1)
        types = {f.name: f.dataType.typeName() for f in df.schema.fields}
        ent = F.concat_ws("|", *[F.coalesce(ts_text(F.col(k)) if types[k].startswith("timestamp")
                                            else F.col(k).cast("string"), F.lit("")) for k in key])
        acct = F.col("account_id") if "account_id" in key else F.lit(None)
        parts.append(_v(g, "duplicate_grains", name, acct, ent, F.col("duplicate_count")))
    return _union(parts)


def worst_duplicates(duplicates: DataFrame) -> DataFrame:
    """C3 samples: of each table the grains with the most rows, the largest first, equal
    counts by the grain's text.  ``duplicates`` comes from ``duplicate_grains``; a map
    task forwards at most three rows a table (partial limit before the shuffle)."""
    n = F.col("detail").cast("bigint")
    w = Window.partitionBy("table_name").orderBy(n.desc(), F.col("entity_id"))
    return duplicates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_SAMPLE_ROWS) \
        .select("table_name", "rank", "account_id", "entity_id", n.alias("duplicate_count"))


# --------------------------------------------------------------------- C4

def impossible_timestamps(raw_wb_sales: DataFrame, raw_wb_orders: DataFrame, raw_ozon_postings: DataFrame,
                          stg_sales: DataFrame, now: dt.datetime) -> DataFrame:
    """C4: events beyond now + 5 min; deliveries or cancellations before creation."""
    cut = F.lit(now + MAX_FUTURE_SKEW).cast("timestamp_ntz")
    p = raw_ozon_postings
    return _union([
        _v(raw_wb_sales.where(F.col("event_ts") > cut), "impossible_timestamps", "raw_wb_sales",
           F.col("account_id"), F.col("srid"), ts_text(F.col("event_ts"))),
        _v(raw_wb_orders.where(F.col("event_ts") > cut), "impossible_timestamps", "raw_wb_orders",
           F.col("account_id"), F.col("srid"), ts_text(F.col("event_ts"))),
        _v(p.where((F.col("created_at") > cut)
                   | (F.col("delivered_at").isNotNull() & (F.col("delivered_at") < F.col("created_at")))
                   | (F.col("canceled_at").isNotNull() & (F.col("canceled_at") < F.col("created_at")))),
           "impossible_timestamps", "raw_ozon_postings", F.col("account_id"), F.col("posting_number"),
           ts_text(F.col("created_at"))),
        _v(stg_sales.where(F.col("event_ts") > cut), "impossible_timestamps", "stg_sales",
           F.col("account_id"), F.col("order_id"), ts_text(F.col("event_ts"))),
    ])


# --------------------------------------------------------------------- C5

def invalid_values(mrt_stock: DataFrame, mrt_ads: DataFrame, mrt_funnel: DataFrame) -> DataFrame:
    """Negative stock; negative cost or revenue; adds > views or orders > adds."""
    f = mrt_funnel
    return _union([
        _v(mrt_stock.where(F.col("stock_end") < 0), "invalid_values", "mrt_stock_daily_negative",
           F.col("account_id"), F.col("product_id"), F.col("stock_end")),
        _v(mrt_ads.where((F.col("cost") < 0) | (F.col("revenue") < 0)), "invalid_values",
           "mrt_ads_daily_negative_cost", F.col("account_id"), F.col("campaign_id"), F.col("cost")),
        _v(f.where((F.col("adds_to_cart") > F.col("views")) | (F.col("orders") > F.col("adds_to_cart"))),
           "invalid_values", "mrt_funnel_daily_impossible_counts", F.col("account_id"), F.col("product_id"),
           F.concat_ws("/", F.col("views").cast("string"), F.col("adds_to_cart").cast("string"),
                       F.col("orders").cast("string"))),
    ])


# --------------------------------------------------------------------- C6

def summarize(violations: DataFrame) -> DataFrame:
    """Per check: summary text, exact failure count, three samples.

    Samples are ``table:account:entity`` strings in (table, account, entity,
    detail) order, joined by ``;``.
    """
    order = [F.col("table_name"), F.col("account_id").asc_nulls_first(), F.col("entity_id"), F.col("detail")]
    counts = violations.groupBy("check").agg(F.count(F.lit(1)).alias("failures"))
    w = Window.partitionBy("check").orderBy(*order)
    top = (violations.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MAX_SAMPLE_ROWS)
           .select("check", "rn", F.concat_ws(":", "table_name", F.coalesce("account_id", F.lit("")),
                                                 "entity_id").alias("sample")))
    samples = top.groupBy("check").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sample"))), lambda s: s["sample"]),
                     ";").alias("samples"))
    summ = F.create_map(*[x for k, v in SUMMARIES.items() for x in (F.lit(k), F.lit(v))])
    return counts.join(samples, "check").select(
        "check", summ[F.col("check")].alias("summary"), "failures", "samples")


def report(summary: DataFrame) -> DataFrame:
    """One row — status, issue count and the ``check=n; …`` message in check order."""
    rank = F.create_map(*[x for i, k in enumerate(CHECK_ORDER) for x in (F.lit(k), F.lit(i))])
    s = summary.select(rank[F.col("check")].alias("ord"), "check", "failures")
    return s.agg(
        F.when(F.count(F.lit(1)) > 0, "failed").otherwise("success").alias("status"),
        F.count(F.lit(1)).alias("issues"),
        F.coalesce(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("ord", F.concat("check", F.lit("="), F.col("failures").cast("string"))
                                                 .alias("m")))), lambda x: x["m"]), "; "),
            F.lit("")).alias("message"))


def audit_row(summary: DataFrame, task: str, run_id: str, started: dt.datetime, finished: dt.datetime) -> DataFrame:
    """The run's one row for the task-run table, from the per-check summary: status,
    message, and the issues with their samples as JSON (``meta_json``)."""
    rank = F.create_map(*[x for i, k in enumerate(CHECK_ORDER) for x in (F.lit(k), F.lit(i))])
    issue = F.struct(rank[F.col("check")].alias("ord"), "check", "summary", "failures",
                     F.split("samples", ";").alias("samples"))
    one = summary.agg(F.array_sort(F.collect_list(issue)).alias("found"))  # a row a check, five at most
    bad = F.size("found") > 0
    status = F.when(bad, "failed").otherwise("success")
    counts = F.array_join(F.transform("found", lambda x: F.concat(x["check"], F.lit("="), x["failures"].cast("string"))), "; ")
    issues = F.transform("found", lambda x: F.struct(x["check"].alias("check"), x["summary"].alias("summary"),
                                                     x["failures"].alias("failures"), x["samples"].alias("samples")))
    return one.select(
        F.lit(task).alias("task_name"), F.lit(run_id).alias("run_id"),
        F.lit(started).cast("timestamp_ntz").alias("started_at"), F.lit(finished).cast("timestamp_ntz").alias("finished_at"),
        status.alias("status"), F.lit(0).cast("bigint").alias("rows_ingested"),
        F.when(bad, F.concat(F.lit("data quality failures detected: "), counts))
        .otherwise(F.lit("data quality checks passed")).alias("message"),
        F.to_json(F.struct(status.alias("status"), F.size("found").alias("issue_count"), issues.alias("issues")))
        .alias("meta_json"))


class DataQualityError(RuntimeError):
    """Raised by ``raise_if_failed`` with the report's ``check=n; …`` message."""


def raise_if_failed(report_df: DataFrame) -> dict:
    """Bring the one-row report to the driver; raise when any check failed."""
    row = report_df.first()
    out = row.asDict() if row is not None else {"status": "success", "issues": 0, "message": ""}
    if out["status"] == "failed":
        raise DataQualityError(out["message"])
    return out
