"""O1–O10 operational metrics over the run-audit and cursor tables.

The reference exports counters to a monitoring system and alerts with range
queries; here the same signals are windowed aggregates over ``sys_task_runs``
and ``sys_watermarks``.  Sliding windows are summed over panes (one step of the
slide each): rows are counted by pane with map-side combine, and only the counts
are expanded to the windows that contain them; exact percentiles select by value
buckets, so no group's values are ever placed in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Duration histogram bucket bounds (seconds) and alert thresholds.
DURATION_BUCKETS = (0.1, 0.5, 1, 2, 5, 10, 20, 30, 60, 120, 300, 600)
MAX_CURSOR_LAG_SECONDS = 21600
MAX_EMPTY_PER_HOUR = 20


def duration_seconds() -> Column:
    d = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return F.greatest(d.cast("double") / 1e6, F.lit(0.0))


def sliding_sums(rows: DataFrame, ts: str, length: str, slide: str, key: list[str], count: Column,
                 out: str) -> DataFrame:
    """(w, key, out): ``count`` (an aggregate that adds up) in sliding windows over ``ts``.

    Every window is made of whole panes, since ``length`` must be a multiple of
    ``slide``; a pane lies in the same windows as each of its rows."""
    panes = rows.groupBy(F.window(ts, slide).start.alias("pane"), *key).agg(count.alias("in_pane"))
    return panes.groupBy(F.window("pane", length, slide).alias("w"), *key).agg(F.sum("in_pane").alias(out))


def failed_runs(runs: DataFrame, length: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """O1: failed runs per task in sliding windows over ``finished_at``."""
    w = sliding_sums(runs, "finished_at", length, slide, ["task_name"], F.count_if(F.col("status") == "failed"), "failed_runs")
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "task_name", "failed_runs")


def cursor_lag(wm: DataFrame, now: dt.datetime) -> DataFrame:
    """O2: per (source, account) the newest cursor's lag ``max(now − cursor, 0)``
    in seconds, and whether it exceeds 6 h."""
    newest = wm.groupBy("source", "account_id").agg(
        F.max_by("watermark_ts", F.struct("updated_at", "watermark_ts")).alias("watermark_ts"))
    micros = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) \
        - F.unix_micros(F.col("watermark_ts").cast("timestamp"))
    lag = F.greatest(F.lit(0).cast("bigint"), F.floor(micros / 1_000_000).cast("bigint"))
    return newest.select("source", "account_id", "watermark_ts", lag.alias("lag_seconds"),
                         (lag > MAX_CURSOR_LAG_SECONDS).alias("stale"))


def empty_responses(runs: DataFrame, length: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Runs that ingested nothing, counted per task in sliding hours;
    ``anomaly`` when more than 20."""
    e = runs.where(F.col("rows_ingested") == 0)
    w = sliding_sums(e, "finished_at", length, slide, ["task_name"], F.count(F.lit(1)), "empty_responses")
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "task_name",
                    "empty_responses", (F.col("empty_responses") > MAX_EMPTY_PER_HOUR).alias("anomaly"))


def runs_by_status(runs: DataFrame, length: str = "1 hour") -> DataFrame:
    """Runs per task and status in tumbling hours of ``started_at``."""
    w = runs.groupBy(F.window("started_at", length).alias("w"), "task_name", "status").agg(
        F.count(F.lit(1)).alias("runs"))
    return w.select(F.col("w.start").alias("window_start"), "task_name", "status", "runs")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality on equally named columns of two aliased frames (h, t)."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"h.`{c}`").eqNullSafe(F.col(f"t.`{c}`"))
    return on


def rank_targets(df: DataFrame, group: list[str], p_pct: int) -> DataFrame:
    """(group, total, need): rows of each group and the rank of its discrete percentile."""
    need = F.floor((F.col("total") * p_pct + 99) / 100)  # ceil(total * p / 100) in integers
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("total")).withColumn("need", need)


def value_at_rank(df: DataFrame, group: list[str], value: str, targets: DataFrame, out: str,
                  widths: tuple[float, ...] = (4096.0, 64.0, 1.0)) -> DataFrame:
    """(group, out): the smallest value whose running count reaches the group's ``need``.

    Weighted selection by value buckets, coarse to fine: rows are counted by
    (group, bucket) with map-side combine, a prefix sum over a group's buckets
    finds the one that holds the rank, and only rows of that bucket go on.  The
    last step sorts the distinct values of one finest bucket.  No step depends
    on how rows lie in partitions, and none sees more of a group than its
    buckets or one bucket's distinct values."""
    hist = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    found = targets.select(*group, "need", F.lit(0).cast("bigint").alias("before"))
    inside: list[str] = []
    for level, width in enumerate([*widths, None]):
        bucket = value if width is None else f"bucket_{level}"
        if width is not None:
            hist = hist.withColumn(bucket, F.floor(F.col(value) / width))
        mine = hist.alias("h").join(found.alias("t"), _same(hist, found, [*group, *inside])) \
            .select("h.*", "t.need", "t.before")
        keys = [*group, *inside]
        counts = mine.groupBy(*keys, bucket, "need", "before").agg(F.sum("n").alias("n"))
        running = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("cum", F.col("before") + F.sum("n").over(running))
        first = Window.partitionBy(*keys).orderBy(bucket)
        at = counts.where(F.col("cum") >= F.col("need")).withColumn("place", F.row_number().over(first)).where("place = 1")
        found = at.select(*keys, bucket, "need", (F.col("cum") - F.col("n")).alias("before"))
        inside.append(bucket)
    return found.select(*group, F.col(value).alias(out))


def exact_percentile(df: DataFrame, group: list[str], value: str, p_pct: int) -> DataFrame:
    """Exact discrete percentile (the smallest value whose cumulative share
    reaches ``p_pct`` %) per group."""
    return value_at_rank(df, group, value, rank_targets(df, group, p_pct), f"p{p_pct}")


def p95_duration(runs: DataFrame, length: str = "15 minutes") -> DataFrame:
    """Exact p95 of run duration per task in tumbling 15-minute windows."""
    d = runs.select(F.window("finished_at", length).start.alias("window_start"), "task_name",
                    duration_seconds().alias("duration"))
    return exact_percentile(d, ["window_start", "task_name"], "duration", 95)


def duration_histogram(runs: DataFrame) -> DataFrame:
    """Per task and status, runs per duration bucket (``le`` upper bound;
    +Inf beyond the last) and the cumulative count."""
    bounds = F.array(*[F.lit(float(b)) for b in DURATION_BUCKETS])
    idx = F.size(F.filter(bounds, lambda b: b < duration_seconds()))
    le = F.when(idx < len(DURATION_BUCKETS), F.element_at(bounds, idx + 1).cast("string")).otherwise(F.lit("+Inf"))
    g = runs.groupBy("task_name", "status", idx.alias("bucket"), le.alias("le")).agg(
        F.count(F.lit(1)).alias("runs"))
    w = Window.partitionBy("task_name", "status").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("task_name", "status", "bucket", "le", "runs", F.sum("runs").over(w).alias("cumulative"))


def hold_for(signal: DataFrame, key: list[str], ts: str, active: str, hold_minutes: int,
             step_minutes: int = 1, segment: str = "day") -> DataFrame:
    """Minutes at which a condition has been true for ``hold_minutes``.

    ``signal`` has one row per key and evaluation minute (repeated and null minutes
    count once, or not at all).  A run of consecutive active minutes starts where the
    previous active minute is more than one step back; the alert fires from run start +
    hold onwards.  One scan: a key's active minutes become one sorted list per segment
    (a day holds 1440 at most), a window over a key's segments carries the last minute
    and the latest start forward, and the lists are cut into runs in place.
    """
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    segs = Window.partitionBy(*key).orderBy("seg")
    x = signal.where(F.col(active) & F.col(ts).isNotNull()).groupBy(*key, F.date_trunc(segment, F.col(ts)).alias("seg")) \
        .agg(F.sort_array(F.collect_set(ts)).alias("minutes"))
    x = x.withColumn("last_before", F.lag(F.get("minutes", F.size("minutes") - 1)).over(segs))

    def starts_run(m: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("last_before")).otherwise(F.get("minutes", i - 1))
        return before.isNull() | (m - step > before)

    at = F.transform("minutes", lambda m, i: F.when(starts_run(m, i), i))
    x = x.withColumn("starts", F.filter(at, lambda i: i.isNotNull()))
    newest = F.get("minutes", F.get("starts", F.size("starts") - 1))
    x = x.withColumn("carry", F.max(newest).over(segs.rowsBetween(Window.unboundedPreceding, -1)))
    # cut at every start, and at 0 where the segment goes on with the run that was carried
    carried = F.coalesce(F.get("starts", F.lit(0)) > 0, F.lit(True))
    x = x.withColumn("carried", carried).withColumn("cuts", F.when(F.col("carried"), F.concat(F.array(F.lit(0)), "starts")).otherwise(F.col("starts")))

    def run(b: Column, k: Column) -> Column:
        end = F.coalesce(F.get("cuts", k + 1), F.size("minutes"))
        since = F.when((k == 0) & F.col("carried"), F.col("carry")).otherwise(F.get("minutes", b))
        return F.struct(since.alias("since"), F.slice("minutes", b + 1, end - b).alias("minutes"))

    runs = x.select(*key, F.explode(F.transform("cuts", run)).alias("run"))
    return runs.select(*key, F.explode("run.minutes").alias("firing_at"), F.col("run.since").alias("since")) \
        .where(F.col("firing_at") >= F.col("since") + F.make_dt_interval(mins=F.lit(hold_minutes)))


def failure_alert(runs: DataFrame, hold_minutes: int = 5) -> DataFrame:
    """O1 + O7: a task's 15-minute failure window has been non-zero for 5 minutes."""
    sig = failed_runs(runs).select("task_name", F.col("window_end").alias("minute"),
                                   (F.col("failed_runs") > 0).alias("active"))
    return hold_for(sig, ["task_name"], "minute", "active", hold_minutes)


def rows_ingested(runs: DataFrame) -> DataFrame:
    """Rows ingested per task."""
    return runs.groupBy("task_name").agg(F.sum("rows_ingested").alias("rows_ingested"))


def latency_summary(runs: DataFrame) -> DataFrame:
    """p50, p95 and max duration and the run rate (runs per second of span),
    in one row: one aggregate over the percentiles stacked with the run span
    (no join)."""
    # One group, but not as a literal: that would leave the joins below without a key.
    one = F.coalesce(F.length("task_name") * 0, F.lit(0)).alias("g")
    d = runs.select(one, duration_seconds().alias("duration"))
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (
        ("c50", "double"), ("c95", "double"), ("duration", "double"), ("total", "bigint"),
        ("started_at", "timestamp_ntz"), ("finished_at", "timestamp_ntz"))}

    def row(df: DataFrame, **given) -> DataFrame:
        return df.select(*[given[c].alias(c) if c in given else none[c] for c in none])

    stats = row(exact_percentile(d, ["g"], "duration", 50), c50=F.col("p50")) \
        .unionByName(row(exact_percentile(d, ["g"], "duration", 95), c95=F.col("p95"))) \
        .unionByName(row(d.agg(F.max("duration").alias("m"), F.count(F.lit(1)).alias("k")).where("k > 0"), duration=F.col("m"), total=F.col("k")))
    span = row(runs, started_at=F.col("started_at").cast("timestamp_ntz"), finished_at=F.col("finished_at").cast("timestamp_ntz"))
    agg = stats.unionByName(span).agg(
        F.max("total").alias("runs"), F.min("c50").alias("p50"), F.min("c95").alias("p95"),
        F.max("duration").alias("max_duration"),
        F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"))
    secs = (F.unix_micros(F.col("last_finish").cast("timestamp"))
            - F.unix_micros(F.col("first_start").cast("timestamp"))).cast("double") / 1e6
    return agg.select(F.coalesce("runs", F.lit(0).cast("bigint")).alias("runs"), "p50", "p95", "max_duration",
                      F.when(secs > 0, F.col("runs") / secs).otherwise(F.lit(0.0)).alias("runs_per_second"))


def stored_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per raw table and their total (last row, table ``*``)."""
    per = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        per = c if per is None else per.unionByName(c)
    tot = per.agg(F.sum("rows").alias("rows")).select(F.lit("*").alias("table_name"), "rows")
    return per.unionByName(tot)
