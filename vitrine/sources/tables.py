"""K1–K7: tables on plain Parquet, written by Spark's dynamic partition overwrite.

Layout of a table root::

    <root>/write_batch=<name>/<day column>=<yyyy-mm-dd>/*.parquet

Every write stages its files in a folder of its own and moves whole partitions
into place when its job commits; nothing else is kept about a table, so there is
no state that two writers could overwrite in each other.

* K1 ``append`` — a batch of its own (a stream's epoch, or a fresh name), so
  appends that run at the same time never touch the same partition, and a
  retried epoch replaces what its first attempt has left;
* K4 ``windowed_replace`` — the window's days are overwritten in the batch
  ``window``; days that came out empty and the window's appended partitions that
  stood there before are then dropped by name (a batch appended meanwhile stays);
* K5 ``retain`` — days below the cutoff are dropped, no data is rewritten;
* K7 ``upsert`` — a table partitioned by a hash of its key, of which only the
  buckets that hold a new row are rewritten;
* ``vacuum`` — removes what jobs that died have left, and empty batches.

A replace that dies between commit and drop leaves days too many, never too
few; running it again ends it.  Readers prune by day as by any partition column.
Only partition names pass through the driver.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.latest import latest_wins

NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's directory name for a null day
BATCH = "write_batch"
WINDOW = "window"       # the batch of windowed replaces
BUCKET = "key_bucket"
DONE = "_committed"     # in a stream epoch's folder, once it is whole
LANDED_DAYS = 2         # files that a task of ``_write_landed`` has open at once; with more days, it sorts


class _FS:
    """A folder through Hadoop's FileSystem: local disk, HDFS and object stores alike."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def p(self, rel: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}")

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self.p(rel))

    def read_text(self, rel: str) -> str:
        stream = self.fs.open(self.p(rel))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def touch(self, rel: str) -> None:
        self.fs.create(self.p(rel), True).close()

    def glob(self, pattern: str) -> list:
        return list(self.fs.globStatus(self.p(pattern)) or [])

    def names(self, pattern: str) -> list[str]:
        return [x.getPath().getName() for x in self.glob(pattern)]

    def delete(self, rel: str) -> None:
        self.fs.delete(self.p(rel), True)


def _partitions(fs: _FS) -> list[tuple[str, str]]:
    """(batch folder, day folder) of every partition."""
    return [(x.getPath().getParent().getName(), x.getPath().getName())
            for x in fs.glob(f"{BATCH}=*/*=*") if x.isDirectory()]


def _day(folder: str) -> dt.date | None:
    """A day folder's date; None for rows without a day."""
    value = folder.split("=", 1)[1]
    return None if value == NO_DAY else dt.date.fromisoformat(value)


def _files(fs: _FS, parts: list[tuple[str, str]]) -> dict[tuple[str, str], frozenset[str]]:
    """The file names of partitions; every write gives its files new names."""
    return {p: frozenset(fs.names(f"{p[0]}/{p[1]}/*")) for p in parts}


def read_table(spark: SparkSession, root: str, schema=None, day_from: dt.date | None = None,
               day_to: dt.date | None = None) -> DataFrame | None:
    """The rows (the day column as a date), or None for an empty table.

    ``day_from`` / ``day_to`` are conditions on the partition column, so days
    outside are not read; rows without a day are outside every range."""
    fs = _FS(spark, root)
    parts = _partitions(fs)
    if not parts:
        return None
    day_col = parts[0][1].split("=", 1)[0]
    r = spark.read if schema is None else spark.read.schema(schema)
    df = r.parquet(fs.root).drop(BATCH).withColumn(day_col, F.col(day_col).cast("date"))
    if day_from is not None:
        df = df.where(F.col(day_col) >= F.lit(day_from))
    return df if day_to is None else df.where(F.col(day_col) <= F.lit(day_to))


def _write(df: DataFrame, root: str, parts: list[str], sort_by: tuple[str, ...] = ()) -> None:
    """Replace the partitions that ``df`` has rows for.  REBALANCE: AQE splits a
    hot day over several tasks; files are sorted by the table's key."""
    (df.hint("rebalance", parts[-1]).sortWithinPartitions(parts[-1], *sort_by)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(root))


def _write_landed(df: DataFrame, root: str, parts: list[str]) -> None:
    """The same for rows dated by the file they come from: each task writes what it has read, since it
    reads few days.  No row passes through a shuffle or, up to some days a task, a sort, so that the
    disk holds the table alone; its texts (payloads) are packed closer than by Parquet's default."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, LANDED_DAYS)
    try:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .option("parquet.compression.codec.zstd.level", 9).partitionBy(*parts).parquet(root))
    finally:
        conf.set(key, before)


def _epoch_name(batch_id: tuple[str, int]) -> str:
    return f"s-{batch_id[0]}-{int(batch_id[1]):012d}"


def _rows_of(spark: SparkSession, fs: _FS, name: str) -> int:
    return spark.read.parquet(f"{fs.root}/{BATCH}={name}").count() if fs.names(f"{BATCH}={name}/*=*") else 0


def batch_done(spark: SparkSession, root: str, batch_id: tuple[str, int]) -> bool:
    """Whether an epoch is committed."""
    return _FS(spark, root).exists(f"{BATCH}={_epoch_name(batch_id)}/{DONE}")


def stored_batches(spark: SparkSession, root: str) -> int:
    """The number of batches that have stored rows."""
    return len({b for b, _ in _partitions(_FS(spark, root))})


def batch_rows(spark: SparkSession, root: str, batch_id: tuple[str, int]) -> int:
    """The rows that an epoch has stored (a retried epoch's audit counts them, not zero)."""
    return _rows_of(spark, _FS(spark, root), _epoch_name(batch_id))


def read_batch(spark: SparkSession, root: str, batch_id: tuple[str, int], schema) -> DataFrame:
    """The rows that an epoch has stored, none where it stored none."""
    fs, folder = _FS(spark, root), f"{BATCH}={_epoch_name(batch_id)}"
    if not fs.names(f"{folder}/*=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{fs.root}/{folder}")


def read_stream_rows(spark: SparkSession, root: str, stream: str) -> DataFrame | None:
    """The rows that one stream (or backfill) has appended; None where it stored none."""
    fs = _FS(spark, root)
    if not fs.names(f"{BATCH}=s-{stream}-????????????/*=*"):
        return None
    return spark.read.parquet(fs.root).where(F.col(BATCH).startswith(f"s-{stream}-")).drop(BATCH)


def append(spark: SparkSession, root: str, df: DataFrame, day_col: str = "day",
           batch_id: tuple[str, int] | None = None, landed: bool = False) -> int:
    """K1: append rows (any day); returns the committed row count (from the file footers).

    With ``batch_id`` = (stream, epoch) an epoch that is committed, or older
    than the stream's last one, is skipped; one whose first attempt died is
    written again over what is left of it.  ``landed``: the day is that of the
    landed file a row comes from, so its task writes it (see ``_write_landed``)."""
    fs = _FS(spark, root)
    name = f"a-{uuid.uuid4().hex}" if batch_id is None else _epoch_name(batch_id)
    if batch_id is not None:
        last = max(fs.names(f"{BATCH}=s-{batch_id[0]}-????????????"), default="")
        if f"{BATCH}={name}" < last or fs.exists(f"{BATCH}={name}/{DONE}"):
            return 0
    (_write_landed if landed else _write)(df.withColumn(BATCH, F.lit(name)), fs.root, [BATCH, day_col])
    count = _rows_of(spark, fs, name)
    if batch_id is not None:
        fs.touch(f"{BATCH}={name}/{DONE}")
    return count


def windowed_replace(spark: SparkSession, root: str, new_rows: DataFrame | None, cutoff: dt.date,
                     day_col: str = "day", sort_by: tuple[str, ...] = (), until: dt.date | None = None,
                     merge_key: tuple[str, ...] = ()) -> int:
    """K4: replace the days from ``cutoff`` on (to ``until``, if given) with ``new_rows``.

    Days in the window without new rows disappear (all of them where
    ``new_rows`` is None); days outside and rows without a day stay.
    New rows dated before the cutoff are ignored, or, with ``merge_key``,
    merged into their own days: only those days are rewritten, and a new row
    takes the place of a stored one with an equal key.  Returns the window's
    rows, counted while they are written."""
    fs = _FS(spark, root)
    inside = lambda d: d is not None and d >= cutoff and (until is None or d <= until)
    before = _files(fs, [p for p in _partitions(fs) if inside(_day(p[1]))])
    count = 0
    if new_rows is not None:
        day = F.col(day_col)
        wanted = (day >= F.lit(cutoff)) & (F.lit(True) if until is None else day <= F.lit(until))
        late = day < F.lit(cutoff)
        seen = Observation()
        watched = new_rows.observe(seen, F.count_if(wanted).alias("n"), F.min(F.when(late, day)).alias("lo"),
                                   F.max(F.when(late, day)).alias("hi"))
        _write(watched.where(wanted).withColumn(BATCH, F.lit(WINDOW)), fs.root, [BATCH, day_col], tuple(sort_by))
        count = int(seen.get["n"] or 0)
        if merge_key and seen.get["lo"] is not None:
            some = new_rows.where(late).persist()   # read three times below
            try:
                _merge_late(spark, fs, some, seen.get["lo"], seen.get["hi"], day_col, sort_by, merge_key)
            finally:
                some.unpersist()
    for part, files in _files(fs, list(before)).items():
        if part[0] != f"{BATCH}={WINDOW}" or files <= before[part]:   # not written just now
            fs.delete("/".join(part))
    return count


def _merge_late(spark: SparkSession, fs: _FS, rows: DataFrame, lo: dt.date, hi: dt.date, day_col: str,
                sort_by: tuple[str, ...], merge_key: tuple[str, ...]) -> None:
    """Rewrite the days of late ``rows`` with what they don't replace."""
    before = _files(fs, [p for p in _partitions(fs) if (d := _day(p[1])) is not None and lo <= d <= hi])
    stored = read_table(spark, fs.root, day_from=lo, day_to=hi)
    if stored is not None:
        on = F.lit(True)
        for k in merge_key:
            on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}"))
        rest = stored.join(rows.select(day_col).distinct(), day_col, "left_semi").alias("s") \
            .join(rows.select(*merge_key).alias("l"), on, "left_anti")
        rows = rows.unionByName(rest, allowMissingColumns=True)
    _write(rows.withColumn(BATCH, F.lit(WINDOW)), fs.root, [BATCH, day_col], tuple(sort_by))
    window = f"{BATCH}={WINDOW}"
    merged = {d for (b, d), files in _files(fs, [(window, d) for d in {p[1] for p in before}]).items()
              if files and not files <= before.get((b, d), frozenset())}
    for b, d in before:
        if d in merged and b != window:
            fs.delete(f"{b}/{d}")


def retain(spark: SparkSession, root: str, cutoff: dt.date) -> list[str]:
    """K5: drop whole days below ``cutoff`` (see ``retention_cutoff``); returns them."""
    fs = _FS(spark, root)
    old = [p for p in _partitions(fs) if (d := _day(p[1])) is not None and d < cutoff]
    for part in old:
        fs.delete("/".join(part))
    return sorted({_day(d).isoformat() for _, d in old})


def retention_cutoff(as_of: dt.date, days: int) -> dt.date:
    """K5's clamp: keep between 30 and 3650 days."""
    return as_of - dt.timedelta(days=max(30, min(3650, int(days))))


def vacuum(spark: SparkSession, root: str, older_than_hours: float = 24) -> list[str]:
    """Delete staging folders of jobs that died (untouched for some hours) and batches without a
    partition; a stream's newest batch stays, as it tells the last epoch."""
    fs = _FS(spark, root)
    limit = dt.datetime.now().timestamp() - older_than_hours * 3600
    gone = [x.getPath().getName() for x in fs.glob(".spark-staging-*") if x.getModificationTime() / 1000 <= limit]
    full = {b for b, _ in _partitions(fs)}
    batches = sorted(fs.names(f"{BATCH}=*"))
    newest = {b[:-13]: b for b in batches if b.startswith(f"{BATCH}=s-")}
    gone += [b for b in batches if b not in full and b not in newest.values()]
    for name in gone:
        fs.delete(name)
    return gone


# --------------------------------------------------------------------- K7

def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def upsert(spark: SparkSession, root: str, new_rows: DataFrame, key: tuple[str, ...], newest: str,
           buckets: int = 64) -> int:
    """K7: keyed upsert; the row with the newest ``newest`` wins, of equals the new one.

    The table is partitioned by a hash of the key (``buckets`` must stay the
    same); only buckets that hold a new row are read and written.  Returns the
    number of buckets written."""
    fs = _FS(spark, root)
    rows = new_rows.withColumn(BUCKET, bucket_of(key, buckets)).persist()
    try:
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        both = rows.withColumn("is_new", F.lit(1))
        if fs.names(f"{BUCKET}=*"):
            stored = spark.read.schema(rows.schema).parquet(fs.root).where(F.col(BUCKET).isin(touched))
            both = both.unionByName(stored.withColumn("is_new", F.lit(0)))
        if touched:
            _write(latest_wins(both, key, (newest, "is_new")).drop("is_new"), fs.root, [BUCKET], key)
        return len(touched)
    finally:
        rows.unpersist()


def read_upserted(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The rows of a table kept by ``upsert``; None where nothing was written yet."""
    fs = _FS(spark, root)
    if not fs.names(f"{BUCKET}=*"):
        return None
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(fs.root).drop(BUCKET)


# --------------------------------------------------------------- K3, K6

def advance_cursor(history: DataFrame | None, updates: DataFrame) -> DataFrame:
    """K3: rows of ``updates`` (source, account_id, watermark_ts, updated_at)
    that move the cursor strictly forward; the history stays append-only
    (the survey's Q20) and the newest value is read with L3."""
    if history is None:
        return updates
    cur = history.groupBy("source", "account_id").agg(
        F.max_by("watermark_ts", F.struct("updated_at", "watermark_ts")).alias("current"))
    j = updates.join(cur, ["source", "account_id"], "left")
    return j.where(F.col("current").isNull() | (F.col("watermark_ts") > F.col("current"))).drop("current")


def read_cursor(history: DataFrame | None, now: dt.datetime, lookback_hours: int = 48,
                accounts: DataFrame | None = None) -> DataFrame:
    """Newest stored cursor per (source, account), else ``now − 48 h``.

    ``accounts`` (source, account_id) lists the accounts to start; one without
    a stored cursor gets the look-back.  Without the list, the history's own
    accounts are returned."""
    start = F.lit(now - dt.timedelta(hours=lookback_hours)).cast("timestamp_ntz")
    if history is None:
        return accounts.select("source", "account_id", start.alias("cursor")).distinct()
    cur = history.groupBy("source", "account_id").agg(
        F.max_by("watermark_ts", F.struct("updated_at", "watermark_ts")).alias("watermark_ts"))
    if accounts is not None:
        cur = accounts.select("source", "account_id").distinct().join(cur, ["source", "account_id"], "left")
    return cur.select("source", "account_id", F.coalesce("watermark_ts", start).alias("cursor"))


# Seeded dimensions.
MARKETPLACES = (("wb", "Wildberries"), ("ozon", "Ozon"))
DEFAULT_ACCOUNTS = (("default", "wb", "WB default"), ("default", "ozon", "Ozon default"))


def seed_dimensions(spark: SparkSession, created_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """K6: dim_marketplace and dim_account seed rows."""
    mk = spark.createDataFrame(list(MARKETPLACES), "marketplace string, title string")
    acc = spark.createDataFrame([(a, m, t, created_at) for a, m, t in DEFAULT_ACCOUNTS],
                                "account_id string, marketplace string, title string, created_at timestamp_ntz")
    return mk, acc
