"""Landed JSON feeds → one record per row (VARIANT).

The reference fetches JSON pages over HTTP; here the pages are landed as
newline-delimited files (one API response per line) and read as text, so any
number of files splits across the cluster.  ``unwrap`` accepts every envelope
the channels use (S9), ``merge_schemas`` keeps one posting per number with the
later schema winning (S10).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions.values import Fields, as_text, is_object, parse_ts

# Envelope paths holding the record list, tried in this order.  A
# bare list cannot match an object path (and vice versa), so "$" goes first:
# the most common page shape needs one lookup.
ENVELOPE_PATHS = ("$", "$.result.postings", "$.result.operations", "$.result.items", "$.result", "$.data")
POSTING_KEY = ("posting_number", "postingNumber", "order_id")


def read_lines(spark: SparkSession, path: str | Sequence[str], modified_after: dt.datetime | None = None,
               modified_before: dt.datetime | None = None) -> DataFrame:
    """Landed response pages, one JSON document per line: ``line``, its ``file``
    and ``ingested_at``, the time the file landed.  Files outside (``modified_after``,
    ``modified_before``) are left out when the folder is listed, before any is opened;
    files are cut into splits, so a large one is parsed by many tasks."""
    paths = [path] if isinstance(path, str) else list(path)
    window = {"modifiedAfter": modified_after, "modifiedBefore": modified_before}
    opts = {k: v.strftime("%Y-%m-%dT%H:%M:%S") for k, v in window.items() if v is not None}
    return spark.read.options(timeZone="UTC", **opts).text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ingested_at"))


def parse_pages(lines: DataFrame, line_col: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """S9 with its rejects, each page parsed once: a row a record (``pos``, ``rec``,
    ``payload``), and a row with ``reject`` = why and ``payload`` = the text itself for
    a page that is not JSON, a page without a record list, and a list element that is
    not an object.  An empty or null line and an empty list give no row."""
    blank = F.coalesce(F.trim(F.col(line_col)), F.lit("")) == ""
    pages = lines.where(~blank).select(*keep, F.col(line_col).alias("_line"),
                                       F.try_parse_json(F.col(line_col)).alias("_doc"))
    pages = pages.select("*", envelope_records(F.col("_doc")).alias("_recs"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("rec"),
                             F.when(F.col("_doc").isNull(), "not JSON").otherwise("no records").alias("reject")))
    each = F.transform("_recs", lambda r, i: F.struct(i.alias("pos"), r.alias("rec"),
                                                      F.when(~F.coalesce(is_object(r), F.lit(False)), "not an object").alias("reject")))
    x = pages.select(*keep, "_line", F.explode(F.when(F.col("_recs").isNull(), whole).otherwise(each)).alias("_x"))
    return x.select(*keep, "_x.pos", "_x.rec", F.when(F.col("_x.pos").isNull(), F.col("_line"))
                    .otherwise(F.to_json("_x.rec")).alias("payload"), "_x.reject")


def store_pages(parsed: DataFrame, path: str) -> None:
    """Records and rejects of ``parse_pages`` by one write: a Parquet table whose
    partition ``kind`` tells them apart (records are kept as their JSON text)."""
    parsed.drop("rec").withColumn("kind", F.when(F.col("reject").isNull(), "record").otherwise("reject")) \
        .write.mode("append").partitionBy("kind").parquet(path)


def _stored(spark: SparkSession, path: str, kind: str, keep: str) -> DataFrame:
    schema = f"{keep}, pos int, payload string, reject string, kind string"  # named: a table may hold no rows yet
    return spark.read.schema(schema).parquet(path).where(F.col("kind") == kind).drop("kind")


def stored_records(spark: SparkSession, path: str, keep: str = "ingested_at timestamp_ntz") -> DataFrame:
    """The records of ``store_pages``, as the normalisers take them."""
    return _stored(spark, path, "record", keep).drop("reject").withColumn("rec", F.parse_json("payload"))


def stored_rejects(spark: SparkSession, path: str, keep: str = "ingested_at timestamp_ntz") -> DataFrame:
    """What ``store_pages`` could not take as records, and why."""
    return _stored(spark, path, "reject", keep)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column behind a generator of one row: a filter on it compares the
    computed value, where one behind a projection is pushed down as its whole expression."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def in_time(recs: DataFrame, keys: Sequence[str], since: dt.datetime | None = None,
            until: dt.datetime | None = None) -> DataFrame:
    """The request filters of the feeds: records whose time, by the first of ``keys``
    that holds one, lies in [``since``, ``until``) — changes since a cursor (S1, S2),
    one day of them, or the day range of S4 to S8.  A record without a readable time is
    kept, since no request could have left it out by its time."""
    f = Fields(prefix="_t")
    at = parse_ts(f.first(keys))
    keep = F.lit(True)
    if since is not None:
        keep = keep & (at >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        keep = keep & (at < F.lit(until).cast("timestamp_ntz"))
    return f.drop(_once(f.stage(recs), "_tkeep", F.coalesce(keep, F.lit(True))).where("_tkeep"))


def envelope_records(doc: Column) -> Column:
    """The record array of a response (bare list, ``{result: […]}``,
    ``{result: {postings|operations|items: […]}}``, ``{data: […]}``); NULL for
    anything else."""
    return F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in ENVELOPE_PATHS])


def unwrap(lines: DataFrame, line_col: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """One row per object record — ``rec`` (VARIANT), ``payload`` (its JSON
    text) and ``pos`` (position in the page); unparseable lines and non-object
    elements are dropped."""
    pages = lines.select(*keep, F.try_parse_json(F.col(line_col)).alias("_doc"))  # parsed once, not once a path
    # the list is found in a (compiled) projection; the generator only reads it, by an expression, since
    # Spark filters a plain column on its size first and pushes that down as a second parse of the page
    pages = pages.select(*keep, envelope_records(F.col("_doc")).alias("_recs"))
    x = pages.select(*keep, F.posexplode(F.when(F.col("_recs").isNotNull(), F.col("_recs"))).alias("pos", "rec"))
    return x.where(is_object(F.col("rec"))).select(*keep, "pos", "rec", F.to_json("rec").alias("payload"))


def rejects(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines that are not JSON or carry no record list (kept for inspection, Q12)."""
    doc = F.try_parse_json(F.col(line_col))
    return lines.where(doc.isNull() | envelope_records(doc).isNull())


def merge_schemas(by_schema: Sequence[tuple[str, DataFrame]], order_cols: Sequence[str] = ("pos",)) -> DataFrame:
    """Postings fetched per schema (in priority order); per posting number
    the record of the latest schema (then the latest position) wins, records
    without a number are all kept."""
    parts = None
    for rank, (name, df) in enumerate(by_schema):
        d = df.select(F.lit(rank).alias("schema_rank"), F.lit(name).alias("schema"), "*")
        parts = d if parts is None else parts.unionByName(d, allowMissingColumns=True)
    f = Fields(prefix="_k")
    key = as_text(f.first(POSTING_KEY))
    keyed = f.drop(_once(f.stage(parts), "posting_key", key))
    # one pass over the records: those without a number are spread by their order columns
    spread = F.when(F.col("posting_key").isNull(), F.xxhash64(*order_cols))
    w = Window.partitionBy("posting_key", spread).orderBy(F.col("schema_rank").desc(),
                                                          *[F.col(c).desc() for c in order_cols])
    return keyed.withColumn("_krn", F.row_number().over(w)) \
        .where((F.col("_krn") == 1) | F.col("posting_key").isNull()).drop("_krn")


# --------------------------------------------------- parameter contracts (§2.14)

# Posting schemas and the day clamps of the backfill entry points.
POSTING_SCHEMAS = ("fbs", "fbo")
DEFAULT_POSTING_SCHEMAS = "fbs,fbo"
BACKFILL_MAX_DAYS = {"sales": 90, "orders": 90, "postings": 90, "funnel": 365, "funnel_admin": 90,
                     "finance": 365, "transforms": 365, "marts": 365}


def parse_schemas(text: str | None = None) -> tuple[str, ...]:
    """``"fbs,fbo"`` → the ordered distinct valid schemas; ``("fbs",)`` when none is valid."""
    items = [x.strip().lower() for x in (DEFAULT_POSTING_SCHEMAS if text is None else text).split(",") if x.strip()]
    valid = [x for x in items if x in POSTING_SCHEMAS]
    return tuple(dict.fromkeys(valid)) or ("fbs",)


def clamp_backfill_days(kind: str, days: int) -> int:
    """Days of a backfill, clamped to 1..the feed's maximum."""
    return max(1, min(BACKFILL_MAX_DAYS[kind], int(days)))
