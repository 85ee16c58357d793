"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of every contract are runs without these characters.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a scratch folder is made, but only in a
    single process (``local[...]``); on a cluster that is an error, since each
    machine would write to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    d = "file://" + tempfile.mkdtemp(prefix="vitrine-shared-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls return the same."""
    return os.path.join(shared_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again.

    It cuts the lineage: a lost executor makes later jobs reread files, not
    recompute.  The schema is passed on, so an empty table reads back too.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id bigint, text string), so other columns can't clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once for the row.

    Inside lambdas the optimiser may repeat an inlined expression for each
    element; a lambda variable is never repeated.
    """
    return F.transform(F.array(value), body)[0]


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
