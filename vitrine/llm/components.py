"""Connected components of an edge table by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component.

    ``edges`` has columns a, b (any order).  Nodes without an edge don't
    appear.  Every round is two group-by-minimum steps with a join back; hubs
    combine in the map tasks.  The rounds' edges are written to the shared
    folder; only a count and a checksum reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = saved(e, "edges")
    before = None
    while True:
        # large star: neighbours above a node hang on the smallest node around it
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours hang on the smallest of them
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = saved(small.filter("u <> v").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
