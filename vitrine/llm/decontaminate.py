"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are the queries, documents the indexed domain (an LSH ensemble).
A document's shingles, in order, are cut into overlapping windows, so that a
short item is not lost in a long document: an item of up to STRIDE shingles
lies whole in one window, of a longer one each window holds a full share.
Windows fall into size partitions.  For a partition whose windows hold up to u
shingles, containment t of an item of q shingles means a Jaccard similarity of
at least s = t*q / (u + q - t*q), so ceil(ln(MISS) / ln(1 - s)) one-row bands
find it but for a chance of MISS.  Every window is looked up with the bands of
its partition, every item carries the bands of the largest.

A filter of fixed size (``bloom``) of the items' band values
reaches all tasks; windows that hit it bring their document's set along, and
the candidates, joined on the band value, are verified by exact containment of
the item's shingle set in the document's.

Words: runs of characters other than ASCII punctuation, space and control
characters, in lower case.  Defined results: texts with fewer than five words
are a single shingle (so such an item matches only a document that consists of
it); null or empty texts and items match nothing; repeated rows give the same
pair once; rows with a null id are found under a null id; empty tables give no
pairs; columns beside id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import bloom
from vitrine.llm.common import saved, unused
from vitrine.llm.shingles import WORDS, Hasher

CONTAINMENT = 0.75
MISS = 1e-6
MOST = 0.5
STRIDE = 32
TOGETHER = 100_000                    # shingles whose bands are computed together
WINDOW = 2 * STRIDE
PARTITIONS = (4, 8, 16, 32, WINDOW)   # upper sizes of the windows of a partition


class WordHasher(Hasher):
    """Shingles over words without punctuation, in lower case."""

    def __init__(self, words: int = WORDS):
        super().__init__(words)
        self.white = np.ones(256, bool)
        self.white[128:] = False
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            self.white[lo:hi] = False

    def ordered(self, texts):
        """(row, shingle hashes in order) of each text."""
        with np.errstate(over="ignore"):
            for i, h in self.runs([t and t.lower() for t in texts]):
                yield i, self.windows(h) if len(h) >= self.words else self.whole(h) if len(h) else h


def bands(q: int, u: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Hash functions by which an item of q shingles is found in windows of up to u; falls with q, grows with u.

    An item longer than a window is met by several windows, each with a share
    of it, so no similarity above MOST is counted on.
    """
    s = min(MOST, containment * q / (u + q - containment * q))
    return math.ceil(math.log(miss) / math.log(1 - s))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _low(h: np.ndarray, at: np.ndarray, factor: np.uint64) -> np.ndarray:
    """The least of the permuted hashes of each stretch that begins at ``at``."""
    return np.minimum.reduceat(h * factor, at)


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, shingles) of the items that have a word."""
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            rows = [(i, np.unique(h).view(np.int64)) for i, h in hasher.ordered(b.column(1).to_pylist()) if len(h)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                 pa.array([h for _, h in rows], pa.list_(pa.int64()))], ["item_id", "shingles"])

    return items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "item_id bigint, shingles array<bigint>")


def item_bands(sets: DataFrame, smallest: int) -> DataFrame:
    """(item_id, band, value): the values under which an item is looked up.

    An item has the bands of the largest partition for its own size.
    """
    def run(batches):
        factors = _factors(bands(smallest, WINDOW))
        for b in batches:
            ids, band, value = [], [], []
            for item, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.array(s, np.int64).view(np.uint64)
                for k in range(bands(len(h), WINDOW)):
                    ids.append(item)
                    band.append(k)
                    value.append(int(_low(h, np.zeros(1, np.int64), factors[k]).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(band, pa.int32()),
                                              pa.array(value, pa.int64())], ["item_id", "band", "value"])

    return sets.mapInArrow(run, "item_id bigint, band int, value bigint")


def _suspects(docs: DataFrame, filter_: np.ndarray, smallest: int) -> DataFrame:
    """(doc_id, text_key, hits, shingles) of the documents with a window that hits the filter."""
    schema = "doc_id bigint, text_key bigint, hits array<struct<band:int,value:bigint>>, shingles array<bigint>"
    hit_type = pa.list_(pa.struct([("band", pa.int32()), ("value", pa.int64())]))

    def look(sets, counts, factors):
        """For each of several documents, its band values that hit the filter."""
        h = np.concatenate(sets)
        sizes = np.array([len(x) for x in sets])
        blocks = -(-sizes // STRIDE)
        doc = np.repeat(np.arange(len(sets)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * STRIDE
        # a window is a block with the next; a document's last block is one only if it is its first
        whole = np.flatnonzero((nth + 1 < blocks[doc]) | (nth == 0))
        alone = blocks[doc[whole]] == 1
        after = np.where(alone, whole, whole + 1)
        held = np.minimum(sizes[doc[whole]] - nth[whole] * STRIDE, WINDOW)
        need = np.array(counts)[np.searchsorted(PARTITIONS, held)]
        found = [set() for _ in sets]
        for k in range(int(need.max())):
            low = _low(h, at, factors[k])
            use = np.flatnonzero(need > k)
            v = np.minimum(low[whole[use]], low[after[use]])
            for i in np.flatnonzero(bloom.hits(filter_, v)):
                found[doc[whole[use[i]]]].add((k, int(v[i].view(np.int64))))
        return found

    def run(batches):
        hasher = WordHasher()
        counts = [bands(smallest, u) for u in PARTITIONS]
        factors = _factors(max(counts))
        for b in batches:
            rows, hits, sets, some, size = [], [], [], [], 0

            def flush():
                for (i, h), found in zip(some, look([h for _, h in some], counts, factors) if some else ()):
                    if found:
                        rows.append(i)
                        hits.append([{"band": k, "value": v} for k, v in sorted(found)])
                        sets.append(np.unique(h).view(np.int64))

            with np.errstate(over="ignore"):
                for i, h in hasher.ordered(b.column(1).to_pylist()):
                    if len(h):
                        some.append((i, h))
                        size += len(h)
                    if size >= TOGETHER:
                        flush()
                        some, size = [], 0
                flush()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(hits, hit_type),
                                              pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "text_key", "hits", "shingles"])

    return docs.mapInArrow(run, schema)


def text_key(text: str = "text"):
    """The key under which a text's findings are returned."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared) of the items contained in documents, each pair once."""
    sets = saved(item_sets(items), "leak-items")
    smallest = sets.agg(F.min(F.size("shingles"))).first()[0] or 1
    values = saved(item_bands(sets, smallest), "leak-bands")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         text_key(text_col).alias("text_key"))
    found = saved(_suspects(source, bloom.build(values, "value"), smallest), "leak-suspects")
    pairs = found.select("text_key", F.explode("hits").alias("hit")) \
        .select("text_key", F.col("hit.band").alias("band"), F.col("hit.value").alias("value")).distinct() \
        .join(values, ["band", "value"]).select("text_key", "item_id").distinct()
    texts = found.select("text_key", "shingles").dropDuplicates(["text_key"])
    shared = pairs.join(texts, "text_key").join(sets.select("item_id", F.col("shingles").alias("asked")), "item_id") \
        .select("text_key", "item_id", F.size("asked").cast("bigint").alias("n_item"),
                F.size(F.array_intersect("shingles", "asked")).cast("bigint").alias("n_shared")) \
        .filter(F.col("n_shared") >= F.lit(containment) * F.col("n_item"))
    return found.select("doc_id", "text_key").distinct().join(shared, "text_key") \
        .select("doc_id", "text_key", "item_id", "n_item", "n_shared").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that contain no item; columns as in ``docs``."""
    key = unused("__text_key", docs)
    found = leaks(docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), items)
    keyed = docs.withColumn(key, text_key(f"`{text_col}`"))
    return bloom.without(keyed, found.select(F.col("text_key").alias(key)), key).drop(key)
