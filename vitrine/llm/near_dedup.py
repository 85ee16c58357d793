"""Near duplicates by fast similarity sketching, banding and exact verification.

1. A set's sketch has ``SIZE`` coordinates, filled in rounds: in round i < SIZE
   every shingle is placed into a hashed bin with the value (i, hash), in round
   SIZE + j every shingle goes to bin j; a bin keeps its least value.  So every
   coordinate is filled after 2 * SIZE rounds at the latest, most sets need
   about SIZE / n * ln(SIZE) of them, and two sets agree in a coordinate with
   the chance of their Jaccard similarity, concentrated as for independent
   coordinates.  A set of n shingles costs n * rounds, not n * SIZE.
2. The sketch is cut into ``BANDS`` bands.  A pair at the threshold (0.85)
   shares none of them with a chance of (1 - 0.85**5)**40, below 1e-10.
3. Sets that share a bucket (an equal band) with another are fetched whole.
   Shingles that only one of them holds are in no overlap, so their number
   bounds every similarity of the set; sets and pairs below are done with.
4. In each bucket the set with the smallest share of such shingles leads.
   Every set is compared with the most central of its leaders, exactly, on the
   full sets.  In the second pass the pairs that share a bucket but not a
   component are compared likewise, so a group of near copies is not expanded
   into all its pairs, and no pair of a bucket that can be similar is left out.

Equal sets are one node, named by 126 bits of their digest.  Buckets are read
in sorted order, one row after the other; no bucket is held in memory.  What
may grow with the square of a group is only this: sets of different components
that share a band and whose bound, but not whose similarity, reaches the
threshold, are compared pair by pair.

Defined results: a document without words has an empty set, n_shingles 0, is
linked with nothing and kept; fewer words than a shingle make one shingle;
repeated rows each return a row; rows with a null id belong to their component
but never name it (a component of null ids has a null id and all of it is
kept); ties between equal texts fall to the smallest id; a long text is hashed
as a whole; an empty table gives no rows; columns beside id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import bloom
from vitrine.llm.common import id_text, saved
from vitrine.llm.components import components
from vitrine.llm.shingles import WORDS, Hasher

PERCENT = 85
BANDS, ROWS = 40, 5
SIZE = BANDS * ROWS
BATCH_SHINGLES = 200_000   # shingles of the sets that are sketched together
LOW = np.uint64(0xFFFFFFFF)
NODE = "decimal(38,0)"


class Sketcher:
    """Sketches of many sets at once."""

    def __init__(self, size: int = SIZE, bands: int = BANDS):
        self.size, self.bands = size, bands
        draw = np.random.default_rng(20240213)
        self.salt = draw.integers(1, 2**63, 2 * size, dtype=np.uint64)
        self.weight = draw.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = Hasher(1).mix

    def sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of ``size`` coordinates for each (non-empty) set."""
        size, empty = self.size, np.uint64(2**64 - 1)
        out = np.full(len(sets) * size, empty)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        with np.errstate(over="ignore"):
            for i in range(2 * size):
                x = self.mix(flat ^ self.salt[i])
                place = ((x & LOW) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else i - size
                np.minimum.at(out, doc * size + place, np.uint64(i << 54) | (x >> np.uint64(10)))
                open_ = (out.reshape(-1, size) == empty).any(axis=1)
                if not open_.any():
                    break
                keep = open_[doc]
                flat, doc = flat[keep], doc[keep]
        return out.reshape(-1, size)

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of each sketch; the band's number is part of it."""
        with np.errstate(over="ignore"):
            cells = (sketches * self.weight).reshape(len(sketches), self.bands, -1)
            return self.mix(cells.sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def nodes(digests: list[bytes | None]) -> pa.Array:
    """Digests, less two bits, as decimal numbers."""
    raw = np.frombuffer(b"".join(d or bytes(16) for d in digests), np.uint64).reshape(-1, 2).copy()
    raw[:, 1] &= np.uint64(2**62 - 1)
    held = np.array([d is not None for d in digests], bool)
    valid = pa.py_buffer(np.packbits(held, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(38), len(digests), [valid, pa.py_buffer(raw.tobytes())])


def halves(column: pa.Array) -> np.ndarray:
    """(rows, 2) words of a decimal column, the low one first."""
    raw = np.frombuffer(column.buffers()[1], np.uint64).reshape(-1, 2)
    return raw[column.offset:column.offset + len(column)]


def low_word(column: str):
    """The low word of a decimal column, signed."""
    @F.arrow_udf("bigint")
    def f(values: pa.Array) -> pa.Array:
        return pa.array(halves(values)[:, 0].view(np.int64) if len(values) else np.zeros(0, np.int64))
    return f(column)


def document_sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, bands) per row.

    ``bands`` is null for an empty set and for a set that the task has met
    before; the node of an empty set is null.
    """
    def run(batches):
        hasher, sketcher, seen = Hasher(words), Sketcher(), set()

        def rows(ids, sets, digests, new):
            keys = sketcher.keys(sketcher.sketches([sets[i] for i in new]))
            at, count = np.zeros(len(sets) + 1, np.int32), np.zeros(len(sets), np.int32)
            count[new] = BANDS
            np.cumsum(count, out=at[1:])
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)),
                                             mask=pa.array(count == 0))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), nodes(digests), bands],
                ["doc_id", "n_shingles", "node", "bands"])

        for b in batches:
            sets, digests, new, size, first = [], [], [], 0, 0
            for i, s in hasher.sets(b.column(1).to_pylist()):
                d = digest(s) if len(s) else None
                if d is not None and d not in seen:
                    seen.add(d)
                    new.append(len(sets))
                    size += len(s)
                sets.append(s)
                digests.append(d)
                if size >= BATCH_SHINGLES:
                    yield rows(b.column(0)[first:i + 1], sets, digests, new)
                    sets, digests, new, size, first = [], [], [], 0, i + 1
            if sets:
                yield rows(b.column(0)[first:], sets, digests, new)

    return id_text(docs).mapInArrow(run, f"doc_id bigint, n_shingles bigint, node {NODE}, bands array<bigint>")


def bucket_members(sketched: DataFrame) -> DataFrame:
    """(band, node, n, lead, lead_n): the sets of each bucket but the first, with the first."""
    def run(batches):
        last = None                         # the bucket that goes on: its key, first row and latest row
        for b in batches:
            if not len(b):
                continue
            key, node, n = b.column(0).to_numpy(), halves(b.column(1)), b.column(2).to_numpy()
            if last is not None:            # its first row and its latest row stand before the batch
                key = np.concatenate([[last[0]] * 2, key])
                node = np.concatenate([last[1], node])
                n = np.concatenate([last[2], n])
            begin = np.ones(len(key), bool)
            begin[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(begin)[np.cumsum(begin) - 1]
            again = np.zeros(len(key), bool)            # the same set from another task
            again[1:] = ~begin[1:] & (node[1:] == node[:-1]).all(axis=1)
            out = ~begin & ~again
            out[:0 if last is None else 2] = False      # sent before
            i = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i]), decimals(node[i]), pa.array(n[i]), decimals(node[start[i]]), pa.array(n[start[i]])],
                ["band", "node", "n", "lead", "lead_n"])
            s = start[-1]
            last = (key[-1], node[[s, -1]], n[[s, -1]])

    rows = sketched.filter("bands is not null").select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"))
    return rows.repartition("band").sortWithinPartitions("band", "node") \
        .mapInArrow(run, f"band bigint, node {NODE}, n bigint, lead {NODE}, lead_n bigint")


def decimals(words: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(words, np.uint64)
    return pa.Array.from_buffers(pa.decimal128(38), len(raw), [None, pa.py_buffer(raw.tobytes())])


def full_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes, and of few others, once each."""
    bits = 1 << min(27, max(20, int(wanted.count() * 16).bit_length()))   # 16 MB at most; a fuller filter lets more sets through
    found = bloom.build(wanted.select(low_word("node").alias("v")), "v", bits)

    def run(batches):
        hasher, seen = Hasher(words), set()
        for b in batches:
            held = []
            for _, s in hasher.sets(b.column(0).to_pylist()):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                held.append((d, s))
            if held:
                hit = bloom.hits(found, np.array([int.from_bytes(d[:8], "little") for d, _ in held], np.uint64))
                held = [x for x, yes in zip(held, hit) if yes]
            for i in range(0, len(held), 256):
                part = held[i:i + 256]
                at = np.cumsum([0] + [len(s) for _, s in part])
                flat = np.concatenate([s for _, s in part]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [nodes([d for d, _ in part]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                    ["node", "shingles"])

    rows = id_text(docs).select("text").mapInArrow(run, f"node {NODE}, shingles array<bigint>")
    return rows.groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets reach the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b") \
        .select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), both.alias("k")) \
        .filter("100L * k >= %dL * (na + nb - k)" % percent).select("a", "b")


def unique_counts(sets: DataFrame) -> DataFrame:
    """(node, n, u): the set's size and how many of its shingles no other set of the table holds."""
    held = sets.select(F.explode("shingles").alias("s"), "node").groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node"))
    alone = held.filter("k = 1").groupBy("node").agg(F.count("*").alias("u"))
    return sets.select("node", F.size("shingles").cast("bigint").alias("n")).join(alone, "node", "left") \
        .select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))


def _possible(n, u, m, v, percent: int):
    """Sets of n and m shingles, u and v of them their own, can reach the threshold: shingles of one set alone are in no overlap."""
    most = F.least(n - u, m - v)
    return most * (100 + percent) >= (n + m) * percent


def links(docs: DataFrame, sketched: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Similar pairs (a, b) of nodes that suffice to connect every component."""
    members = saved(bucket_members(sketched), "sketch-buckets")
    rows = members.select("band", "node").union(members.select("band", F.col("lead").alias("node")).distinct())
    sets = saved(full_sets(docs, rows.select("node").distinct(), words), "sketch-sets")
    able = unique_counts(sets).filter(F.col("n") * percent <= (F.col("n") - F.col("u")) * 100)
    rows = saved(rows.join(saved(able, "sketch-able"), "node"), "sketch-rows")

    # First pass: the most central set (the smallest share of shingles of its own) leads its bucket.
    rank = (F.col("u") / F.col("n")).alias("rank")
    lead = rows.groupBy("band").agg(F.min(F.struct(rank, "node", "n", "u")).alias("l"), F.count("*").alias("k")).filter("k > 1")
    near = _possible(F.col("l.n"), F.col("l.u"), F.col("n"), F.col("u"), percent)
    first = saved(rows.join(lead, "band").filter((F.col("node") != F.col("l.node")) & near)
                  .groupBy(F.col("node").alias("b")).agg(F.min(F.struct("l.rank", "l.node")).alias("l"))
                  .select(F.col("l.node").alias("a"), "b"), "sketch-pairs")
    found = saved(confirmed(first, sets, percent), "sketch-links")

    # Second pass: what shares a bucket but not a component.
    roots = saved(components(found), "sketch-roots")
    labelled = saved(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "sketch-rows")
    mixed = saved(labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                  .filter("lo <> hi").select("band"), "sketch-mixed")
    # A pair is made once, in the least of its common buckets.
    cards = labelled.groupBy("node").agg(F.collect_list("band").alias("all"))
    rest = labelled.join(mixed, "band").join(saved(cards, "sketch-cards"), "node")
    a, b = (rest.select("band", F.col("node").alias(x), *[F.col(c).alias(c + x) for c in ("n", "u", "root", "all")]) for x in "ab")
    pairs = a.join(b, "band").filter((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb"))
                                     & _possible(F.col("na"), F.col("ua"), F.col("nb"), F.col("ub"), percent)
                                     & (F.array_min(F.array_intersect("alla", "allb")) == F.col("band"))).select("a", "b")
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "sketch-pairs")
    return found.union(saved(confirmed(pairs, sets, percent), "sketch-links"))


def dedup(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text)."""
    sketched = saved(document_sketches(docs, words), "sketch-documents")
    rows = sketched.select("doc_id", "n_shingles", "node")
    roots = saved(components(links(docs, sketched, percent, words)), "sketch-roots")
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    least = saved(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "sketch-nodes")
    names = saved(least.groupBy("root").agg(F.min("own").alias("name")), "sketch-names")
    # Only sets with a copy or a link need a look-up: tables, so that a hot set or component is split by AQE.
    named = saved(least.join(names, "root").filter("copies > 1 or node <> root or not own <=> name")
                  .select("node", "name"), "sketch-names")
    out = rows.join(named.withColumn("found", F.lit(True)), "node", "left") \
        .withColumn("component_id", F.when(F.col("found"), F.col("name")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
