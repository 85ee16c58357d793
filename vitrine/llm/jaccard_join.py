"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is the order of the shingles' 64-bit hashes.  It is cut
into fragments, and every document's set into one segment a fragment:

1. Each task hashes its documents, drops sets it has already seen and sends
   the segments, packed, to their fragments (one shuffle, 8 bytes a shingle).
2. A fragment knows all places of its shingles, so it counts them.  Shingles
   of a single set can't overlap and end here; the others go on, with their
   counts, to their documents (packed again).
3. Two sets with a Jaccard similarity of t share a shingle among the first
   n - ceil(t * n) + 1 of each, in any common order; rare shingles come first.
   A document whose unique shingles fill that prefix has no partner.
4. Sets that share a prefix shingle are compared: overlaps are counted for
   each fragment separately and summed for each pair.

Equal sets are one node.  In the first round each node is compared with the
most central node of each of its prefix shingles, in the second the pairs that
share a prefix shingle but lie in different components, if the place of the
shingle in both leaves enough to overlap: a pair inside one
component can't change it, so no group of near copies is expanded into pairs.

Defined results: a document without words has an empty set, n_shingles 0 and
is linked with nothing; fewer words than a shingle make one shingle; repeated
rows each return a row; rows with a null id belong to their component but
never name it (a component of null ids has a null id); an empty table gives
no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import bloom
from vitrine.llm.common import id_text, saved, unused
from vitrine.llm.components import components
from vitrine.llm.shingles import WORDS, Hasher

PERCENT = 75
FRAGMENT_SHINGLES = 2_000_000   # shingles that one fragment task holds
FLUSH_SHINGLES = 1_500_000      # shingles that a map task holds before it sends them
SLICES = 8                      # fragments in which pairs are counted


def node_of(shingles: np.ndarray) -> tuple[bytes, int]:
    """A set's digest, and its first 8 bytes as a signed number: its node."""
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return d, int.from_bytes(d[:8], "little", signed=True)


def document_sets(docs: DataFrame, words: int = WORDS, *more: str) -> DataFrame:
    """(doc_id, n_shingles, node) and the bigint columns ``more`` per row; the node of an empty set is null."""
    def run(batches):
        hasher = Hasher(words)
        for b in batches:
            n, node = [], []
            for _, s in hasher.sets(b.column(1).to_pylist()):
                n.append(len(s))
                node.append(node_of(s)[1] if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *b.columns[2:]],
                ["doc_id", "n_shingles", "node", *more])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *more)
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint" + "".join(f", {c} bigint" for c in more))


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of each hash: equal cuts of the order."""
    return ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def segments(docs: DataFrame, fragments: int, words: int = WORDS) -> DataFrame:
    """(frag, nodes, sizes, lens, hashes): packed segments of the distinct sets of each task."""
    def packed(held):
        nodes = np.array([x[0] for x in held], np.int64)
        sizes = np.array([len(x[1]) for x in held], np.uint32)
        flat = np.concatenate([x[1] for x in held])
        frag = fragment_of(flat, fragments).astype(np.uint32)
        order = np.argsort(frag, kind="stable")      # within a fragment by set, within a set by hash
        of = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)[order]
        flat, frag = flat[order], frag[order]
        del order
        at = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (of[1:] != of[:-1])]))  # a segment each
        lens, owner = np.diff(np.append(at, len(flat))).astype(np.uint32), of[at]
        found, first = np.unique(frag[at], return_index=True)
        rows = []
        for f, lo, hi in zip(found.tolist(), first, np.append(first[1:], len(at))):
            end = at[hi] if hi < len(at) else len(flat)
            rows.append((f, nodes[owner[lo:hi]].tobytes(), sizes[owner[lo:hi]].tobytes(), lens[lo:hi].tobytes(),
                         flat[at[lo]:end].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5)],
            ["frag", "nodes", "sizes", "lens", "hashes"])

    def run(batches):
        hasher, seen, held, size = Hasher(words), set(), [], 0
        for b in batches:
            for _, s in hasher.sets(b.column(1).to_pylist()):
                if not len(s):
                    continue
                digest, node = node_of(s)
                if digest in seen:
                    continue
                seen.add(digest)
                held.append((node, s))
                size += len(s)
                if size >= FLUSH_SHINGLES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return id_text(docs).mapInArrow(run, "frag int, nodes binary, sizes binary, lens binary, hashes binary")


def _flat(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]  # views; the values are not copied one by one
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def shared_shingles(parts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, nodes, sizes, hashes, counts): places of shingles that two or more sets hold, packed for their nodes' buckets."""
    schema = "bucket int, nodes binary, sizes binary, hashes binary, counts binary"

    def run(t: pa.Table) -> pa.Table:
        h = _flat(t.column("hashes"), np.uint64)
        order = np.argsort(h, kind="stable")
        g = h[order]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        del g
        order = order[same[1:] | same[:-1]]          # only shingles at two places or more
        h = h[order]
        of = np.searchsorted(np.cumsum(_flat(t.column("lens"), np.uint32), dtype=np.int64), order, "right")
        node, size = _flat(t.column("nodes"), np.int64)[of], _flat(t.column("sizes"), np.uint32)[of]
        del of, same
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        new = np.ones(len(h), bool)                  # the same set from two tasks counts once
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size = h[new], node[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        count = np.repeat(count, count)
        keep = count > 1
        h, node, size = h[keep], node[keep], size[keep]
        count = np.minimum(count[keep], 65535).astype(np.uint16)  # only for the order, which any function of the shingle may give
        bucket = (node.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(k, order[cut[k]:cut[k + 1]]) for k in range(buckets) if cut[k] < cut[k + 1]]
        return pa.table([
            pa.array([k for k, _ in rows], pa.int32()),
            *(pa.array([x[i].tobytes() for _, i in rows], pa.binary()) for x in (node, size, h, count))],
            names=["bucket", "nodes", "sizes", "hashes", "counts"])

    return parts.groupBy("frag").applyInArrow(run, schema)


def candidates(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, own, slice, hashes, prefix, places) of the sets that can have a partner.

    ``hashes``: the set's shared shingles of one slice of the order; ``prefix``:
    those of them within the prefix by which partners are found, and their
    ``places`` among all shingles, rare ones first; ``own``: unique shingles.
    """
    schema = ("node bigint, n bigint, own bigint, slice int, hashes array<bigint>, prefix array<bigint>, "
              "places array<bigint>")

    def run(t: pa.Table) -> pa.Table:
        node, size = _flat(t.column("nodes"), np.int64), _flat(t.column("sizes"), np.uint32).astype(np.int64)
        h, count = _flat(t.column("hashes"), np.uint64), _flat(t.column("counts"), np.uint16)
        order = np.lexsort((h, count, node))
        node, size, h = node[order], size[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        held = np.diff(np.append(first, len(node)))
        rank = np.arange(len(node)) - np.repeat(first, held)
        prefix = size - (size * percent + 99) // 100 + 1
        own = size - np.repeat(held, held)
        place = own + rank
        keep = own < prefix
        node, size, own, h, place, inside = (x[keep] for x in (node, size, own, h, place, place < prefix))
        part = (h >> np.uint64(61)).astype(np.int32)
        order = np.lexsort((h, part, node))
        node, size, own, h, place, inside, part = (x[order] for x in (node, size, own, h, place, inside, part))
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (part[1:] != part[:-1])
        at = np.append(np.flatnonzero(new), len(node)) if len(node) else np.zeros(1, np.int64)
        before = np.concatenate([[0], np.cumsum(inside)])
        values = pa.array(h.view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        ends = pa.array(before[at], pa.int32())
        pre = pa.ListArray.from_arrays(ends, pa.array(h[inside].view(np.int64)))
        places = pa.ListArray.from_arrays(ends, pa.array(place[inside]))
        at = at[:-1]
        return pa.table([pa.array(node[at]), pa.array(size[at]), pa.array(own[at]), pa.array(part[at]), lists, pre, places],
                        names=["node", "n", "own", "slice", "hashes", "prefix", "places"])

    return shared.groupBy("bucket").applyInArrow(run, schema)


def _possible(n, p, m, q, percent: int):
    """Sets of n and m shingles with a common one at places p and q can reach the threshold.

    If it is their first common one, the overlap is at most what follows it in
    either; a similar pair passes at least there.
    """
    rest = F.least(n - p, m - q)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= (n + m) * percent)


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (a, na, b, nb) those that reach the threshold, with their overlap.

    Overlaps are counted slice by slice; a slice of a pair is one row.
    """
    left = sets.select(F.col("node").alias("a"), "slice", F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), "slice", F.col("hashes").alias("y"))
    counted = pairs.join(left, "a").join(right, ["b", "slice"]) \
        .select("a", "na", "b", "nb", F.size(F.array_intersect("x", "y")).cast("bigint").alias("part"))
    return counted.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("overlap")) \
        .filter(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent)


def _leaders(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs of each node with the most central node of each of its prefix shingles.

    The most central has the smallest share of unique shingles: of the near
    copies of a text, the one least changed.
    """
    lead = prefix.groupBy("h").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("rank"), "node", "n", "place")).alias("l"),
                                   F.count("*").alias("k")).filter("k > 1")
    near = _possible(F.col("l.n"), F.col("l.place"), F.col("n"), F.col("place"), percent)
    return prefix.join(lead, "h").filter((F.col("node") != F.col("l.node")) & near) \
        .select(F.col("l.node").alias("a"), F.col("l.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()


def _labelled(prefix: DataFrame, roots: DataFrame) -> DataFrame:
    return prefix.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _across(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a prefix shingle but not a component.

    The smaller set (by size, then node) is found by a shorter prefix: with a
    partner at least as large, place p must leave n - p >= 2 * n * t / (1 + t).
    """
    mixed = labelled.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
    rows = labelled.join(mixed, "h")
    a = rows.filter((F.col("n") - F.col("place")) * (100 + percent) >= F.col("n") * (2 * percent)) \
        .select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"))
    b = rows.select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = _possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
    return a.join(b, "h").filter((F.col("ra") != F.col("rb")) & smaller & near).select("a", "na", "b", "nb").distinct()


def links(docs: DataFrame, sets: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Similar pairs (a, b) of nodes that suffice to connect every component."""
    total = sets.dropDuplicates(["node"]).agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(1, -(-int(total) // FRAGMENT_SHINGLES))
    parts = segments(docs, fragments, words).repartition(fragments, "frag")
    shared = shared_shingles(parts, fragments).repartition(fragments, "bucket")
    cand = saved(candidates(shared, percent), "jaccard-sets")
    prefix = cand.filter(F.size("prefix") > 0) \
        .select(F.explode(F.arrays_zip("prefix", "places")).alias("x"), "node", "n", "own") \
        .select(F.col("x.prefix").alias("h"), F.col("x.places").alias("place"), "node", "n", "own")
    first = saved(similar(_leaders(prefix, percent), cand, percent).select("a", "b"), "jaccard-links")
    roots = components(first)
    second = similar(_across(_labelled(prefix, roots), percent), cand, percent).select("a", "b")
    return first.union(saved(second, "jaccard-links"))


def _rooted(docs: DataFrame, percent: int, words: int, *more: str) -> DataFrame:
    """(doc_id, n_shingles, node, more, root) per row; the root of an empty set is null."""
    sets = saved(document_sets(docs, words, *more), "jaccard-documents")
    roots = components(links(docs, sets, percent, words))
    return sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) per row of ``docs`` (doc_id, text)."""
    rows = _rooted(docs, percent, words)
    names = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("name"))
    return rows.join(names, "root", "left").select(
        "doc_id", "n_shingles", "node",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component; columns as in ``docs``.

    The one with the smallest id stays (ids before nulls, then the least hash
    of its text); of rows that repeat both, the one with the least hash of the
    whole row.  Documents without words have
    no component and all stay.
    """
    key, own = unused("__text_key", docs), unused("__doc_id", docs)
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))) \
        .withColumn(own, F.col(f"`{id_col}`").cast("bigint"))
    rows = saved(_rooted(keyed.select(F.col(own).alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                                      F.col(key).alias("text_key")), percent, WORDS, "text_key"), "jaccard-rows")
    rows = rows.filter("root is not null")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("w"))
    gone = rows.join(first, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("text_key") == F.col("w.text_key")))) \
        .select(F.col("text_key").alias(key), F.col("doc_id").alias(own))
    kept = bloom.without(keyed, saved(gone.distinct(), "jaccard-gone"), key, own)
    again = saved(rows.groupBy("text_key", "doc_id").agg(F.count("*").alias("k")).filter("k > 1")
                  .select(F.col("text_key").alias(key), F.col("doc_id").alias(own)), "jaccard-again")
    if not again.isEmpty():
        k, o, place = unused("again_key", kept), unused("again_id", kept), unused("again_place", kept)
        plain = [F.col(f"`{f.name}`") for f in kept.schema if f.dataType.typeName() not in ("map", "variant")]
        order = Window.partitionBy(key, own).orderBy(F.xxhash64(*plain))
        once = kept.join(again.select(F.col(key).alias(k), F.col(own).alias(o)),
                         (F.col(key) == F.col(k)) & F.col(own).eqNullSafe(F.col(o)), "left_semi") \
            .withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
        kept = bloom.without(kept, again, key, own).union(once)
    return kept.drop(key, own)
