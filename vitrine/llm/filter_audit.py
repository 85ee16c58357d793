"""Audit of how five document filters interact, with exact duplicates found by radix tries.

Filters A to D look at a text alone, E at the whole table: a document fails E
if a smaller id holds the same text.

1. Adaptive prefixes: the range of all texts is cut where they branch.  Each
   round counts, for every prefix that is still too heavy, the bytes below each
   next byte, together with the least and greatest continuation; what these two
   share is skipped in one step, as a compressed edge is.  Light neighbours are
   joined again, so a partition holds about ``part_bytes`` or a single text.
2. Texts go to their partition once a task (with the least id the task has seen)
   and are inserted whole into a compressed trie that holds the minimum id at
   the terminals.  Traversing it gives the first holder of every text.
3. A document's flag is whether it is the first holder; its five flags are one
   mask.  Masks are counted per part, 32 cells at most, and every order's rows
   follow from the cells: no text is read again for the 120 orders.

The driver holds one boundary a partition and 256 counts a heavy prefix.

Defined results: null text is empty; null lang is the part ''; a null id is
never a duplicate and never makes one; repeated rows (equal id and text) count
as often as they stand and are no duplicates of each other; of several label
rows of one id any 1 counts; ties don't arise, ids are compared as numbers; a
text of any length is inserted whole; an empty table gives no rows; columns
beside id, text and lang (labels: id, quality, toxic) are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import saved

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
NODE_BYTES = 500           # what a text costs in a trie beside its bytes
WINDOW = 64                # bytes beyond a prefix that a round looks at first
FLUSH_BYTES = 32 << 20     # texts that a map task holds before it sends them


def text_mask(data: bytes, code_points: int) -> int:
    """Flags A to D of a text."""
    words = data.split()   # of bytes: at exactly \\x20 and \\x09-\\x0D
    mask = BIT["A"] if len(words) < MIN_WORDS else 0
    if 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words):
        mask |= BIT["B"]
    if 100 * (len(data) - len(data.translate(None, UPPER))) > MAX_UPPER_PERCENT * code_points:
        mask |= BIT["C"]
    if len(data.translate(None, SIGNS)) < len(data):
        mask |= BIT["D"]
    return mask


def text_masks(rows: DataFrame) -> DataFrame:
    """(doc_id, part, key, mask) of rows (doc_id, part, key, text)."""
    def run(batches):
        for b in batches:
            texts = b.column(3)
            points = pc.utf8_length(texts).to_pylist()
            masks = [text_mask(t, n) for t, n in zip(texts.cast(pa.binary()).to_pylist(), points)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(masks, pa.int32())], ["doc_id", "part", "key", "mask"])

    return rows.select("doc_id", "part", "key", "text").mapInArrow(run, "doc_id bigint, part string, key bigint, mask int")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n          # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def prefix_weights(rows: DataFrame, heads: list[bytes], window: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """(head, next byte or -1, weight, least, greatest continuation) below each of the ``heads`` (sorted, none a prefix of another)."""
    reach = max(map(len, heads)) + 1 + window

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for t, size in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                i = bisect.bisect_right(heads, t) - 1
                if i < 0 or not t.startswith(heads[i]):
                    continue
                at = len(heads[i])
                key = (i, t[at] if at < len(t) else -1)
                rest = t[at + 1:at + 1 + window]
                x = held.get(key)
                if x is None:
                    held[key] = [size, rest, rest]
                else:
                    x[0] += size
                    if rest < x[1]:
                        x[1] = rest
                    elif rest > x[2]:
                        x[2] = rest
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()),
                 pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.binary()),
                 pa.array([x[2] for x in held.values()], pa.binary())], ["head", "next", "size", "lo", "hi"])

    found = rows.select(F.substring("text", 1, reach).alias("text"), (F.octet_length("text") + NODE_BYTES).cast("bigint").alias("size")) \
        .mapInArrow(run, "head int, next int, size bigint, lo binary, hi binary") \
        .groupBy("head", "next").agg(F.sum("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return sorted((r.head, r.next, r.size, bytes(r.lo), bytes(r.hi)) for r in found.collect())


def boundaries(rows: DataFrame, part_bytes: int) -> list[bytes]:
    """First prefixes of the partitions, in order; each holds about ``part_bytes`` or is a single text."""
    leaves, heavy, window = [], [b""], WINDOW
    while heavy:
        again, alike = [], False
        for head, nxt, size, lo, hi in prefix_weights(rows, heavy, window):
            prefix = heavy[head] + (bytes([nxt]) if nxt >= 0 else b"")
            n = common(lo, hi)
            if nxt < 0 or size <= part_bytes or (lo == hi and len(lo) < window):
                leaves.append((prefix, size))
            else:
                again.append(prefix + lo[:n])
                alike |= n == window
        heavy, window = sorted(again), window * 4 if alike else WINDOW   # a long common stretch is passed in ever larger steps
    bounds, room = [], 0
    for prefix, size in sorted(leaves):
        if not bounds or size > room:
            bounds.append(prefix)
            room = part_bytes
        room -= size
    return bounds


class RadixTrie:
    """A compressed trie over byte strings; terminals hold the minimum id."""

    def __init__(self):
        self.root = [b"", {}, None, None]          # label, children by first byte, least id, key

    def insert(self, text: bytes, low, key) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, low, (key,)]
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = common(label, text[at:at + len(label)])
            fork = [label[:n], {label[n]: child}, None, None]
            child[0] = label[n:]
            node[1][text[at]] = fork
            node, at = fork, at + n
        if node[3] is None:
            node[2], node[3] = low, (key,)
        elif low is not None and (node[2] is None or low < node[2]):
            node[2] = low

    def terminals(self):
        """(key, least id) of every text held."""
        open_ = [self.root]
        while open_:
            _, children, low, key = open_.pop()
            if key is not None:
                yield key[0], low
            open_.extend(children.values())


def first_holders(rows: DataFrame, part_bytes: int) -> DataFrame:
    """(key, low) for each distinct text of rows (doc_id, key, text): the least id that holds it."""
    bounds = boundaries(rows, part_bytes)
    parts = max(1, len(bounds))

    def send(batches):
        held, size = {}, 0

        def packed():
            texts = list(held)
            where = [max(0, bisect.bisect_right(bounds, t) - 1) for t in texts]
            for i in range(0, len(texts), 1024):
                t = texts[i:i + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[i:i + 1024], pa.int32()), pa.array(t, pa.large_binary()).cast(pa.binary()),
                     pa.array([held[x][0] for x in t], pa.int64()), pa.array([held[x][1] for x in t], pa.int64())],
                    ["trie", "text", "low", "key"])

        for b in batches:
            for doc_id, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                x = held.get(t)
                if x is None:
                    held[t] = [doc_id, key]
                    size += len(t)
                elif doc_id is not None and (x[0] is None or doc_id < x[0]):
                    x[0] = doc_id
            if size >= FLUSH_BYTES:
                yield from packed()
                held, size = {}, 0
        if held:
            yield from packed()

    def grow(batches):
        tries: dict[int, RadixTrie] = {}
        for b in batches:
            for part, t, low, key in zip(*(c.to_pylist() for c in b.columns)):
                tries.setdefault(part, RadixTrie()).insert(t, low, key)
        for trie in tries.values():
            found = trie.terminals()
            while some := list(itertools.islice(found, 8192)):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()),
                                                  pa.array([x for _, x in some], pa.int64())], ["key", "low"])

    sent = rows.select("doc_id", "key", "text").mapInArrow(send, "trie int, text binary, low bigint, key bigint")
    return sent.repartition(parts, "trie").mapInArrow(grow, "key bigint, low bigint").filter("low is not null")


def masks(docs: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """(doc_id, part, mask, copies): equal rows of a document's five flags, counted together."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    if part_bytes is None:
        size = rows.agg(F.sum((F.octet_length("text") + NODE_BYTES).cast("bigint"))).first()[0] or 0
        part_bytes = max(8 << 20, min(128 << 20, size // 200))
    slim = text_masks(rows).groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("copies"))
    first = first_holders(rows, part_bytes).select(F.col("low").alias("doc_id"), "key", F.lit(True).alias("first")).distinct()
    joined = slim.join(first, ["doc_id", "key"], "left")
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", (F.col("mask") + F.when(repeated, BIT["E"]).otherwise(0)).alias("mask"), "copies")


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): an array of (mask, n, good, toxic), 32 at most a part."""
    def any_one(name):
        return F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)

    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic") \
        .groupBy("doc_id").agg(any_one("quality"), any_one("toxic"))

    def total(name):
        return F.sum(F.col("copies") * F.coalesce(F.col(name), F.lit(0))).cast("bigint").alias(name)

    counted = masked.join(known, "doc_id", "left").groupBy("part", "mask") \
        .agg(F.sum("copies").cast("bigint").alias("n"), total("quality"), total("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", F.col("quality").alias("good"), "toxic")).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(order), step, before, BIT[f]))
            before |= BIT[f]
    schema = "array<struct<filter_order:string,step:int,before:int,bit:int>>"
    table = F.from_json(F.lit("[" + ",".join(
        '{"filter_order":"%s","step":%d,"before":%d,"bit":%d}' % s for s in steps) + "]"), schema)
    rows = cells(saved(masks(docs, part_bytes), "audit-masks"), labels) \
        .select("part", "cells", F.explode(table).alias("s")).select("part", "cells", "s.*")

    def total(value, when):
        return F.aggregate(F.filter("cells", when), F.lit(0).cast("bigint"), lambda s, c: s + value(c))

    def has(c, mask):
        return c["mask"].bitwiseAND(F.col(mask)) != 0

    def removed(c):
        return has(c, "bit") & ~has(c, "before")

    def number(c):
        return c["n"]

    # A document that fails k filters is removed by each of them in 120 / k orders.
    share = F.array(*[F.lit(math.factorial(len(FILTERS)) // k).cast("bigint") for k in range(1, len(FILTERS) + 1)])
    return rows.select(
        "part", "filter_order", "step",
        total(number, lambda c: ~has(c, "before") & ~has(c, "bit")).alias("kept"),
        total(number, removed).alias("removed"),
        total(number, lambda c: has(c, "bit") & has(c, "before")).alias("redundant"),
        total(number, lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * F.element_at(share, F.bit_count(c["mask"])), lambda c: has(c, "bit")).alias("shapley"))
