"""Prefix trie of rebuilt conversations by truncation peeling.

A conversation c is rebuilt from the first h turns of its source, c less c % 5,
and its own turns after its first h.  Nodes of the trie are the distinct
sequences of first turns; they are found from the bottom up:

1. Turns are numbered and hashed; a sequence's key is the 128-bit exclusive or
   of its turns' hashes, each mixed with its place, so keys of all prefixes are
   running aggregates, taken in blocks of turns.
2. Conversations that end in the same sequence become one leaf candidate.
   Turns beyond the deepest one that a different conversation shares are private:
   stripping them merges with nothing, so they are peeled in place.
3. From the deepest shared depth on, level by level: conversations that newly
   end (or leave their private tail) at the depth are merged with the nodes
   that survive from the level below, one row per node leaves, its last turn is
   stripped and its parent is grouped in the next round.  Counts, least member,
   leaves and saved bytes are summed on the way, so nodes are discovered and
   aggregated in one pass.

A round's rows are combined in the map tasks first: a first turn that all
conversations share is one row a task.  Rounds follow the longest prefix that two
different conversations share, not the longest conversation; a path is held in
rows of its shared part only.  A level is one small table in the shared folder.

Defined results: turns are ordered by turn (null first), ties by role, then
text; null role or text is empty; repeated rows are turns of their own; c % 5
keeps the sign of c; a source that is absent gives no turns; rows with a null
id are one conversation with h = 0 and no source, which counts as a member, is
the least one only when alone, and isn't listed among the ends; a conversation
left without turns is a member of the root; an empty table gives no nodes;
columns beside id, turn, role and text are not read.  Long texts are hashed
whole.  Different sequences share a key with a chance of about 2**-120.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import saved

FAMILY = 5          # conversations that share a source
MOST_SHARED = 9     # h is below this
BLOCK = 512         # turns whose running keys are taken together
CHUNK_IDS = 4096    # ids that are joined into one chunk


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, x, y, bytes): place from 1 by turn, role and text; x, y hash role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # Cut by range, so a conversation of any length is spread; the cut is kept with the rows.
    slim = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(7), "text", F.lit("\n"), "role").alias("y"),
        F.octet_length("text").cast("bigint").alias("bytes")), "trie-turns")
    sizes = slim.groupBy("conv_id", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    # ``at`` counts rows of a partition in their order, so a place is a difference.
    return slim.join(base, slim["conv_id"].eqNullSafe(base["c"]) & (slim["part"] == base["p"])) \
        .select("conv_id", (F.col("base") + F.col("at") - F.col("first") + 1).alias("place"), "x", "y", "bytes")


def kept_turns(conv_id):
    """h, and the source, of a conversation."""
    h = F.coalesce(F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % MOST_SHARED, F.lit(0))
    return h, conv_id - conv_id % FAMILY


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, bytes) of the rebuilt conversations."""
    h, source = kept_turns(F.col("conv_id"))
    heads = turns.filter((F.col("place") < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)) \
        .select(F.col("conv_id").alias("source"), F.col("place").alias("depth"), "x", "y", "bytes")
    taken = convs.filter("conv_id is not null").select("conv_id", h.alias("h"), source.alias("source")) \
        .join(heads, "source").filter("depth <= h").select("conv_id", "depth", "x", "y", "bytes")
    # A source with fewer turns than h gives all: later turns move up.
    given = saved(heads.groupBy("source").agg(F.count("*").alias("n")), "trie-heads")
    own = turns.withColumn("h", h).filter("place > h").withColumn("source", source)
    own = own.join(given, "source", "left") \
        .select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("depth"), "x", "y", "bytes")
    return taken.union(own)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, kx, ky): keys of each conversation's first ``depth`` turns."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    rows = turns.select("conv_id", "depth", "bytes", block.alias("block"), F.xxhash64("depth", "x", "y").alias("x"),
                        F.xxhash64(F.lit(11), "y", "depth", "x").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")) \
        .select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                *[F.coalesce(F.bit_xor(k).over(before), F.lit(0)).alias(f"b{k}") for k in "xy"])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "depth", "bytes", "block", *[F.bit_xor(k).over(inside).alias(k) for k in "xy"])
    return rows.join(base, rows["conv_id"].eqNullSafe(base["c"]) & (rows["block"] == base["b"])) \
        .select("conv_id", "depth", "bytes", *[F.col(k).bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in "xy"])


def ends_digests(ended: DataFrame) -> DataFrame:
    """(kx, ky, depth, ends_sha256) of rows (kx, ky, depth, conv_id): ids ascending, comma-joined.

    Ids are sorted by range, so those of a hot sequence are joined into chunks
    by many tasks; one task reads only a sequence's chunks, one after the other.
    """
    key = ["depth", "kx", "ky"]

    def chunks(batches):
        for b in batches:
            for i in range(0, len(b), CHUNK_IDS):
                part = b.slice(i, CHUNK_IDS).to_pydict()
                rows, last = [], None
                for d, x, y, c in zip(part["depth"], part["kx"], part["ky"], part["conv_id"]):
                    if (d, x, y) != last:
                        rows.append((d, x, y, c, []))
                        last = (d, x, y)
                    rows[-1][4].append(str(c))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([",".join(r[4]) for r in rows])],
                    [*key, "first", "ids"])

    def digests(batches):
        last, sha = None, None
        for b in batches:
            out = []
            for d, x, y, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (d, x, y) != last:
                    if last is not None:
                        out.append((*last, sha.hexdigest()))
                    last, sha = (d, x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield batch(out)
        if last is not None:
            yield batch([(*last, sha.hexdigest())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                                          + [pa.array([r[3] for r in rows], pa.string())], [*key, "ends_sha256"])

    rows = ended.filter("conv_id is not null").select(*key, "conv_id")
    packed = rows.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id") \
        .mapInArrow(chunks, "depth bigint, kx bigint, ky bigint, first bigint, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "first") \
        .mapInArrow(digests, "depth bigint, kx bigint, ky bigint, ends_sha256 string")


NODE = ["depth", "kx", "ky", "px", "py", "bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]


def _summed():
    """How rows of one node merge; equal sequences have equal parents and bytes."""
    return [*[F.min(c).alias(c) for c in ("px", "py", "bytes", "conv_id")],
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]]


def _emitted(rows: DataFrame) -> DataFrame:
    """Merged rows of one depth as nodes: a childless one is a leaf, and its own bytes are added."""
    return rows.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("bigint")) \
        .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes"))


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of ``rows`` (conv_id, turn, role, text)."""
    long = "bigint"
    turns = saved(numbered_turns(rows), "trie-turns")
    convs = saved(rows.select(F.col("conv_id").cast(long).alias("conv_id")).distinct(), "trie-conversations")
    paths = saved(prefix_keys(rebuilt(turns, convs)), "trie-paths")

    # Every conversation's last key; the root's is 0, 0.
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "kx", "ky")).alias("z")).select(F.col("conv_id").alias("c"), "z")
    ended = saved(convs.join(last, convs["conv_id"].eqNullSafe(last["c"]), "left").select(
        "conv_id", *[F.coalesce(F.col(f"z.{k}"), F.lit(0).cast(long)).alias(k) for k in ("depth", "kx", "ky")]), "trie-ends")
    # Equal conversations are one, named by the least id.
    distinct = saved(ended.groupBy("depth", "kx", "ky").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-distinct")

    # The paths of those, with parents; which nodes do several of them share?
    names = distinct.filter("depth > 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("length"), "n_convs")
    mine = paths.join(names, paths["conv_id"].eqNullSafe(names["c"])).drop("c")
    up = mine.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("kx").alias("px"), F.col("ky").alias("py"))
    up = up.withColumnsRenamed({"conv_id": "c", "depth": "d"})
    mine = saved(mine.join(up, mine["conv_id"].eqNullSafe(up["c"]) & (mine["depth"] == up["d"]), "left").select(
        "conv_id", "depth", "kx", "ky", *[F.coalesce(p, F.lit(0)).alias(p) for p in ("px", "py")], "bytes", "length", "n_convs"), "trie-paths")
    shared = saved(mine.groupBy("depth", "kx", "ky").agg(F.count("*").alias("k")).filter("k > 1").drop("k"), "trie-shared")
    held = mine.join(shared.withColumn("shared", F.lit(True)), ["depth", "kx", "ky"], "left")
    held = saved(held.withColumn("shared", F.coalesce("shared", F.lit(False))), "trie-paths")

    # Private tails: each turn below the last shared one is a node with one (distinct) conversation.
    tail = held.filter("not shared")
    rest = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    below = tail.groupBy("conv_id", "block").agg(F.sum("bytes").alias("k")) \
        .select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("k").over(after), F.lit(0)).alias("below"))
    tail = tail.withColumn("rest", F.sum("bytes").over(rest))
    private = tail.join(below, tail["conv_id"].eqNullSafe(below["c"]) & (tail["block"] == below["b"])).select(
        "depth", "kx", "ky", "px", "py", "bytes", "conv_id", "n_convs", (F.col("depth") < F.col("length")).cast(long).alias("n_children"),
        F.lit(1).cast(long).alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("rest") + F.col("below"))).alias("saved"))
    private = saved(private, "trie-private")

    # What enters the rounds: paths that end on a shared node, and tops of private tails (as children of theirs).
    zero = F.lit(0).cast(long)
    ends_here = held.filter("shared and depth = length").select(
        "depth", "kx", "ky", "px", "py", "bytes", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"))
    top = private.select(F.col("depth").alias("below"), F.col("px").alias("kx"), F.col("py").alias("ky"), "conv_id", "n_convs", "n_leaves", "saved") \
        .withColumn("depth", F.col("below") - 1)
    ways = held.filter("shared").select(F.col("conv_id").alias("c"), "depth", "kx", "ky", "px", "py", "bytes")
    stubs = top.join(ways.withColumnRenamed("depth", "d"), top["conv_id"].eqNullSafe(F.col("c")) & (top["depth"] == F.col("d")), "inner") \
        .select("depth", top["kx"], top["ky"], "px", "py", "bytes", "conv_id", "n_convs", F.lit(1).cast(long).alias("n_children"), "n_leaves", "saved")
    entering = saved(ends_here.union(stubs).groupBy("depth", "kx", "ky").agg(*_summed()), "trie-entering")
    parents = saved(held.filter("shared").groupBy("depth", "kx", "ky").agg(F.min("px").alias("px"), F.min("py").alias("py"), F.min("bytes").alias("bytes")), "trie-parents")

    deepest = shared.agg(F.max("depth")).first()[0] or 0
    levels, alive = [private], None
    for depth in range(deepest, 0, -1):
        now = entering.filter(F.col("depth") == depth).select(*NODE)
        if alive is not None:
            # survivors: their last turn stripped, their parent takes their place
            stripped = alive.groupBy(F.col("px").alias("kx"), F.col("py").alias("ky")).agg(
                F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("*").alias("n_children"),
                F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")).withColumn("depth", F.lit(depth).cast(long))
            here = parents.filter(F.col("depth") == depth).drop("depth")
            now = now.union(stripped.join(here, ["kx", "ky"]).select(*NODE))
        alive = saved(_emitted(now.groupBy("depth", "kx", "ky").agg(*_summed())).select(*NODE), "trie-level")
        levels.append(alive)

    # The root: conversations without turns, nodes of depth 1.
    bare = distinct.filter("depth = 0").select("conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"))
    first = [x.filter("depth = 1") for x in ([private] if alive is None else [private, alive])]
    for x in first:
        bare = bare.union(x.select("conv_id", "n_convs", F.lit(1).cast(long).alias("n_children"), "n_leaves", "saved"))
    root = bare.groupBy().agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]) \
        .filter("n_convs is not null").select(*[zero.alias(c) for c in ("depth", "kx", "ky")], *[F.lit(None).cast(long).alias(c) for c in ("px", "py")],
                                              zero.alias("bytes"), "conv_id", "n_convs", "n_children", "n_leaves", "saved")
    nodes = _emitted(root)
    for x in levels:
        nodes = nodes.union(x.select(*NODE))
    nodes = saved(nodes, "trie-nodes")

    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(over, ["depth", "px", "py"], "left").join(ends_digests(ended), ["depth", "kx", "ky"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
