"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs n + n * n / capacity (linear work plus attention).
Documents longer than a sequence are first cut at every ``capacity`` tokens.
Pieces go, by a hash, to groups of about GROUP documents; in a group, pieces
in descending order of cost join the cheapest sequence with room for them.  A
group has exactly as many sequences as its tokens need, so a piece that fits
nowhere whole is cut over the cheapest sequences with room: all sequences are
full but for less than one sequence in the group.

Defined results: null text is empty; an empty document is its end id; repeated
rows are packed each for itself (they spread over the groups); null ids pass
through; a very long text only adds full sequences; an empty table gives no
rows; columns beside id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import id_text
from vitrine.llm.tokens import ROWS, ByteEncoder, slices, worker_encoder

CAPACITY = 2048
GROUP = 1024  # documents of a group, on average

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def cost(n, capacity: int = CAPACITY):
    return n + n * n / capacity


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """Sequences as lists of (piece, first token, tokens, offset), for pieces of at most ``capacity`` tokens."""
    count = -(-sum(lengths) // capacity)
    room = np.full(count, capacity, np.int64)
    load = np.zeros(count)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(count)]

    def put(s, piece, first, n):
        out[s].append((piece, first, n, int(capacity - room[s])))
        room[s] -= n
        load[s] += cost(n, capacity)

    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        first, n = 0, lengths[piece]
        while n:
            fits = np.where(room >= n, load, np.inf)
            s = int(fits.argmin())
            if fits[s] < np.inf:
                put(s, piece, first, n)
                break
            s = int(np.where(room > 0, load, np.inf).argmin())
            part = int(room[s])
            put(s, piece, first, part)
            first, n = first + part, n - part
    return out


def pack(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 1, capacity: int = CAPACITY,
         group: int = GROUP) -> DataFrame:
    """One row per piece: its place in its document and sequence, and its ids (unsigned 32-bit, little-endian).

    ``tokenizer`` is a byte-level tokenizer file that every executor can read,
    ``pattern`` its pre-token pattern.  Sequence ids are unique; group g has
    the ids from g * 2**32.
    """
    groups = max(1, -(-docs.count() // group))
    width = ByteEncoder(tokenizer, pattern).width

    def tokenized(batches):
        encoder = worker_encoder(ByteEncoder, tokenizer, pattern)
        end = np.array([end_id], encoder.dtype).tobytes()
        seen: dict = defaultdict(int)  # copies of a row get groups of their own
        for b in (part for batch in batches for part in slices(batch, ROWS)):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist())):
                ids = ids.tobytes() + end
                n = len(ids) // encoder.width
                key = xxhash.xxh64_intdigest(f"{doc_id}:{xxhash.xxh64_hexdigest(ids)}")
                seen[key] += 1
                for start in range(0, n, capacity):
                    part = ids[start * encoder.width:(start + capacity) * encoder.width]
                    g = xxhash.xxh64_intdigest(f"{key}:{seen[key]}:{start}") % groups
                    rows.append((g, doc_id, start, n, part))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["grp", "doc_id", "start", "doc_tokens", "ids"])

    def packed(t: pa.Table) -> pa.Table:
        ids = t.column("ids").to_pylist()
        docs_, starts, totals = (t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        order = sorted(range(len(ids)), key=lambda i: (docs_[i] is None, docs_[i] or 0, starts[i], ids[i]))
        first = t.column("grp")[0].as_py() << 32
        rows = []
        for s, members in enumerate(assign([len(ids[i]) // width for i in order], capacity)):
            for piece, at, n, offset in members:
                i = order[piece]
                part = np.frombuffer(ids[i], f"<u{width}")[at:at + n].astype("<u4").tobytes()
                rows.append((docs_[i], starts[i] + at, n, totals[i], first + s, offset, part))
        kinds = (pa.int64(),) * 6 + (pa.binary(),)
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=[x.split()[0] for x in PIECES.split(", ")])

    return id_text(docs).mapInArrow(tokenized, "grp bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary") \
        .groupBy("grp").applyInArrow(packed, PIECES)
