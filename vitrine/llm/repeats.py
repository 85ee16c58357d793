"""Repeated passages: every byte of a string of LENGTH bytes that starts at two places.

Content-anchored fingerprints, in place of prefix doubling.  Sorting all
positions of the corpus at every offset would shuffle some 16 bytes for each
byte of text and round; instead positions are sampled by content so that no
repeat is missed:

1. The anchor of a start s is the place of the least k-gram hash among the
   first SPAN places of s (the leftmost of equals).  It depends only on the
   string's own bytes, so equal strings have their anchors at the same offset.
   An anchor owns the run of starts that name it, about LENGTH / 12 of them.
2. Anchors are dealt and sorted by the rank pair of the two halves of their
   first LENGTH - SPAN + 1 bytes, which all strings of their starts hold.  A
   unique pair ends the search for all its starts.  An equal pair is reranked
   with the full stretch from the first own start to the last one's end: where
   that is repeated, so are all own starts.
3. Of what is left, where stretches differ within one pair, every start is a
   position of its own: sorted by the rank pair at offsets 0 and LENGTH / 2,
   past the threshold, so equal pairs are repeated strings.

Ranks are 64-bit hashes of the bytes that they name (equal for two different
strings with a chance of about 2**-60).  Equal texts are one text with a count:
all their strings start elsewhere too.

Bytes are of UTF-8; matches never cross texts.  Defined results: null text is
empty; a text shorter than LENGTH loses nothing; repeated rows are copies of
each other, so they are removed whole (from LENGTH bytes on); null ids pass
through; long texts are worked off in blocks; an empty table gives no rows;
columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import bloom
from vitrine.llm.common import id_text, saved
from vitrine.llm.shingles import Hasher

LENGTH = 400
BLOCK = 1 << 18                 # starts that are looked at together
FLUSH = 150_000                 # positions that a map task holds before it sends them
FRAGMENT = 500_000              # positions that one fragment task holds
RESOLVED, LISTED = 1, 2         # flags of an anchor


def shape(length: int) -> tuple[int, int]:
    """(SPAN, k) for a length: places in which an anchor is sought, bytes of its gram."""
    return max(1, min(128, length // 3)), max(1, min(24, length // 4))


class Bytes(Hasher):
    """Hashes of stretches of one text's bytes, from prefix sums."""

    def __init__(self):
        super().__init__()
        self.table[65:91] = np.random.default_rng(5).integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def load(self, data: np.ndarray) -> None:
        if len(data) > len(self.power):
            self._grow(len(data) * 5 // 4)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.mix((self.total[end] - self.total[start]) * self.back[start])


def anchors(b: Bytes, data: np.ndarray, length: int):
    """Runs (first start, last start, rank of the pair, rank of the stretch) of one text."""
    span, k = shape(length)
    tail = length - span + 1
    half = tail // 2
    for block in range(0, len(data) - length + 1, BLOCK):
        part = data[block:block + BLOCK + length - 1]
        b.load(part)
        grams, starts = len(part) - k + 1, len(part) - length + 1
        place = np.arange(grams)
        low = np.uint64((1 << 20) - 1)
        value = (b.of(place, place + k) & ~low) | place.astype(np.uint64)
        rows = -(-grams // span)
        held = np.full(rows * span, np.uint64(2**64 - 1))
        held[:grams] = value
        held = held.reshape(rows, span)
        ahead = np.minimum.accumulate(held, axis=1).ravel()
        behind = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:starts], ahead[span - 1:span - 1 + starts]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], starts) - 1
        at = anchor[first]
        pair = b.mix(b.of(at, at + half) * np.uint64(3) + b.of(at + half, at + tail))
        where = ((at - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        stretch = b.mix(b.of(first, last + length) + b.mix(where))
        yield first + block, last + block, pair, stretch


def _flat(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _dealt(part: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Columns packed by part number."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(p, order[cut[p]:cut[p + 1]]) for p in range(parts) if cut[p] < cut[p + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32())]
        + [pa.array([c[i].tobytes() for _, i in rows], pa.binary()) for c in columns.values()], ["part", *columns])


def _packed_schema(*names: str) -> str:
    return "part int, " + ", ".join(f"{n} binary" for n in names)


def _cut(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class _Held:
    """Position columns collected by a map task, sent in packed batches."""

    def __init__(self, parts: int, by: str, kinds: dict[str, str]):
        self.parts, self.by, self.kinds = parts, by, kinds
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.rows.append(columns)
        self.size += len(columns[0])

    def take(self) -> pa.RecordBatch:
        joined = {n: np.concatenate([r[i] for r in self.rows]).astype(k) for i, (n, k) in enumerate(self.kinds.items())}
        self.rows, self.size = [], 0
        return _dealt(_cut(joined[self.by].view(np.uint64), self.parts), self.parts, joined)


ANCHOR = {"pair": "u8", "stretch": "u8", "text": "i8", "first": "u4", "width": "u1"}
START = {"rank": "u8", "text": "i8", "first": "u4"}


def _columns(t: pa.Table, kinds: dict[str, str]) -> list[np.ndarray]:
    return [_flat(t.column(n), np.dtype(k)) for n, k in kinds.items()]


def _send_anchors(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """Packed anchors of the distinct texts of each task."""
    def run(batches):
        b, seen, held = Bytes(), set(), _Held(parts, "pair", ANCHOR)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                data = np.frombuffer(text.encode(), np.uint8)
                with np.errstate(over="ignore"):
                    for first, last, pair, stretch in anchors(b, data, length):
                        held.add(pair, stretch, np.full(len(pair), key), first, last - first)
                if held.size >= FLUSH:
                    yield held.take()
        if held.size:
            yield held.take()

    return texts.mapInArrow(run, _packed_schema(*ANCHOR))


def _judge_anchors(sent: DataFrame, parts: int) -> DataFrame:
    """Packed (text, first, width, flag) of the anchors whose rank pair is not unique."""
    def run(t: pa.Table) -> pa.Table:
        pair, stretch, text, first, width = _columns(t, ANCHOR)
        order = np.argsort(pair, kind="stable")      # the sort by rank pair; most are unique and end here
        g = pair[order]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        order = order[same[1:] | same[:-1]]
        pair, stretch, text, first, width = (x[order] for x in (pair, stretch, text, first, width))
        order = np.lexsort((first, text, stretch, pair))
        pair, stretch, text, first, width = (x[order] for x in (pair, stretch, text, first, width))
        new = np.ones(len(pair), bool)               # the same text from two tasks counts once
        new[1:] = (pair[1:] != pair[:-1]) | (stretch[1:] != stretch[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1])
        pair, stretch, text, first, width = (x[new] for x in (pair, stretch, text, first, width))
        flag = np.zeros(len(pair), np.uint8)
        if len(pair):
            lead = np.ones(len(pair), bool)          # first of its stretch
            lead[1:] = (pair[1:] != pair[:-1]) | (stretch[1:] != stretch[:-1])
            at = np.flatnonzero(lead)
            copies = np.diff(np.append(at, len(pair)))
            flag[np.repeat(copies > 1, copies)] |= RESOLVED
            p = pair[at]                             # one row a stretch: pairs that have several
            several = np.zeros(len(p) + 1, bool)
            several[1:-1] = p[1:] == p[:-1]
            flag[at[several[1:] | several[:-1]]] |= LISTED
        keep = flag > 0
        columns = {"text": text[keep], "first": first[keep], "width": width[keep], "flag": flag[keep]}
        return pa.Table.from_batches([_dealt(_cut(columns["text"].view(np.uint64), parts), parts, columns)])

    return sent.groupBy("part").applyInArrow(run, _packed_schema("text", "first", "width", "flag"))


def _by_text(text: np.ndarray, columns: list[np.ndarray], kinds) -> list[pa.Array]:
    """Text keys and, for each, its values as lists (rows sorted by text)."""
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    ends = pa.array(np.append(at, len(text)), pa.int32())
    return [pa.array(text[at], pa.int64())] + [pa.ListArray.from_arrays(ends, pa.array(c).cast(k)) for c, k in zip(columns, kinds)]


def _marks(judged: DataFrame) -> DataFrame:
    """(text_key, first, width, flag) arrays per text, in order of the starts."""
    def run(t: pa.Table) -> pa.Table:
        text, first, width, flag = _columns(t, {"text": "i8", "first": "u4", "width": "u1", "flag": "u1"})
        order = np.lexsort((first, text))
        arrays = _by_text(text[order], [x[order] for x in (first, width, flag)], (pa.int64(), pa.int32(), pa.int32()))
        return pa.table(arrays, names=["text_key", "first", "width", "flag"])

    return judged.groupBy("part").applyInArrow(
        run, "text_key bigint, first array<bigint>, width array<int>, flag array<int>")


def _send_starts(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """Packed rank pairs of all listed starts of the distinct texts of each task."""
    half = length // 2

    def run(batches):
        b, seen, held = Bytes(), set(), _Held(parts, "rank", START)
        for batch in batches:
            for key, text, first, width, flag in zip(*(c.to_pylist() for c in batch.columns)):
                if key in seen:
                    continue
                seen.add(key)
                data = np.frombuffer(text.encode(), np.uint8)
                runs = [(f, f + w) for f, w, g in zip(first, width, flag) if g & LISTED]
                with np.errstate(over="ignore"):
                    at = 0
                    while at < len(runs):            # runs near each other share prefix sums
                        lo, end = runs[at][0], at
                        while end < len(runs) and runs[end][1] - lo < BLOCK:
                            end += 1
                        end = max(end, at + 1)
                        b.load(data[lo:runs[end - 1][1] + length])
                        s = np.concatenate([np.arange(f, e + 1) for f, e in runs[at:end]]) - lo
                        rank = b.mix(b.of(s, s + half) * np.uint64(3) + b.of(s + half, s + length))
                        held.add(rank, np.full(len(s), key), s + lo)
                        at = end
                if held.size >= FLUSH:
                    yield held.take()
        if held.size:
            yield held.take()

    return texts.mapInArrow(run, _packed_schema(*START))


def _judge_starts(sent: DataFrame, parts: int) -> DataFrame:
    """Packed (text, first) of the starts whose rank pair is not unique."""
    def run(t: pa.Table) -> pa.Table:
        rank, text, first = _columns(t, START)
        order = np.lexsort((first, text, rank))
        rank, text, first = rank[order], text[order], first[order]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1])
        rank, text, first = rank[new], text[new], first[new]
        same = np.zeros(len(rank) + 1, bool)
        same[1:-1] = rank[1:] == rank[:-1]
        keep = same[1:] | same[:-1]
        columns = {"text": text[keep], "first": first[keep]}
        return pa.Table.from_batches([_dealt(_cut(columns["text"].view(np.uint64), parts), parts, columns)])

    return sent.groupBy("part").applyInArrow(run, _packed_schema("text", "first"))


def _spans(marks: DataFrame, found: DataFrame, parts: int, length: int) -> DataFrame:
    """(text_key, starts, ends): merged stretches covered by repeated strings."""
    schema = "text_key bigint, starts array<bigint>, ends array<bigint>"

    def starts(t: pa.Table) -> pa.Table:
        text, first = _columns(t, {"text": "i8", "first": "u4"})
        order = np.lexsort((first, text))
        lists = _by_text(text[order], [first[order]], (pa.int64(),))
        return pa.table(lists, names=["text_key", "single"])

    def merged(batches):
        for b in batches:
            out = []
            for first, width, flag, single in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                lo = [f for f, g in zip(first or (), flag or ()) if g & RESOLVED] + (single or [])
                hi = [f + w for f, w, g in zip(first or (), width or (), flag or ()) if g & RESOLVED] + (single or [])
                order = np.argsort(lo, kind="stable")
                lo, hi = np.array(lo, np.int64)[order], np.array(hi, np.int64)[order] + length
                if not len(lo):
                    out.append((None, None))
                    continue
                reach = np.maximum.accumulate(hi)
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                out.append((lo[new], reach[np.append(new[1:], len(lo)) - 1]))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], kind),
                                              pa.array([o[1] for o in out], kind)], ["text_key", "starts", "ends"])

    single = found.groupBy("part").applyInArrow(starts, "text_key bigint, single array<bigint>")
    return marks.join(single, "text_key", "left").mapInArrow(merged, schema).filter("starts is not null")


def _removed(rows: DataFrame, length: int) -> DataFrame:
    """Applies the spans to rows (doc_id, text, copies, starts, ends); copies > 1 removes the whole text."""
    schema = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string, "
              "starts array<bigint>, ends array<bigint>")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, copies, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
                data = (text or "").encode()
                if copies and copies > 1 and len(data) >= length:
                    starts, ends = [0], [len(data)]
                starts, ends = starts or [], ends or []
                kept = b"".join(data[s:e] for s, e in zip([0, *ends], [*starts, len(data)]))
                out.append((doc_id, len(data), sum(ends) - sum(starts), len(starts), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore"), starts, ends))
            spans = pa.list_(pa.int64())
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), spans, spans)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             [x.strip().split()[0] for x in schema.split(", ")])

    return rows.select("doc_id", "text", "copies", "starts", "ends").mapInArrow(run, schema)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, starts, ends) per row of ``docs`` (doc_id, text).

    ``starts`` and ``ends`` are the removed stretches in bytes.  ``kept_text``
    is the remaining bytes as text, without the rest of a character cut in two.
    """
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.xxhash64("text"))
    texts = rows.select("text_key", "text").filter(F.octet_length("text") >= length)
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    span = shape(length)[0]
    parts = max(1, -(-int(size) * 2 // (span + 1) // FRAGMENT))
    judged = _judge_anchors(_send_anchors(texts, parts, length).repartition(parts, "part"), parts)
    marks = saved(_marks(judged), "repeat-marks")
    listed = marks.filter(F.exists("flag", lambda x: x.bitwiseAND(F.lit(LISTED)) != 0))
    wanted = bloom.build(listed, "text_key")
    starts = listed.agg(F.sum(F.aggregate(F.zip_with("width", "flag", lambda w, f: F.when(
        f.bitwiseAND(F.lit(LISTED)) != 0, w + 1).otherwise(0)), F.lit(0), lambda s, x: s + x))).first()[0] or 0
    more = max(1, -(-int(starts) // FRAGMENT))
    sent = _send_starts(bloom.held(texts, "text_key", wanted).join(listed, "text_key"), more, length)
    found = _judge_starts(sent.repartition(more, "part"), parts)
    copies = texts.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    spans = saved(_spans(marks, found, parts, length).join(copies, "text_key", "full"), "repeat-spans")
    touched = bloom.build(spans, "text_key")
    hit = bloom.held(rows, "text_key", touched).join(spans, "text_key", "left")
    rest = bloom.held(rows, "text_key", touched, negate=True).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
        F.col("text").alias("kept_text"), F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends"))
    return _removed(hit, length).union(rest)
