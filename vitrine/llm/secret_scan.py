"""Secret scans: fixed patterns plus formats learnt by grammar inference.

Base patterns find assignments, access keys and long hex runs.  Their values
are labelled credentials: a bounded sample of each kind trains a probabilistic
automaton (``grammar``), a sample of the other long tokens a background model
of character pairs.  Every token that is long, or as long as the shortest value
that trains, is a candidate unless base spans cover it whole, and is scored by
all automata; one that a format explains at least as well as nearly all of its
own held-out examples, and much better than the background does, is a span of
kind ``format``.  Tokens under MIN_CANDIDATE have a background of their own.

Positions are code points, ends exclusive.  Defined results: null text is
empty and holds nothing; rows are scanned one by one, so repeated rows repeat
their result and null ids pass through; without labelled credentials there are
no formats and the base spans stay; whole texts are scanned, whatever their
length; columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import id_text
from vitrine.llm.grammar import CLASSES, Automaton, classes, infer

# Fixed values of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "format")

MIN_CANDIDATE = 16       # characters of a token that is a candidate, unless a shorter value trains
SAMPLE = 400             # labelled values of each kind, and background tokens, that train (the bound)
QUANTILE = 0.05          # share of held-out examples that a format may leave out
MIN_GAIN = 0.5           # nats a character by which a format must beat the background


class Finder:
    """Base spans and candidates of one text."""

    def __init__(self, least: int = MIN_CANDIDATE):
        flags = re.ASCII
        self.assign = re.compile(ASSIGN, flags | re.IGNORECASE)
        self.access, self.hex = re.compile(ACCESS, flags), re.compile(HEX, flags)
        self.token = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % least, flags)

    def base(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
        """(start, kind, end, value), by start and kind; ``tokens`` are the candidates."""
        out = []
        low = text.lower()
        if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
            out += [(m.start(), 0, m.end(), m[2]) for m in self.assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        # access keys and hex runs long enough stand inside a candidate
        for s, e in tokens:
            if e - s >= MIN_ACCESS:
                out += [(m.start(), 1, m.end(), m[0]) for m in self.access.finditer(text, s, e) if len(m[0]) >= MIN_ACCESS]
            if e - s >= MIN_HEX:
                out += [(m.start(), 2, m.end(), m[0]) for m in self.hex.finditer(text, s, e) if len(m[0]) >= MIN_HEX]
        return sorted(out)

    def tokens(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.token.finditer(text)]


def _others(tokens, base):
    """Candidates that no base span touches."""
    for s, e in tokens:
        if not any(b[0] < e and s < b[2] for b in base):
            yield s, e


def _open(tokens, base):
    """Candidates that base spans don't cover whole; ``base`` in order."""
    for s, e in tokens:
        at = s
        for b in base:
            if b[0] <= at < b[2]:
                at = b[2]
        if at < e:
            yield s, e


def samples(docs: DataFrame, sample: int = SAMPLE, least: int = MIN_CANDIDATE) -> DataFrame:
    """(kind, value): the ``sample`` distinct values of each kind with the least hashes.

    Kind 3 is the background, kind 4 that of tokens of ``least`` characters up
    to MIN_CANDIDATE.  Each task sends no more than ``sample`` values of a kind.
    """
    def run(batches):
        finder = Finder(least)
        held: dict[int, dict[str, int]] = {k: {} for k in range(5)}

        def keep(kind, value):
            held[kind][value] = xxhash.xxh64_intdigest(value)
            if len(held[kind]) > 4 * sample:
                held[kind] = dict(heapq.nsmallest(sample, held[kind].items(), key=lambda x: x[::-1]))

        for b in batches:
            for text in b.column(1).to_pylist():
                text = text or ""
                tokens = finder.tokens(text)
                base = finder.base(text, tokens)
                for _, kind, _, value in base:
                    keep(kind, value)
                for s, e in _others(tokens, base) if base else tokens:
                    keep(3 if e - s >= MIN_CANDIDATE else 4, text[s:e])
        rows = [(k, v, h) for k in held for v, h in heapq.nsmallest(sample, held[k].items(), key=lambda x: x[::-1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] - (1 << 63) for r in rows], pa.int64())], ["kind", "value", "h"])

    rows = id_text(docs).mapInArrow(run, "kind int, value string, h bigint").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= sample).select("kind", "value")


class Formats:
    """Automata of the credential kinds, with their thresholds, against a background of character pairs.

    ``least``: the characters of the shortest candidate; ``short``: the
    background of candidates under MIN_CANDIDATE.
    """

    def __init__(self, automata: list[tuple[Automaton, float]], background: list[list[float]],
                 short: list[list[float]], least: int):
        self.automata, self.background, self.short, self.least = automata, background, short, least

    def common(self, symbols: list[int]) -> float:
        """Log probability under the background."""
        background = self.background if len(symbols) >= MIN_CANDIDATE else self.short
        last, total = len(CLASSES), 0.0
        for c in symbols:
            total += background[last][c] - math.log(len(CLASSES[c]))
            last = c
        return total + background[last][len(CLASSES)]

    def likely(self, value: str) -> bool:
        symbols = classes(value)
        usual = None
        for automaton, least in self.automata:
            score = automaton.score(symbols)
            if score > -math.inf and score / len(symbols) >= least:
                usual = self.common(symbols) if usual is None else usual
                if score - usual >= MIN_GAIN * len(symbols):
                    return True
        return False


def _pairs(values: list[str]) -> list[list[float]]:
    n = len(CLASSES)
    counts = [[1.0] * (n + 1) for _ in range(n + 1)]
    for v in values:
        last = n
        for c in classes(v):
            counts[last][c] += 1
            last = c
        counts[last][n] += 1
    return [[math.log(x / sum(row)) for x in row] for row in counts]


def train(labelled: dict[int, list[str]]) -> Formats:
    """An automaton for each kind, from 4 of 5 values; the fifth sets its threshold.

    An automaton that refuses more than QUANTILE of the fifth is smoothed.
    """
    automata = []
    for kind in range(3):
        values = labelled.get(kind, [])
        held = values[::5]
        automaton = infer([v for i, v in enumerate(values) if i % 5] or values)
        if automaton:
            def threshold():
                per = sorted(automaton.score(s) / len(s) for s in map(classes, held))
                return per[int(QUANTILE * len(per))]

            if threshold() == -math.inf:
                automaton.smooth()
            automata.append((automaton, threshold()))
    return Formats(automata, _pairs(labelled.get(3, [])), _pairs(labelled.get(4, [])), _least(labelled))


def _least(labelled: dict[int, list[str]]) -> int:
    return min([MIN_CANDIDATE, *(len(v) for kind in range(3) for v in labelled.get(kind, []))])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats learnt from the documents; at most 4 * ``sample`` values reach the driver at once.

    If a value under MIN_CANDIDATE trains, a second pass samples the background of such tokens.
    """
    def taken(rows: DataFrame) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for r in rows.orderBy("kind", F.xxhash64("value"), "value").collect():
            out.setdefault(r.kind, []).append(r.value)
        return out

    labelled = taken(samples(docs, sample))
    least = _least(labelled)
    if least < MIN_CANDIDATE:
        labelled |= taken(samples(docs, sample, least).filter("kind = 4"))
    return train(labelled)


def all_spans(finder: Finder, formats: Formats, text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base and format spans, by start and kind."""
    tokens = finder.tokens(text)
    if not tokens and ":" not in text and "=" not in text:
        return []
    base = finder.base(text, tokens)
    rest = _open(tokens, base) if base else tokens
    return sorted([b[:3] for b in base] + [(s, 3, e) for s, e in rest if formats.likely(text[s:e])])


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, spans) per row; spans: array of (kind, start, end) in order."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        finder = Finder(formats.least)
        for b in batches:
            out = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(finder, formats, t or "")]
                   for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch of spans replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, formats: Formats, text_col: str = "text", length_col: str | None = "n_chars",
           mark: str = "[secret]") -> DataFrame:
    """All documents, secrets replaced; columns as in ``docs`` (``length_col`` follows the text)."""
    def clean(texts):
        finder = Finder(formats.least)
        for batch in texts:
            out = []
            for t in batch.to_pylist():
                spans = all_spans(finder, formats, t) if t else []
                out.append(redacted(t, spans, mark) if spans else t)
            yield pa.array(out, pa.string())

    from collections.abc import Iterator  # for the UDF's type hints
    clean.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(clean, "string")
    out = docs.withColumn(text_col, udf(F.col(f"`{text_col}`").cast("string")))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col))
                             .otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
