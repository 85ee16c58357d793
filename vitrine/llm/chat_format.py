"""Chat formatting with a compiled, sandboxed template language.

A template is text with ``{{ expression }}``, ``{% if/elif/else/endif %}``,
``{% for x in messages %}``, ``{% set x = expression %}`` and
``{% generation %} ... {% endgeneration %}`` (the text a model is to learn).
It is parsed into a syntax tree, constant parts are folded, and the rest
becomes Python closures.  Expressions reach only the fields of messages, the
loop's state and the listed filters: no attributes, calls or imports.

``format_conversations`` renders a conversation's turns in order, one by one:
a task holds a turn and a segment of output, never a whole conversation.

Defined results: null role or text is empty; turns sort by (turn, role, text),
nulls first, so ties and repeated rows have a fixed order and each is a turn;
rows with a null id form one conversation; an empty table gives no rows;
columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 20  # code points after which a segment of output is sent

CONTROL = ("###", "</turn>")
ESCAPE = "\\"
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape(':') }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}")


def escape(text: str, *more: str) -> str:
    """Puts a backslash before backslashes, control strings and ``more``."""
    return re.sub("|".join(map(re.escape, (ESCAPE, *CONTROL, *more))), lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "trim": lambda s: s.strip(),
    "upper": lambda s: s.upper(),
    "lower": lambda s: s.lower(),
    "default": lambda s, other: s if s else other,
    "length": len,
}


class TemplateError(ValueError):
    """The template is not in the language."""


# ---- parsing -------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|().,\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text: {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.todo = _tokens(source)

    def peek(self, *values):
        return bool(self.todo) and self.todo[0][0] in ("op", "name") and self.todo[0][1] in values

    def take(self, kind=None, value=None):
        if not self.todo or kind and self.todo[0][0] != kind or value and self.todo[0][1] != value:
            raise TemplateError(f"expected {value or kind}")
        return self.todo.pop(0)[1]

    def whole(self):
        node = self.any_of()
        if self.todo:
            raise TemplateError(f"unexpected {self.todo[0][1]!r}")
        return node

    def any_of(self):
        node = self.all_of()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.all_of())
        return node

    def all_of(self):
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        node = self.joined()
        if self.peek("==", "!=", "<", ">", "<=", ">="):
            return ("compare", self.take(), node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.peek("+", "~"):
            self.take()
            node = ("join", node, self.filtered())
        return node

    def filtered(self):
        node = self.field()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = []
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    args.append(self.any_of())
                    if not self.peek(")"):
                        self.take("op", ",")
                self.take("op", ")")
            node = ("filter", name, node, args)
        return node

    def field(self):
        node = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                node = ("field", node, self.take("name"))
            else:
                node = ("field", node, self.atom()[1])
                self.take("op", "]")
        return node

    def atom(self):
        if self.peek("("):
            self.take()
            node = self.any_of()
            self.take("op", ")")
            return node
        if not self.todo:
            raise TemplateError("an expression is missing")
        kind, value = self.todo.pop(0)
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "num":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> list[tuple]:
    """Syntax tree: a list of ("text", s), ("put", e), ("set", name, e), ("if", [(e, body)]), ("for", name, e, body), ("gen", body)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.DOTALL)
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(("put", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, f"{word} {rest}".strip()
                if word == "if":
                    branches, test = [], _Expression(rest).whole()
                    while True:
                        body, end = block("elif", "else", "endif")
                        branches.append((test, body))
                        if end == "endif":
                            break
                        test = ("const", True) if end == "else" else _Expression(end[4:]).whole()
                    out.append(("if", branches))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                    if not m:
                        raise TemplateError(f"not a loop: {part}")
                    out.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError(f"not an assignment: {part}")
                    out.append(("set", name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    out.append(("gen", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown or unexpected tag: {part}")
            elif part:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block()[0]


# ---- folding -------------------------------------------------------------

_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
            ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _text(value) -> str:
    return "" if value is None else str(value)


def _folded(node: tuple) -> tuple:
    """The expression with its constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "field":
        return ("field", _folded(node[1]), node[2])
    if kind == "filter":
        new = ("filter", node[1], _folded(node[2]), [_folded(x) for x in node[3]])
        parts = [new[2], *new[3]]
    else:
        new = tuple(_folded(x) if isinstance(x, tuple) else x for x in node)
        parts = [x for x in new if isinstance(x, tuple)]
        if kind in ("and", "or") and new[1][0] == "const":
            return new[2] if bool(new[1][1]) == (kind == "and") else new[1]
    return ("const", _closure(new)({})) if all(x[0] == "const" for x in parts) else new


def fold(body: list[tuple]) -> list[tuple]:
    """The tree with constants computed, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "put":
            e = _folded(node[1])
            node = ("text", _text(e[1])) if e[0] == "const" else ("put", e)
        elif kind == "set":
            node = ("set", node[1], _folded(node[2]))
        elif kind == "if":
            branches = []
            for test, inner in node[1]:
                test = _folded(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold(inner)))
                if test[0] == "const":
                    break
            if not branches:
                continue
            if branches[0][0][0] == "const":
                for x in branches[0][1]:
                    _add(out, x)
                continue
            node = ("if", branches)
        elif kind == "for":
            node = ("for", node[1], _folded(node[2]), fold(node[3]))
        elif kind == "gen":
            node = ("gen", fold(node[1]))
        _add(out, node)
    return out


def _add(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


# ---- closures ------------------------------------------------------------

def _closure(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        of, key = _closure(node[1]), node[2]

        def field(scope):
            x = of(scope)
            return x.get(key) if isinstance(x, dict) else None
        return field
    if kind == "filter":
        f, of, args = FILTERS[node[1]], _closure(node[2]), [_closure(x) for x in node[3]]
        return lambda scope: f(_text(of(scope)), *(a(scope) for a in args))
    if kind == "not":
        of = _closure(node[1])
        return lambda scope: not of(scope)
    a, b = _closure(node[-2]), _closure(node[-1])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "join":
        return lambda scope: _text(a(scope)) + _text(b(scope))
    compare = _COMPARE[node[1]]
    return lambda scope: compare(a(scope), b(scope))


def _renderer(body: list[tuple]) -> Callable[[dict], Iterator]:
    """A generator function over a scope: strings to write, True and False where generated text begins and ends."""
    steps = []
    for node in body:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, s=node[1]: (s,))
        elif kind == "put":
            steps.append(lambda scope, e=_closure(node[1]): (_text(e(scope)),))
        elif kind == "set":
            steps.append(lambda scope, n=node[1], e=_closure(node[2]): scope.__setitem__(n, e(scope)) or ())
        elif kind == "if":
            def branch(scope, branches=[(_closure(t), _renderer(b)) for t, b in node[1]]):
                return next((r(scope) for t, r in branches if t(scope)), ())
            steps.append(branch)
        elif kind == "gen":
            def marked(scope, r=_renderer(node[1])):
                yield True
                yield from r(scope)
                yield False
            steps.append(marked)
        else:
            def loop(scope, n=node[1], e=_closure(node[2]), r=_renderer(node[3])):
                rows, i = iter(e(scope) or ()), 0
                row = next(rows, rows)
                while row is not rows:
                    after = next(rows, rows)
                    inner = scope | {n: row, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": after is rows}}
                    yield from r(inner)
                    row, i = after, i + 1
            steps.append(loop)

    def render(scope):
        for step in steps:
            yield from step(scope)
    return render


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator]:
    """A function from messages (dicts) to the stream of ``_renderer``."""
    render = _renderer(fold(parse(template)))
    return lambda messages: render({"messages": messages})


def render(template: str, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation's text and the spans (code points) of its generated text."""
    text, spans, at = [], [], 0
    for x in compile_template(template)(messages):
        if x is True:
            spans.append([at, at])
        elif x is False:
            spans[-1][1] = at
        else:
            text.append(x)
            at += len(x)
    return "".join(text), [tuple(s) for s in spans]


# ---- Spark ---------------------------------------------------------------

SEGMENTS = "conv_id bigint, segment bigint, start bigint, text string, spans array<struct<start:bigint,end:bigint>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, start, text, spans): each conversation's output, in segments.

    A usual conversation is one segment.  ``start`` and ``spans`` are code
    points from the conversation's beginning; no expression's output is cut.
    A partition holds whole conversations, their segments in order.
    """
    parse(template)  # a wrong template fails here, not in the tasks
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def turns(batches):
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(3)))

    def segments(run, messages):
        text, spans, size, start, number, opened = [], [], 0, 0, 0, None
        for x in run(messages):
            if x is True:
                opened = start + size
            elif x is False:
                spans.append({"start": opened, "end": start + size})
                opened = None
            else:
                text.append(x)
                size += len(x)
            if size >= segment:
                if opened is not None and start + size > opened:
                    spans.append({"start": opened, "end": start + size})
                    opened = start + size
                yield number, start, "".join(text), spans
                text, spans, size, start, number = [], [], 0, start + size, number + 1
        if text or spans or not number:
            yield number, start, "".join(text), spans

    def run(batches):
        make = compile_template(template)
        held, size = [], 0
        for conv, group in itertools.groupby(turns(batches), key=lambda r: r[0]):
            for s in segments(make, ({"role": r or "", "text": t or ""} for _, r, t in group)):
                held.append((conv, *s))
                size += len(s[2])
                if size >= segment:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    def batch(held):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span))
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)],
                                          ["conv_id", "segment", "start", "text", "spans"])

    order = ["conv_id", "turn", "role", "text"]
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                       F.col("role").cast("string"), F.col("text").cast("string")) \
        .repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text") \
        .mapInArrow(run, SEGMENTS)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
_END = re.compile(r"\\.|</turn>\n", re.DOTALL)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of ``TEMPLATE`` says: turns and loss text per conversation, digested.

    Reads segments as ``format_conversations`` leaves them (whole conversations
    in a partition, in order).
    """
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")

    def parsed(buffer):
        """(role, text) of the complete turns, and what is left."""
        out, at = [], 0
        while True:
            head = _TURN.match(buffer, at)
            end = head and next((m for m in _END.finditer(buffer, head.end()) if m[0][0] == "<"), None)
            if not end:
                return out, buffer[at:]
            out.append((unescape(head[1]), unescape(buffer[head.end():end.start()])))
            at = end.end()

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        done = []
        for conv, group in itertools.groupby(rows, key=lambda r: r["conv_id"]):
            turns, loss, n, lost, total, left = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for r in group:
                total += len(r["text"])
                found, left = parsed(left + r["text"])
                for role, text in found:
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for s in r["spans"]:
                    text = unescape(r["text"][s["start"] - r["start"]:s["end"] - r["start"]])
                    lost += len(text)
                    loss.update(text.encode())
            if left:
                raise ValueError(f"conversation {conv}: the output doesn't end with a turn")
            done.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), total))
            if len(done) >= 5000:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    def batch(done):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)],
                                          [x.split()[0] for x in schema.split(", ")])

    return formatted.mapInArrow(run, schema)
