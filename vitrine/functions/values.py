"""Value helpers over one semi-structured record (a VARIANT column).

The feeds are JSON; the reference maps them row by row in Python with idioms
like ``a or b or c`` and ``int(x)`` with a fallback.  These helpers express
the same rules as Spark column expressions over ``VARIANT`` (which keeps a
number apart from a string, so ``0`` is falsy while ``"0"`` is not).

``Fields`` stages every path a normaliser reads as four plain columns — the
value, its type name, its text and its truthiness — computed once per row.  All
paths of one level come from a single cast of the record to a struct of VARIANT
fields, and each value is turned into text once: a cast of a VARIANT builds a
Cast expression for every value, so the mapping expressions work on the text,
where whole-stage code generation reaches them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.schemas import MONEY

_INT_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT")


@dataclass(frozen=True)
class Typed:
    """A VARIANT value with its ``schema_of_variant`` type name and its text."""

    v: Column
    t: Column
    s: Column

    @staticmethod
    def of(x: Column) -> "Typed":
        return Typed(x, F.schema_of_variant(x), F.try_variant_get(x, "$", "string"))


def path(v: Column, p: str) -> Column:
    """Value at a dotted path (``a.b``) as VARIANT; NULL when a level is missing
    or not an object."""
    return F.try_variant_get(v, "$." + p, "variant")


def truthy_of(x: Typed) -> Column:
    """P10: Python truthiness (missing/NULL → false; ``0``, ``""``, ``[]``, ``{}``,
    ``false`` → false; the string ``"0"`` → true)."""
    t = x.t
    return (F.when(t.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "STRING", F.length(x.s) > 0)
            .when(t == "BOOLEAN", x.s == "true")
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .when(t.startswith("ARRAY"), x.s != "[]")
            .otherwise(F.coalesce(x.s.try_cast("double") != 0, F.lit(True))))


class Fields:
    """Paths of one record column, staged as value / type / text / truthy columns."""

    def __init__(self, rec: str = "rec", prefix: str = "_f"):
        self.rec, self.prefix = rec, prefix
        self.paths: dict[str, int] = {}

    def _i(self, p: str) -> int:
        return self.paths.setdefault(p, len(self.paths))

    def get(self, p: str) -> Typed:
        i = self._i(p)
        return self._staged(i)

    def _staged(self, i: int) -> Typed:
        return Typed(*[F.col(f"{self.prefix}{k}{i}") for k in "vts"])

    def truthy(self, p: str) -> Column:
        return F.col(f"{self.prefix}b{self._i(p)}")

    def first(self, keys: Sequence[str]) -> Typed:
        """``rec.get(k1) or rec.get(k2) or …`` — the first truthy field, else NULL."""
        gs = [(self.get(k), self.truthy(k)) for k in keys]
        return Typed(*[F.coalesce(*[F.when(b, getattr(g, k)) for g, b in gs]) for k in "vts"])

    def stage(self, df: DataFrame) -> DataFrame:
        """Add the staged columns (narrow projections; no shuffle)."""
        p, at = self.prefix, {k: i for k, i in self.paths.items()}
        level, owner = [(k.split("."), i) for k, i in at.items()], {"": F.col(self.rec)}
        depth = 1
        while level:
            by_parent: dict[str, list[str]] = {}
            for parts, _ in level:
                names = by_parent.setdefault(".".join(parts[:depth - 1]), [])
                if parts[depth - 1] not in names:
                    names.append(parts[depth - 1])
            structs = {q: f"{p}o{depth}_{n}" for n, q in enumerate(by_parent)}
            df = df.select("*", *[F.try_variant_get(owner[q], "$", f"struct<{','.join(f'`{x}`:variant' for x in names)}>")
                                  .alias(structs[q]) for q, names in by_parent.items()])
            owner = {".".join(filter(None, (q, x))): F.col(structs[q]).getField(x) for q, names in by_parent.items() for x in names}
            df = df.select("*", *[owner[k].alias(f"{p}v{i}") for k, i in at.items() if len(k.split(".")) == depth])
            level = [(parts, i) for parts, i in level if len(parts) > depth]
            depth += 1
        staged = [(i, Typed.of(F.col(f"{p}v{i}"))) for i in at.values()]
        df = df.select("*", *[x.alias(f"{p}{k}{i}") for i, g in staged for k, x in (("t", g.t), ("s", g.s))])
        return df.select("*", *[truthy_of(self._staged(i)).alias(f"{p}b{i}") for i in at.values()])

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith(self.prefix)])


def as_text(x: Typed) -> Column:
    """``str(x)`` for scalars (numbers keep their JSON text)."""
    return x.s


def safe_int(x: Typed, default: int | Column | None = 0) -> Column:
    """``int(x)`` else default — numbers truncate (12.7 → 12), integer
    strings parse, ``"12.0"`` and non-scalars give the default, booleans 1/0."""
    t = x.t
    d = default if isinstance(default, Column) else F.lit(default).cast("bigint")
    val = (F.when(t.isin(*_INT_TYPES), x.s.try_cast("bigint"))
           .when(t == "STRING", F.trim(x.s).try_cast("bigint"))
           .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), x.s.try_cast("double").try_cast("bigint"))
           .when(t == "BOOLEAN", (x.s == "true").cast("bigint")))
    return F.coalesce(val, d)


def _is_number(t: Column) -> Column:
    return t.isin(*_INT_TYPES, "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def safe_money(x: Typed, default: float | None = 0.0) -> Column:
    """P12 for money: ``float(x)`` else default, as DECIMAL(18,2)."""
    t = x.t
    val = (F.when(t == "STRING", F.trim(x.s).try_cast(MONEY))
           .when(t == "BOOLEAN", (x.s == "true").cast("int").cast(MONEY))
           .when(_is_number(t), x.s.try_cast(MONEY)))
    return F.coalesce(val, F.lit(default).cast(MONEY)) if default is not None else val


def safe_float(x: Typed, default: float = 0.0) -> Column:
    """``float(x)`` else default, as DOUBLE (ratios, conversions)."""
    t = x.t
    val = (F.when(t == "STRING", F.trim(x.s).try_cast("double"))
           .when(t == "BOOLEAN", (x.s == "true").cast("int").cast("double"))
           .when(_is_number(t), x.s.try_cast("double")))
    return F.coalesce(val, F.lit(default).cast("double"))


# Accepted ISO-8601 spellings beyond Spark's default parser.
BASIC_ISO_FORMATS = ("yyyyMMdd'T'HHmmssX", "yyyyMMdd'T'HHmmss", "yyyyMMdd")


def parse_text_ts(s: Column) -> Column:
    """P13/P14 on text: ISO-8601 → UTC wall time (``TIMESTAMP_NTZ``).

    Offsets and ``Z`` convert to UTC, naive values are taken as UTC (the
    session zone), a date alone is midnight; the basic form
    ``20260301T101500Z`` has its own patterns.  Empty or unparseable → NULL,
    and so is a time without a date (Spark would take today's).
    """
    s = F.when(s.rlike(r"^[+-]?\d{4}"), s)
    parsed = F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in BASIC_ISO_FORMATS])
    return F.convert_timezone(None, F.lit("UTC"), parsed)


def parse_ts(x: Typed) -> Column:
    """P13 on a VARIANT: only text values are timestamps."""
    return parse_text_ts(F.when(x.t == "STRING", F.trim(x.s)))


def is_object(x: Column) -> Column:
    """True for a JSON object (a cast to an empty struct succeeds only for objects;
    much cheaper than building the record's full schema text)."""
    return F.try_variant_get(x, "$", "struct<>").isNotNull()
