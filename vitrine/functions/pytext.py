"""Values as the text that a message template writes.

A template's placeholder stands for ``str(value)``; Spark's own cast differs for
floating point numbers (``1.0E7``), booleans (``true``) and fractions of a second.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double_text(c: Column) -> Column:
    """The shortest digits that read back as the same double, written plainly from
    1e-4 up to 1e16 and with an exponent beyond (``0.3``, ``10000000.0``, ``1e+16``).
    Below 1e-307, where doubles lose precision, there may be a digit too many."""
    c = c.cast("double")
    tries = [F.format_string(f"%.{digits - 1}e", c) for digits in (1, 15, 16, 17)]
    sci = F.coalesce(*[F.when(t.cast("double") == c, t) for t in tries[:-1]], tries[-1])
    digits = F.rtrim(F.regexp_replace(F.regexp_extract(sci, r"^-?([0-9.]+)e", 1), r"\.", ""), F.lit("0"))
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    exp = F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")
    rest = F.substring(digits, F.lit(2), F.length(digits))
    whole = F.rpad(F.substring(digits, F.lit(1), exp + 1), exp + 1, F.lit("0"))
    after = F.substring(digits, exp + 2, F.length(digits))
    plain = F.when(exp >= 0, F.concat(whole, F.lit("."), F.when(after == "", F.lit("0")).otherwise(after))) \
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
    power = F.concat(F.substring(digits, 1, 1), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)),
                     F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                     F.format_string("%02d", F.abs(exp)))
    sign = F.when(sci.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")) \
        .when(c == float("-inf"), F.lit("-inf")) \
        .when(c.isNotNull(), F.concat(sign, F.when(exp.between(-4, 15), plain).otherwise(power)))


def text(c: Column, dtype: T.DataType) -> Column:
    """``str(value)`` of a column; NULL stays NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.date_format(c, "SSSSSS") == "000000", whole) \
            .otherwise(F.concat(whole, F.date_format(c, ".SSSSSS")))
    return c.cast("string")


def formatted(c: Column, spec: str, conversion: str | None = None) -> Column:
    """``format(value, spec)``, by Python's own formatter over Arrow batches.  NULL, or
    a value that the spec does not fit, is written as its plain text."""
    def one(v):
        x = {"r": repr, "s": str, "a": ascii}[conversion](v) if conversion else v
        try:
            return format(x, spec)
        except (TypeError, ValueError):
            return str(x)
    return F.udf(one, "string", useArrow=True)(c)
