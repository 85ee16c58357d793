"""R1–R8 alert rules: a query, a row condition, message templates.

The reference evaluates an allow-listed Python expression once per row in a
Python loop.  Here the expression is parsed once on the driver (``ast``) and
compiled to a single Spark ``Column`` (R8), so a rule is one distributed
``where``; alerts of all rules are a ``unionByName`` and the report counts rows
and hits in one pass.  Anything outside the allow-list raises
``UnsafeExpressionError`` at compile time.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
import re
import string
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import pytext

try:  # rule files in YAML need a parser that is not part of this library
    import yaml
except ImportError:
    yaml = None


class UnsafeExpressionError(ValueError):
    """The condition uses syntax outside the allow-list."""


@dataclass
class RuleAction:
    type: str
    template: str


@dataclass
class Rule:
    """Name, query (Spark SQL, ``{table}`` placeholders and ``:as_of``),
    condition (default always true), params and actions."""

    name: str
    query: str
    condition: str = "True"
    actions: list[RuleAction] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)


# The three shipped rules (queries re-aimed at ``:as_of``).
BUILTIN_RULES = (
    Rule("bad_acos",
         "SELECT day, marketplace, account_id, campaign_id, acos, revenue, cost FROM {mrt_ads_daily} "
         "WHERE day = date_sub(:as_of, 1)",
         'row.get("revenue", 0) > 0 and row.get("acos", 0) > params.get("max_acos", 0.3)',
         [RuleAction("telegram", "High ACOS: {campaign_id} acos={acos} revenue={revenue} cost={cost}")],
         {"max_acos": 0.3}),
    Rule("low_stock",
         "SELECT marketplace, account_id, product_id, sum(stock_end) AS stock_end FROM {mrt_stock_daily} "
         "WHERE day = date_sub(:as_of, 1) GROUP BY marketplace, account_id, product_id",
         'row.get("stock_end", 0) < params.get("threshold", 5)',
         [RuleAction("telegram", "Low stock: {marketplace}/{account_id}/{product_id}, stock={stock_end}")],
         {"threshold": 5}),
    Rule("no_sales_7d",
         "SELECT marketplace, account_id, product_id, sum(qty) AS qty_7d FROM {mrt_sales_daily} "
         "WHERE day BETWEEN date_sub(:as_of, 7) AND :as_of GROUP BY marketplace, account_id, product_id",
         'row.get("qty_7d", 0) <= params.get("max_qty", 0)',
         [RuleAction("telegram", "No sales in 7d: {marketplace}/{account_id}/{product_id}")],
         {"max_qty": 0}),
)

KNOWN_ACTIONS = ("telegram", "log")


# ------------------------------------------------------------- R4 rule files

def parse_rule(text: str, source: str) -> Rule:
    """One rule file.  JSON is read by itself, YAML where a parser is installed; name and
    query must be there, the condition is true by default."""
    if source.endswith(".json"):
        raw = json.loads(text)
    elif yaml is not None:
        raw = yaml.safe_load(text)
    else:
        raise ValueError(f"{source}: reading YAML rules needs the yaml package; JSON needs none")
    if not isinstance(raw, dict) or not {"name", "query"} <= raw.keys():
        raise ValueError(f"{source}: a rule is an object with a name and a query")
    actions = [RuleAction(str(a["type"]), str(a["template"])) for a in raw.get("actions") or []]
    return Rule(str(raw["name"]), str(raw["query"]), str(raw.get("condition", "True")), actions,
                dict(raw.get("params") or {}))


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rule files (``.json``, ``.yml``, ``.yaml``) of a folder and the folders
    under it, in the order of their paths.  Rules are configuration: a file each, read
    whole on the driver, whatever storage the folder is on."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,yml,yaml}")
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value").collect()
    return [parse_rule(r["value"], r["path"]) for r in sorted(rows)]


_RULE_FILE = "name string, query string, condition string, params variant, " \
             "actions array<struct<type: string, template: string>>"


def store_rules(spark: SparkSession, rules, path: str) -> None:
    """Write rules as JSON files that ``load_rules`` reads, each in a folder with its name."""
    for rule in rules:
        raw = json.dumps({"name": rule.name, "query": rule.query, "condition": rule.condition,
                          "params": rule.params, "actions": [vars(a) for a in rule.actions]})
        row = spark.createDataFrame([(raw,)], "value string").select(F.from_json("value", _RULE_FILE).alias("r"))
        row.select("r.*").coalesce(1).write.mode("overwrite").json(f"{path}/{rule.name}")


# ------------------------------------------------------------------ R8 compiler

_NUM = "num"
_INT = "int"
_BOOL = "bool"
_STR = "str"
_NUMBERS = (_NUM, _INT)
_ANY = "any"
_ARR = "arr"
_MAP = "map"


def _kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return _BOOL
    if isinstance(dtype, T.IntegralType):
        return _INT
    if isinstance(dtype, T.NumericType):
        return _NUM
    if isinstance(dtype, T.StringType):
        return _STR
    if isinstance(dtype, T.ArrayType):
        return _ARR
    if isinstance(dtype, T.MapType):
        return _MAP
    return _ANY


def _truthy(c: Column, kind: str) -> Column:
    """Python truthiness as a boolean Column (NULL stays NULL → not triggered)."""
    if kind == _BOOL:
        return c
    if kind in _NUMBERS:
        return c != 0
    if kind == _STR:
        return F.length(c) > 0
    if kind in (_ARR, _MAP):
        return F.size(c) > 0
    return c.cast("boolean")


def _result(ka: str, kb: str) -> str:
    return _INT if ka == kb == _INT else _NUM


def _equal(a: Column, ka: str, b: Column, kb: str) -> Column:
    """``a == b`` for any two kinds: values of different kinds are unequal, a boolean
    is the number 0 or 1."""
    if ka == _BOOL and kb in _NUMBERS:
        a, ka = a.cast("int"), _INT
    if kb == _BOOL and ka in _NUMBERS:
        b, kb = b.cast("int"), _INT
    if _ANY in (ka, kb) or ka == kb or (ka in _NUMBERS and kb in _NUMBERS):
        return a == b
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))


def _int_divmod(a: Column, b: Column) -> tuple[Column, Column]:
    """Quotient rounded down and modulo with the divisor's sign; NULL for a divisor of 0."""
    a, b = a.cast("bigint"), b.cast("bigint")
    d = F.when((b != 0) & (b != -1), b)  # the least integer has no quotient by -1
    r = a % d
    down = (r != 0) & ((r < 0) != (d < 0))
    q = F.call_function("div", a, d)
    return (F.when(b == -1, F.try_subtract(F.lit(0).cast("bigint"), a)).otherwise(F.when(down, q - 1).otherwise(q)),
            F.when(b == -1, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).otherwise(F.when(down, r + d).otherwise(r)))


class _Compiler:
    def __init__(self, schema: T.StructType, params: dict[str, Any]):
        self.cols = {f.name: _kind_of(f.dataType) for f in schema.fields}
        self.types = {f.name: f.dataType for f in schema.fields}
        self.params = params

    def fail(self, node: ast.AST, why: str = "unsupported expression") -> UnsafeExpressionError:
        return UnsafeExpressionError(f"{why}: {ast.dump(node)[:120]}")

    def lit(self, v: Any) -> tuple[Column, str]:
        if isinstance(v, bool):
            return F.lit(v), _BOOL
        if isinstance(v, int):
            return F.lit(v), _INT
        if isinstance(v, float):
            return F.lit(v), _NUM
        if isinstance(v, str):
            return F.lit(v), _STR
        if v is None:
            return F.lit(None), _ANY
        if isinstance(v, (list, tuple, set)):
            return self.array([self.lit(x) for x in v]), _ARR
        if isinstance(v, dict):
            return F.create_map(*[self.lit(x)[0] for kv in v.items() for x in kv]), _MAP
        raise UnsafeExpressionError(f"unsupported literal {v!r}")

    def array(self, items: list[tuple[Column, str]]) -> Column:
        """A list as a value of its own; its elements must be of one kind."""
        kinds = {_NUM if k == _INT else k for _, k in items} - {_ANY}
        if len(kinds) > 1:
            raise UnsafeExpressionError("a list of mixed kinds is only supported after 'in'")
        return F.array(*[c for c, _ in items])

    def elements(self, node: ast.AST) -> list[tuple[Column, str]] | None:
        """The elements of a literal list, or of one given by params; else None."""
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [self.compile(e) for e in node.elts]
        try:
            value = self.const(node)
        except (UnsafeExpressionError, KeyError):
            return None
        return [self.lit(x) for x in value] if isinstance(value, (list, tuple, set)) else None

    def const(self, node: ast.AST) -> Any:
        """Driver-side value of a node that only touches params and literals."""
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) \
                and isinstance(node.func.value, ast.Name) and node.func.value.id == "params" \
                and node.func.attr == "get" and not node.keywords and 1 <= len(node.args) <= 2:
            key = self.const(node.args[0])
            default = self.const(node.args[1]) if len(node.args) == 2 else None
            return self.params.get(key, default)
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "params":
            return self.params[self.const(node.slice)]
        raise self.fail(node)

    def compile(self, node: ast.AST) -> tuple[Column, str]:  # noqa: C901 - one case per construct
        if isinstance(node, ast.Expression):
            return self.compile(node.body)
        if isinstance(node, ast.Constant):
            return self.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id in ("row", "params"):
                raise self.fail(node, "bare row/params is not a value")
            raise self.fail(node, f"name {node.id!r} is not allowed")
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return self.array([self.compile(e) for e in node.elts]), _ARR
        if isinstance(node, ast.Dict):
            if any(k is None for k in node.keys):
                raise self.fail(node, "dict unpacking is not allowed")
            return F.create_map(*[self.compile(x)[0] for kv in zip(node.keys, node.values) for x in kv]), _MAP
        if isinstance(node, ast.Subscript):
            if isinstance(node.value, ast.Name) and node.value.id == "row":
                key = self.const(node.slice)
                if key not in self.cols:
                    raise UnsafeExpressionError(f"row has no column {key!r}")
                return F.col(key), self.cols[key]
            if isinstance(node.value, ast.Name) and node.value.id == "params":
                return self.lit(self.const(node))
            base, kind = self.compile(node.value)
            idx, _ = self.compile(node.slice)
            if kind == _ARR:
                return F.element_at(base, idx + 1), _ANY
            return base.getItem(idx), _ANY
        if isinstance(node, ast.BinOp):
            a, ka = self.compile(node.left)
            b, kb = self.compile(node.right)
            op = type(node.op)
            if op is ast.Add:  # a sum of integers too large for the type is NULL
                return (F.concat(a, b), _STR) if _STR in (ka, kb) else (F.try_add(a, b), _result(ka, kb))
            if op is ast.Sub:
                return F.try_subtract(a, b), _result(ka, kb)
            if op is ast.Mult:
                return F.try_multiply(a, b), _result(ka, kb)
            if op is ast.Div:
                return F.try_divide(a.cast("double"), b.cast("double")), _NUM
            if op in (ast.FloorDiv, ast.Mod) and ka == kb == _INT:  # exact, also beyond 2**53
                return _int_divmod(a, b)[op is ast.Mod], _INT
            if op is ast.FloorDiv:
                return F.floor(F.try_divide(a.cast("double"), b.cast("double"))), _NUM
            if op is ast.Mod:  # Python's modulo takes the divisor's sign
                return a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))), _NUM
            if op is ast.Pow:
                return F.pow(a, b), _NUM
            raise self.fail(node)
        if isinstance(node, ast.UnaryOp):
            v, k = self.compile(node.operand)
            if isinstance(node.op, ast.UAdd):
                return v, k
            if isinstance(node.op, ast.USub):
                return -v, k if k == _INT else _NUM
            if isinstance(node.op, ast.Not):
                return ~_truthy(v, k), _BOOL
            raise self.fail(node)
        if isinstance(node, ast.BoolOp):
            parts = [_truthy(*self.compile(v)) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(node.op, ast.And) else (out | p)
            return out, _BOOL
        if isinstance(node, ast.Compare):
            left, lk = self.compile(node.left)
            conds = []
            for op, right_node in zip(node.ops, node.comparators):
                if isinstance(op, (ast.Is, ast.IsNot)):
                    v = right_node.value if isinstance(right_node, ast.Constant) else NotImplemented
                    if not (v is None or isinstance(v, bool)):
                        raise self.fail(node, "'is' is only allowed with None, True or False")
                    if v is None:
                        c = left.isNull()
                    else:  # identity with a bool: a boolean value equal to it (NULL is not)
                        c = F.lit(False) if lk != _BOOL else F.coalesce(left == F.lit(v), F.lit(False))
                    conds.append(c if isinstance(op, ast.Is) else ~c)
                    continue
                if isinstance(op, (ast.In, ast.NotIn)) and (items := self.elements(right_node)) is not None:
                    c = F.lit(False)  # each element by itself: kinds may be mixed
                    for e, ek in items:
                        c = c | _equal(left, lk, e, ek)
                    conds.append(~c if isinstance(op, ast.NotIn) else c)
                    if len(node.ops) > 1:
                        left, lk = self.compile(right_node)
                    continue
                right, rk = self.compile(right_node)
                if isinstance(op, (ast.In, ast.NotIn)):
                    if rk == _STR:
                        c = F.contains(right, left)
                    elif rk == _MAP:
                        c = F.array_contains(F.map_keys(right), left)
                    else:
                        c = F.array_contains(right, left)
                    conds.append(~c if isinstance(op, ast.NotIn) else c)
                    left, lk = right, rk
                    continue
                if isinstance(op, (ast.Eq, ast.NotEq)):
                    c = _equal(left, lk, right, rk)
                    conds.append(~c if isinstance(op, ast.NotEq) else c)
                    left, lk = right, rk
                    continue
                if _STR in (lk, rk) and {lk, rk} & {_NUM, _INT, _BOOL}:
                    raise self.fail(node, "text and numbers have no order")
                fn = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
                      ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b}.get(type(op))
                if fn is None:
                    raise self.fail(node)
                conds.append(fn(left, right))
                left, lk = right, rk
            out = conds[0]
            for c in conds[1:]:
                out = out & c
            return out, _BOOL
        if isinstance(node, ast.IfExp):
            t, kt = self.compile(node.body)
            e, _ = self.compile(node.orelse)
            return F.when(_truthy(*self.compile(node.test)), t).otherwise(e), kt
        if isinstance(node, ast.Call):
            return self.call(node)
        raise self.fail(node)

    def integer(self, v: Column, kind: str) -> Column:
        """``int(v)``: an integer stays as it is, a fraction loses its digits, text must be
        an integer; NULL where there is none or it needs more than 64 bits."""
        if kind in (_INT, _BOOL):
            return v.cast("bigint")
        if kind == _STR:
            digits = F.trim(v)
            return F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits).try_cast("bigint")
        return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).try_cast("bigint") if kind == _NUM \
            else v.try_cast("bigint")

    def call(self, node: ast.Call) -> tuple[Column, str]:
        f = node.func
        kw = {k.arg: k.value for k in node.keywords}
        if None in kw:
            raise self.fail(node, "keyword unpacking is not allowed")
        if kw and not (isinstance(f, ast.Name) and f.id == "round" and set(kw) <= {"ndigits"}):
            raise self.fail(node, "keyword arguments are only supported for round(ndigits=…)")
        if isinstance(f, ast.Attribute) and f.attr == "get" and 1 <= len(node.args) <= 2:
            if isinstance(f.value, ast.Name) and f.value.id == "params":
                return self.lit(self.const(node))
            if isinstance(f.value, ast.Name) and f.value.id == "row":
                key = self.const(node.args[0])
                if key in self.cols:  # a present column: its NULL stays NULL
                    return F.col(key), self.cols[key]
                return self.lit(self.const(node.args[1]) if len(node.args) == 2 else None)
            base, kind = self.compile(f.value)
            key, _ = self.compile(node.args[0])
            default = self.compile(node.args[1])[0] if len(node.args) == 2 else F.lit(None)
            if kind == _MAP:
                return F.coalesce(F.try_element_at(base, key), default), _ANY
            raise self.fail(node)
        if not isinstance(f, ast.Name):
            raise self.fail(node, "only allow-listed functions may be called")
        args = [self.compile(a) for a in node.args]
        name = f.id
        if name in ("min", "max") and len(args) >= 2:
            return (F.least if name == "min" else F.greatest)(*[a for a, _ in args]), _NUM
        if name in ("min", "max") and len(args) == 1:  # one iterable: a literal list or an array value
            arg = node.args[0]
            if isinstance(arg, (ast.List, ast.Tuple, ast.Set)) and len(arg.elts) >= 1:
                items = [self.compile(e)[0] for e in arg.elts]
                if len(items) == 1:
                    return items[0], _NUM
                return (F.least if name == "min" else F.greatest)(*items), _NUM
            v, k = args[0]
            if k == _ARR:
                return (F.array_min if name == "min" else F.array_max)(v), _NUM
        if name == "abs" and len(args) == 1:
            return F.abs(args[0][0]), args[0][1] if args[0][1] == _INT else _NUM
        if name == "round" and len(args) + len(kw) in (1, 2) and args:  # Python rounds half to even
            nd = node.args[1] if len(args) == 2 else kw.get("ndigits")
            scale = self.const(nd) if nd is not None else 0
            return F.bround(args[0][0], int(scale or 0)), _NUM
        if name == "int" and len(args) == 1:
            return self.integer(*args[0]), _INT
        if name == "float" and len(args) == 1:
            return args[0][0].cast("double"), _NUM
        if name == "bool" and len(args) == 1:
            return _truthy(*args[0]), _BOOL
        if name == "str" and len(args) == 1:
            v, k = args[0]
            if k == _NUM:
                v = F.when(F.typeof(v).isin("double", "float"), pytext.double_text(v)).otherwise(v.cast("string"))
            return pytext.text(v, T.BooleanType() if k == _BOOL else T.StringType()), _STR
        if name == "len" and len(args) == 1:
            v, k = args[0]
            return (F.size(v) if k in (_ARR, _MAP) else F.length(v)), _INT
        raise self.fail(node, f"call to {name!r} is not allowed")


def compile_condition(expr: str, schema: T.StructType, params: dict[str, Any] | None = None) -> Column:
    """A rule condition as one boolean Column over a row of ``schema``."""
    try:
        tree = ast.parse(expr, mode="eval")
    except SyntaxError as e:
        raise UnsafeExpressionError(str(e)) from e
    col, kind = _Compiler(schema, params or {}).compile(tree)
    return _truthy(col, kind)


# ------------------------------------------------------------- R5–R7 runner

_FIELD = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def render(template: str, schema: T.StructType, params: dict[str, Any]) -> Column:
    """``{name}`` placeholders from the row or from params, with any format spec and
    conversion.  Plain ones are column expressions; those with a spec go through
    Python's formatter (triggered rows only).  A width or precision may come from
    params (``{x:.{digits}f}``); attributes and indexes are refused."""
    types = {f.name: f.dataType for f in schema.fields}
    parts: list[Column] = []
    for literal, fld, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if fld is None:
            continue
        if not _FIELD.match(fld):
            raise UnsafeExpressionError(f"unsupported placeholder {{{fld}}}")
        inner = [n for _, n, _, _ in string.Formatter().parse(spec or "") if n is not None]
        if any(n not in params or n in types for n in inner):
            raise UnsafeExpressionError(f"the format {spec!r} may only refer to params")
        spec = spec.format(**{n: params[n] for n in inner}) if spec else ""
        if fld in types:
            shown = pytext.formatted(F.col(fld), spec, conv) if spec or conv else pytext.text(F.col(fld), types[fld])
            parts.append(F.coalesce(shown, F.lit("None")))
        elif fld in params:
            parts.append(F.lit(("{0" + (f"!{conv}" if conv else "") + ":" + spec + "}").format(params[fld])))
        else:
            raise KeyError(fld)
    return F.concat(*parts) if parts else F.lit("")


def rule_frame(spark: SparkSession, rule: Rule, tables: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """The rule's query as a DataFrame (tables bound by name, ``:as_of`` bound)."""
    names = [n for _, n, _, _ in string.Formatter().parse(rule.query) if n]
    return spark.sql(rule.query, args={"as_of": as_of}, **{n: tables[n] for n in names})


def alerts(spark: SparkSession, rules, tables: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """One alert row per triggered row and known action:
    ``rule, action, message, text`` with text = ``[rule] message``."""
    out = None
    for rule in rules:
        df = rule_frame(spark, rule, tables, as_of)
        hit = df.where(compile_condition(rule.condition, df.schema, rule.params))
        for act in rule.actions:
            if act.type not in KNOWN_ACTIONS:
                continue
            msg = render(act.template, df.schema, rule.params)
            a = hit.select(F.lit(rule.name).alias("rule"), F.lit(act.type).alias("action"), msg.alias("message"))
            out = a if out is None else out.unionByName(a)
    if out is None:
        return spark.createDataFrame([], "rule string, action string, message string, text string")
    return out.withColumn("text", F.concat(F.lit("["), "rule", F.lit("] "), "message"))


def rule_report(spark: SparkSession, rules, tables: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """R5 report: rows and triggered per rule, both from one aggregate pass."""
    out = None
    for i, rule in enumerate(rules):
        df = rule_frame(spark, rule, tables, as_of)
        cond = compile_condition(rule.condition, df.schema, rule.params)
        r = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(cond, F.lit(False))).alias("triggered")) \
            .select(F.lit(i).alias("ord"), F.lit(rule.name).alias("name"), "rows", "triggered")
        out = r if out is None else out.unionByName(r)
    return out


def run_report(spark: SparkSession, rules, tables: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """The report with the total of triggered rows on every line (a row a rule, so
    the window over all of them is as long as the rule list)."""
    everything = Window.partitionBy(F.lit(0))
    return rule_report(spark, rules, tables, as_of) \
        .withColumn("total_triggered", F.sum("triggered").over(everything))


def store_alerts(spark: SparkSession, alerts_df: DataFrame, root: str, as_of: dt.date) -> int:
    """R7 sink: append the alert rows (with their evaluation day) to the alerts
    table; delivery to a messenger is outside this library."""
    from vitrine.sources import tables
    return tables.append(spark, root, alerts_df.withColumn("day", F.lit(as_of)))
