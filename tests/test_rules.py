import datetime as dt
import decimal
import json
import struct

import pytest
from pyspark.sql import functions as F

from vitrine.functions import pytext
from vitrine.operators import rules
from vitrine.operators.rules import Rule, RuleAction, UnsafeExpressionError, compile_condition


def test_one_of_two_rows_triggers(spark):
    df = spark.createDataFrame([("sku-1", 2), ("sku-2", 10)], "sku string, stock_end bigint")
    rule = Rule("low", "SELECT * FROM {t}", 'row.get("stock_end", 0) < params.get("threshold", 5)',
                [RuleAction("telegram", "Low stock: {sku}, stock={stock_end}"), RuleAction("pager", "ignored")],
                {"threshold": 5})
    out = rules.alerts(spark, [rule], {"t": df}, None).collect()
    assert [(r.rule, r.action, r.message, r.text) for r in out] == \
        [("low", "telegram", "Low stock: sku-1, stock=2", "[low] Low stock: sku-1, stock=2")]
    rep = rules.rule_report(spark, [rule], {"t": df}, None).collect()[0]
    assert (rep.name, rep.rows, rep.triggered) == ("low", 2, 1)


@pytest.mark.parametrize("expr", ["__import__('os').system('x')", "open('f')", "row.__class__",
                                  "lambda: 1", "[x for x in row]", "row.get('a', 0).bit_length()", "exec('1')",
                                  "row['a'] is 1", "{**params}", "max(row['a'], key=abs)"])
def test_unsafe_expressions_rejected(spark, expr):
    schema = spark.createDataFrame([(1,)], "a int").schema
    with pytest.raises(UnsafeExpressionError):
        compile_condition(expr, schema, {})


ROWS = [(1, 0.5, "abc", None), (-7, 2.0, "", 3), (0, -1.5, "x", 0), (10, 0.0, "0", -4)]
EXPRS = [
    "row['a'] > 0 and row['b'] < 1",
    "row['a'] // 2 == -4 or row['a'] % 3 == 2",
    "abs(row['a']) >= 7 if row['b'] else min(row['a'], 3) == 0",
    "not row['c']",
    "row['c'] in ('abc', 'x')",
    "row['a'] not in [0, 1]",
    "len(row['c']) == 1",
    "row['d'] is None",
    "row.get('zz', 5) == 5 and params.get('k', 1) == 2",
    "round(row['b']) == 2",
    "max(row['a'], 2) * 2 ** 2 > 10",
    "1 < row['a'] <= 10",
    "bool(row['b']) and str(row['a']) != '0'",
    "int(row['b']) == -1 or float(row['a']) == 10.0",
    "{'x': 1}.get(row['c'], 0) == 1",
    "round(row['b'] * 3.3, ndigits=1) > 1.6",
    "max([row['a'], 2, row['a'] * 2]) > 3",
    "min((row['a'],)) < 1",
    "(row['a'] > 0) is True",
    "(row['a'] > 0) is not False and row['d'] is not None",
    "row['a'] is True",
]


@pytest.mark.parametrize("expr", EXPRS)
def test_compiled_condition_matches_python(spark, expr):
    df = spark.createDataFrame(ROWS, "a int, b double, c string, d int")
    params = {"k": 2}
    cond = compile_condition(expr, df.schema, params)
    got = [r[0] for r in df.select(F.coalesce(cond, F.lit(False))).collect()]
    want = []
    for a, b, c, d in ROWS:
        row = {"a": a, "b": b, "c": c, "d": d}
        try:
            want.append(bool(eval(expr, {"__builtins__": {"min": min, "max": max, "abs": abs, "round": round,  # noqa: S307
                                                          "int": int, "float": float, "len": len, "bool": bool,
                                                          "str": str}}, {"row": row, "params": params})))
        except TypeError:
            want.append(False)  # a NULL operand: Python raises, the Column form does not trigger
    assert got == want, expr


EXACT = [(2 ** 53 + 1, 3, "12", 2.5), (-(2 ** 62) - 1, 7, " -7 ", -2.5), (2 ** 63 - 1, -2, "1.5", 1e17),
         (0, 5, "x", 0.0), (9007199254740995, -5, "9007199254740993", -0.5)]
EXACT_EXPRS = [
    "int(row['n']) == 9007199254740993", "row['n'] // row['k'] == 3002399751580331", "row['n'] % row['k'] == 2",
    "row['n'] % row['k'] < 0", "row['n'] // row['k'] < -1", "int(row['t']) == 12", "int(row['t']) == 9007199254740993",
    "int(row['t']) < 0", "int(row['x']) == 2", "int(row['x']) == 100000000000000000", "int(row['x']) == 0",
    "row['t'] in ['12', 7, None, True]", "row['k'] in ['3', 3, 2.5]", "row['k'] not in ['3', 7.0]",
    "row['t'] in params.get('mixed')", "row['k'] in params.get('mixed')", "row['t'] == 12", "row['t'] != 12",
    "(row['k'] > 4) == 1", "str(row['x']) == '1e+17'", "str(row['k'] > 4) == 'True'", "-row['k'] // 2 == -2"]


@pytest.mark.parametrize("expr", EXACT_EXPRS)
def test_integers_exact_and_lists_mixed(spark, expr):
    df = spark.createDataFrame(EXACT, "n bigint, k bigint, t string, x double")
    params = {"mixed": ["12", 3, 2.0]}
    got = [r[0] for r in df.select(F.coalesce(compile_condition(expr, df.schema, params), F.lit(False))).collect()]
    want = []
    for n, k, t, x in EXACT:
        try:
            want.append(bool(eval(expr, {"__builtins__": {"int": int, "str": str}},  # noqa: S307
                                  {"row": {"n": n, "k": k, "t": t, "x": x}, "params": params})))
        except (TypeError, ValueError):
            want.append(False)
    assert got == want, expr


def test_order_of_text_and_number_and_mixed_list_values_are_refused(spark):
    schema = spark.createDataFrame([(1, "a")], "a int, c string").schema
    for expr in ("row['c'] < 3", "len([1, 'a']) == 2"):
        with pytest.raises(UnsafeExpressionError):
            compile_condition(expr, schema, {})


def test_integer_overflow_does_not_trigger(spark):
    df = spark.createDataFrame([(2 ** 63 - 1,), (1,)], "a bigint")
    cond = compile_condition("row['a'] + row['a'] > 0 and row['a'] * 4 > 0", df.schema, {})
    assert [r[0] for r in df.select(F.coalesce(cond, F.lit(False))).collect()] == [False, True]


def test_numbers_are_written_as_their_shortest_text(spark):
    import random
    rnd = random.Random(5)
    values = [0.0, -0.0, 0.1, 1e16, 9999999999999998.0, 1e-4, 9.9e-5, 2e-3, 1e7, 12345678.9, 1e22, 1e23, 5e-324,
              1.7976931348623157e308, 2.0 ** 60, 1 / 3, 100.0, -123456.5, float("nan"), float("inf"), float("-inf")]
    values += [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(500)]
    values += [round(rnd.uniform(-1e6, 1e6), rnd.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = dict(df.select("i", pytext.double_text(F.col("v"))).collect())
    assert {i: got[i] for i, v in enumerate(values)} == {i: str(v) for i, v in enumerate(values)}


def test_templates_with_formats_equal_python(spark):
    row = {"s": "ab", "i": 1234567, "x": 2.675, "h": 0.125, "m": decimal.Decimal("12.30"), "b": True,
           "d": dt.date(2024, 1, 5), "t": dt.datetime(2024, 1, 5, 10, 0, 0, 500000)}
    df = spark.createDataFrame([tuple(row.values())],
                               "s string, i bigint, x double, h double, m decimal(18,2), b boolean, d date, t timestamp_ntz")
    params = {"w": 9, "p": 0.256}
    for template in ("{s}|{i}|{x}|{m}|{b}|{d}|{t}", "{x:.2f}|{h:.2f}|{h:.1%}|{i:,d}|{i:>12}|{s:^6}|{s!r}|{m:.1f}|{x:e}",
                     "{i:0{w}d}|{p:.1%}|{p}|{{x}}", "{d:%d.%m.%Y}"):
        got = df.select(rules.render(template, df.schema, params)).collect()[0][0]
        assert got == template.format(**row, **params), template


def test_formats_of_null_and_unfit_values_are_plain_text(spark):
    df = spark.createDataFrame([(None, "abc")], "x double, s string")
    assert df.select(rules.render("{x:.2f}|{s:d}|{x}", df.schema, {})).collect()[0][0] == "None|abc|None"
    for template in ("{s.__class__}", "{s[0]}", "{x:{s}}"):
        with pytest.raises(UnsafeExpressionError):
            rules.render(template, df.schema, {})


def test_rule_files_load_in_path_order_and_report_totals(spark, tmp_path):
    q = "SELECT * FROM {t}"
    files = {"b_two.json": {"name": "two", "query": q, "condition": 'row["v"] > params["least"]', "params": {"least": 2},
                            "actions": [{"type": "log", "template": "{v}"}]},
             "a_one.json": {"name": "one", "query": q}, "notes.txt": {"name": "no", "query": q}}
    for name, raw in files.items():
        (tmp_path / name).write_text(json.dumps(raw, indent=1))
    loaded = rules.load_rules(spark, str(tmp_path))
    assert [(r.name, r.condition, r.params) for r in loaded] == [("one", "True", {}),
                                                                 ("two", 'row["v"] > params["least"]', {"least": 2})]
    df = spark.createDataFrame([(i,) for i in range(5)], "v int")
    rep = rules.run_report(spark, loaded, {"t": df}, None).orderBy("ord").collect()
    assert [(r["name"], r["rows"], r["triggered"], r["total_triggered"]) for r in rep] == [("one", 5, 5, 7), ("two", 5, 2, 7)]
    assert [r.message for r in rules.alerts(spark, loaded, {"t": df}, None).orderBy("message").collect()] == ["3", "4"]


def test_stored_rules_read_back_and_bad_files_are_refused(spark, tmp_path):
    rules.store_rules(spark, rules.BUILTIN_RULES[::-1], str(tmp_path / "r"))
    assert rules.load_rules(spark, str(tmp_path / "r")) == list(rules.BUILTIN_RULES)
    (tmp_path / "bad.json").write_text('{"name": "x"}')
    with pytest.raises(ValueError, match="a name and a query"):
        rules.load_rules(spark, str(tmp_path / "bad.json"))


def test_yaml_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yml").write_text("name: y\nquery: SELECT * FROM {t}\ncondition: row['v'] == 1\nparams:\n  a: 1\n")
    assert rules.load_rules(spark, str(tmp_path)) == [Rule("y", "SELECT * FROM {t}", "row['v'] == 1", [], {"a": 1})]
