import datetime as dt

from pyspark.sql import functions as F

from conftest import recs
from vitrine.functions.values import Fields, parse_text_ts, parse_ts, safe_int, safe_money


def _eval(spark, docs, build):
    f = Fields()
    expr = build(f)
    return [r[0] for r in f.stage(recs(spark, docs)).select(expr).collect()]


def test_truthiness_distinguishes_number_and_string(spark):
    docs = [{"a": 0}, {"a": "0"}, {"a": ""}, {"a": []}, {"a": {}}, {"a": None}, {}, {"a": False},
            {"a": 0.0}, {"a": 2}, {"a": [0]}, {"a": {"b": 1}}, {"a": True}]
    got = _eval(spark, docs, lambda f: f.truthy("a"))
    assert got == [bool(d.get("a")) for d in docs]


def test_first_truthy_takes_first_truthy_alias(spark):
    docs = [{"x": 0, "y": 5}, {"x": "0", "y": 5}, {"x": None, "y": None}, {"y": "t"}]
    got = _eval(spark, docs, lambda f: F.try_variant_get(f.first(("x", "y")).v, "$", "string"))
    assert got == ["5", "0", None, "t"]


def test_safe_int_follows_python_int(spark):
    docs = [{"a": "12.0"}, {"a": 12.7}, {"a": -12.7}, {"a": " 7 "}, {"a": True}, {"a": None}, {"a": [1]},
            {"a": "x"}, {"a": 3}]
    got = _eval(spark, docs, lambda f: safe_int(f.get("a"), -1))
    assert got == [-1, 12, -12, 7, 1, -1, -1, -1, 3]


def test_safe_money_accepts_text_and_numbers(spark):
    from decimal import Decimal
    docs = [{"a": "1499.00"}, {"a": 12.5}, {"a": "bad"}, {}, {"a": {"v": 1}}]
    got = _eval(spark, docs, lambda f: safe_money(f.get("a")))
    assert got == [Decimal("1499.00"), Decimal("12.50"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00")]


def test_iso_timestamps_become_utc_wall_time(spark):
    docs = [{"a": "2026-03-01T10:15:00Z"}, {"a": "2026-03-01T10:15:00+03:00"}, {"a": "2026-03-01T10:15:00"},
            {"a": "2026-03-01"}, {"a": "20260301T101500Z"}, {"a": ""}, {"a": "garbage"}, {"a": 5}]
    got = _eval(spark, docs, lambda f: parse_ts(f.get("a")))
    assert got == [dt.datetime(2026, 3, 1, 10, 15), dt.datetime(2026, 3, 1, 7, 15), dt.datetime(2026, 3, 1, 10, 15),
                   dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 1, 10, 15), None, None, None]


def test_out_of_range_numbers_do_not_fail_the_job(spark):
    from vitrine.operators import normalize as N
    docs = [{"srid": "x", "quantity": 1e20, "nmId": 1e30, "forPay": 1e30},
            {"srid": "y", "quantity": -9223372036854775808}]
    rows = {r.srid: r for r in N.wb_sales(recs(spark, docs), "r", "a").collect()}
    # beyond BIGINT: the default (1), as for any value int() cannot store
    assert rows["x"].quantity == 1 and rows["x"].nm_id == 0 and float(rows["x"].price_rub) == 0.0
    assert rows["y"].quantity is None and rows["y"].is_return == 1


def test_value_rules_match_python_on_random_json(spark):
    import json
    import random
    from decimal import Decimal

    from vitrine.functions.values import safe_float

    rnd = random.Random(11)

    def value():
        k = rnd.randrange(9)
        return [lambda: rnd.randrange(-50, 50), lambda: round(rnd.uniform(-100, 100), rnd.randrange(0, 3)),
                lambda: str(rnd.randrange(-50, 50)), lambda: f"{rnd.uniform(-9, 9):.2f}", lambda: "",
                lambda: rnd.choice([True, False]), lambda: None, lambda: [0] * rnd.randrange(2),
                lambda: {"a": 1} if rnd.random() < 0.5 else {}][k]()

    vals = [value() for _ in range(300)]
    docs = [{"a": v} for v in vals]

    def py_int(v, d=-1):
        try:
            return int(v)
        except (TypeError, ValueError):
            return d

    def py_float(v, d=0.0):
        try:
            return float(v)
        except (TypeError, ValueError):
            return d

    f = Fields()
    cols = [f.truthy("a").alias("t"), safe_int(f.get("a"), -1).alias("i"), safe_float(f.get("a")).alias("x"),
            safe_money(f.get("a")).alias("m")]
    rows = f.stage(recs(spark, docs)).select(*cols).collect()
    for v, r in zip(vals, rows):
        assert r.t == bool(v), (v, r)
        assert r.i == py_int(v), (v, r)
        assert r.x == py_float(v), (v, r)
        want_m = Decimal(str(py_float(v))).quantize(Decimal("0.01")) if not isinstance(v, bool) else Decimal(int(v))
        assert r.m == want_m, (json.dumps(v), r)


def test_time_without_a_date_is_no_timestamp(spark):
    df = spark.createDataFrame([("T10:00",), ("10:00:00",), ("2026-03-01T10:00",), ("20260301T101500Z",), ("",)], "s string")
    got = [r[0] for r in df.select(parse_text_ts(F.col("s"))).collect()]
    assert [x is None for x in got] == [True, True, False, False, True]


def test_numbers_of_every_spelling_and_nested_paths(spark):
    """Values are read from the text of a field: exponents, decimals, booleans, and paths that share a parent."""
    from vitrine.functions.values import as_text, safe_float
    docs = [{"a": {"x": 1e3, "y": True}, "b": "1e3"}, {"a": 12.345, "b": False}, {"a": {"y": {"z": 0}}, "b": 10**30}, {"a": [], "b": [1]}]
    f = Fields()
    cols = [safe_money(f.get("a.x")), safe_int(f.first(("a.y", "b"))), safe_money(f.get("a")), safe_float(f.get("b")),
            as_text(f.get("a.y.z")), f.truthy("a")]
    rows = [tuple(r) for r in f.stage(recs(spark, docs)).select(*cols).collect()]
    assert [float(r[0]) for r in rows] == [1000.0, 0.0, 0.0, 0.0]
    assert [r[1] for r in rows] == [1, 0, 0, 0]
    assert [float(r[2]) for r in rows] == [0.0, 12.35, 0.0, 0.0]
    assert [r[3] for r in rows] == [1000.0, 0.0, 1e30, 0.0]
    assert [r[4] for r in rows] == [None, None, "0", None] and [r[5] for r in rows] == [True, True, True, False]


def test_a_path_is_read_by_one_cast_of_its_record(spark):
    f = Fields()
    cols = [safe_int(f.get(k)) for k in ("a", "b", "c")]
    plan = f.stage(recs(spark, [{"a": 1}])).select(*cols)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(a,VariantType") == 1 and plan.lower().count("parsejson") == 1
