"""Secret scans: base spans against plain patterns, learnt formats on held-out strings."""

import hashlib
import random
import re

from vitrine.llm import grammar, queries, secret_scan

PATTERNS = [
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [(name, s, e) for s, _, name, e in sorted(found)]


def corpus():
    r = random.Random(5)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    keys = lambda n: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    out = ["", None, "token=abcdef", "TOKEN : 'abc", "ſecret=abcdefg", "toKen=abcdefg", "é password: \"x-/+=._9\" z",
           "AKIAAKIA" + "A" * 13, "AKIA" + "B" * 15, "a" * 23 + "g", "a" * 24, "api_key=" + keys(16), "token=token=abcdef",
           "passwd=" + "0" * 24 + "apikey: " + "f" * 30, "secret='" + keys(20) + "'token=" + hexes(40)]
    for _ in range(150):
        out.append(" ".join(r.choice(["Words", "and", "é漢", "token", "=", ":", "secret=", "password: ", hexes(40), hexes(23), keys(16),
                                      keys(12), "api_key", '"', "notasecretbutlongprose"]) for _ in range(r.randint(1, 25))))
    return out


def test_base_spans_equal_patterns(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    docs.drop("spans").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op2_secret_scans(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = [f"{k}:{s}:{e}" for k, s, e in base(t)]
        got = [x for x in rows[i].spans.split(",") if x]
        assert [x for x in got if not x.startswith("format")] == want, repr(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k, _, _ in PATTERNS)
        assert len(got) == len(want) + rows[i].n_format


def test_redact(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, len(t or ""), 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint, kind int")
    out = secret_scan.redact(docs, secret_scan.fit(docs))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(rows) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].text is None
        else:
            assert not base(rows[i].text) and rows[i].n_chars == len(rows[i].text)
            if not base(t) and "AKIA" not in t and not re.search("[0-9a-f]{16}", t):
                assert rows[i].text == t


def test_formats_generalise():
    r = random.Random(2)
    key = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    hex40 = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    prose = lambda: "".join(r.choice(["the", "ing", "er", "on", "tion", "al", "re"]) for _ in range(r.randint(5, 9)))
    formats = secret_scan.train({0: [], 1: [key() for _ in range(300)], 2: [hex40() for _ in range(300)], 3: [prose() for _ in range(300)]})
    found = [formats.likely(key()) for _ in range(200)] + [formats.likely(hex40()) for _ in range(200)]
    wrong = [formats.likely(prose()) for _ in range(200)]
    assert sum(found) >= 0.85 * len(found) and not any(wrong)


def test_inference_merges_states():
    values = ["ab" * n for n in range(1, 12) for _ in range(40 >> min(n, 5))]
    learnt = grammar.infer(values)
    assert len(learnt.steps) < 24
    assert learnt.score(grammar.classes("abab")) > learnt.score(grammar.classes("abababab"))
    assert grammar.infer([]) is None


def test_no_credentials(spark):
    docs = spark.createDataFrame([(1, "plain words only"), (1, "plain words only"), (None, None)], "doc_id bigint, text string")
    formats = secret_scan.fit(docs)
    assert [r.spans for r in secret_scan.scan(docs, formats).collect()] == [[], [], []]
    assert secret_scan.scan(docs.limit(0), formats).count() == 0


def test_candidates_beside_base_spans_and_short(spark):
    """A token around a base span and a bare value of a short format are scored too."""
    r = random.Random(6)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    long = lambda: f"sk_{pick(upper, 6)}_{pick('0123456789abcdef', 24)}_{pick(upper, 6)}"
    short = lambda: f"{pick(upper, 2)}-{pick('0123456789', 6)}"
    words = lambda n: sorted({pick(lower, r.randint(6, n)) for _ in range(300)})
    formats = secret_scan.train({0: [long() for _ in range(150)] + [short() for _ in range(150)],
                                 3: [w + pick(lower, 10) for w in words(20)], 4: words(15)})
    values = [long(), short()]
    texts = [f"see {v}, and {pick(lower, 11)}" for v in values]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in secret_scan.scan(docs, formats).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, formats).collect()}
    for i, v in enumerate(values):
        assert ("format", 4, 4 + len(v)) in spans[i] and clean[i] == texts[i].replace(v, "[secret]")


def test_quantile_counts_refused_values():
    """A format leaves out no more than QUANTILE of its own held-out examples, also those that the automaton has not seen."""
    r = random.Random(9)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    sign = lambda: r.choice("+/_.=-")
    values = [pick("ABCDEF", r.randint(1, 12)) + sign() + pick("0123456789", r.randint(1, 12)) + sign() + pick("abcdef", 3)
              for _ in range(200)]
    formats = secret_scan.train({0: values, 3: [pick("abcdefghijklmnopqrstuvwxyz", 18) for _ in range(300)]})
    (automaton, least), = formats.automata
    held = [automaton.score(s) / len(s) for s in map(grammar.classes, values[::5])]
    assert sum(x < least for x in held) <= secret_scan.QUANTILE * len(held)
