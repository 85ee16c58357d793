"""Chat formatting: the template language, and an exact round trip."""

import hashlib
import random

import pytest

from vitrine.llm import chat_format as c


def test_language():
    out, spans = c.render("{% set x = 'a' + 'b' %}{{ x | upper }}{% if 1 == 2 %}no{% elif not none %}yes{% else %}no{% endif %}"
                          "{% for m in messages %}{% if loop.first %}<{% endif %}{{ loop.index }}{{ m['role'] }}"
                          "{% if not loop.last %},{% else %}>{% endif %}{% endfor %}"
                          "{% generation %}{{ 'q' ~ ('' | default('z')) }}{% endgeneration %}!",
                          [{"role": "u", "text": ""}, {"role": "a", "text": ""}])
    assert out == "AByes<1u,2a>qz!" and spans == [(12, 14)]
    assert c.render("{{ m }}{{ messages.x }}", []) == ("", [])


def test_constants_fold():
    assert c.fold(c.parse("a{{ 'b' | upper }}{% if true and 'x' %}c{% else %}{{ y }}{% endif %}{% if false %}d{% endif %}")) == [("text", "aBc")]
    assert c.fold(c.parse("{{ y and ('p' + 'q') }}")) == [("put", ("and", ("name", "y"), ("const", "pq")))]


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if x %}", "{{ x.__class__() }}", "{{ x | eval }}", "{% import os %}",
                                 "{{ }}", "{{ 'a' 'b' }}", "{% endif %}", "{% set 1 = 2 %}", "{{ $ }}"])
def test_sandbox_refuses(bad):
    with pytest.raises(c.TemplateError):
        c.compile_template(bad)


def test_fields_stay_inside_messages():
    assert c.render("{{ m.__class__ }}{% for m in messages %}{{ m.__class__ }}{{ m.role.x }}{% endfor %}", [{"role": "u"}])[0] == ""


def conversations():
    r = random.Random(9)
    parts = ["\\", "###", "####", "</turn>", "</tu", "rn>", "\n", ": ", "### user: ", "é漢😀", "word ", "\\\\", "<", "#", ""]
    text = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
    rows = []
    for conv in range(40):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", None, "a:b\n\\c"]), r.choice([text(), text(), None])))
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, None, None, None), (None, 1, "assistant", "x"),
             (77, 1, "assistant", "long " * 50_000), (77, 0, "user", "</turn>" * 40_000)]
    return rows


def wanted(rows):
    low = lambda x: (x is not None, x)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    out = {}
    for conv, turns in by.items():
        turns = [(role or "", text or "") for _, role, text in sorted(turns, key=lambda t: tuple(map(low, t)))]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = c.render(c.TEMPLATE, [{"role": a, "text": t} for a, t in turns])[0]
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    return out


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_round_trip(spark, segment):
    rows = conversations()
    table = spark.createDataFrame([(*x, "t") for x in rows], "conv_id bigint, turn bigint, role string, text string, segment string").repartition(3)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.formatted_chars)
           for x in c.read_back(c.format_conversations(table, segment=segment)).collect()}
    assert got == wanted(rows)
    assert c.read_back(c.format_conversations(table.limit(0))).count() == 0
