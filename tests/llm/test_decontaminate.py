"""Containment search against exact containment of all pairs."""

import random
import re

from vitrine.llm import decontaminate

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        s = shingles(t)
        for i, q in items:
            q = shingles(q)
            if q and len(q & s) >= 0.75 * len(q):
                out.add((d, i, len(q), len(q & s)))
    return out


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)] + ["été", "Größe"]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [prose(n) for n in (1, 3, 4, 5, 6, 9, 12, 20, 30, 40, 55, 70, 130, 400)]
    docs = []
    for n in list(range(0, 60, 7)) + [80, 200, 900, 4000]:
        for item in items:
            part = list(item)
            if r.random() < .4:
                part = part[:max(1, int(len(part) * r.uniform(.5, 1)))]
            w = prose(n)
            at = r.randint(0, n)
            text = " ".join(w[:at]) + r.choice([". ", "\n", " ### ", " ("]) + " ".join(part) + r.choice([".", ") ", "\n"]) + " ".join(w[at:])
            docs.append(text.upper() if r.random() < .2 else text)
    return list(enumerate(docs + ["", None, docs[7], " ".join(items[0])])), \
        [(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, " ".join(items[8]))]


def test_equals_all_pairs(spark):
    docs, items = corpus()
    found = decontaminate.leaks(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, item_id int").repartition(4),
                                spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, band int"))
    got = [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_without_leaks(spark):
    docs, items = corpus()
    rows = [(None if d % 9 == 0 else d, t, "x") for d, t in docs]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, `__text_key` string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.without_leaks(table, bench)
    bad = {docs[d][1] for d, *_ in brute(docs, items)}
    want = sorted((str(d), str(t)) for d, t, _ in rows if t not in bad)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want


def test_empty_tables(spark):
    docs, items = corpus()
    some = spark.createDataFrame(docs[:30], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(some, none).count() == 0
    assert decontaminate.without_leaks(some, none).count() == 30
    assert decontaminate.leaks(some.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_bands():
    for u in decontaminate.PARTITIONS:
        sizes = [decontaminate.bands(q, u) for q in range(1, 300)]
        assert sizes == sorted(sizes, reverse=True)
    assert decontaminate.bands(8, 8) < decontaminate.bands(8, 64)
