"""Filter audit against a direct simulation of all orders; tries against a dictionary."""

import itertools
import random
import re
from collections import Counter

from vitrine.llm import filter_audit

DOCS, LABELS = "doc_id bigint, lang string, text string", "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    low = {}
    for d, _, t in docs:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    rows = []
    for d, lang, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w),
                                             100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                             bool(re.search(r"[#$%&*|]", t)), d is not None and d > low[t])) if x}
        rows.append((lang or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, total = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone),
                            sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:9], total[r[0], r[9]]) for r in out)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "ÀB", "X", "NASA", "a#b", "ok"]
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 40, 99, 100, 300]))) for _ in range(n // 2)]
    texts += ["same long head " * 20 + str(i % 7) for i in range(n // 4)] + ["", None, "a", "ab", "a" * 700, "a" * 701, "ä" * 400]
    docs = [(r.choice([i, i, r.randrange(n)]), r.choice(["en", "de", "", None]), r.choice(texts)) for i in range(n)]
    docs += docs[:9] + [(None, "en", "a"), (None, "en", "a"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, n, 2)] + [(2, 1, 1), (None, 1, 1)]
    return docs, labels


def test_equals_simulation(spark):
    for seed, part_bytes in ((1, None), (2, 3000), (3, 1)):
        docs, labels = corpus(seed, 120)
        got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS), part_bytes)
        assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)


def test_boundaries_are_where_texts_branch(spark):
    texts = ["x" * 300 + c + str(i) for c in "abc" for i in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    cuts = filter_audit.boundaries(rows, 20_000)
    assert cuts == sorted(cuts) and len(cuts) >= 4 and any(c.startswith(b"x" * 300) for c in cuts)
    assert filter_audit.boundaries(rows.limit(0), 10) == []


def test_trie_holds_minimum_ids():
    r = random.Random(4)
    trie, want = filter_audit.RadixTrie(), {}
    for i in range(4000):
        t = bytes(r.choices(b"ab", k=r.randint(0, 9))) * r.choice([1, 1, 50])
        d = r.choice([None, r.randrange(1000)])
        trie.insert(t, d, t)
        old = want.get(t)
        want[t] = d if old is None else old if d is None else min(d, old)
    assert dict(trie.terminals()) == want


def test_common():
    for a, b in ((b"", b""), (b"a", b""), (b"abc", b"abd"), (b"x" * 99, b"x" * 98 + b"y"), (b"ab", b"abc")):
        assert filter_audit.common(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_empty_tables_and_extra_columns(spark):
    empty = filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.collect() == []
    docs = spark.createDataFrame([(1, "en", "a", 5, 6)], DOCS + ", mask int, part int")
    labels = spark.createDataFrame([(1, 1, 0, "x")], LABELS + ", copies string")
    assert [(r.kept, r.removed, r.good_lost) for r in filter_audit.audit(docs, labels).filter("step = 1 and filter_order like 'A%'").collect()] \
        == [(0, 1, 1)] * 24


def test_long_texts(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, "en", long), (2, "en", long + "x"), (3, "en", long)], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS), 1 << 20).filter("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.kept, r.removed) for r in got] == [(2, 1)]
