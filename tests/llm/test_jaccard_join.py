"""N-gram Jaccard join against all pairs."""

import random
import re

from vitrine.llm import jaccard_join
from vitrine.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["É", "naïve", "A.b", "x y"]
    prose = lambda k: [r.choice(words) for _ in range(k)]
    passages = [prose(r.randint(10, 40)) for _ in range(4)]
    bases = [prose(r.randint(1, 120)) for _ in range(8)]
    out = []
    for _ in range(n):
        if r.random() < .7:
            w = list(r.choice(bases))
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = r.choice(passages) + prose(r.randint(0, 15)) + r.choice(passages)
        text = r.choice([" ", "\n", " \t"]).join(w)
        out.append(text.upper() if r.random() < .1 else text)
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(tuple(r) for r in got)


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FRAGMENT_SHINGLES", 800)
    monkeypatch.setattr(jaccard_join, "FLUSH_SHINGLES", 500)
    for seed in (1, 2):
        texts = corpus(seed, 150) + [None, "", " \t", "one", "one", "a b c d", "A B c d", "x " * 400]
        rows = list(enumerate(texts))
        assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (2, text + " end", 4), (None, "z", 5)],
                                 "doc_id bigint, text string, node int")
    got = sorted(((r.doc_id or -1, r.component_id) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (-1, 2), (2, 2), (-1, None)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1] or i in got}


def test_segments_room_does_not_grow_with_the_fragments():
    """Many small sets cut into many fragments take room for their shingles, not for sets times fragments."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = [f"text number {i}" for i in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    whole, jaccard_join.id_text = jaccard_join.id_text, lambda docs: docs
    try:
        run = jaccard_join.segments(Rows(), 2000)
        tracemalloc.start()
        out = list(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        jaccard_join.id_text = whole
    assert sum(len(x) // 8 for b in out for x in b.column("hashes").to_pylist()) == len(texts)
    assert peak < 200e6
