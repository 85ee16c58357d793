"""Near duplicates against all pairs; sketches against their similarity."""

import numpy as np
import pytest
from test_jaccard_join import corpus, shingles

from vitrine.llm import near_dedup

SCHEMA = "doc_id bigint, text string"


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(corpus(seed, 250) + ["", " \n", "a", "a", "A b", None])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in near_dedup.dedup(docs).collect()) == brute(rows)


def test_every_coordinate_is_filled_and_agrees_as_often_as_sets_do():
    r = np.random.default_rng(1)
    s = near_dedup.Sketcher()
    for n in (1, 2, 7, 100, 5000):
        base = r.integers(0, 2**63, n + n // 5 + 1, dtype=np.uint64)
        a, b = base[:n], base[n // 5:][:n]
        x = s.sketches([a, b, np.sort(a)])
        assert (x != 2**64 - 1).all() and (x[0] == x[2]).all()
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x[0] == x[1]).mean() - exact) < .15


def test_sketches_do_not_depend_on_their_neighbours():
    r = np.random.default_rng(2)
    s, sets = near_dedup.Sketcher(), [r.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 900, 40)]
    together = s.sketches(sets)
    assert all((together[i] == s.sketches([x])[0]).all() for i, x in enumerate(sets))


def test_nulls_repeats_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (9, text + " more", 4), (None, None, 5), (None, "one word", 6), (7, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node int").withColumnRenamed("node", "component_id")
    got = sorted((tuple(r) for r in near_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(5, 56, 5, True), (5, 56, 5, True), (None, 56, 5, False), (9, 57, 5, False), (None, 0, None, True),
                          (None, 1, None, True), (7, 0, 7, True)], key=str)


def test_empty_table(spark):
    assert near_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    words = [f"word{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[100_000:]))]
    got = {r.doc_id: r.component_id for r in near_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 100] + [f"x{i}"] + base[i % 100 + 1:])) for i in range(300)]
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert {r.component_id for r in near_dedup.dedup(docs).collect()} == {0}
