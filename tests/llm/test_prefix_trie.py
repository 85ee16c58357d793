"""Prefix trie against the definition, node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vitrine.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, u, r, x in rows:
        turns[c].append(((u is not None, u or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        source = turns.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), []) if c is not None else []
        rebuilt[c] = source[:h] + own[h:]
    nodes, kids, saved, leaves = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += k not in kids

    def least(k):
        return min((c for c in nodes[k] if c is not None), default=None)

    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if c is not None and len(rebuilt[c]) == len(k))))
        out.append((least(k), len(k), least(k[:-1]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_equals_definition(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-8, 40), 10**12, None]:
        if r.random() < .9:
            rows += [(c, r.choice([i, i, i, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None]))
                     for i in range(r.choice([1, 2, 5, 9, 12, 30]))]
    assert run(spark, rows) == brute(rows)


def test_copies_and_truncations(spark):
    rows = [(c, i, "u", "x") for c, n in ((100, 24), (201, 22), (305, 24), (406, 24), (512, 3), (513, 3)) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_long_private_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = [(3, i, "u", f"turn {i}") for i in range(400)] + [(5, 0, "u", "hi"), (6, 0, "u", "hi")]
    assert run(spark, rows, 4) == brute(rows)


def test_turnless_and_empty(spark):
    # 1's h is 7: its own turns end before, its source 0 is absent
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b")]
    assert zlib.crc32(b"1") % 9 > 2 or run(spark, rows) == brute(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_extra_columns_and_long_texts(spark):
    text = "ä" * 1_000_000
    rows = [(5, 0, "u", text), (10, 0, "u", text), (10, 1, "u", "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth int, part int")
    assert sorted((tuple(r) for r in prefix_trie.trie(docs).collect()), key=str) == brute(rows)


def test_many_ends_are_joined_from_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 5)
    rows = [(c, 0, "u", "same") for c in range(0, 400, 5)]
    assert run(spark, rows) == brute(rows)
