"""Repeated passages against a brute-force version."""

import hashlib
import random
from collections import Counter

from vitrine.llm import repeats


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in repeats.remove(docs, length).collect()}
    assert len(rows) == len(texts)
    return [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))]


def corpus(seed, n, alphabet, words):
    r = random.Random(seed)
    passages = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 90))) for _ in range(words)]
    texts = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < .4 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
                 for _ in range(r.randint(0, 7))]
        texts.append("".join(parts))
    return texts


def test_equals_brute_force(spark):
    for seed, alphabet, length in ((1, "abcdefgh é", 24), (2, "ab", 30), (3, "xyzé漢", 13)):
        texts = corpus(seed, 60, alphabet, 12)
        texts += [texts[5], texts[6], texts[6], None, "", "a" * 200, "ab" * 90, "short"]
        assert run(spark, texts, length) == brute(texts, length), (seed, length)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    monkeypatch.setattr(repeats, "FLUSH", 100)
    monkeypatch.setattr(repeats, "FRAGMENT", 150)
    texts = corpus(4, 25, "abcd", 6) + ["".join(corpus(5, 20, "abcd", 6))]
    assert run(spark, texts, 24) == brute(texts, 24)


def test_production_length(spark):
    r = random.Random(7)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, edge = prose(90), prose(120)[:399]
    texts = [prose(150) + passage + prose(30), passage + prose(40), prose(20) + edge + "Q", "R" + edge, edge, prose(200)]
    got = run(spark, texts, repeats.LENGTH)
    assert got == brute(texts, repeats.LENGTH)
    assert got[0][1] >= 400 and got[4][1] == 0 and got[5][1] == 0


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, text_key string, part int")
    assert repeats.remove(empty).count() == 0
    docs = spark.createDataFrame([(None, "b" * 500, "x", 1), (None, "b" * 500, "y", 2), (3, None, None, None)],
                                 "doc_id bigint, text string, text_key string, part int")
    rows = repeats.remove(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in rows) == [(0, 500, 1), (0, 500, 1), (3, 0, 0)]


def test_passages_of_both_sides_of_the_length(spark):
    """Shared passages of 50 to 120 words, from 250 to 900 bytes: removed from 400 bytes on, whatever the partitions."""
    import random
    r = random.Random(7)
    word = lambda n: "".join(r.choices("abcdefghij", k=n))
    rows, want = [], {}
    for g in range(12):
        passage = " ".join(word(r.randint(3, 9)) for _ in range(r.randint(50, 120)))
        for k in range(2):
            i = 2 * g + k
            head, tail = (" ".join(word(8) for _ in range(40)) for _ in range(2))
            rows.append((i, f"{head}{'AB'[k]}#{passage}#{'AB'[k]}{tail}"))
            want[i] = len(passage) + 2 if len(passage) + 2 >= 400 else 0
    for parts in (1, 5, 37):
        got = repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()
        assert {x.doc_id: x.n_removed for x in got} == want
        for x in got:
            assert len(x.kept_text.encode()) == x.n_bytes - x.n_removed
    assert 0 < sum(v > 0 for v in want.values()) < len(want)
