"""Quality rules: measures against a brute-force version, verdicts on labels."""

import random
import re

from vitrine.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_measures_equal_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e f g", "a b c d e f g h", "a " * 40, "x y " * 30, "é漢 | b\x0bc\x0c.\r\n"]
    for _ in range(150):
        texts.append("".join(r.choice(["a", "b ", "c\n", " ", "é. ", "#", "<", "w1 ", "w2 ", "w3 w4 w5 ", "\t", " ", "\x85"])
                             for _ in range(r.randint(0, 120))))
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, m string")
    rows = {x.doc_id: x for x in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == measures(t), repr(t)
        assert not (x.base_failed and x.kept)


def test_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(junk) <= 0.2 * len(junk)


def test_clean_removes_lines_and_keeps_columns(spark):
    prose = " ".join(f"word{i}" for i in range(40)) + "."
    docs = spark.createDataFrame(
        [(1, prose + "\nHome | News | Sport | Contact\nWe use cookies to improve this site.", "x", 3, 9),
         (2, "Home | News | Sport | Contact | " * 8, "x", 3, 9), (3, None, None, None, None), (4, prose, "x", 3, 9)],
        "doc_id bigint, text string, `__quality` string, n_chars bigint, n_words int")
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(out) == {1, 4} and quality.clean(docs).columns == docs.columns
    assert out[1].text == prose and out[1].n_chars == len(prose) and out[4].text == prose
    assert quality.clean(docs.limit(0)).count() == 0
