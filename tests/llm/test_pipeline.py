"""The pipeline against a chain of brute-force versions of its stages."""

import os
import random
import sys

import numpy as np
import public_tokenizers as P
import zlib

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import test_decontaminate  # noqa: E402
import test_jaccard_join  # noqa: E402
import test_quality_rules  # noqa: E402
import test_secret_scan  # noqa: E402
from vitrine.llm.tokens import ByteEncoder  # noqa: E402


def corpus():
    r = random.Random(21)
    words = [f"word{i}" for i in range(900)] + ["été", "Größe"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    items = [(k, prose(r.randint(8, 40))) for k in range(6)]
    rows = []
    for i in range(60):
        text = "\n".join(prose(r.randint(15, 60)) for _ in range(r.randint(1, 4)))
        if i % 8 == 0:
            text += " token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + "\" " + prose(5)
        if i % 6 == 0:
            text += "\nHome | News | Sport | Contact | About"
        if i % 7 == 0:
            text += "\n" + items[i % 6][1]
        rows.append(text)
    near = rows[3].split(" ")
    near[4] = "changed"
    rows += [rows[1], rows[1], rows[2], " ".join(near) if len(near) > 60 else rows[3] + " end.", "a | b | c | d | " * 12, "short.", None, "",
             "x y z. " * 40]
    table = [(i, t, "en", f"src{i % 3}", len(t or ""), i) for i, t in enumerate(rows)]
    table += [table[1], (None, rows[9] + " null id.", "en", None, None, None)]
    return table, items


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key bigint"


def test_stages_in_order(spark, tmp_path):
    table, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        results.append(docs.collect())
        if k < 4:
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    plain = lambda rows: sorted(((r[0] is None, r[0] or 0, r[1]) for r in rows))

    base = [r for r in table if not test_quality_rules.measures(r[1])[5]]
    cleaned = {r[5]: r for r in results[0]}
    assert {r[5] for r in base} == set(cleaned)
    for r in base:
        assert cleaned[r[5]].text == r[1].replace("\nHome | News | Sport | Contact | About", "")
        assert r[0] is None or cleaned[r[5]].n_chars == len(cleaned[r[5]].text)

    rows = [(10_000 if r.doc_id is None else r.doc_id, r.text) for r in results[0]]
    names = {}
    for doc_id, _, component in test_jaccard_join.brute(rows):
        names.setdefault(component, []).append(doc_id)
    kept = {10_000 if r.doc_id is None else r.doc_id for r in results[1]}
    assert kept == set(names) and len(results[1]) == len(names)

    bad = {x[0] for x in test_decontaminate.brute([(k, r.text) for k, r in enumerate(results[1])], items)}
    assert plain(results[2]) == plain([r for k, r in enumerate(results[1]) if k not in bad])

    assert len(results[3]) == len(results[2])
    before = {r.doc_id: r.text for r in results[2]}
    for r in results[3]:
        assert not test_secret_scan.base(r.text)
        assert test_secret_scan.base(before[r.doc_id]) or r.text == before[r.doc_id]

    encoder = ByteEncoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for r in results[3]:
        ids = np.concatenate([np.frombuffer(encoder.direct(r.text), encoder.dtype), [1]]).astype("<u4")
        pieces = sorted((p for p in results[4] if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert [p.start for p in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in pieces)


def test_run_equals_stages(spark, tmp_path):
    table, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 30 and out.columns[:2] == ["doc_id", "start"]


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_columns_with_helper_names(spark):
    from vitrine.llm import jaccard_join, quality
    names = ["__k", "__o", "__gone_0", "gone_0", "gone_1", "again_key", "again_id", "again_place", "Quality", "root", "node", "w", "m"]
    lines = ["The " + " ".join(f"{w}{chr(97 + i)}" for w in "quick brown fox jumps over lazy dog home".split()) + "." for i in range(20)]
    text = "\n".join(lines[:18])
    rows = [(i, t, *range(len(names))) for i, t in ((1, text), (1, text), (2, text), (3, "\n".join(lines[:19])), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 1]
    kept = quality.clean(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_row_that_stays_of_repeated_ones_is_defined(spark):
    from vitrine.llm import jaccard_join
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    found = {tuple(jaccard_join.one_of_each(docs.repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(found) == 1


def test_quality_measures_are_computed_once(spark):
    from vitrine.llm import quality
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    plan = quality.clean(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_stages_bound_the_batches_of_their_workers(spark, tmp_path):
    """A stage that runs by itself hands at most some 8 MB of text to a worker at once."""
    import pyarrow as pa
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    docs = spark.range(0, 30, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd. ', 150000) AS text")
    for _, stage in corpus_pipeline.STAGES[3:]:
        stage(spark, docs.limit(0), str(tmp_path))
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
        assert sum(r.n for r in sizes) == 30 and max(r.n for r in sizes) <= 10
        spark.conf.set(key, "64m")
    spark.conf.set(key, "8m")
