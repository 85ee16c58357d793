"""Licence scans: held-out accuracy, unknown text, odd rows."""

import random

import pytest

from vitrine.llm import license_scan


@pytest.fixture(scope="module")
def classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return license_scan.train(spark, docs)


def found(spark, classifier, texts):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, row int, words string")
    rows = {r.doc_id: (r.licences, r.n_paragraphs) for r in license_scan.scan(docs, classifier).collect()}
    return [rows[i] for i in range(len(texts))]


def test_held_out_notices(spark, classifier):
    """Notices with other words around them and small changes."""
    r = random.Random(4)
    texts, want = [], []
    for family, notices in license_scan.NOTICES.items():
        for n in notices:
            around = " ".join(r.choice(["der", "onde", "thing", "reou", "annt", "here"]) for _ in range(6))
            for t in (n + ".", f"{around}. {n}, {around}.", n.upper(), n.replace(" ", "  ") + f" ({around})"):
                texts.append(f"{around}\n{t}\n{around}")
                want.append(family)
    got = found(spark, classifier, texts)
    right = sum(g == (w, 1) for g, w in zip(got, want))
    assert right >= 0.95 * len(want), [(t, g, w) for t, g, w in zip(texts, got, want) if g != (w, 1)]


def test_corpus_lines(spark, classifier):
    """The licence lines of the test data, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.licences for r in license_scan.scan(docs, classifier).collect()}
    lines = {"Licensed under CC BY-NC 4.0": "cc-by-nc", "General Public License, version 3": "gpl", "All rights reserved.": "proprietary",
             "Licensed under the Apache License, Version 2.0": "apache-2.0", "Released under the MIT License.": "mit"}
    for r in docs.collect():
        want = sorted({f for line, f in lines.items() if line in r.text})
        assert rows[r.doc_id] == (",".join(want) or "unknown"), r.text[-200:]


def test_unknown_and_odd_rows(spark, classifier):
    long = "plain words " * 20_000
    got = found(spark, classifier, [None, "", "\n\n", "The driver shows a valid license to the officer.", "released", long,
                                    long + "\nReleased under the MIT License.\n\nReleased under the MIT License.",
                                    "All rights reserved.\nLicensed under CC BY-NC 4.0"])
    assert got == [("unknown", 0)] * 6 + [("mit", 2), ("cc-by-nc,proprietary", 2)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert license_scan.scan(empty, classifier).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, None)], "doc_id bigint, text string")
    assert sorted(str(r.licences) for r in license_scan.scan(twice, classifier).collect()) == ["mit", "mit", "unknown"]


def test_reworded_notices(spark, classifier):
    """Notices that lack their longest word, but hold MIN_SHARE of the triples."""
    got = found(spark, classifier, ["Distributed under the Apache License, Version 2.0.", "Available under the MIT License.",
                                    "Available under CC BY-NC 4.0.", "Covered by the terms of the GNU General Public License as published by the FSF.",
                                    "It runs under the terms of the contract."])
    assert got == [("apache-2.0", 1), ("mit", 1), ("cc-by-nc", 1), ("gpl", 1), ("unknown", 0)]


def test_wrapped_notices(spark, classifier):
    """A notice over several lines is one paragraph; lines that no notice joins stay apart."""
    gnu = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,"""
    lesser = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
    narrow = "\r\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this software".split())
    by_nc = "This work is licensed under a Creative Commons Attribution-\nNonCommercial 4.0 International License."
    apart = "Available under the\n \nMIT License."
    lines = "Available under the MIT License.\nReleased under the BSD License\nReleased under the BSD License"
    # Two notices, and far more lines than the words that are looked at.
    deep = "\n".join(["plain words"] * 3000 + ["All rights reserved.", "Licensed under CC", "BY-NC 4.0"] + ["plain words"] * 3000)
    got = found(spark, classifier, [gnu, lesser, narrow, by_nc, apart, lines, deep])
    assert got == [("gpl", 1), ("lgpl", 1), ("mit", 1), ("cc-by-nc", 1), ("unknown", 0), ("bsd,mit", 3), ("cc-by-nc,proprietary", 2)]


def test_every_notice_wrapped(spark, classifier):
    """Each notice at each width that cuts it, with other lines around."""
    import textwrap
    texts, want = [], []
    for family, notices in license_scan.NOTICES.items():
        for n in notices:
            for width in (20, 40, 70):
                wrapped = textwrap.wrap(n, width)
                if len(wrapped) > 1:
                    texts.append("onde thing\n// " + "\n// ".join(wrapped) + ".\nannt here")
                    want.append((family, 1))
    got = found(spark, classifier, texts)
    right = sum(g == w for g, w in zip(got, want))
    assert right >= 0.95 * len(want), [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
