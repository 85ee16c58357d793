"""Licence scans, DataFrame and ML functions only (no Python in tasks).

A logistic regression over hashed word n-grams (1 to 3 words) names the
licence family of a paragraph, or ``unknown``, which is a class of its own.  A
paragraph is a line, or the neighbouring lines over which a notice is wrapped;
a line without words ends it.  The classifier's
training rows are bounded: stretches of the notices below, and at most
BACKGROUND paragraphs of the corpus.  Probabilities are calibrated by a
temperature, fitted on rows held out of training.  A prediction counts if its
calibrated probability reaches MIN_PROBABILITY and the paragraph contains at
least MIN_SHARE of the word triples of one of the family's notices.  A
paragraph without any notice's triple has a share of 0, so it is unknown
without being scored.

Defined results: null or empty text has no paragraph and no licence; repeated
rows each return a row; null ids pass through; a long text is one row of the
scan and one row a paragraph after it; an empty corpus trains on the notices
alone; columns beside id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import id_text, let, saved

BACKGROUND = 2000        # corpus paragraphs of class unknown that train, from BACKGROUND_DOCS documents
BACKGROUND_DOCS = 400
FEATURES = 1 << 14
WHOLE = 25.0             # weight of a whole notice among the training rows
MIN_PROBABILITY = 0.5
MIN_SHARE = 0.6
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
UNKNOWN = "unknown"

# Usual notices of each family, from the public licence texts.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "This project is released under the terms of the Apache License 2.0",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL, version 2 of the License or any later version of the License"),
    "lgpl": (
        "licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "agpl": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "Redistributions of source code must retain the above copyright notice, this list of conditions",
        "Released under the BSD License",
        "Licensed under the 3-Clause BSD License"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0"),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "public-domain": (
        "This is free and unencumbered software released into the public domain",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "Dedicated to the public domain under CC0 1.0"),
    "proprietary": (
        "All rights reserved",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential license"),
}
FAMILIES = (UNKNOWN, *NOTICES)


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _triples(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i:i + 3]) for i in range(len(words) - 2)}) or [" ".join(words)]


# Every notice has three words or more, so a share above 0 needs one of these.
TRIPLES = sorted({t for notices in NOTICES.values() for n in notices for t in _triples(_plain(n))})


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)),
                                              lambda i: F.array_join(F.slice(w, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


# (its triples in order, how many MIN_SHARE asks for, its words) of each notice, and the words of the longest.
ORDERED = [(list(dict.fromkeys(" ".join(w[i:i + 3]) for i in range(len(w) - 2))), len(w))
           for notices in NOTICES.values() for w in map(_plain, notices)]
LONGEST = max(n for _, n in ORDERED)


def _crossed(before: Column, after: Column) -> Column:
    """True where a notice runs on from the words ``before`` a line break to those ``after`` it.

    Its triples up to some place stand before the break or on it, the later
    ones on it or after it; together they reach MIN_SHARE, and they are more
    than either side holds alone.  A notice may hold as many foreign words as
    it has itself.
    """
    notices = F.array(*[F.struct(F.array(*[F.lit(x) for x in t]).alias("triples"), F.lit(MIN_SHARE * len(t)).alias("need"),
                                 F.lit(2 * n).alias("reach")) for t, n in ORDERED])

    def runs_on(notice: Column, hits: Column) -> Column:
        ranks = F.transform(F.filter(hits, lambda h: F.abs(h["at"]) <= notice["reach"]),
                            lambda h: F.struct(F.array_position(notice["triples"], h["triple"]).alias("rank"), h["at"].alias("at")))
        ranks = F.filter(ranks, lambda r: r["rank"] > 0)

        def of(rows: Column, test) -> Column:
            return F.array_distinct(F.transform(F.filter(rows, lambda r: test(r["at"])), lambda r: r["rank"]))

        def joined(p: Column) -> Column:
            def reached(place: Column) -> Column:
                n = F.size(F.array_distinct(F.concat(F.filter(p["before"], lambda r: r <= place), p["on"],
                                                     F.filter(p["after"], lambda r: r > place))))
                return (n >= notice["need"]) & (n > F.size(p["before"])) & (n > F.size(p["after"]))

            return F.exists(F.sequence(F.lit(0), F.size(notice["triples"])), reached)

        return let(let(ranks, lambda r: F.struct(of(r, lambda at: at <= -2).alias("before"), of(r, lambda at: at.isin(-1, 0)).alias("on"),
                                                 of(r, lambda at: at >= 1).alias("after"))), joined)

    def crossed(b: Column, w: Column) -> Column:
        # ``at``: 1 for the triple that starts with the first word after the break.
        hits = F.filter(F.transform(grams(w, 3), lambda t, i: F.struct(t.alias("triple"), (i + 1 - F.size(b)).alias("at"))),
                        lambda h: h["triple"].isin(TRIPLES))
        return let(hits, lambda h: (F.size(h) > 0) & F.exists(notices, lambda n: runs_on(n, h)))

    return let(before, lambda b: let(F.concat(b, after), lambda w: crossed(b, w)))


def unwrapped(text: Column) -> Column:
    """The text, with a space for each line break over which a notice runs on.

    The lines between two lines without words are looked at together: up to
    twice the words of the longest notice on both sides of each break.
    """
    most = 2 * LONGEST

    def first(w: Column) -> Column:
        return F.slice(w, 1, most)

    def last(w: Column) -> Column:
        return F.slice(w, F.greatest(F.lit(1), F.size(w) - (most - 1)), most)

    def near(ends: Column, start: Column, n: Column, which: str) -> Column:
        return F.flatten(F.transform(F.slice(ends, start, n), lambda e: e[which]))

    def line(text: Column, ends: Column, i: Column) -> Column:
        # ``i`` counts from 0: the lines up to i + 1 stand before the break, line i + 2 is the first after it.
        start = F.greatest(F.lit(1), i + 2 - most)
        before = last(near(ends, start, i + 2 - start, "last"))
        after = first(near(ends, i + 2, F.lit(most), "first"))
        broken = F.when(i + 1 >= F.size(ends), "").when(_crossed(before, after), " ").otherwise("\n")
        return F.concat(text, broken)

    def run(lines: Column) -> Column:
        ends = F.transform(lines, lambda x: let(words(x), lambda w: F.struct(first(w).alias("first"), last(w).alias("last"))))
        return let(ends, lambda e: F.array_join(F.transform(lines, lambda x, i: line(x, e, i)), ""))

    runs = F.transform(F.split(text, r"\n[^\p{L}\p{N}]*\n"), lambda r: let(F.split(r, "\n"), run))
    return F.array_join(runs, "\n\n")


def features(rows: DataFrame) -> DataFrame:
    """Adds the hashed n-grams of column ``words``."""
    rows = rows.withColumn("grams", let(F.col("words"), lambda w: F.array_distinct(F.concat(w, grams(w, 2), grams(w, 3)))))
    return HashingTF(binary=True, numFeatures=FEATURES, inputCol="grams", outputCol="features").transform(rows)


def stretches() -> list[tuple[str, str, bool]]:
    """(family, text, whole): each notice and its stretches of at least MIN_SHARE of its words."""
    out = []
    for family, notices in NOTICES.items():
        for notice in notices:
            w = _plain(notice)
            least = max(3, -(-len(w) * 3 // 5))
            step = max(1, (len(w) - least) // 4)
            sizes = sorted({len(w), *range(least, len(w) + 1, step)})
            out += [(family, " ".join(w[i:i + n]), n == len(w)) for n in sizes for i in range(0, len(w) - n + 1, step)]
    return out


class Classifier:
    """A fitted model and its temperature."""

    def __init__(self, model, temperature: float):
        self.model, self.temperature = model, temperature

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` and ``probability`` (calibrated) to rows with ``words``."""
        out = self.model.transform(features(rows))
        scaled = F.transform(vector_to_array("rawPrediction"), lambda x: F.exp(x / F.lit(self.temperature)))
        out = out.withColumn("__e", scaled)
        best = F.array_max("__e")
        return out.withColumn("family", F.array(*[F.lit(f) for f in FAMILIES])[F.array_position("__e", best).cast("int") - 1]) \
            .withColumn("probability", best / F.aggregate("__e", F.lit(0.0), lambda s, x: s + x)) \
            .drop("__e", "grams", "features", "rawPrediction", "prediction")


def train(spark: SparkSession, docs: DataFrame) -> Classifier:
    """Fits on whole notices and four of five other rows, the temperature on the fifth (of rows like those that are scored)."""
    known = spark.createDataFrame(stretches(), "family string, paragraph string, whole boolean")
    some = id_text(docs).filter(F.length("text") > 0).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(BACKGROUND_DOCS)
    # Paragraphs like those that are scored come first, others fill up.
    other = some.select(F.explode(F.split(_paragraphs("text"), "\n")).alias("paragraph")).distinct() \
        .withColumn("words", words(F.col("paragraph"))).withColumn("triples", _triples_of("words")) \
        .filter(~_confirmed()).withColumn("scored", _holds_triple(F.col("words"))) \
        .orderBy(F.desc("scored"), F.xxhash64("paragraph"), "paragraph").limit(BACKGROUND) \
        .select(F.lit(UNKNOWN).alias("family"), "paragraph", F.lit(False).alias("whole"), "scored")
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    rows = known.withColumn("scored", F.lit(True)).union(other).withColumn("words", words(F.col("paragraph"))).filter(F.size("words") > 0) \
        .withColumn("label", label.cast("double")).withColumn("weight", F.when(F.col("whole"), WHOLE).otherwise(1.0)) \
        .withColumn("held", (F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0) & ~F.col("whole") & F.col("scored"))
    rows = saved(rows.coalesce(1).sortWithinPartitions("family", "paragraph"), "licence-training")
    model = LogisticRegression(maxIter=25, regParam=1e-4, family="multinomial", weightCol="weight", standardization=False,
                               featuresCol="features", labelCol="label", probabilityCol="")
    model = model.fit(features(rows.filter("not held")).coalesce(1))
    raw = vector_to_array("rawPrediction")
    scored = model.transform(features(rows.filter("held"))).select(raw.alias("r"), "label")

    def loss(t):
        e = F.aggregate("r", F.lit(0.0), lambda s, x: s + F.exp(x / F.lit(t)))
        return F.avg(F.log(e) - F.get("r", F.col("label").cast("int")) / F.lit(t))

    losses = scored.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: losses[i] if losses[i] is not None else abs(TEMPERATURES[i] - 1))
    return Classifier(model, TEMPERATURES[best])


def _holds_triple(w: Column) -> Column:
    """True where the words hold a triple of any notice."""
    return let(w, lambda v: F.exists(grams(v, 3), lambda t: t.isin(TRIPLES)))


def _paragraphs(name: str) -> Column:
    """The column with wrapped notices on one line; a text without any notice's triple has none."""
    return F.when(_holds_triple(words(F.col(name))), unwrapped(F.col(name))).otherwise(F.col(name))


def _triples_of(name: str) -> Column:
    return let(F.col(name), lambda w: F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(grams(w, 3)))


def _confirmed(family: str | None = None) -> Column:
    """The paragraph holds MIN_SHARE of the triples of a notice of the family in that column; without one, of any notice."""
    out = F.lit(False)
    for name, notices in NOTICES.items():
        for notice in notices:
            t = _triples(_plain(notice))
            held = F.size(F.array_intersect("triples", F.array(*[F.lit(x) for x in t]))) >= MIN_SHARE * len(t)
            out = out | (held if family is None else (F.col(family) == name) & held)
    return out


def scan_paragraphs(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(row, doc_id, paragraph, family) of the paragraphs with a confirmed licence."""
    lines = docs.filter(_holds_triple(words(F.col("text")))) \
        .select("row", "doc_id", F.posexplode(F.split(unwrapped(F.col("text")), "\n")).alias("paragraph", "line")) \
        .withColumn("words", words(F.col("line"))).filter(_holds_triple(F.col("words")))
    return classifier.predict(lines) \
        .filter((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY)) \
        .withColumn("triples", _triples_of("words")) \
        .filter(_confirmed("family")).select("row", "doc_id", "paragraph", "family")


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, licences, n_paragraphs) per row of ``docs``.

    ``licences``: the distinct families, comma-joined in order, or ``unknown``;
    ``n_paragraphs``: paragraphs with a confirmed licence.
    """
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    found = scan_paragraphs(rows, classifier).groupBy("row", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"), F.count("*").alias("n_paragraphs"))
    return rows.select("row", "doc_id").join(found.drop("doc_id"), "row", "left") \
        .select("doc_id", F.coalesce("licences", F.lit(UNKNOWN)).alias("licences"),
                F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))
