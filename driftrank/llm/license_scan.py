"""License scans (4): a trained paragraph classifier, DataFrame functions only.

A paragraph is a line of a text, or a run of lines that resemble a notice
template only together (a wrapped notice; comment marks are no words).  Its
features are the distinct word n-grams (one and two words) that occur in the
notice templates and are rare in the corpus.  A sparse multinomial logistic
regression (elastic net, fitted by Spark ML) gives the probability of each
licence family and of the class ``unknown``.  A family counts as found when

- it is the most probable class and its probability reaches the calibrated
  threshold: the ``1 - false_rate`` quantile of the largest family
  probability over all corpus lines that resemble no template, to a bin of
  a thousandth, one half at least; and
- the template comparison confirms it: the paragraph holds at least
  ``overlap`` of the n-grams of one template of that family.

One aggregate over all texts counts the lines that resemble no template by
the template n-grams they hold.  It gives the frequencies (so a frequent
notice, wrapped or not, keeps its words) and the threshold.  Training uses
the templates, copies of them that lack some words (chosen by hash), and as
``unknown`` distinct such lines of at most ``sample_docs`` distinct texts of
at most ``max_chars`` characters, the first by hash.

Scanning is one projection without shuffle or Python: a text is split into
lines only if it has a feature word, and only runs that resemble a template
are scored, since no other can be found.  ``paragraph`` is the first line of
the run.  What holds the ``overlap`` of a template must have one of the
template's ``signal`` words, its longest ones, since too few of its n-grams do
without them; texts, lines and runs without any are passed over at once.

Cases: null and empty texts have no licences; repeated lines are found each
for itself; equal probabilities go to the earlier family; an empty table
gives no rows (then templates alone train against the fixed counter-examples);
repeated rows are scanned each for itself; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import written

# fixed values: notice texts of common licences
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later "
                "version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
]
# counter-examples with words of notices
PLAIN = [
    "The license plate of the car was found in the public park.", "He needs a driving license to work here.",
    "Version 2 of the file will be released later this year.", "An apache helicopter landed under the bridge.",
    "All rights of the person are granted by the general public.", "The source of the river is free of charge.",
    "Students of MIT published their work in 2004.", "Software version 3.0 is a work in progress.",
    "The copy of this document is subject to the conditions of the project.", "",
]
# common words, which mark a notice only where nothing else is left
COMMON = frozenset("a all any are as be by can for from in is it may no not of on or that the this to under use was with work you".split())
UNKNOWN = "unknown"
BINS = 1000
LINE_COST = 0.05
FAMILIES = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def grams(w: Column) -> Column:
    """The distinct words and word pairs of a word array."""
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(w, F.filter(pairs, lambda p: p.isNotNull())))


def holds(w: Column, some: list[str]) -> Column:
    """Whether one of ``some`` is among the words ``w``."""
    return F.arrays_overlap(w, F.lit(some))


def grams_of(w: Column, known: list[str]) -> Column:
    """Those of the distinct words and word pairs of ``w`` that are in ``known``."""
    one, two = [g for g in known if " " not in g], [g for g in known if " " in g]
    begin = sorted({g.split(" ")[0] for g in two})
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                       lambda a, b: F.when(a.isin(begin), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(one)), F.filter(pairs, lambda p: p.isNotNull() & p.isin(two))))


@dataclass
class Model:
    """Bounded by the templates: vocabulary, weights per family, threshold, template n-grams."""
    vocabulary: list[str]
    weights: list[list[float]]
    bias: list[float]
    threshold: float
    templates: list[tuple[str, list[str]]]


def _rows(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return (spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text"))
                                                      for f, t in pairs])).alias("r")).select("r.*"))


def _variants(templates: DataFrame, copies: int) -> DataFrame:
    """(family, w): each template whole, and copies that lack about a fifth of the words."""
    return (templates.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(copies)))).withColumn("w", words(F.col("text")))
            .select("family", F.when(F.col("v") == 0, F.col("w")).otherwise(
                F.filter("w", lambda x, i: F.pmod(F.xxhash64(x, i, F.col("v")), F.lit(10)) > 1)).alias("w")))


def similar(g: Column, known: list[tuple[str, list[str]]]) -> Column:
    """Largest share of a template's n-grams that the n-grams ``g`` hold."""
    return F.greatest(*[F.size(F.array_intersect(g, F.lit(t))) / F.lit(float(len(t))) for _, t in known], F.lit(0.0))


def signal(known: list[tuple[str, list[str]]], overlap: float) -> list[str]:
    """Words one of which is in any text that holds ``overlap`` of a template's n-grams.

    Per template the longest words outside ``COMMON`` (the rarest, as a rule)
    are taken until the n-grams without any of them are fewer than the
    overlap asks for.  Any choice of words gives the same notices.
    """
    out: set[str] = set()
    for _, t in known:
        mine: set[str] = set()
        for w in sorted((g for g in t if " " not in g), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(mine.isdisjoint(g.split(" ")) for g in t) / len(t) < overlap:
                break
            mine.add(w)
        out |= mine
    return sorted(out)


def needed(known: list[tuple[str, list[str]]], overlap: float) -> list[tuple[list[str], int]]:
    """Per template its words, and how many of them any text has that holds ``overlap`` of its n-grams.

    So many words hold at most their own number of n-grams and the pairs that
    begin with them; the words that begin the most pairs are counted first.
    """
    out = []
    for _, t in known:
        one = [g for g in t if " " not in g]
        begun = sorted((sum(g.startswith(w + " ") for g in t) for w in one), reverse=True)
        out.append((one, next((n for n in range(len(one) + 1) if n + sum(begun[:n]) >= overlap * len(t) - 1e-6), len(one) + 1)))
    return out


def enough(w: Column, need: list[tuple[list[str], int]]) -> Column:
    """Whether the words ``w`` are as many as one of the templates needs."""
    has = F.lit(False)
    for one, n in need:
        has = has | (F.size(F.array_intersect(w, F.lit(one))) >= n)
    return has


def _bound(value: Column, name: str, use) -> Column:
    """``use`` of a struct that holds ``value`` as ``name``, made once."""
    return F.element_at(F.transform(F.array(F.struct(value.alias(name))), use), 1)


def possible(w: Column, known: list[tuple[str, list[str]]], single: list[str], overlap: float) -> Column:
    """Whether a text of the words ``w`` can hold a notice: it has a mark and enough of one template's words."""
    return holds(w, signal(known, overlap)) & _bound(
        F.array_intersect(w, F.lit(single)), "u", lambda d: enough(d["u"], needed(known, overlap)))


def _lines(text: Column) -> Column:
    """Array of (i, w): words of each line."""
    return F.transform(F.split(text, "\n"), lambda p, i: F.struct(i.alias("i"), words(p).alias("w")))


def _compared(lines: Column, known: list, single: list[str], marks: list[str], overlap: float = 0.0) -> Column:
    """Lines with u, their words in ``single``, mark, whether one is in ``marks``, and s, the similarity.

    ``s`` is 0 for lines without a mark and those that cannot reach ``overlap``.
    """
    need = needed(known, overlap)
    lines = F.transform(lines, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"), F.filter(
        x["w"], lambda w: w.isin(single)).alias("u"), holds(x["w"], marks).alias("mark")))
    lines = F.transform(lines, lambda x: F.struct(
        x["i"].alias("i"), x["w"].alias("w"), x["u"].alias("u"), x["mark"].alias("mark"),
        F.when(x["mark"] & enough(x["u"], need), grams(x["w"])).alias("g")))
    return F.transform(lines, lambda x: F.struct(
        x["i"].alias("i"), x["w"].alias("w"), x["u"].alias("u"), x["mark"].alias("mark"),
        F.when(x["g"].isNotNull(), similar(x["g"], known)).otherwise(0.0).alias("s")))


def _runs(lines: Column, known: list, overlap: float) -> Column:
    """Array of (start, end, w): runs of lines, one or more, that resemble a template.

    A run starts at any line, ends before a line without words, and holds at
    most as many words past its first line as the longest template; its end
    is the line of the best score, the similarity less LINE_COST per line.
    Of overlapping runs the one with the best score stays, the earlier end
    first; a line outside them that resembles a template is a run as well.
    Only starts with a mark in reach, and near them as many of a template's
    words as it takes, are compared: no other can resemble one.
    """
    more = max([len(g) for _, g in known] or [1])       # at least the words of the longest template
    need = needed(known, overlap)
    marked = F.transform(F.filter(lines, lambda x: x["mark"]), lambda x: x["i"])
    starts = _bound(marked, "marked", lambda d: F.filter(lines, lambda x: (F.size(x["u"]) > 0) & F.exists(
        d["marked"], lambda m: m.between(x["i"], x["i"] + more))))
    near = F.transform(starts, lambda x: F.struct(x["i"].alias("i"), F.slice(lines, x["i"] + 1, more + 1).alias("near")))
    near = F.transform(near, lambda x: F.struct(x["i"].alias("i"), x["near"].alias("near"), F.array_position(
        F.transform(x["near"], lambda y: F.size(y["w"]) == 0), True).cast("int").alias("k")))
    near = F.transform(near, lambda x: F.struct(x["i"].alias("i"), F.when(
        x["k"] > 0, F.slice(x["near"], 1, F.greatest(x["k"] - 1, F.lit(0)))).otherwise(x["near"]).alias("near")))
    near = F.transform(F.filter(near, lambda x: F.exists(x["near"], lambda y: y["mark"])), lambda x: F.struct(
        x["i"].alias("i"), x["near"].alias("near"), F.array_distinct(F.flatten(F.transform(x["near"], lambda y: y["u"]))).alias("u")))
    near = F.transform(F.filter(near, lambda x: enough(x["u"], need)), lambda x: F.struct(
        x["i"].alias("i"), F.transform(x["near"], lambda y: y["w"]).alias("ws")))

    def held(x: Column, n: Column) -> Column:
        return F.slice(F.flatten(F.slice(x["ws"], 1, n)), 1, F.size(F.element_at(x["ws"], 1)) + more)

    full = F.transform(near, lambda x: F.struct(x["i"].alias("i"), x["ws"].alias("ws"),
                                                grams(held(x, F.size(x["ws"]))).alias("g")))
    like = F.filter(full, lambda x: similar(x["g"], known) >= overlap)
    tried = F.transform(like, lambda x: F.struct(x["i"].alias("i"), x["ws"].alias("ws"), F.transform(
        F.sequence(F.lit(1), F.size(x["ws"])), lambda n: F.struct(n.alias("n"), grams(held(x, n)).alias("g"))).alias("tries")))
    tried = F.transform(tried, lambda x: F.struct(x["i"].alias("i"), x["ws"].alias("ws"), F.transform(x["tries"], lambda y: F.struct(
        similar(y["g"], known).alias("s"), y["n"].alias("n"))).alias("tries")))
    best = F.transform(tried, lambda x: F.struct(x["i"].alias("i"), x["ws"].alias("ws"), F.array_max(F.transform(
        F.filter(x["tries"], lambda y: y["s"] >= overlap),
        lambda y: F.struct((y["s"] - y["n"] * LINE_COST).alias("s"), (-y["n"]).alias("n")))).alias("best")))
    runs = F.transform(best, lambda x: F.struct(
        (x["i"] - x["best"]["n"] - 1).alias("end"), (-x["best"]["s"]).alias("less"), (-x["i"]).alias("back"),
        held(x, -x["best"]["n"]).alias("w")))
    none = F.array().cast("array<struct<end:int,less:double,back:int,w:array<string>>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return (F.when((F.size(acc) == 0) | (-x["back"] > last["end"]), F.concat(acc, F.array(x)))
                .when(x["less"] < last["less"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc))

    kept = _bound(F.aggregate(F.array_sort(runs), none, add), "kept", lambda d: F.concat(
        F.transform(d["kept"], lambda x: F.struct((-x["back"]).alias("start"), x["end"].alias("end"), x["w"].alias("w"))),
        F.transform(F.filter(lines, lambda x: (x["s"] >= overlap) & ~F.exists(d["kept"], lambda r: x["i"].between(
            -r["back"], r["end"]))), lambda x: F.struct(x["i"].alias("start"), x["i"].alias("end"), x["w"].alias("w")))))
    return F.array_sort(kept)


def _unlike(docs: DataFrame, text: str, known: list, overlap: float) -> DataFrame:
    """(w): words of all lines that have any and belong to nothing that resembles a template."""
    single = sorted({g for _, t in known for g in t if " " not in g})
    marks = signal(known, overlap)

    def rest(d: Column) -> Column:
        return F.filter(d["all"], lambda x: (x["s"] < overlap) & ~F.exists(
            d["runs"], lambda r: x["i"].between(r["start"], r["end"])))

    def plain(lines: Column) -> Column:
        both = _bound(_compared(lines, known, single, marks, overlap), "all", lambda d: F.struct(
            d["all"].alias("all"), _runs(d["all"], known, overlap).alias("runs")))
        return F.transform(_bound(both, "d", lambda x: rest(x["d"])), lambda x: x["w"])

    lines = docs.select(_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    some = possible(F.flatten(F.transform("lines", lambda x: x["w"])), known, single, overlap)
    w = F.when(some, plain(F.col("lines"))).otherwise(F.transform("lines", lambda x: x["w"]))
    return lines.select(F.explode(w).alias("w")).filter(F.size("w") > 0)


def _sample(docs: DataFrame, text: str, sample_docs: int, max_chars: int, paragraphs: int, known: list,
            overlap: float) -> DataFrame:
    """(w): distinct paragraphs unlike every template, of a bounded sample of distinct texts."""
    some = docs.select(F.col(text).alias("t")).filter(F.length("t").between(1, max_chars)).withColumn("h", F.xxhash64("t"))
    first = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(sample_docs).collect()]
    once = some.filter(F.col("h").isin(first)).dropDuplicates(["h"])
    return _unlike(once, "t", known, overlap).distinct().orderBy(F.xxhash64("w"), "w").limit(paragraphs)


def _features(docs: DataFrame, text: str, every: list[str], known: list, overlap: float) -> DataFrame:
    """(g, n): paragraphs of all texts unlike every template, by the template n-grams they hold; written."""
    held = _unlike(docs, text, known, overlap).select(F.array_sort(grams_of(F.col("w"), every)).alias("g"))
    return written(held.groupBy("g").agg(F.count("*").alias("n")), "features")


def fit(docs: DataFrame, *, text: str = "text", templates: list | None = None, sample_docs: int = 400,
        max_chars: int = 1 << 16, paragraphs: int = 4000, rare: float = 0.01, overlap: float = 0.5,
        copies: int = 20, false_rate: float = 0.001) -> Model:
    """The classifier, trained on templates and a bounded sample of the corpus."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    base = _rows(spark, templates)
    plain = _rows(spark, [(UNKNOWN, t) for t in PLAIN]).select(words(F.col("text")).alias("w"))
    known = [(r["family"], r["g"]) for r in base.select("family", grams(words(F.col("text"))).alias("g")).collect()]
    # n-grams of the templates, without single words that the corpus often has and pairs of such words only
    every = sorted({g for _, t in known for g in t})
    features = _features(docs, text, every, known, overlap)
    often = {r["g"]: r["n"] for r in features.select("n", F.explode("g").alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
             .collect()}
    total = features.agg(F.sum("n")).first()[0] or 0
    limit = rare * max(1, total)
    single = {g for g in every if " " not in g and often.get(g, 0) <= limit}
    vocabulary = sorted(single | {g for g in every if " " in g and single & set(g.split(" "))})

    unlike = written(_sample(docs, text, sample_docs, max_chars, paragraphs, known, overlap), "paragraphs")
    number = F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(i)))])
    labelled = (_variants(base, copies).unionByName(plain.withColumn("family", F.lit(UNKNOWN)))
                .unionByName(unlike.withColumn("family", F.lit(UNKNOWN)))
                .select(number[F.col("family")].alias("label"), grams(F.col("w")).alias("grams")))
    # a bounded table, in two partitions: every step of the fit is one small job over it
    labelled = written(labelled.coalesce(2), "labelled")
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True, minTF=1.0)
    made = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=100).fit(
        vector.transform(labelled))
    table, bias = made.coefficientMatrix.toArray(), made.interceptVector.toArray()
    model = Model(vocabulary, [[float(x) for x in row] for row in table], [float(x) for x in bias], 0.5, known)

    # the quantile over all paragraphs, to the upper edge of its bin
    lines = features.select("n", F.array(F.struct("g")).alias("lines"))
    probable = lines.select("n", F.explode(_probabilities(F.col("lines"), model)).alias("x"))
    bins = (probable.select("n", F.ceil(F.array_max(F.slice("x.p", 1, len(FAMILIES) - 1)) * BINS).alias("bin"))
            .groupBy("bin").agg(F.sum("n").alias("n")).collect())
    above = 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        above += r["n"]
        if above > false_rate * total:
            model.threshold = max(0.5, r["bin"] / BINS)
            break
    return model


def _probabilities(lines: Column, model: Model) -> Column:
    """Array of (g, ..., p): each line's struct with the class probabilities added."""
    vocabulary = F.lit(model.vocabulary)
    weight = [F.lit([0.0, *row]) for row in model.weights]
    placed = F.transform(lines, lambda x: F.struct(x.alias("line"), F.filter(
        F.transform(x["g"], lambda g: F.array_position(vocabulary, g)), lambda p: p > 0).alias("at")))

    def total(at: Column, k: int) -> Column:
        return F.aggregate(at, F.lit(model.bias[k]), lambda acc, p: acc + F.element_at(weight[k], (p + 1).cast("int")))

    scored = F.transform(placed, lambda x: F.struct(x["line"].alias("line"), F.array(
        *[total(x["at"], k) for k in range(len(model.bias))]).alias("z")))
    raised = F.transform(scored, lambda x: F.struct(x["line"].alias("line"), F.transform(
        x["z"], lambda z: F.exp(z - F.array_max(x["z"]))).alias("e")))
    summed = F.transform(raised, lambda x: F.struct(x["line"].alias("line"), x["e"].alias("e"), F.aggregate(
        x["e"], F.lit(0.0), lambda acc, e: acc + e).alias("s")))
    return F.transform(summed, lambda x: F.struct(x["line"].alias("line"), F.transform(
        x["e"], lambda e: e / x["s"]).alias("p")))


def licences(text: Column, model: Model, overlap: float = 0.5) -> Column:
    """Array of (paragraph, family, probability, similarity) of the notices in a text."""
    marks = signal(model.templates, overlap)
    every = sorted({g for _, t in model.templates for g in t if " " not in g})
    t = F.coalesce(text, F.lit(""))

    runs = _bound(_compared(_lines(t), model.templates, every, marks, overlap), "all",
                  lambda d: _runs(d["all"], model.templates, overlap))
    some = F.transform(runs, lambda x: F.struct(x["start"].alias("i"), grams(x["w"]).alias("g")))
    found = F.transform(_probabilities(some, model), lambda x: F.struct(
        x["line"].alias("line"), F.array_max(x["p"]).alias("top"), F.array_position(x["p"], F.array_max(x["p"])).alias("k")))
    named = F.filter(found, lambda x: (x["k"] < len(FAMILIES)) & (x["top"] >= model.threshold))
    compared = F.transform(named, lambda x: F.struct(
        x["line"]["i"].alias("paragraph"), F.element_at(F.lit(FAMILIES), x["k"].cast("int")).alias("family"),
        x["top"].alias("probability"), F.greatest(F.lit(0.0), *[
            F.when(x["k"] == FAMILIES.index(f) + 1, F.size(F.array_intersect(x["line"]["g"], F.lit(g))) / F.lit(float(len(g))))
            for f, g in model.templates]).alias("similarity")))
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    some = _bound(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), "w", lambda d: possible(d["w"], model.templates, every, overlap))
    return F.when(some, F.filter(compared, lambda x: x["similarity"] >= overlap)).otherwise(empty)


def scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, notices, families) per row: the notices found and their sorted distinct families."""
    found = docs.select(F.col(doc_id).alias("doc_id"), licences(F.col(text), model).alias("notices"))
    return found.withColumn("families", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))))
