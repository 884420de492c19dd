import re

import pytest

from driftrank.llm import license_scan as L
from driftrank.llm.tables import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(read(spark, SF, "documents"))


def test_planted_notices(spark, model):
    rows = [(i, "some words\n" + t + "\nmore words here", "x") for i, (_, t) in enumerate(L.TEMPLATES)]
    rows += [(100 + i, t, "x") for i, t in enumerate(L.PLAIN)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "the word " * 20000, "x"), (203, L.TEMPLATES[0][1] + "\n" + L.TEMPLATES[3][1], "x"),
             (0, rows[0][1], "x"),
             (204, "This program is distributed under the GNU General Public License version 3 as published by the Free Software "
                   "Foundation", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, families string").repartition(3)
    got = {}
    for r in L.scan(df, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (family, _) in enumerate(L.TEMPLATES):
        for r in got[i]:
            assert r["families"] == [family] and [n["paragraph"] for n in r["notices"]] == [1], (family, r)
    assert len(got[0]) == 2
    assert all(not got[k][0]["notices"] for k in got if 100 <= k < 203)
    assert got[203][0]["families"] == ["Apache-2.0", "MIT"] and got[204][0]["families"] == ["GPL-3.0"]


def test_documents_with_and_without_notices(spark, model):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    lines = {r["doc_id"]: sum(bool(re.match(r"(Licensed under|Released under|This work is licensed)", x))
                              for x in r["text"].split("\n")) for r in docs.collect()}
    found = {r["doc_id"]: len(r["notices"]) for r in L.scan(docs, model).collect()}
    assert found == lines


def test_frequent_notice(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(i, (f"{notice}\n" if i % 3 == 0 else "") + f"plain words number {i}\nand some more of them") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["families"] for r in L.scan(df, L.fit(df, copies=5)).collect()}
    assert found == {i: ["Apache-2.0"] if i % 3 == 0 else [] for i, _ in rows}


def test_wrapped_templates(spark, model):
    import textwrap
    rows, k = [], 0
    for family, t in L.TEMPLATES:
        for mark, width in (("", 70), ("# ", 70), (" * ", 40)):
            lines = textwrap.wrap(t, width)
            rows.append((k, "\n".join(["first line of it", *[mark + x for x in lines], "", "last words"]), family))
            k += 1
    mit, apache = textwrap.wrap(L.TEMPLATES[1][1], 60), textwrap.wrap(L.TEMPLATES[4][1], 60)
    rows.append((900, "\n".join(mit + apache), "Apache-2.0,MIT"))
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = {r["doc_id"]: r for r in L.scan(df, model).collect()}
    assert {k: got[k]["families"] for k, _, _ in rows} == {k: f.split(",") for k, _, f in rows}
    assert all(len(r["notices"]) == 1 for k, r in got.items() if k < 900) and len(got[900]["notices"]) == 2


def test_threshold_over_all_paragraphs(spark):
    near = "the license version of the software is free of charge to any person"
    rows = [(0, "one text in many copies")] * 500 + [(1, "\n".join(f"word{c} license version 3 public" for c in "abcdefgh"))]
    df = spark.createDataFrame(rows + [(2, near)], "doc_id long, text string").repartition(3)
    every = sorted({g for _, t in L.TEMPLATES for g in t.lower().replace(".", "").split()})
    known = [(r["family"], r["g"]) for r in L._rows(spark, L.TEMPLATES).select("family", L.grams(L.words(L.F.col("text"))).alias("g")).collect()]
    assert sum(r["n"] for r in L._features(df, "text", every, known, 0.5).collect()) == 509
    assert L._sample(df, "text", 3, 1 << 16, 100, known, 0.5).count() == 10


def test_signal_words_are_in_all_that_resembles_a_template():
    import itertools
    known = [("x", ["a", "bb", "ccc", "a bb", "bb ccc"]), ("y", ["license", "mit", "the", "the mit", "mit license"])]
    for overlap in (0.4, 0.5, 0.9):
        marks = set(L.signal(known, overlap))
        for _, t in known:
            words = [g for g in t if " " not in g]
            for n in range(len(words) + 1):
                for some in itertools.combinations(words, n):
                    held = sum(set(g.split(" ")) <= set(some) for g in t)
                    assert held / len(t) < overlap or marks & set(some)


def test_runs_equal_those_without_the_signal_filter(spark):
    docs = read(spark, SF, "documents").select("text").limit(40).unionByName(spark.createDataFrame(
        [(" the first of\n" + t.replace(" ", "\n", 3) + "\nthe copy of it",) for _, t in L.TEMPLATES], "text string"))
    known = [(r["family"], r["g"]) for r in L._rows(spark, L.TEMPLATES).select("family", L.grams(L.words(L.F.col("text"))).alias("g")).collect()]
    single = sorted({g for _, t in known for g in t if " " not in g})

    def found(marks):
        lines = L._compared(L._lines(L.F.col("text")), known, single, marks)
        return [tuple(map(tuple, r[0])) for r in docs.select("text", lines.alias("all")).orderBy("text").select(
            L._runs(L.F.col("all"), known, 0.5)).collect()]
    assert found(L.signal(known, 0.5)) == found(single) and any(found(single))


def test_empty_corpus_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = L.fit(docs, copies=5)
    out = L.scan(docs, model)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_text_that_resembles_a_template_lacks_the_needed_words():
    import itertools
    known = [("x", ["a", "bb", "ccc", "a bb", "bb ccc", "bb a"]), ("y", ["license", "mit", "the", "the mit", "mit license"])]
    for overlap in (0.0, 0.4, 0.5, 0.6, 0.9, 1.0):
        for (one, least), (_, t) in zip(L.needed(known, overlap), known, strict=True):
            for n in range(len(one) + 1):
                for some in itertools.combinations(one, n):
                    held = sum(set(g.split(" ")) <= set(some) for g in t)
                    assert held / len(t) < overlap or n >= least


def test_runs_are_sought_only_where_the_words_allow_one(spark):
    known = [(r["family"], r["g"]) for r in L._rows(spark, L.TEMPLATES).select("family", L.grams(L.words(L.F.col("text"))).alias("g")).collect()]
    single = sorted({g for _, t in known for g in t if " " not in g})
    rows = [(0, "er kam mit dem Zug\nund in der Stadt\nmit ihr an"), (1, "the public library is free"), (2, ""), (3, "Released under\nthe MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", L.possible(L.words(L.F.col("text")), known, single, 0.5).alias("p")).collect()
    assert {r["doc_id"]: r["p"] for r in got} == {0: False, 1: False, 2: False, 3: True}
    lines = L._compared(L._lines(L.F.col("text")), known, single, L.signal(known, 0.5), 0.5)
    runs = df.select("doc_id", lines.alias("all")).select("doc_id", L._runs(L.F.col("all"), known, 0.5).alias("r")).collect()
    assert {r["doc_id"]: [(x["start"], x["end"]) for x in r["r"]] for r in runs} == {0: [], 1: [], 2: [], 3: [(0, 1)]}
    pairs = L.grams_of(L.F.array(*map(L.F.lit, ["the", "mit", "license", "of", "mit", "license"])), ["license", "mit license", "of mit"])
    assert sorted(spark.range(1).select(pairs).first()[0]) == ["license", "mit license", "of mit"]
