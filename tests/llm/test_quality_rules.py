import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftrank.llm import quality_rules as Q

from . import helpers


def brute(text):
    t = text or ""
    w = helpers.words(t)
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if helpers.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, " \n\n ", "a\n a\n x \x0b a\r\n", "a b c a b c", "x y z x y z x y z", "é é é é", "a b", "w " * 5000,
             "a\u00a0b c\u2003d a\u00a0b", "line\nline\nline "]
    texts += [" ".join(rng.choice(["a", "b", "##c", "D|", "\n", "e\n"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    for r in Q.counted(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute(texts[r["doc_id"]]), repr(texts[r["doc_id"]])[:80]


@pytest.mark.parametrize("n, risk", [(700, 0.01), (5000, 0.01), (90000, 0.01), (50, 0.2)])
def test_binomial_tail(spark, n, risk):
    rows = sorted({0, 1, 2, int(n * risk * 0.5), int(n * risk) - 1, int(n * risk) + 1})
    df = spark.createDataFrame([(x,) for x in rows if x >= 0], "x long")
    for r in df.select("x", Q.at_most(F.col("x"), F.lit(n), risk).alias("p")).collect():
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk)
                             + (n - i) * math.log1p(-risk)) for i in range(r["x"] + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-6) if r["x"] < n * risk else r["p"] == 1.0


def holdout(good, bad):
    text = " ".join(f"w{i}" for i in range(60))
    rows, labels = [], []
    for i in range(good + bad):
        junk = i >= good
        rows.append((i, text + (" ###" * 40 if junk else " #" * (i % 3)), "en" if i % 2 else None))
        labels.append((i, 0 if junk else 1))
    return rows, labels


def test_cutoffs_reject_junk_and_keep_good_texts(spark):
    rows, labels = holdout(3000, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels + [(5, None), (99999, 0), (None, 1)], "doc_id long, quality int")
    got = Q.judged(docs, known).collect()
    assert all(r["kept"] == (r["doc_id"] < 3000) and not r["base_failed"] for r in got)
    assert all(r["rejected_by"] == ["symbols"] for r in got if r["doc_id"] >= 3000 and not r["kept"]
               and "symbols" in r["rejected_by"] and len(r["rejected_by"]) == 1)


def test_too_few_labels_or_none_act_by_the_base_rule(spark):
    rows, labels = holdout(100, 50)
    docs = spark.createDataFrame(rows + [(None, "few words", None), (7, None, "en"), (7, None, "en")], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    for labelled in (known, known.limit(0)):
        got = Q.judged(docs, labelled).collect()
        assert len(got) == 153 and all(r["kept"] == (not r["base_failed"]) for r in got)
        assert sum(r["base_failed"] for r in got) == 3 or sum(r["base_failed"] for r in got) == 53
    assert Q.judged(docs.limit(0), known).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    plan = Q.counted(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
