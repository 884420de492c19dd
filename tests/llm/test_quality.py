import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftrank.llm import quality
from driftrank.llm.tables import read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    rows = quality.scored(read(spark, SF, "documents"), model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    test = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(test) > 50 and np.mean([p == y for p, y in test]) > 0.97


TEXTS = ["one two two Three!!", "É é", "x", "", "a\tb\n\nb  b", "word" * 50, "ab ab ab", " lead and trail "]


def runs(word):
    """The word's byte runs of three and four, one mark on each side included."""
    data = b" " + word.encode() + b" "
    return [data[i:i + n] for n in (3, 4) for i in range(len(data) - n + 1)]


def test_words_have_their_byte_runs_as_features():
    place = {}
    for t in TEXTS:
        words = t.split()
        w = quality.Words.of(pa.array([t]))
        assert w.size.tolist() == [len(x.encode()) for x in words]
        assert w.again.tolist() == [k > 0 and words[k] == words[k - 1] for k in range(len(words))]
        for k, x in enumerate(words):
            got = [*w.three[w.starts[k]:w.starts[k] + w.size[k]], *w.four[w.starts[k]:w.starts[k] + w.size[k] - 1]]
            assert len(got) == len(runs(x)) == 2 * len(x.encode()) - 1
            for run, row in zip(runs(x), got):
                assert place.setdefault(run, row) == row and row < quality.BUCKETS


def test_score_is_the_softmax_of_the_averaged_vectors():
    """The sixteen dimensions, averaged text by text, against the scores of all texts at once."""
    net = quality.train(["good words here", "more good words", "BAD!! JUNK!!", "JUNK!! BAD!! JUNK!!"], [1, 1, 0, 0], epochs=3)
    model = net.collapsed(0.25)
    got = model.scores(pa.array(TEXTS))
    for t, score in zip(TEXTS, got):
        at, w = quality.text_vector(t)
        assert not t.split() or abs(w.sum() - 1) < 1e-5
        z = (w @ net.table[at] if len(at) else np.zeros(quality.DIM)) @ net.out + net.bias + np.array([0, 0.25])
        assert abs(score - np.exp(z[1]) / np.exp(z).sum()) < 1e-5
    alone = [model.scores(pa.array([t]))[0] for t in TEXTS]
    assert np.array_equal(got, alone)            # whatever shares the slice


def test_nulls_empty_repeats_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "a b", 0.0), (1, "a b", 0.0)],
                               "doc_id long, text string, score double")
    got = quality.scored(df, model).collect()
    assert len(got) == 4 and got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"]
    assert not got[2]["held_out"]
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.scored(df.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    df = spark.createDataFrame([(i, "some text here") for i in range(20)], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.9 for r in quality.scored(df, quality.fit(df, one)).collect())
    assert all(r["score"] == 0.5 for r in quality.scored(df, quality.fit(df, one.limit(0))).collect())


def test_held_out_labels_and_long_texts_do_not_train(spark):
    base = [(i, "good words here" if i % 2 else "BAD!! JUNK!!") for i in range(40)]
    df = spark.createDataFrame(base, "doc_id long, text string")
    truth = [(i, i % 2) for i in range(40)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in truth]
    a = quality.fit(df, spark.createDataFrame(truth, "doc_id long, quality int"))
    b = quality.fit(df, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert np.array_equal(a.row, b.row) and a.bias == b.bias
