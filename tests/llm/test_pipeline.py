"""Each stage on a small table, against brute force."""
import re

import pytest

import corpus_pipeline
from driftrank.llm.tables import read, written

from . import helpers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage; the outputs are written and read again."""
    docs, out = read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF), name)
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    columns = read(spark, SF, "documents").columns
    assert all(stages[n][1].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality(spark, stages):
    before, after = map(rows, stages["quality_classifier"])
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    assert all(after[i] == before[i] for i in after)
    known = [i for i in before if i in labels]
    assert sum((i in after) == (labels[i] == 1) for i in known) >= 0.95 * len(known)


def test_one_of_each_group(stages):
    before, after = map(rows, stages["ngram_jaccard"])
    ids = sorted(before)
    sets = [helpers.shingles(before[i]["text"]) for i in ids]
    first = helpers.components(sets)
    assert sorted(after) == [i for k, i in enumerate(ids) if not sets[k] or first[k] == k]
    assert all(after[i] == before[i] for i in after)


def test_no_benchmark_passage_stays_and_clean_texts_do(spark, stages):
    before, after = map(rows, stages["benchmark_decontamination"])
    patterns = [w for r in read(spark, SF, "benchmark").collect() for w in helpers.windows(r["text"])]

    def hit(text):
        text = " " + " ".join(helpers.bench_words(text)) + " "
        return any(" " + " ".join(w) + " " in text for w in patterns)
    assert sorted(after) == sorted(i for i, r in before.items() if not hit(r["text"]))


def test_secrets_are_replaced(stages):
    before, after = map(rows, stages["secret_scans"])
    shape = re.compile(r"AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}")
    assert set(after) == set(before)
    for i, r in after.items():
        want = shape.sub("[secret]", before[i]["text"])
        assert r["text"] == want and (want == before[i]["text"] or r["n_chars"] == len(want))


def test_packing_holds_every_document(stages):
    before, after = stages["best_fit_packing"]
    pieces = after.collect()
    assert {r["doc_id"] for r in pieces} == set(rows(before))
    used = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096


def test_run_gives_the_last_stage(spark, stages):
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SF).select(*keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages["best_fit_packing"][1].select(*keys).collect()))


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_tables_pass_all_stages(spark, kind):
    docs = read(spark, SF, "documents")
    if kind == "empty":
        docs = docs.limit(0)
    else:
        odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0),
                                     (2, "é" * 70000, None, None, 70000), (3, "a b c", "x", "y", None)], docs.schema)
        docs = odd.unionByName(docs.limit(20))
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() >= 0
