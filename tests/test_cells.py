import numpy as np
import pytest
from pyspark.sql import functions as F

from driftrank.operators.cells import (CellIndex, CellModel, cell_table, candidates, probed, publish_cells, search_cells,
                                       similar_in_cells, train_cells)
from driftrank.operators.knn import catalog_filter, knn, similar_items
from driftrank.operators.recommend import recommend

SF = "/root/testdata/sf0.1"


def table(spark, vectors, **more):
    rows = [(i, np.asarray(v, dtype=np.float64).tolist(), "A" if i % 2 else "B", f"t{i % 3}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "item_idx int, features array<float>, product_group_name string, product_type_name string")


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    index = table(spark, np.concatenate([c + 0.15 * rng.normal(size=(40, 8)) for c in centres]))
    return index, train_cells(index, 12, subspaces=4, sample_rows=400)


def found(rows, key="user_idx"):
    return {(r[key], r["rank"]): (r["item_idx"], round(r["score"], 9)) for r in rows.collect()}


def test_all_cells_probed_equal_the_exact_search(spark, small):
    index, model = small
    q = index.where("item_idx % 9 = 0").select(F.col("item_idx").alias("user_idx"), "features", F.array("item_idx").alias("ex"))
    cells = cell_table(index, model)
    want = found(knn(q, index, 7, exclude="ex", item_filter=catalog_filter(product_group="A")))
    asked = {"probes": 12, "exclude": "ex", "item_filter": catalog_filter(product_group="A"), "shard_rows": 15}
    assert found(search_cells(q, cells, model, 7, **asked)) == want
    assert found(search_cells(q, cells, model, 7, rerank=480, **asked)) == want


def test_filters_per_query_act_before_the_cut(spark, small):
    index, model = small
    approx = CellIndex(model, cell_table(index, model), probes=12, rerank=480)
    src = index.where("item_idx % 30 = 0").select(
        "item_idx", F.col("product_group_name").alias("must_group"), F.lit(None).cast("string").alias("must_type"),
        F.array().cast("array<string>").alias("not_groups"), F.array("product_type_name").alias("not_types"))
    want = found(similar_items(src, index, 5, per_query_filters=True), "source_item_idx")
    assert found(similar_in_cells(src, index, approx, 5, per_query_filters=True), "source_item_idx") == want and want


def test_codes_are_the_nearest_and_the_published_table_is_whole(spark, small, tmp_path):
    index, model = small
    back = publish_cells(index, model, str(tmp_path / "cells"))
    assert back.count() == index.count()
    rows = back.orderBy("item_idx").collect()
    unit = np.stack([r["features"] for r in rows]).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert [r["cell"] for r in rows] == (unit @ model.centroids.T).argmax(axis=1).tolist()
    rest = unit - model.centroids[[r["cell"] for r in rows]]
    code = np.stack([np.frombuffer(r["code"], np.uint8) for r in rows])
    for s in range(4):
        away = ((rest[:, None, 2 * s:2 * s + 2] - model.codebooks[s][None]) ** 2).sum(axis=2)
        assert np.allclose(away.min(axis=1), away[np.arange(len(rows)), code[:, s]])
    plan = back.where("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_recall_on_the_embeddings_at_a_tenth_of_the_exact_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = e.selectExpr("cast(vec_id as int) AS item_idx", "cast(embedding as array<float>) AS features").cache()
    q = index.where("item_idx % 8 = 0").withColumnRenamed("item_idx", "user_idx")
    from driftrank.plans.tables import CELLS
    model = train_cells(index, CELLS["n_cells"])
    cells = cell_table(index, model).cache()
    exact = {(r.user_idx, r.item_idx) for r in knn(q, index, 10).collect()}
    got = {(r.user_idx, r.item_idx) for r in
           search_cells(q, cells, model, 10, probes=CELLS["probes"], rerank=CELLS["rerank"]).collect()}
    n, pairs = index.count(), q.count() * index.count()
    by_code = probed(q, model, CELLS["probes"]).groupBy("cell").count().join(
        cells.groupBy("cell").agg(F.count("*").alias("n")), "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    share = min(CELLS["rerank"], n) * q.count() / pairs
    recall = len(got & exact) / len(exact)
    print(f"recall {recall:.4f}, scored exactly {share:.3f} of the pairs, by code {by_code / pairs:.3f}")
    assert recall >= 0.9 and share <= 0.1
    assert candidates(q, cells, model, 10, probes=1, exact=False).count() <= 10 * q.count()


def test_recommend_takes_its_candidates_from_the_cells(spark, small):
    index, model = small
    approx = CellIndex(model, cell_table(index, model), probes=12, rerank=480)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_idx int")
    vectors = index.where("item_idx in (5, 77)").select(
        F.when(F.col("item_idx") == 5, 1).otherwise(2).alias("user_idx"), "features")
    history = spark.createDataFrame([(1, 5, 1.0)], "user_idx int, item_idx int, last_purchase_at double")
    trending = spark.createDataFrame([(1, 9, 4.0), (2, 8, 3.0)], "rank int, item_idx int, score double")
    for lam in (1.0, 0.6):
        want = recommend(users, vectors, index, history, trending, k=4, diversity_lambda=lam).collect()
        got = recommend(users, vectors, index, history, trending, k=4, diversity_lambda=lam, approx=approx).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_empty_index_and_queries(spark, small):
    index, model = small
    cells = cell_table(index, model)
    q = index.select(F.col("item_idx").alias("user_idx"), "features")
    assert search_cells(q, cells.limit(0), model, 3, probes=2, rerank=5).isEmpty()
    assert search_cells(q.limit(0), cells, model, 3, probes=2, rerank=5).isEmpty()
    none = q.limit(2).withColumn("features", F.lit(None).cast("array<float>"))
    assert search_cells(none, cells, CellModel(model.centroids), 3, probes=2).isEmpty()


def test_rows_of_a_repeated_item_are_all_ranked(spark, small):
    index, model = small
    q = index.where("item_idx in (3, 200)").select(F.col("item_idx").alias("user_idx"), "features")
    once, twice = cell_table(index, model), cell_table(index.unionByName(index.withColumn("product_group_name", F.lit("C"))), model)
    best = [r.item_idx for r in search_cells(q, once, model, 2, probes=12, rerank=480, shard_rows=15).where("user_idx = 3").orderBy("rank").collect()]
    rows = search_cells(q, twice, model, 8, probes=12, rerank=960, shard_rows=15).where("user_idx = 3").orderBy("rank").collect()
    assert [r.item_idx for r in rows] == [best[0]] * 4 + [best[1]] * 4       # each of two candidates meets both rows of its item
    rows = search_cells(q, twice, model, 4, probes=12, rerank=960, shard_rows=15, item_filter=F.col("product_group_name") == "C")
    assert [r.item_idx for r in rows.where("user_idx = 3").orderBy("rank").collect()] == [best[0]] * 2 + [best[1]] * 2
