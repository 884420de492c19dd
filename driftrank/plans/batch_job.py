"""The batch job end to end: ingest -> preprocess -> train -> load -> trending.

One session, each step DataFrame -> DataFrame, persisted only at the table
boundaries (Parquet under ``out``).  Id maps are stable across runs: the
existing map is read, only new ids are appended (never rewriting the table
being read).  Archived stream events, when present, join the history for
the ratings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank import adapters
from driftrank import schema as S
from driftrank.operators.ids import update_mapping
from driftrank.operators.interactions import interactions, merge_events
from driftrank.operators.knn import build_item_index
from driftrank.operators.trending import enrich_trending, trending
from driftrank.sources.tables import (append_table, publish, read_if_exists, read_table,
                                      save_model, write_table)


def _map(spark: SparkSession, ids: DataFrame, id_col: str, idx_col: str, path: str) -> DataFrame:
    existing = read_if_exists(spark, path)
    added = update_mapping(existing, ids, id_col, idx_col)
    if existing is None:
        write_table(added, path)
    else:
        append_table(added, path)
    return read_table(spark, path)


def run_batch(spark: SparkSession, sf_dir: str, out: str, train_als: bool = True,
              factors: DataFrame | None = None, seed: int = 42) -> dict[str, str]:
    """Run every batch step; returns the written table paths.

    Item vectors come from ALS (``train_als``) or from ``factors``
    (id, features), e.g. precomputed embeddings.
    """
    out = out.rstrip("/")
    p = {name: f"{out}/{name}" for name in (
        "raw/customers", "raw/articles", "raw/transactions", "raw/events",
        "mappings/user_map", "mappings/item_map", "processed/train_data",
        "models/user_factors", "models/item_factors", "models/als",
        "serve/item_index", "serve/user_vectors", "serve/user_map", "serve/trending")}

    # 1 ingest: transactions partitioned by month so date filters prune files
    write_table(adapters.customers(spark, sf_dir), p["raw/customers"])
    write_table(adapters.articles(spark, sf_dir), p["raw/articles"])
    tx = adapters.transactions(spark, sf_dir).withColumn("t_month", F.date_format("t_dat", "yyyy-MM"))
    write_table(tx, p["raw/transactions"], partition_by=["t_month"])
    customers = read_table(spark, p["raw/customers"])
    articles = read_table(spark, p["raw/articles"])
    history = read_table(spark, p["raw/transactions"]).drop("t_month")

    # 2 preprocess: stable maps, merged history, ratings
    user_map = _map(spark, customers, "customer_id", "user_idx", p["mappings/user_map"])
    item_map = _map(spark, articles, "article_id", "item_idx", p["mappings/item_map"])
    archived = read_if_exists(spark, p["raw/events"])
    merged = merge_events(history, archived.drop("batch_id") if archived is not None
                          and "batch_id" in archived.columns else archived)
    write_table(interactions(merged, user_map, item_map), p["processed/train_data"])
    ratings = read_table(spark, p["processed/train_data"])

    # 3 train
    if train_als:
        from driftrank.operators.model import train
        model = train(ratings, seed=seed)
        write_table(model.userFactors, p["models/user_factors"])
        write_table(model.itemFactors, p["models/item_factors"])
        save_model(model, p["models/als"])
        factors = read_table(spark, p["models/item_factors"])
        users = read_table(spark, p["models/user_factors"])
        publish(users, p["serve/user_vectors"], "id")
    elif factors is None:
        raise ValueError("factors are required when ALS is not trained")

    # 4 load: keyed lookup tables, distributed writes only
    publish(build_item_index(factors, item_map, articles), p["serve/item_index"], "item_idx")
    publish(user_map, p["serve/user_map"], "user_idx")

    # 5 trending (history only, as the original job); the month partition
    # column stays so the recency bound prunes whole months
    top = trending(read_table(spark, p["raw/transactions"]), S.TRENDING_DAYS, S.TRENDING_K)
    write_table(enrich_trending(top, item_map, articles), p["serve/trending"])
    return p


def serve_recommendations(spark: SparkSession, paths: dict[str, str], users: DataFrame,
                          history: DataFrame | None = None, k: int = S.DEFAULT_K,
                          diversity_lambda: float = S.DEFAULT_LAMBDA, **filters) -> DataFrame:
    """Answer a request table from the published tables of ``run_batch``:
    ALS user vectors, the item index and the trending list (plus a purchase
    history table when there is one)."""
    from driftrank.operators.recommend import recommend
    vectors = read_table(spark, paths["serve/user_vectors"])
    index = read_table(spark, paths["serve/item_index"])
    trend = read_table(spark, paths["serve/trending"])
    if history is None:
        history = spark.createDataFrame([], "user_idx int, item_idx int, last_purchase_at double")
    return recommend(users, vectors, index, history, trend, k=k,
                     diversity_lambda=diversity_lambda, **filters)
