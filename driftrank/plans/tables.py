"""Logical tables of the pipeline built from a test-data folder.

Every derived table (maps, index, user vectors, histories) is computed by
Spark from the given tables, so the work grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank import adapters
from driftrank import schema as S

# Snapshot date of the "existing" id map in the incremental-map query: the
# map as it stood for transactions before this day.
MAP_SNAPSHOT = "1999-01-01"


# Approximate search: a cell per ~45 items of the largest test index, whose
# vectors point everywhere, so that most cells have to be probed.
CELLS = {"n_cells": 44, "probes": 36, "rerank": 150}


_SHARED: dict = {}


def shared_tables(spark: SparkSession, sf_dir: str) -> "Tables":
    """One Tables per (session, folder): the checkpointed state tables are
    computed once and then read by every query of the session, as the
    pipeline's persisted tables are.  ``clear_shared()`` drops them."""
    key = (id(spark.sparkContext), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    t = _SHARED.get(key)
    if t is None:
        t = _SHARED[key] = Tables(spark, sf_dir)
    return t


def clear_shared() -> None:
    _SHARED.clear()


class Tables:
    """Logical tables of one data folder.

    With ``materialize`` the derived state tables (maps, index, accepted
    events, vectors, history, trending) are written as Parquet below the
    session's shared checkpoint dir on first use: the lineage is cut, the id
    assignment is fixed once, and every later plan reads the written table,
    with its statistics, column pruning and pushed filters.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize = materialize

    def _keep(self, df: DataFrame) -> DataFrame:
        if not self.materialize:
            return df
        from driftrank.session import scratch_path
        path = scratch_path(self.spark, "state")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def raw(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    @cached_property
    def customers(self) -> DataFrame:
        return adapters.customers(self.spark, self.sf_dir)

    @cached_property
    def articles(self) -> DataFrame:
        return adapters.articles(self.spark, self.sf_dir)

    @cached_property
    def transactions(self) -> DataFrame:
        return adapters.transactions(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return adapters.events(self.spark, self.sf_dir, self.user_map, self.item_map)

    @cached_property
    def user_map(self) -> DataFrame:
        from driftrank.operators.ids import assign_ids
        return self._keep(assign_ids(self.customers, "customer_id", "user_idx"))

    @cached_property
    def item_map(self) -> DataFrame:
        from driftrank.operators.ids import assign_ids
        return self._keep(assign_ids(self.articles, "article_id", "item_idx"))

    @cached_property
    def item_factors(self) -> DataFrame:
        return adapters.item_factors(self.spark, self.sf_dir)

    @cached_property
    def item_index(self) -> DataFrame:
        from driftrank.operators.knn import build_item_index
        return self._keep(build_item_index(self.item_factors, self.item_map, self.articles))

    @cached_property
    def cell_index(self):
        """The item index as published cells with codes, trained once per folder."""
        from driftrank.operators.cells import CellIndex, publish_cells, train_cells
        from driftrank.session import scratch_path
        model = train_cells(self.item_index, CELLS["n_cells"])
        table = publish_cells(self.item_index, model, scratch_path(self.spark, "cells"))
        return CellIndex(model, table, CELLS["probes"], CELLS["rerank"])

    @cached_property
    def item_vectors(self) -> DataFrame:
        return self.item_index.select(F.col("item_idx"), F.col("features"))

    @cached_property
    def accepted_events(self) -> DataFrame:
        """Known-type events that pass the debounce (user, item, type; 300 s)."""
        from driftrank.operators.interactions import known_events
        from driftrank.operators.state import debounce
        return self._keep(debounce(known_events(self.events)))

    @cached_property
    def user_vectors(self) -> DataFrame:
        """User vectors drifted by EMA over the accepted events (cold start)."""
        from driftrank.operators.state import ema_vectors
        return self._keep(ema_vectors(self.accepted_events, self.item_vectors))

    @cached_property
    def prior_vectors(self) -> DataFrame:
        """Trained user vectors (id, features) that the events then drift:
        the embeddings stand for the ALS user factors of the same index."""
        return self.item_factors.join(self.user_map.select(F.col("user_idx").alias("id")), "id", "left_semi")

    @cached_property
    def seeded_vectors(self) -> DataFrame:
        """User vectors drifted from the trained ones."""
        from driftrank.operators.state import ema_vectors
        return self._keep(ema_vectors(self.accepted_events, self.item_vectors, user_vectors=self.prior_vectors))

    @cached_property
    def history(self) -> DataFrame:
        """Bounded purchase history (last 100 distinct items, 1-year expiry)."""
        from driftrank.operators.state import user_history
        return self._keep(user_history(self.accepted_events, self.item_vectors))

    @cached_property
    def trending(self) -> DataFrame:
        from driftrank.operators.trending import enrich_trending, trending
        return self._keep(enrich_trending(trending(self.transactions, S.TRENDING_DAYS, S.TRENDING_K),
                               self.item_map, self.articles))

    @cached_property
    def users(self) -> DataFrame:
        """Request table: every mapped customer asks for recommendations."""
        return self.user_map.select(F.col("user_idx").cast("int").alias("user_idx"))

    @cached_property
    def ratings(self) -> DataFrame:
        """Weighted implicit ratings of transactions and archived events."""
        from driftrank.operators.archive import events_to_transactions
        from driftrank.operators.interactions import interactions, merge_events
        merged = merge_events(self.transactions, events_to_transactions(self.events))
        return self._keep(interactions(merged, self.user_map, self.item_map))

    @cached_property
    def als_model(self):
        """The ALS model of the ratings, trained once per folder."""
        from driftrank.operators.model import train
        return train(self.ratings)
