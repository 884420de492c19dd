"""Interaction matrix: J1/J2 map ids, A1 ratings, A7 popularity, A8/A9 stats,
U1/ST6 merge of history with archived events, F4 known events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.functions.columns import damped_rating, event_weight


def merge_events(transactions: DataFrame, archived: DataFrame | None) -> DataFrame:
    """U1/ST6: history plus archived events by name, missing columns null."""
    if archived is None:
        return transactions
    return transactions.unionByName(archived, allowMissingColumns=True)


def map_users(tx: DataFrame, user_map: DataFrame) -> DataFrame:
    """Attach user_idx (inner).  The user map grows with the customer
    base, so no unconditional broadcast: AQE broadcasts it when its measured
    size is under the threshold and otherwise sort-merges (skew-split)."""
    return tx.join(user_map.select("customer_id", "user_idx"), "customer_id", "inner")


def map_items(tx: DataFrame, item_map: DataFrame) -> DataFrame:
    """Attach item_idx (inner)."""
    return tx.join(item_map.select("article_id", "item_idx"), "article_id", "inner")


def interactions(tx: DataFrame, user_map: DataFrame, item_map: DataFrame,
                 weights: Mapping[str, float] = S.EVENT_WEIGHTS) -> DataFrame:
    """A1: rating = log1p(sum of event weights) per (user_idx, item_idx).

    The weights are summed per (customer_id, article_id) *before* the id
    joins: the partial aggregate collapses a hot customer's rows map-side,
    so the joins see one row per pair instead of one per transaction.  The
    maps are 1:1, so the result equals joining first.
    """
    pairs = (tx.groupBy("customer_id", "article_id")
             .agg(F.sum(event_weight("event_type", weights)).alias("_w")))
    mapped = map_items(map_users(pairs, user_map), item_map)
    return mapped.select(
        F.col("user_idx").cast("int"),
        F.col("item_idx").cast("int"),
        damped_rating(F.col("_w")).alias("rating"),
    )


def popularity(tx: DataFrame, key: str = "article_id") -> DataFrame:
    """Interaction count per item."""
    return tx.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def matrix_stats(tx: DataFrame, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """Rows, distinct users/items/pairs, density and sparsity (%).

    The rows are counted per (user, item) once, with map-side partial counts;
    the distinct counts then run over that smaller table, which is hashed by
    the distinct key, so a hot user or item never lands in a single task.
    """
    pairs = tx.groupBy(user, item).agg(F.count(F.lit(1)).alias("n"))
    one = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_distinct(user).alias("n_users"),
        F.count_distinct(item).alias("n_items"),
        F.count(F.when(F.col(user).isNotNull() & F.col(item).isNotNull(), 1)).alias("n_pairs"),
    )
    density = F.col("n_pairs").cast("double") / (F.col("n_users") * F.col("n_items"))
    return one.select(
        "n_rows", "n_users", "n_items", "n_pairs",
        F.round(density * 100.0, 6).alias("density_pct"),
        F.round((F.lit(1.0) - density) * 100.0, 6).alias("sparsity_pct"),
    )


def known_events(events: DataFrame, weights: Mapping[str, float] = S.EVENT_WEIGHTS) -> DataFrame:
    """keep events whose type carries a weight (null and unknown dropped)."""
    return events.where(F.col("event_type").isin(list(weights)))
