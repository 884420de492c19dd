"""User profiles: A6 activity, R4 recent purchases, A5 top categories, UP1
profile assembly (J8 metadata attach)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftrank import schema as S


def attach_metadata(history: DataFrame, index: DataFrame,
                    cols: tuple[str, ...] = S.PAYLOAD_COLS) -> DataFrame:
    """History item -> catalog payload; missing items keep nulls."""
    return history.join(index.select("item_idx", *cols), "item_idx", "left")


def user_activity(history: DataFrame) -> DataFrame:
    """Total purchases (distinct items in the set), first and last time."""
    return history.groupBy("user_idx").agg(
        F.count(F.lit(1)).cast("int").alias("total_purchases"),
        F.min("last_purchase_at").alias("first_purchase_at"),
        F.max("last_purchase_at").alias("last_purchase_at"))


def recent_items(history: DataFrame, n: int = S.PROFILE_RECENT) -> DataFrame:
    """The n newest items per user (ties: ascending id text, as a stable
    descending sort of an ascending sorted set leaves them)."""
    S.check_args(recent_limit=n)
    w = Window.partitionBy("user_idx").orderBy(F.col("last_purchase_at").desc(),
                                               F.col("item_idx").cast("string").asc())
    return (history.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
            .select("user_idx", F.col("pos").cast("int"), "item_idx", "last_purchase_at"))


def top_categories(history: DataFrame, index: DataFrame, field: str,
                   n: int = S.PROFILE_TOP_CATEGORIES) -> DataFrame:
    """A5: the n most frequent non-empty values of ``field`` over a user's
    history items, with count and percentage of the non-empty total
    (half-even, 1 place).  Count ties: most recently purchased first, then
    name."""
    S.check_args(top_categories=n)
    h = attach_metadata(history, index, (field,)).where(
        F.col(field).isNotNull() & (F.col(field) != ""))
    c = h.groupBy("user_idx", F.col(field).alias("name")).agg(
        F.count(F.lit(1)).cast("int").alias("count"),
        F.max("last_purchase_at").alias("_recent"))
    tot = F.sum("count").over(Window.partitionBy("user_idx"))
    w = Window.partitionBy("user_idx").orderBy(F.col("count").desc(), F.col("_recent").desc(),
                                               F.col("name").asc())
    return (c.withColumn("_tot", tot).withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= n)
            .select("user_idx", F.col("pos").cast("int"), "name", "count",
                    F.bround(F.col("count") / F.col("_tot") * 100.0, 1).alias("percentage")))


def user_profiles(users_with_vectors: DataFrame, history: DataFrame, index: DataFrame,
                  user_map: DataFrame, recent_limit: int = S.PROFILE_RECENT,
                  n_categories: int = S.PROFILE_TOP_CATEGORIES, nested: bool = True) -> DataFrame:
    """UP1: one row per user that has a vector (others are "not found").

    Flat columns: user_idx, customer_id, total_purchases, first/last time.
    ``nested`` adds recent_purchases and top groups/types as sorted arrays
    of structs (each bounded: recent_limit / n_categories entries).
    """
    S.check_args(recent_limit=recent_limit, top_categories=n_categories)
    users = users_with_vectors.select(
        (F.col("id") if "id" in users_with_vectors.columns else F.col("user_idx"))
        .cast("int").alias("user_idx")).distinct()
    act = user_activity(history)
    cust = user_map.select(F.col("user_idx").cast("int"), "customer_id")
    out = (users.join(act, "user_idx", "left").join(cust, "user_idx", "left")
           .select("user_idx", "customer_id",
                   F.coalesce("total_purchases", F.lit(0)).alias("total_purchases"),
                   "first_purchase_at", "last_purchase_at"))
    if not nested:
        return out
    rec = (attach_metadata(recent_items(history, recent_limit), index)
           .groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct(
               "pos", "item_idx", F.lit(0.0).alias("score"),
               F.struct(*S.PAYLOAD_COLS).alias("metadata")))).alias("recent_purchases")))
    groups = (top_categories(history, index, "product_group_name", n_categories)
              .groupBy("user_idx").agg(F.sort_array(F.collect_list(
                  F.struct("pos", "name", "count", "percentage"))).alias("top_product_groups")))
    types = (top_categories(history, index, "product_type_name", n_categories)
             .groupBy("user_idx").agg(F.sort_array(F.collect_list(
                 F.struct("pos", "name", "count", "percentage"))).alias("top_product_types")))
    empty = F.array()
    return (out.join(rec, "user_idx", "left").join(groups, "user_idx", "left")
            .join(types, "user_idx", "left")
            .select("*").fillna(0, ["total_purchases"])
            .withColumn("recent_purchases", F.coalesce("recent_purchases", empty.cast(
                rec.schema["recent_purchases"].dataType)))
            .withColumn("top_product_groups", F.coalesce("top_product_groups", empty.cast(
                groups.schema["top_product_groups"].dataType)))
            .withColumn("top_product_types", F.coalesce("top_product_types", empty.cast(
                types.schema["top_product_types"].dataType))))
