"""ST7/J9 purchase intake: requests (user_idx, item_idx) -> accepted purchase
events carrying both id spaces, or rejects with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_purchases(requests: DataFrame, user_map: DataFrame, index: DataFrame,
                       ts_col: str | None = "timestamp") -> DataFrame:
    """Both lookups are left joins; the user is checked first.

    Output: user_idx, item_idx, customer_id, article_id, status
    (``accepted`` / ``user_not_found`` / ``item_not_found``).
    """
    um = user_map.select(F.col("user_idx").cast("int"), F.col("customer_id"))
    items = index.select(F.col("item_idx").cast("int"),
                         F.when(F.col("article_id") != "", F.col("article_id")).alias("article_id"))
    keep = [ts_col] if ts_col and ts_col in requests.columns else []
    j = (requests.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), *keep)
         .join(um, "user_idx", "left").join(items, "item_idx", "left"))
    status = (F.when(F.col("customer_id").isNull(), F.lit("user_not_found"))
              .when(F.col("article_id").isNull(), F.lit("item_not_found"))
              .otherwise(F.lit("accepted")))
    return j.select("user_idx", "item_idx", "customer_id", "article_id", *keep,
                    status.alias("status"))


def intake_purchases(requests: DataFrame, user_map: DataFrame, index: DataFrame):
    """ST7: (accepted purchase events in the 7-field stream shape, rejects)."""
    v = validate_purchases(requests, user_map, index)
    ts = F.col("timestamp") if "timestamp" in v.columns else F.unix_micros(F.current_timestamp()) / 1e6
    accepted = v.where(F.col("status") == "accepted").select(
        F.col("customer_id").alias("user_id"), "user_idx", F.col("article_id").alias("item_id"),
        "item_idx", F.lit("purchase").alias("event_type"), ts.cast("double").alias("timestamp"),
        F.lit(1).cast("int").alias("quantity"))
    rejects = v.where(F.col("status") != "accepted")
    return accepted, rejects
