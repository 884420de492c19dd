"""Trending items: F1 recency, A2 distinct buyers, R1 top-k, T1/T2 trending
and its enrichment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.functions.columns import image_code, item_metadata


def recent(tx: DataFrame, days: int = S.TRENDING_DAYS, as_of: dt.date | str | None = None,
           date_col: str = "t_dat", month_col: str = "t_month") -> DataFrame:
    """rows with ``date >= anchor - days`` (inclusive).

    The anchor is the data's own max date (a scalar subquery, same plan) or
    a literal ``as_of``; a literal bound reaches the Parquet scan as a
    pushed filter.  When the table carries the month partition column the
    same bound is applied to it too, so whole months are pruned.
    """
    if as_of is not None:
        bound: Column = F.date_sub(F.lit(as_of).cast("date"), days)
    else:
        bound = F.date_sub(tx.agg(F.max(date_col)).scalar(), days)
    out = tx.where(F.col(date_col) >= bound)
    if month_col in tx.columns:
        out = out.where(F.col(month_col) >= F.date_format(bound, "yyyy-MM"))
    return out


def distinct_buyers(tx: DataFrame, item: str = "article_id", user: str = "customer_id",
                    approx_rsd: float | None = None) -> DataFrame:
    """A2: distinct buyers per item (exact, or HyperLogLog++ with ``approx_rsd``)."""
    agg = (F.approx_count_distinct(user, approx_rsd) if approx_rsd
           else F.count_distinct(user))
    return tx.groupBy(item).agg(agg.cast("double").alias("score"))


def topk(df: DataFrame, k: int, score: str = "score", tie: str = "article_id") -> DataFrame:
    """Global top-k with a total order, plus an explicit 1-based rank.

    ``orderBy().limit()`` plans as TakeOrderedAndProject (k rows per task,
    then one merge of k x tasks rows); the rank is assigned on those k rows.
    """
    top = df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)
    w = Window.orderBy(F.col(score).desc(), F.col(tie).asc())
    return top.withColumn("rank", F.row_number().over(w))


def trending(tx: DataFrame, days: int = S.TRENDING_DAYS, k: int = S.TRENDING_K,
             as_of=None, approx_rsd: float | None = None) -> DataFrame:
    """Top-k items by distinct buyers in the last ``days`` days."""
    return topk(distinct_buyers(recent(tx, days, as_of), approx_rsd=approx_rsd), k)


def daily_buyers(tx: DataFrame, user_map: DataFrame) -> DataFrame:
    """Mergeable sets of buyers per day and item, from transactions of any days.

    Exact: (t_dat, article_id, bucket, buyers), the places of the buyers among
    32,768 dense user ids per row, so an item with very many buyers is many
    bounded rows and one with a single buyer is a small one.  What is
    shuffled are the transactions, not a set for each of them.
    """
    bought = tx.select("t_dat", "article_id", "customer_id").join(user_map.select("customer_id", "user_idx"), "customer_id")
    bit = F.col("user_idx").cast("long") + 1
    keys = ["t_dat", "article_id", "bucket"]
    placed = bought.select("t_dat", "article_id", F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).cast("int").alias("at"))
    return placed.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("buyers"))


def daily_sketches(tx: DataFrame, log_k: int = 12) -> DataFrame:
    """The approximate form: (t_dat, article_id, sketch), one HyperLogLog sketch of 2^log_k registers."""
    return tx.groupBy("t_dat", "article_id").agg(F.hll_sketch_agg("customer_id", log_k).alias("sketch"))


def trending_from_days(days: DataFrame, window: int = S.TRENDING_DAYS, k: int = S.TRENDING_K, as_of=None) -> DataFrame:
    """T1 from the day tables: the sets of the window's days are united, no transaction is read.

    ``days`` is a table of ``daily_buyers`` (exact) or ``daily_sketches``
    rows; several rows of one day and item, as from late data, are united too.
    """
    live = recent(days, window, as_of)
    if "sketch" in days.columns:
        score = live.groupBy("article_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("score"))
    else:
        one = live.select("article_id", "bucket", F.explode("buyers").alias("at"))
        score = one.groupBy("article_id").agg(F.count_distinct("bucket", "at").cast("double").alias("score"))
    return topk(score, k)


def enrich_trending(top: DataFrame, item_map: DataFrame, articles: DataFrame,
                    flat: bool = True) -> DataFrame:
    """Attach item_idx (inner) and article payload (left), ranked anew
    without gaps where an item has no index.  ``top`` has at most k rows, so
    it is broadcast (proven bound) and its mapped rows fit one window."""
    mapped = item_map.select("article_id", "item_idx").join(F.broadcast(top), "article_id")
    mapped = mapped.withColumn("rank", F.row_number().over(Window.orderBy("rank", "article_id")))
    meta = articles.select("article_id", "prod_name", "product_type_name",
                           "product_group_name", "graphical_appearance_name")
    joined = mapped.join(meta, "article_id", "left")
    if flat:
        out = joined.select(
            F.col("rank").cast("int"), F.col("item_idx").cast("int"), "article_id", "score",
            "prod_name", "product_type_name", "product_group_name",
            "graphical_appearance_name", image_code("article_id").alias("image_code"),
            F.lit(S.SOURCE_TRENDING).alias("source"))
    else:
        out = joined.select(
            F.col("rank").cast("int"), F.col("item_idx").cast("int"), "score",
            item_metadata().alias("metadata"), F.lit(S.SOURCE_TRENDING).alias("source"))
    return out.orderBy("rank")
