"""ALS1-ALS4 model operators, P8 explode of ranked lists, J6 enrichment."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank import schema as S


#: ALS's own number of factor blocks, kept until a block would hold more ratings than this:
#: a task sorts the ratings of its block and holds up to a factor of the other side for each
BLOCKS, BLOCK_RATINGS = 10, 3_000_000
#: more blocks than this are kept on disk between the iterations, so that memory is the tasks'
BLOCKS_IN_MEMORY = 40
SWEEP_S = 10.0


def factor_blocks(ratings: int) -> int:
    """Factor blocks per side.  Every half iteration sends a factor once to
    each block that rates it, so what is shuffled grows with the blocks up to
    a copy per rating: they follow the ratings that a block can hold, not the
    shuffle width."""
    return max(BLOCKS, -(-ratings // BLOCK_RATINGS))


@contextmanager
def swept(spark: SparkSession, every: float = SWEEP_S):
    """Collects the driver's garbage every so many seconds: Spark removes the
    shuffle files of a finished iteration once nothing refers to them, which a
    driver with little to do finds out long after the training."""
    done = threading.Event()

    def sweep():
        while not done.wait(every):
            spark.sparkContext._jvm.System.gc()

    thread = threading.Thread(target=sweep, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def train(interactions: DataFrame, seed: int = 42, user_col: str = "user_idx",
          item_col: str = "item_idx", rating_col: str = "rating", **overrides) -> ALSModel:
    """ALS1/ALS2: implicit-feedback ALS (rank 32, reg 0.01, alpha 1, 10
    iterations, cold-start rows dropped) with a fixed seed.  The session's
    checkpoint dir cuts the lineage at every iteration, so that the disk holds
    the shuffles of about two and not of all."""
    params = {"checkpointInterval": 1, **S.ALS_PARAMS, **overrides}
    if "numUserBlocks" not in params:
        blocks = factor_blocks(interactions.count())
        params.update(numUserBlocks=blocks, numItemBlocks=blocks)
        if blocks > BLOCKS_IN_MEMORY:
            params = {"intermediateStorageLevel": "DISK_ONLY", "finalStorageLevel": "DISK_ONLY", **params}
    als = ALS(userCol=user_col, itemCol=item_col, ratingCol=rating_col, seed=seed, **params)
    with swept(interactions.sparkSession):
        return als.fit(interactions)


def batch_recommend(user_factors: DataFrame, item_factors: DataFrame, n: int,
                    user_col: str = "user_idx") -> DataFrame:
    """ALS3: top-n items for every user by dot product, in the shape of
    ``recommendForAllUsers`` (user, recommendations array<item_idx, rating>),
    from factor tables (id, features).

    Scored with the sharded block kNN (``metric='dot'``) instead of the
    built-in, which cross-joins user and item factor blocks; ties go to the
    smaller item id.  Each user's list holds n entries (a bounded group).
    """
    from driftrank.operators.knn import knn
    users = user_factors.select(F.col("id").alias(user_col), "features")
    items = item_factors.select(F.col("id").alias("item_idx"), "features")
    top = knn(users, items, n, query_id=user_col, metric="dot")
    return top.groupBy(user_col).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "item_idx", F.col("score").cast("float").alias("rating")))).alias("_r")).select(
        user_col, F.transform("_r", lambda x: F.struct(x["item_idx"].alias("item_idx"),
                                                       x["rating"].alias("rating"))).alias("recommendations"))


def explode_recs(recs: DataFrame, list_col: str = "recommendations",
                 key: str = "user_idx") -> DataFrame:
    """Ranked array of structs -> one row per entry with its 1-based rank."""
    return recs.select(key, F.posexplode(list_col).alias("_pos", "_rec")).select(
        key, (F.col("_pos") + 1).cast("int").alias("rank"), "_rec.*")


def attach_articles(recs: DataFrame, item_map: DataFrame, articles: DataFrame) -> DataFrame:
    """item_idx -> article_id and name (inner joins)."""
    return (recs.join(item_map.select("item_idx", "article_id"), "item_idx")
            .join(articles.select("article_id", "prod_name"), "article_id"))


def holdout_split(df: DataFrame, keys: list[str], test_pct: int = 20, seed: int = 42) -> DataFrame:
    """ALS4: deterministic train/test split by an md5 hash of the row key
    (independent of partition layout and engine, unlike ``randomSplit``)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int") % 100
    return df.withColumn("split", F.when(bucket < test_pct, F.lit("test")).otherwise(F.lit("train")))
