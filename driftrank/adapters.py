"""Map the driver's TPC-H-ish test tables onto the logical tables.

| logical      | from                | rule                                         |
|--------------|---------------------|----------------------------------------------|
| customers    | customer            | customer_id = string(c_custkey)              |
| articles     | part                | padded p_partkey, name, type -> group, brand -> type, size |
| transactions | lineitem x orders   | date of order, customer, padded part, price  |
| events       | events              | user_id, padded props.k; indices from the maps |
| item_factors | embeddings          | id = vec_id, features = embedding            |

The event type map (view -> add_to_cart) is a fixture choice so that every
weight class occurs; error/signup stay unknown to exercise the filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.functions.columns import pad_id

FIXTURE_TYPE_MAP = {"view": "add_to_cart"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        pad_id("p_partkey").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        F.col("p_brand").alias("product_type_name"),
        F.col("p_type").alias("product_group_name"),
        F.col("p_size").cast("string").alias("graphical_appearance_name"),
        F.floor(F.col("p_size") / 10).cast("string").alias("index_group_name"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        F.to_date("o_orderdate").alias("t_dat"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        pad_id("l_partkey").alias("article_id"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.lit(S.ARCHIVE_SALES_CHANNEL).cast("int").alias("sales_channel_id"),
        F.lit(None).cast("string").alias("event_type"),
    )


def _fixture_type(col: str = "event_type"):
    expr = F.col(col)
    for src, dst in FIXTURE_TYPE_MAP.items():
        expr = F.when(F.col(col) == src, F.lit(dst)).otherwise(expr)
    return expr


def events(spark: SparkSession, sf_dir: str, user_map: DataFrame | None = None,
           item_map: DataFrame | None = None) -> DataFrame:
    """Event rows in the stream's 7-field shape plus ``event_id`` for order."""
    return events_from_raw(table(spark, sf_dir, "events"), user_map, item_map)


def events_from_raw(e: DataFrame, user_map: DataFrame | None = None,
                    item_map: DataFrame | None = None) -> DataFrame:
    """Events with the indices of the id maps; null for ids that a map lacks.

    Without maps the ids in the events count as indices themselves (tests of
    the operators on event tables of their own).
    """
    item = F.get_json_object("props", "$.k").try_cast("int")
    ev = e.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        pad_id(item).alias("item_id"),
        *([] if user_map is not None else [F.col("user_id").cast("int").alias("user_idx")]),
        *([] if item_map is not None else [item.alias("item_idx")]),
        _fixture_type().alias("event_type"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.lit(1).cast("int").alias("quantity"),
    )
    if user_map is not None:
        ev = ev.join(user_map.select(F.col("customer_id").alias("user_id"),
                                     F.col("user_idx").cast("int").alias("user_idx")), "user_id", "left")
    if item_map is not None:
        ev = ev.join(item_map.select(F.col("article_id").alias("item_id"),
                                     F.col("item_idx").cast("int").alias("item_idx")), "item_id", "left")
    return ev.select("event_id", "user_id", "user_idx", "item_id", "item_idx", "event_type", "timestamp", "quantity")


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"),
        F.col("embedding").cast(S.VECTOR_TYPE).alias("features"),
    )
