"""Registered queries: one per operator of the inventory, each reading the
given tables at ``sf_dir``, plus the independent DuckDB twin where SQL can
express it.  Computed doubles are rounded to 6 places in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.plans.sql_views import with_views
from driftrank.plans.tables import MAP_SNAPSHOT, Tables, shared_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- sources

@register("scan_parquet", sql="SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def q_scan_parquet(spark, d):
    from driftrank.sources.tables import read_table
    return read_table(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")


@register("scan_csv", sql=with_views("articles_l") + "SELECT * FROM articles_l")
def q_scan_csv(spark, d):
    """The articles table written as header CSV by Spark, read back with
    an explicit schema (zero-padded ids stay strings)."""
    from driftrank.session import scratch_path
    from driftrank.sources.tables import read_csv_table
    t = shared_tables(spark, d)
    path = scratch_path(spark, "articles-csv")
    t.articles.write.mode("overwrite").option("header", "true").csv(path)
    return read_csv_table(spark, path, schema=S.ARTICLE_SCHEMA)


@register("sink_overwrite", sql=with_views("tx_l") + "SELECT * FROM tx_l")
def q_sink_overwrite(spark, d):
    """K1: write the transactions table (partitioned by date) and read back."""
    from driftrank.session import scratch_path
    from driftrank.sources.tables import read_table, write_table
    t = shared_tables(spark, d)
    path = scratch_path(spark, "transactions")
    write_table(t.transactions, path)
    return read_table(spark, path)


# --------------------------------------------------------- scalar columns

@register("pad_article_id",
          sql="SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS article_id FROM part")
def q_pad_article_id(spark, d):
    from driftrank.functions.columns import pad_id
    return shared_tables(spark, d).raw("part").select("p_partkey", pad_id("p_partkey").alias("article_id"))


@register("events_to_transactions", sql=with_views("ev_l") + (
    "SELECT CAST(make_timestamp(CAST(round(\"timestamp\" * 1e6) AS BIGINT)) AS DATE) AS t_dat, "
    "user_id AS customer_id, item_id AS article_id, CAST(0.03 AS DOUBLE) AS price, "
    "2 AS sales_channel_id, event_type FROM ev_l"))
def q_events_to_transactions(spark, d):
    from driftrank.operators.archive import events_to_transactions
    return events_to_transactions(shared_tables(spark, d).events)


@register("event_weights", sql=with_views("ev_l") + (
    "SELECT event_id, event_type, CAST(CASE WHEN event_type IS NULL THEN 1.0 "
    "WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'add_to_cart' THEN 0.5 "
    "WHEN event_type = 'click' THEN 0.1 ELSE 0.0 END AS DOUBLE) AS weight FROM ev_l"))
def q_event_weights(spark, d):
    from driftrank.functions.columns import event_weight
    return shared_tables(spark, d).events.select("event_id", "event_type",
                                          event_weight("event_type").alias("weight"))


@register("parse_filter_lists", sql=with_views("ev_l", extra=[
    ("lists", "SELECT user_idx, ' ' || string_agg(CAST(item_idx AS VARCHAR), ' , ' ORDER BY item_idx) || ',,' "
              "AS ids_text FROM (SELECT DISTINCT user_idx, item_idx FROM ev_l WHERE event_type = 'click') "
              "GROUP BY user_idx"),
    ("parts", "SELECT user_idx, unnest(string_split(ids_text, ',')) AS p FROM lists"),
]) + ("SELECT user_idx, TRY_CAST(trim(p) AS INTEGER) AS item_idx FROM parts "
      "WHERE trim(p) <> '' AND TRY_CAST(trim(p) AS INTEGER) IS NOT NULL"))
def q_parse_filter_lists(spark, d):
    """P10: each user's clicked items as a padded comma list (' 3 , 5,,'),
    parsed back into ids (trimmed, blanks dropped, ints)."""
    from driftrank.functions.columns import parse_csv_list
    ev = shared_tables(spark, d).events.where(F.col("event_type") == "click")
    lists = ev.select("user_idx", "item_idx").distinct().groupBy("user_idx").agg(
        F.concat(F.lit(" "), F.concat_ws(" , ", F.array_sort(F.collect_list(
            F.col("item_idx").cast("string")))), F.lit(",,")).alias("ids_text"))
    return lists.select("user_idx", F.explode(parse_csv_list("ids_text", as_int=True))
                        .alias("item_idx"))


@register("known_events", sql=with_views("ev_l") + (
    "SELECT * FROM ev_l WHERE event_type IN ('purchase', 'add_to_cart', 'click')"))
def q_known_events(spark, d):
    from driftrank.operators.interactions import known_events
    return known_events(shared_tables(spark, d).events)


@register("events_by_type", sql=with_views("ev_l") + (
    "SELECT event_type, count(*) AS count FROM ev_l GROUP BY event_type"))
def q_events_by_type(spark, d):
    from driftrank.operators.archive import count_by_type
    return count_by_type(shared_tables(spark, d).events)


# ------------------------------------------------------------- id maps

@register("dense_ids", sql=with_views("user_map_l") + "SELECT * FROM user_map_l")
def q_dense_ids(spark, d):
    return shared_tables(spark, d).user_map


@register("distinct_ids", sql=with_views("tx_l") + "SELECT DISTINCT customer_id FROM tx_l")
def q_distinct_ids(spark, d):
    return shared_tables(spark, d).transactions.select("customer_id").distinct()


_SNAP_SQL = [
    ("old_ids", f"SELECT DISTINCT customer_id FROM tx_l WHERE t_dat < DATE '{MAP_SNAPSHOT}'"),
    ("existing", "SELECT customer_id, CAST(row_number() OVER (ORDER BY customer_id) - 1 AS INTEGER) "
                 "AS user_idx FROM old_ids"),
    ("fresh", "SELECT DISTINCT customer_id FROM tx_l WHERE customer_id NOT IN "
              "(SELECT customer_id FROM existing)"),
]


def _snapshot_maps(t: Tables):
    from driftrank.operators.ids import assign_ids
    old = t.transactions.where(F.col("t_dat") < F.lit(MAP_SNAPSHOT).cast("date"))
    existing = assign_ids(old, "customer_id", "user_idx")
    return existing, t.transactions


@register("new_ids", sql=with_views("tx_l", extra=_SNAP_SQL) + "SELECT customer_id FROM fresh")
def q_new_ids(spark, d):
    from driftrank.operators.ids import new_ids
    existing, current = _snapshot_maps(shared_tables(spark, d))
    return new_ids(current, existing, "customer_id")


@register("incremental_ids", sql=with_views("tx_l", extra=_SNAP_SQL) + (
    "SELECT customer_id, user_idx FROM existing UNION ALL "
    "SELECT customer_id, CAST((SELECT coalesce(max(user_idx) + 1, 0) FROM existing) + "
    "row_number() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS user_idx FROM fresh"))
def q_incremental_ids(spark, d):
    from driftrank.operators.ids import full_mapping
    existing, current = _snapshot_maps(shared_tables(spark, d))
    return full_mapping(existing, current, "customer_id", "user_idx")


@register("string_index", sql=with_views("tx_l") + (
    "SELECT article_id, CAST(row_number() OVER (ORDER BY count(*) DESC, article_id) - 1 AS DOUBLE) "
    "AS item_idx, count(*) AS count FROM tx_l GROUP BY article_id"))
def q_string_index(spark, d):
    from driftrank.operators.ids import string_index
    return string_index(shared_tables(spark, d).transactions, "article_id", "item_idx")


# ------------------------------------------------------ joins / ratings

@register("map_users", sql=with_views("tx_l", "user_map_l") + (
    "SELECT t.customer_id, t.article_id, t.t_dat, t.price, m.user_idx "
    "FROM tx_l t JOIN user_map_l m ON t.customer_id = m.customer_id"))
def q_map_users(spark, d):
    from driftrank.operators.interactions import map_users
    t = shared_tables(spark, d)
    return map_users(t.transactions, t.user_map).select(
        "customer_id", "article_id", "t_dat", "price", "user_idx")


@register("map_interactions", sql=with_views("tx_l", "user_map_l", "item_map_l") + (
    "SELECT u.user_idx, i.item_idx, t.t_dat, t.price FROM tx_l t "
    "JOIN user_map_l u ON t.customer_id = u.customer_id "
    "JOIN item_map_l i ON t.article_id = i.article_id"))
def q_map_interactions(spark, d):
    from driftrank.operators.interactions import map_items, map_users
    t = shared_tables(spark, d)
    return map_items(map_users(t.transactions, t.user_map), t.item_map).select(
        "user_idx", "item_idx", "t_dat", "price")


_MERGED_SQL = [
    ("ev_tx", "SELECT CAST(make_timestamp(CAST(round(\"timestamp\" * 1e6) AS BIGINT)) AS DATE) AS t_dat, "
              "user_id AS customer_id, item_id AS article_id, CAST(0.03 AS DOUBLE) AS price, "
              "2 AS sales_channel_id, event_type FROM ev_l"),
    ("merged", "SELECT * FROM tx_l UNION ALL BY NAME SELECT * FROM ev_tx"),
]


def _merged(t: Tables) -> DataFrame:
    from driftrank.operators.archive import events_to_transactions
    from driftrank.operators.interactions import merge_events
    return merge_events(t.transactions, events_to_transactions(t.events))


@register("merge_events", sql=with_views("tx_l", "ev_l", extra=_MERGED_SQL) + "SELECT * FROM merged")
def q_merge_events(spark, d):
    return _merged(shared_tables(spark, d))


@register("interactions", sql=with_views("tx_l", "ev_l", "user_map_l", "item_map_l",
                                         extra=_MERGED_SQL) + (
    "SELECT u.user_idx, i.item_idx, CAST(ln(1 + sum(CASE WHEN m.event_type IS NULL THEN 1.0 "
    "WHEN m.event_type = 'purchase' THEN 1.0 WHEN m.event_type = 'add_to_cart' THEN 0.5 "
    "WHEN m.event_type = 'click' THEN 0.1 ELSE 0.0 END)) AS FLOAT) AS rating "
    "FROM merged m JOIN user_map_l u ON m.customer_id = u.customer_id "
    "JOIN item_map_l i ON m.article_id = i.article_id GROUP BY u.user_idx, i.item_idx"))
def q_interactions(spark, d):
    from driftrank.operators.interactions import interactions
    t = shared_tables(spark, d)
    return interactions(_merged(t), t.user_map, t.item_map)


# ---------------------------------------------------------- aggregates

@register("distinct_buyers", sql=with_views("tx_l") + (
    "SELECT article_id, CAST(count(DISTINCT customer_id) AS DOUBLE) AS score FROM tx_l "
    "GROUP BY article_id"))
def q_distinct_buyers(spark, d):
    from driftrank.operators.trending import distinct_buyers
    return distinct_buyers(shared_tables(spark, d).transactions)


@register("recent_transactions", sql=with_views("tx_l") + (
    "SELECT * FROM tx_l WHERE t_dat >= (SELECT max(t_dat) FROM tx_l) - 30"))
def q_recent_transactions(spark, d):
    from driftrank.operators.trending import recent
    return recent(shared_tables(spark, d).transactions, S.TRENDING_DAYS)


@register("popular_by_count", sql=with_views("tx_l", "articles_l") + (
    "SELECT p.article_id, a.prod_name, a.product_type_name, p.count FROM "
    "(SELECT article_id, count(*) AS count FROM tx_l GROUP BY article_id "
    " ORDER BY count DESC, article_id LIMIT 20) p JOIN articles_l a ON p.article_id = a.article_id"))
def q_popular_by_count(spark, d):
    """20 most interacted items with names (top-k report)."""
    from driftrank.operators.interactions import popularity
    t = shared_tables(spark, d)
    top = popularity(t.transactions).orderBy(F.col("count").desc(), "article_id").limit(20)
    return (top.join(t.articles, "article_id")
            .select("article_id", "prod_name", "product_type_name", "count")
            .orderBy(F.col("count").desc(), "article_id"))


@register("matrix_stats", sql=with_views("tx_l") + (
    "SELECT n_rows, n_users, n_items, n_pairs, "
    "round(n_pairs * 1.0 / (n_users * n_items) * 100.0, 6) AS density_pct, "
    "round((1.0 - n_pairs * 1.0 / (n_users * n_items)) * 100.0, 6) AS sparsity_pct FROM "
    "(SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_users, "
    " count(DISTINCT article_id) AS n_items, "
    " (SELECT count(*) FROM (SELECT DISTINCT customer_id, article_id FROM tx_l)) AS n_pairs FROM tx_l)"))
def q_matrix_stats(spark, d):
    from driftrank.operators.interactions import matrix_stats
    return matrix_stats(shared_tables(spark, d).transactions)


# ------------------------------------------------------------- trending

_TREND_SQL = [
    ("recent_tx", "SELECT * FROM tx_l WHERE t_dat >= (SELECT max(t_dat) FROM tx_l) - 30"),
    ("scored", "SELECT article_id, CAST(count(DISTINCT customer_id) AS DOUBLE) AS score "
               "FROM recent_tx GROUP BY article_id"),
    ("top", "SELECT CAST(row_number() OVER (ORDER BY score DESC, article_id) AS INTEGER) AS rank, "
            "article_id, score FROM scored ORDER BY score DESC, article_id LIMIT 50"),
]


@register("trending_topk", sql=with_views("tx_l", extra=_TREND_SQL) + "SELECT * FROM top")
def q_trending_topk(spark, d):
    from driftrank.operators.trending import trending
    return trending(shared_tables(spark, d).transactions).select("rank", "article_id", "score")


@register("trending_enriched", sql=with_views("tx_l", "item_map_l", "articles_l", extra=_TREND_SQL) + (
    "SELECT t.rank, m.item_idx, t.article_id, t.score, a.prod_name, a.product_type_name, "
    "a.product_group_name, a.graphical_appearance_name, substr(t.article_id, 1, 3) AS image_code, "
    "'trending_now' AS source FROM top t JOIN item_map_l m ON t.article_id = m.article_id "
    "LEFT JOIN articles_l a ON t.article_id = a.article_id ORDER BY t.rank"))
def q_trending_enriched(spark, d):
    return shared_tables(spark, d).trending


# the vector / state / recommendation layers register themselves on import
from driftrank.plans import catalog_vectors  # noqa: E402,F401
from driftrank.plans import catalog_stream  # noqa: E402,F401
from driftrank.plans import catalog_extra  # noqa: E402,F401
