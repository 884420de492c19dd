"""More registered queries: filtered recommendations, exploded ranked lists,
purchase intake events, similar-items outcomes and the model round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.plans.catalog import register
from driftrank.plans.catalog_vectors import KNN_SQL, RECO_SQL, STATE_SQL, TREND_SQL, _PURCHASE_SQL, _mmr_sql, _shown, _topcat_sql
from driftrank.plans.sql_views import cos_sql, with_views
from driftrank.plans.tables import shared_tables

K = S.DEFAULT_K

_FILTERED_SQL = KNN_SQL + TREND_SQL + [
    ("cart", "SELECT DISTINCT user_idx, item_idx FROM ev_l WHERE event_type = 'add_to_cart' "
             "AND item_idx IS NOT NULL"),
    ("fiv", "SELECT item_idx, v FROM index_l WHERE product_group_name = 'ECONOMY' "
            "AND coalesce(product_type_name, '') NOT IN ('Brand#1')"),
    ("fkp", "SELECT q.user_idx, i.item_idx, " + cos_sql("q.u", "i.v") + " AS score "
            "FROM uq q JOIN fiv i ON true WHERE NOT EXISTS (SELECT 1 FROM hist h "
            "WHERE h.user_idx = q.user_idx AND h.item_idx = i.item_idx) AND NOT EXISTS "
            "(SELECT 1 FROM cart c WHERE c.user_idx = q.user_idx AND c.item_idx = i.item_idx)"),
    ("fkr", "SELECT user_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) "
            "AS INTEGER) AS rank, item_idx, score FROM fkp"),
    ("personal", "SELECT user_idx, rank, item_idx, round(score, 6) AS score, 'personalized' AS source, 'known' AS user_type, "
                 f"CAST(NULL AS VARCHAR) AS reason FROM fkr WHERE rank <= {K}"),
] + RECO_SQL[len(KNN_SQL) + len(TREND_SQL) + 1:]


def _carts(t):
    """Explicit exclusions: per user all distinct carted items (bounded by the catalog)."""
    return (t.events.where((F.col("event_type") == "add_to_cart") & F.col("item_idx").isNotNull())
            .groupBy("user_idx").agg(F.collect_set(F.col("item_idx").cast("int")).alias("cart")))


@register("recommend_filtered", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l",
                                               extra=_FILTERED_SQL) + "SELECT * FROM reco")
def q_recommend_filtered(spark, d):
    """RC1 + F2 + F3: only ECONOMY items, Brand#1 excluded, and per user the
    items of all add-to-cart events excluded besides history; the filters
    act before the top-10 cut; fallback ignores them."""
    from driftrank.operators.recommend import recommend
    t = shared_tables(spark, d)
    cart = _carts(t)
    users = t.users.join(cart, "user_idx", "left")
    return recommend(users, t.user_vectors, t.item_index, t.history, t.trending, k=K,
                     diversity_lambda=1.0, product_group="ECONOMY", exclude_types=["Brand#1"],
                     exclude_col="cart").withColumn("score", F.round("score", 6))


@register("filter_usage", sql=with_views("ev_l", "index_l", extra=_FILTERED_SQL[:len(KNN_SQL)] + [
    _FILTERED_SQL[len(KNN_SQL) + len(TREND_SQL)],
    ("req", "SELECT user_idx FROM user_map_l"),
    ("srch", "SELECT r.user_idx FROM req r JOIN uq q ON r.user_idx = q.user_idx"),
    ("cnt", "SELECT (SELECT count(*) FROM srch) AS searched, "
            "(SELECT count(*) FROM srch s JOIN hist h ON s.user_idx = h.user_idx) AS hist_items, "
            "(SELECT count(*) FROM srch s JOIN cart c ON s.user_idx = c.user_idx) AS cart_items, "
            "(SELECT count(DISTINCT s.user_idx) FROM srch s JOIN cart c ON s.user_idx = c.user_idx) AS cart_users"),
]) + ("SELECT kind, count FROM (SELECT 'excluded_history' AS kind, hist_items AS count FROM cnt "
      "UNION ALL SELECT 'excluded_explicit', cart_items FROM cnt "
      "UNION ALL SELECT 'filter_product_group', searched FROM cnt "
      "UNION ALL SELECT 'filter_exclude_types', searched FROM cnt "
      "UNION ALL SELECT 'filter_exclude_ids', cart_users FROM cnt)"))
def q_filter_usage(spark, d):
    """ME6 for the filtered request table: items excluded by history and
    explicitly, and requests per filter kind (counted, as the service did,
    only for users that reach the vector search)."""
    t = shared_tables(spark, d)
    cart = _carts(t)
    searched = t.users.join(t.user_vectors.select("user_idx"), "user_idx").join(cart, "user_idx", "left")
    hist = t.history.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_h"))
    s = searched.join(hist, "user_idx", "left").agg(
        F.count(F.lit(1)).alias("searched"),
        F.coalesce(F.sum("_h"), F.lit(0)).cast("long").alias("hist_items"),
        F.coalesce(F.sum(F.size(F.coalesce("cart", F.array()))), F.lit(0)).cast("long").alias("cart_items"),
        F.count(F.when(F.size(F.coalesce("cart", F.array())) > 0, 1)).alias("cart_users"))
    return s.select(F.inline(F.array(
        F.struct(F.lit("excluded_history").alias("kind"), F.col("hist_items").alias("count")),
        F.struct(F.lit("excluded_explicit").alias("kind"), F.col("cart_items").alias("count")),
        F.struct(F.lit("filter_product_group").alias("kind"), F.col("searched").alias("count")),
        F.struct(F.lit("filter_exclude_types").alias("kind"), F.col("searched").alias("count")),
        F.struct(F.lit("filter_exclude_ids").alias("kind"), F.col("cart_users").alias("count")))))


@register("recommend_nested")
def q_recommend_nested(spark, d):
    """RC1 + E1 in the response shape: per user, source and a ranked array of
    items with payload metadata and (personalised only) explanations."""
    from driftrank.operators.recommend import explain, nest_recommendations, recommend
    t = shared_tables(spark, d)
    recs = recommend(t.users, t.user_vectors, t.item_index, t.history, t.trending, k=K,
                     diversity_lambda=S.DEFAULT_LAMBDA)
    return nest_recommendations(recs, t.item_index, explain(recs, t.history, t.item_index))


@register("recs_exploded", sql=_topcat_sql("product_group_name"))
def q_recs_exploded(spark, d):
    """The profile's ranked group list (array of structs) exploded back
    into rows with its position."""
    from driftrank.operators.profile import user_profiles
    t = shared_tables(spark, d)
    prof = user_profiles(t.user_vectors, t.history, t.item_index, t.user_map, nested=True)
    return prof.select("user_idx", F.inline("top_product_groups")).select(
        "user_idx", "pos", "name", "count", "percentage")


@register("similar_outcomes", sql=with_views("item_map_l", "index_l") + (
    "SELECT CASE WHEN i.item_idx IS NOT NULL THEN 'success' ELSE 'not_found' END AS status, "
    "count(*) AS count FROM item_map_l m LEFT JOIN index_l i ON m.item_idx = i.item_idx GROUP BY 1"))
def q_similar_outcomes(spark, d):
    """ME10: similar-item requests by outcome."""
    from driftrank.operators.knn import similar_items_status
    t = shared_tables(spark, d)
    return (similar_items_status(t.item_map.select("item_idx"), t.item_index)
            .groupBy("status").agg(F.count(F.lit(1)).alias("count")))


@register("purchase_events", sql=with_views("ev_l", "index_l", "user_map_l", extra=_PURCHASE_SQL + [
    ("pt", "SELECT p.event_id, e.\"timestamp\" FROM ev_l e JOIN pv p ON e.event_id = p.event_id"),
]) + ("SELECT v.customer_id AS user_id, v.user_idx, v.article_id AS item_id, v.item_idx, "
      "'purchase' AS event_type, pt.\"timestamp\", 1 AS quantity FROM pv v "
      "JOIN pt ON v.event_id = pt.event_id WHERE v.status = 'accepted'"))
def q_purchase_events(spark, d):
    """ST7: accepted purchase requests as 7-field stream events carrying both
    id spaces (rejects go to ``validate_purchases``)."""
    from driftrank.operators.purchases import intake_purchases
    t = shared_tables(spark, d)
    req = t.events.where(F.col("event_type") == "purchase").select("user_idx", "item_idx", "timestamp")
    accepted, _ = intake_purchases(req, t.user_map, t.item_index)
    return accepted


# five mixes of arguments, dealt by request: plain, one group only, some types out, explicit exclusions, out of range
_MIX = "(({r} // 2 + {r} % 2) % 5)"
_LAM = "CASE " + _MIX + " WHEN 1 THEN 0.8 WHEN 3 THEN 0.5 ELSE 1.0 END"
_K = "CASE " + _MIX + " WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 20 WHEN 3 THEN 3 ELSE 0 END"
_REQUESTS_SQL = STATE_SQL + TREND_SQL + [
    ("cart", "SELECT DISTINCT user_idx, item_idx FROM ev_l WHERE event_type = 'add_to_cart' AND item_idx IS NOT NULL"),
    ("ask", "SELECT user_idx * 2 + j AS rid, user_idx FROM user_map_l, (VALUES (0), (1)) v(j)"),
    ("rq", "SELECT a.rid, a.user_idx, " + _MIX.format(r="rid") + " AS mix, " + _K.format(r="rid") + " AS k, "
           + _LAM.format(r="rid") + " AS lam FROM ask a"),
    ("rp", "SELECT a.rid AS user_idx, i.item_idx, a.k, a.lam, " + cos_sql("q.u", "i.v") + " AS score FROM rq a "
           "JOIN uq q ON q.user_idx = a.user_idx JOIN index_l i ON (mix <> 1 OR i.product_group_name = 'ECONOMY') "
           "AND (mix <> 2 OR i.product_type_name NOT IN ('Brand#1', 'Brand#2')) WHERE mix < 4 "
           "AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_idx = a.user_idx AND h.item_idx = i.item_idx) "
           "AND NOT (mix = 3 AND EXISTS (SELECT 1 FROM cart c WHERE c.user_idx = a.user_idx AND c.item_idx = i.item_idx))"),
    ("rr", "SELECT *, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS INTEGER) AS rank FROM rp"),
    ("rc", "SELECT * FROM rr WHERE rank <= CASE WHEN lam >= 1 THEN k ELSE least(2 * k, k + 20, 50) END"),
] + _mmr_sql("rc", _LAM.format(r="user_idx"), _K.format(r="user_idx"))


@register("recommend_requests", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=_REQUESTS_SQL) + (
    "SELECT p.user_idx AS request_id, a.user_idx, p.rank, p.item_idx, round(p.score, 6) AS score, 'personalized' AS source, "
    "'known' AS user_type, CAST(NULL AS VARCHAR) AS reason FROM mpick p JOIN rq a ON a.rid = p.user_idx "
    "UNION ALL SELECT a.rid, a.user_idx, t.rank, t.item_idx, t.score, 'trending_now', "
    "CASE WHEN q.user_idx IS NULL THEN 'cold_start' ELSE 'known' END, "
    "CASE WHEN q.user_idx IS NULL THEN 'cold_start' ELSE 'no_results' END FROM rq a LEFT JOIN uq q USING (user_idx) "
    "JOIN trend t ON t.rank <= a.k WHERE a.mix < 4 AND a.rid NOT IN (SELECT user_idx FROM mpick) "
    "UNION ALL SELECT a.rid, a.user_idx, 0, NULL, NULL, NULL, CASE WHEN q.user_idx IS NULL THEN 'cold_start' ELSE 'known' END, "
    "'invalid' FROM rq a LEFT JOIN uq q USING (user_idx) WHERE a.mix = 4"))
def q_recommend_requests(spark, d):
    """RC1 with every request's own k, lambda, filters and exclusions: two
    requests per user over five mixes of arguments, one of them out of range."""
    from driftrank.operators.recommend import recommend_requests
    t = shared_tables(spark, d)
    rid = F.col("request_id")
    mix = (F.floor(rid / 2) + rid % 2) % 5
    asked = (t.users.join(_carts(t), "user_idx", "left")
             .withColumn("request_id", F.explode(F.array(F.col("user_idx").cast("long") * 2, F.col("user_idx").cast("long") * 2 + 1)))
             .withColumn("mix", mix))
    case = lambda values, other: F.coalesce(*[F.when(F.col("mix") == m, v) for m, v in values.items()], other)
    none = F.lit(None).cast("string")
    requests = asked.select(
        "request_id", "user_idx", case({0: F.lit(10), 1: F.lit(5), 2: F.lit(20), 3: F.lit(3)}, F.lit(0)).alias("k"),
        case({1: F.lit(0.8), 3: F.lit(0.5)}, F.lit(1.0)).alias("diversity_lambda"),
        F.when(F.col("mix") == 1, F.lit("ECONOMY")).otherwise(none).alias("must_group"),
        F.when(F.col("mix") == 2, F.array(F.lit("Brand#1"), F.lit("Brand#2"))).alias("not_types"),
        F.when(F.col("mix") == 3, F.col("cart")).alias("exclude"))
    return _shown(recommend_requests(requests, t.user_vectors, t.item_index, t.history, t.trending))


@register("similar_items_excluded", sql=with_views("index_l", extra=[
    ("sp", "SELECT a.item_idx AS source_item_idx, b.item_idx, " + cos_sql("a.v", "b.v") + " AS score FROM index_l a "
           "JOIN index_l b ON a.item_idx <> b.item_idx AND b.item_idx NOT IN (a.item_idx + 1, a.item_idx + 2, a.item_idx + 3)"),
    ("sr", "SELECT source_item_idx, CAST(row_number() OVER (PARTITION BY source_item_idx "
           "ORDER BY score DESC, item_idx) AS INTEGER) AS rank, item_idx, score FROM sp"),
]) + f"SELECT source_item_idx, rank, item_idx, round(score, 6) AS score FROM sr WHERE rank <= {K}")
def q_similar_items_excluded(spark, d):
    """V3 with explicit exclusions per request: the three items after the source."""
    from driftrank.operators.knn import similar_items
    t = shared_tables(spark, d)
    item = F.col("item_idx")
    return _shown(similar_items(t.item_index.select("item_idx", F.array(item + 1, item + 2, item + 3).alias("out")),
                                t.item_index, K, exclude="out"))


# first round: transactions before the snapshot, no archive; second: all of them and the archived events of three batches
_ROUND = [
    ("h1", "SELECT customer_id, article_id, event_type FROM tx_l WHERE t_dat < DATE '1999-01-01'"),
    ("h2", "SELECT customer_id, article_id, event_type FROM tx_l UNION ALL SELECT user_id, item_id, event_type FROM ev_l"),
]


def _grown(name: str, id_col: str, idx: str) -> list[tuple[str, str]]:
    """SQL of a map after both rounds: ids of the first in order, then the new ones in order."""
    return [
        (f"{name}1", f"SELECT {id_col}, row_number() OVER (ORDER BY {id_col}) - 1 AS {idx} FROM "
                     f"(SELECT DISTINCT {id_col} FROM h1 WHERE {id_col} IS NOT NULL)"),
        (name, f"SELECT * FROM {name}1 UNION ALL SELECT {id_col}, (SELECT count(*) FROM {name}1) + row_number() OVER "
               f"(ORDER BY {id_col}) - 1 FROM (SELECT DISTINCT {id_col} FROM h2 WHERE {id_col} IS NOT NULL AND "
               f"{id_col} NOT IN (SELECT {id_col} FROM {name}1))"),
    ]


@register("retrain_ratings", sql=with_views("tx_l", "ev_l", extra=_ROUND + _grown("um", "customer_id", "user_idx")
                                            + _grown("im", "article_id", "item_idx")) + (
    "SELECT CAST(u.user_idx AS INTEGER) AS user_idx, CAST(i.item_idx AS INTEGER) AS item_idx, "
    "CAST(ln(1 + sum(CASE WHEN m.event_type IS NULL THEN 1.0 WHEN m.event_type = 'purchase' THEN 1.0 "
    "WHEN m.event_type = 'add_to_cart' THEN 0.5 WHEN m.event_type = 'click' THEN 0.1 ELSE 0.0 END)) AS FLOAT) AS rating "
    "FROM h2 m JOIN um u USING (customer_id) JOIN im i USING (article_id) GROUP BY u.user_idx, i.item_idx"))
def q_retrain_ratings(spark, d):
    """S3 + K2 + I2: a first round without an archive, then three archived
    batches, each appended twice, and a second round over the grown maps."""
    from driftrank.operators.archive import events_to_transactions
    from driftrank.plans.retrain import archive_events, retrain
    from driftrank.plans.tables import MAP_SNAPSHOT
    from driftrank.session import scratch_path
    t = shared_tables(spark, d)
    base = scratch_path(spark, "retrain")
    retrain(t.transactions.where(F.col("t_dat") < F.lit(MAP_SNAPSHOT).cast("date")), base, "1")
    for part in range(3):
        rows = events_to_transactions(t.events.where(F.pmod("event_id", F.lit(3)) == part))
        for _ in range(2):
            archive_events(rows, base, f"1-{part}")
    return retrain(t.transactions, base, "2")


@register("retrain_user_map", sql=with_views("tx_l", "ev_l", extra=_ROUND + _grown("um", "customer_id", "user_idx"))
          + "SELECT customer_id, CAST(user_idx AS INTEGER) AS user_idx FROM um")
def q_retrain_user_map(spark, d):
    """I2 as a published table: the customer map after two rounds, the second repeated."""
    from driftrank.operators.archive import events_to_transactions
    from driftrank.plans.retrain import USERS, extend_map
    from driftrank.session import scratch_path
    t = shared_tables(spark, d)
    base = scratch_path(spark, "maps")
    first = t.transactions.where(F.col("t_dat") < F.lit("1999-01-01").cast("date")).select("customer_id")
    both = t.transactions.select("customer_id").unionByName(events_to_transactions(t.events).select("customer_id"))
    for version, rows in (("1", first), ("2", both), ("2", both)):
        out = extend_map(rows, base, USERS, version, "customer_id", "user_idx")
    return out


@register("trending_incremental", sql=with_views("tx_l", extra=TREND_SQL[:3]) + "SELECT rank, article_id, score FROM top")
def q_trending_incremental(spark, d):
    """T1/A2 from mergeable day sets: the table of all days but the last is
    appended once, then the last day alone (twice, as a retried job would);
    the window unites its days' sets."""
    from driftrank.operators.trending import daily_buyers, trending_from_days
    from driftrank.session import scratch_path
    from driftrank.sources.versions import append_version, read_versions
    t = shared_tables(spark, d)
    base = scratch_path(spark, "daily_buyers")
    last = t.transactions.agg(F.max("t_dat")).first()[0]
    append_version(daily_buyers(t.transactions.where(F.col("t_dat") < F.lit(last)), t.user_map), base, "history")
    for _ in range(2):
        append_version(daily_buyers(t.transactions.where(F.col("t_dat") == F.lit(last)), t.user_map), base, f"{last}")
    return trending_from_days(read_versions(spark, base)).select("rank", "article_id", "score")
