"""Registered queries of the vector, state, recommendation and metric layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.plans.catalog import register
from driftrank.plans.sql_views import cos_sql, with_views
from driftrank.plans.tables import Tables, shared_tables

K = S.DEFAULT_K
TTL = int(S.HISTORY_TTL_DAYS * 86400)
W_SQL = ("CAST(CASE WHEN {t} IS NULL THEN 1.0 WHEN {t} = 'purchase' THEN 1.0 "
         "WHEN {t} = 'add_to_cart' THEN 0.5 WHEN {t} = 'click' THEN 0.1 ELSE 0.0 END AS DOUBLE)")


def _debounce_sql(prefix: str, keys: list[str], seconds: int) -> list[tuple[str, str]]:
    """Recursive twin of the debounce fold: walk each key's events in order
    carrying the last accepted time."""
    kk = ", ".join(keys)
    on = " AND ".join(f"s.{k} = w.{k}" for k in keys)
    return [
        (f"{prefix}kev", "SELECT * FROM ev_l WHERE event_type IN ('purchase', 'add_to_cart', 'click')"),
        (f"{prefix}seq", f"SELECT *, row_number() OVER (PARTITION BY {kk} ORDER BY \"timestamp\", event_id) AS rn "
                         f"FROM {prefix}kev WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys)),
        (f"{prefix}walk(event_id, {kk}, rn, anchor, ok)",
         f"SELECT event_id, {kk}, rn, \"timestamp\", true FROM {prefix}seq WHERE rn = 1 UNION ALL "
         f"SELECT s.event_id, {', '.join('s.' + k for k in keys)}, s.rn, "
         f"CASE WHEN s.\"timestamp\" - w.anchor >= {seconds} THEN s.\"timestamp\" ELSE w.anchor END, "
         f"s.\"timestamp\" - w.anchor >= {seconds} FROM {prefix}walk w JOIN {prefix}seq s "
         f"ON {on} AND s.rn = w.rn + 1"),
        (f"{prefix}flag", f"SELECT q.*, w.ok FROM {prefix}seq q JOIN {prefix}walk w ON q.event_id = w.event_id "
                          f"UNION ALL SELECT *, 1, true FROM {prefix}kev WHERE "
                          + " OR ".join(f"{k} IS NULL" for k in keys)),
    ]


# accepted events (user, item, type; 300 s) -> EMA user vectors -> history
STATE_SQL = _debounce_sql("d_", ["user_idx", "item_idx", "event_type"], S.DEBOUNCE_SECONDS) + [
    ("acc", "SELECT * EXCLUDE (rn, ok) FROM d_flag WHERE ok"),
    ("iv", "SELECT item_idx, v FROM index_l"),
    ("eva", "SELECT a.user_idx, a.event_id, a.\"timestamp\" AS ts, a.event_type, "
            "CAST(0.2 AS DOUBLE) * " + W_SQL.format(t="a.event_type") + " AS c, i.v "
            "FROM acc a JOIN iv i ON a.item_idx = i.item_idx"),
    ("eco", "SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY ts, event_id) AS rn, "
            "coalesce(sum(ln(1 - c)) OVER (PARTITION BY user_idx ORDER BY ts, event_id "
            "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS suf FROM eva"),
    ("eterm", "SELECT user_idx, (CASE WHEN rn = 1 THEN 1.0 ELSE c END) * exp(suf) AS coef, "
              "unnest(range(len(v))) AS pos, unnest(v) AS x FROM eco"),
    ("uvec", "SELECT user_idx, CAST(pos AS INTEGER) AS pos, CAST(sum(coef * CAST(x AS DOUBLE)) AS FLOAT) AS value "
             "FROM eterm GROUP BY user_idx, pos"),
    ("uq", "SELECT user_idx, list(value ORDER BY pos) AS u FROM uvec GROUP BY user_idx"),
    ("pur", "SELECT user_idx, item_idx, \"timestamp\" AS ts FROM acc WHERE event_type = 'purchase' "
            "AND item_idx IN (SELECT item_idx FROM iv)"),
    ("pgap", "SELECT *, lag(ts) OVER (PARTITION BY user_idx ORDER BY ts) AS prev FROM pur"),
    ("pep", f"SELECT *, max(CASE WHEN prev IS NULL OR ts - prev >= {TTL} THEN ts END) "
            "OVER (PARTITION BY user_idx) AS ep FROM pgap"),
    ("plast", "SELECT user_idx, item_idx, max(ts) AS last_purchase_at FROM pep WHERE ts >= ep "
              "GROUP BY user_idx, item_idx"),
    ("prank", "SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY last_purchase_at DESC, "
              "CAST(item_idx AS VARCHAR) DESC) AS r FROM plast"),
    ("hist", "SELECT user_idx, item_idx, last_purchase_at FROM (SELECT *, max(last_purchase_at) "
             "OVER (PARTITION BY user_idx) AS mx FROM prank WHERE r <= 100) "
             f"WHERE (SELECT max(\"timestamp\") FROM acc) - mx < {TTL}"),
]

KNN_SQL = STATE_SQL + [
    ("kp", "SELECT q.user_idx, i.item_idx, " + cos_sql("q.u", "i.v") + " AS score "
           "FROM uq q JOIN iv i ON true WHERE NOT EXISTS (SELECT 1 FROM hist h "
           "WHERE h.user_idx = q.user_idx AND h.item_idx = i.item_idx)"),
    ("kr", "SELECT user_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) "
           "AS INTEGER) AS rank, item_idx, score FROM kp"),
    ("knn", f"SELECT * FROM kr WHERE rank <= {K}"),
]

TREND_SQL = [
    ("recent_tx", "SELECT * FROM tx_l WHERE t_dat >= (SELECT max(t_dat) FROM tx_l) - 30"),
    ("scored", "SELECT article_id, CAST(count(DISTINCT customer_id) AS DOUBLE) AS score "
               "FROM recent_tx GROUP BY article_id"),
    ("top", "SELECT CAST(row_number() OVER (ORDER BY score DESC, article_id) AS INTEGER) AS rank, "
            "article_id, score FROM scored ORDER BY score DESC, article_id LIMIT 50"),
    ("trend", "SELECT t.rank, m.item_idx, t.score FROM top t JOIN item_map_l m ON t.article_id = m.article_id"),
]

RECO_SQL = KNN_SQL + TREND_SQL + [
    ("personal", "SELECT user_idx, rank, item_idx, round(score, 6) AS score, 'personalized' AS source, 'known' AS user_type, "
                 f"CAST(NULL AS VARCHAR) AS reason FROM kr WHERE rank <= {K}"),
    ("req", "SELECT user_idx FROM user_map_l"),
    ("rest", "SELECT r.user_idx, CASE WHEN q.user_idx IS NOT NULL THEN 'known' ELSE 'cold_start' END "
             "AS user_type FROM req r LEFT JOIN uq q ON r.user_idx = q.user_idx "
             "WHERE r.user_idx NOT IN (SELECT user_idx FROM personal)"),
    ("fb", "SELECT r.user_idx, t.rank, t.item_idx, t.score, 'trending_now' AS source, r.user_type, "
           "CASE WHEN r.user_type = 'cold_start' THEN 'cold_start' ELSE 'no_results' END AS reason "
           f"FROM rest r JOIN trend t ON t.rank <= {K}"),
    ("reco", "SELECT * FROM personal UNION ALL SELECT * FROM fb"),
]


def _t(spark, d) -> Tables:
    return shared_tables(spark, d)


def _shown(df):
    """Scores rounded for display; they rank unrounded."""
    return df.withColumn("score", F.round("score", 6))


# --------------------------------------------------------------- index

_INDEX_OUT = ("SELECT item_idx, article_id, prod_name, product_type_name, product_group_name, "
              "graphical_appearance_name, index_group_name, "
              "round(sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 6) AS norm, "
              "round(list_sum(CAST(v AS DOUBLE[])), 6) AS checksum FROM index_l")


def _index_out(df):
    from driftrank.functions.columns import norm
    return df.select("item_idx", *S.PAYLOAD_COLS,
                     F.round(norm(F.col("features")), 6).alias("norm"),
                     F.round(F.aggregate("features", F.lit(0.0).cast("double"),
                                         lambda a, x: a + x.cast("double")), 6).alias("checksum"))


@register("item_index", sql=with_views("index_l") + _INDEX_OUT)
def q_item_index(spark, d):
    """Factors x item map x articles, unit vectors, payload filled."""
    return _index_out(_t(spark, d).item_index)


@register("publish_item_index", sql=with_views("index_l") + _INDEX_OUT)
def q_publish_item_index(spark, d):
    """K4: publish the index range-partitioned by item_idx, read it back."""
    from driftrank.session import scratch_path
    from driftrank.sources.tables import publish, read_table
    path = scratch_path(spark, "item-index")
    publish(_t(spark, d).item_index, path, "item_idx")
    return _index_out(read_table(spark, path))


@register("filter_catalog", sql=with_views("index_l") + (
    "SELECT item_idx, product_group_name, product_type_name FROM index_l "
    "WHERE product_group_name = 'ECONOMY' AND coalesce(product_type_name, '') NOT IN ('Brand#1', 'Brand#2') "
    "AND item_idx NOT IN (1, 2, 3)"))
def q_filter_catalog(spark, d):
    """group must be ECONOMY, types Brand#1/Brand#2 and ids 1-3 excluded."""
    from driftrank.operators.knn import filter_catalog
    return filter_catalog(_t(spark, d).item_index, product_group="ECONOMY",
                          exclude_types=["Brand#1", " Brand#2 ", ""], exclude_ids=[1, 2, 3]
                          ).select("item_idx", "product_group_name", "product_type_name")


@register("similar_items", sql=with_views("index_l", extra=[
    ("iv", "SELECT item_idx, v FROM index_l"),
    ("sp", "SELECT a.item_idx AS source_item_idx, b.item_idx, " + cos_sql("a.v", "b.v") +
           " AS score FROM iv a JOIN iv b ON a.item_idx <> b.item_idx"),
    ("sr", "SELECT source_item_idx, CAST(row_number() OVER (PARTITION BY source_item_idx "
           "ORDER BY score DESC, item_idx) AS INTEGER) AS rank, item_idx, score FROM sp"),
]) + f"SELECT source_item_idx, rank, item_idx, round(score, 6) AS score FROM sr WHERE rank <= {K}")
def q_similar_items(spark, d):
    """V3: 10 nearest items of every item in the index, itself excluded."""
    from driftrank.operators.knn import similar_items
    t = _t(spark, d)
    return _shown(similar_items(t.item_index.select("item_idx"), t.item_index, K))


@register("similar_items_filtered", sql=with_views("index_l", extra=[
    ("iv", "SELECT item_idx, v, product_group_name, product_type_name FROM index_l"),
    ("sp", "SELECT a.item_idx AS source_item_idx, b.item_idx, " + cos_sql("a.v", "b.v") +
           " AS score FROM iv a JOIN iv b ON a.item_idx <> b.item_idx "
           "AND b.product_group_name = a.product_group_name "
           "AND b.product_type_name <> a.product_type_name"),
    ("sr", "SELECT source_item_idx, CAST(row_number() OVER (PARTITION BY source_item_idx "
           "ORDER BY score DESC, item_idx) AS INTEGER) AS rank, item_idx, score FROM sp"),
]) + "SELECT source_item_idx, rank, item_idx, round(score, 6) AS score FROM sr WHERE rank <= 5")
def q_similar_items_filtered(spark, d):
    """V3 with per-request filters: same group as the source, other type."""
    from driftrank.operators.knn import similar_items
    t = _t(spark, d)
    src = t.item_index.select(
        "item_idx", F.col("product_group_name").alias("must_group"),
        F.lit(None).cast("string").alias("must_type"),
        F.array().cast("array<string>").alias("not_groups"),
        F.array("product_type_name").alias("not_types"))
    return _shown(similar_items(src, t.item_index, 5, per_query_filters=True))


@register("similar_items_status", sql=with_views("item_map_l", "index_l") + (
    "SELECT m.item_idx AS source_item_idx, CASE WHEN i.item_idx IS NOT NULL THEN 'success' "
    "ELSE 'not_found' END AS status FROM item_map_l m LEFT JOIN index_l i ON m.item_idx = i.item_idx"))
def q_similar_items_status(spark, d):
    """V6/ME10: every catalog item requested as a source; found or not."""
    from driftrank.operators.knn import similar_items_status
    t = _t(spark, d)
    return similar_items_status(t.item_map.select("item_idx"), t.item_index)


@register("cosine_pairs", sql=with_views("index_l") + (
    "SELECT a.item_idx, b.item_idx AS next_item_idx, round(" + cos_sql("a.v", "b.v") + ", 6) AS similarity "
    "FROM index_l a JOIN index_l b ON b.item_idx = a.item_idx + 1"))
def q_cosine_pairs(spark, d):
    """Cosine between each catalog item and the one with the next index."""
    from driftrank.functions.columns import cosine
    index = _t(spark, d).item_index
    a = index.select("item_idx", (F.col("item_idx") + 1).alias("next_item_idx"), F.col("features").alias("_a"))
    b = index.select(F.col("item_idx").alias("next_item_idx"), F.col("features").alias("_b"))
    return a.join(b, "next_item_idx").select(
        "item_idx", "next_item_idx", F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("similarity"))


# ------------------------------------------------------------- state

@register("debounce", sql=with_views("ev_l", extra=_debounce_sql("b_", ["user_idx", "event_type"], 86400))
          + "SELECT event_id, user_idx, event_type, \"timestamp\" FROM b_flag WHERE ok")
def q_debounce(spark, d):
    """ST1 with key (user, type) and a one-day window, so the fold has work."""
    from driftrank.operators.interactions import known_events
    from driftrank.operators.state import debounce
    ev = known_events(_t(spark, d).events)
    return debounce(ev, keys=("user_idx", "event_type"), seconds=86400).select(
        "event_id", "user_idx", "event_type", "timestamp")


@register("debounce_hits", sql=with_views("ev_l", extra=_debounce_sql("b_", ["user_idx", "event_type"], 86400))
          + "SELECT event_type, count(*) FILTER (WHERE NOT ok) AS hits, count(*) AS events "
            "FROM b_flag GROUP BY event_type")
def q_debounce_hits(spark, d):
    """ME2: debounce rejects per type (key user+type, one day)."""
    from driftrank.operators.interactions import known_events
    from driftrank.operators.state import debounce
    ev = debounce(known_events(_t(spark, d).events), keys=("user_idx", "event_type"),
                  seconds=86400, keep_rejected=True)
    return ev.groupBy("event_type").agg(
        F.count(F.when(~F.col("accepted"), 1)).alias("hits"), F.count(F.lit(1)).alias("events"))


@register("debounce_item_key", sql=with_views("ev_l", extra=_debounce_sql("i_", ["user_idx", "item_idx", "event_type"], 864000))
          + "SELECT event_id, user_idx, item_idx, event_type FROM i_flag WHERE ok")
def q_debounce_item_key(spark, d):
    """ST1 with the service's own key (user, item, type), over ten days since
    no pair comes back within the service's 300 s."""
    from driftrank.operators.interactions import known_events
    from driftrank.operators.state import debounce
    return debounce(known_events(_t(spark, d).events), seconds=864000).select("event_id", "user_idx", "item_idx", "event_type")


@register("ema_user_vectors", sql=with_views("ev_l", "index_l", extra=STATE_SQL)
          + "SELECT user_idx, pos, value FROM uvec")
def q_ema_user_vectors(spark, d):
    """ST2: user vectors drifted by EMA over accepted events (cold start)."""
    v = _t(spark, d).user_vectors
    return v.select("user_idx", F.posexplode("features").alias("pos", "value")).select(
        "user_idx", F.col("pos").cast("int"), "value")


@register("bounded_history", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + "SELECT * FROM hist")
def q_bounded_history(spark, d):
    """ST3/R3: last 100 distinct purchased items per user, 1-year expiry."""
    return _t(spark, d).history


@register("events_missing_item", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + (
    "SELECT a.event_id, a.item_idx FROM acc a LEFT JOIN iv i ON a.item_idx = i.item_idx "
    "WHERE i.item_idx IS NULL"))
def q_events_missing_item(spark, d):
    """accepted events whose item has no vector (skipped by the update)."""
    from driftrank.operators.state import attach_item_vectors
    t = _t(spark, d)
    return (attach_item_vectors(t.accepted_events, t.item_vectors)
            .where(F.col("item_vector").isNull()).select("event_id", "item_idx"))


@register("vector_updates", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + (
    "SELECT CASE WHEN rn = 1 THEN 'created' ELSE 'updated' END AS type, count(*) AS count "
    "FROM eco GROUP BY 1"))
def q_vector_updates(spark, d):
    """ME3: vector writes split into created (a user's first update) and
    updated -- one aggregate: created = users, updated = writes - users."""
    from driftrank.operators.interactions import known_events
    from driftrank.operators.state import drop_missing_items
    t = _t(spark, d)
    ev = drop_missing_items(known_events(t.accepted_events), t.item_vectors)
    tot = ev.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_idx").alias("u"))
    return tot.select(F.inline(F.array(
        F.struct(F.lit("created").alias("type"), F.col("u").alias("count")),
        F.struct(F.lit("updated").alias("type"), (F.col("n") - F.col("u")).alias("count")))))


@register("active_users", sql=with_views("ev_l", "index_l", extra=STATE_SQL)
          + "SELECT count(*) AS active_users FROM uq")
def q_active_users(spark, d):
    """ME4: users holding a vector."""
    return _t(spark, d).user_vectors.agg(F.count(F.lit(1)).alias("active_users"))


# ------------------------------------------------------------- search

@register("knn_users", sql=with_views("ev_l", "index_l", extra=KNN_SQL)
          + "SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM knn")
def q_knn_users(spark, d):
    """V2: exact top-10 items per user vector, purchase history excluded."""
    from driftrank.operators.knn import knn
    from driftrank.operators.recommend import history_arrays
    t = _t(spark, d)
    q = t.user_vectors.join(history_arrays(t.history), "user_idx", "left")
    return _shown(knn(q, t.item_index, K, query_id="user_idx", exclude="history"))


# embeddings of 64 dimensions, neighbours far apart: few bits and many tables for a recall of 0.9
LSH = {"n_tables": 16, "n_bits": 3}


@register("knn_lsh")
def q_knn_lsh(spark, d):
    """V4: approximate top-10 per user (cosine LSH, 16 tables x 3 bits),
    candidates re-ranked exactly, history excluded.  Rows-only check;
    recall against the exact search is tested on the embeddings."""
    from driftrank.operators.knn import knn_lsh
    from driftrank.operators.recommend import history_arrays
    t = _t(spark, d)
    q = t.user_vectors.join(history_arrays(t.history), "user_idx", "left")
    return knn_lsh(q, t.item_index, K, query_id="user_idx", exclude="history", **LSH)


@register("knn_cells")
def q_knn_cells(spark, d):
    """V4: approximate top-10 per user by trained cells and codes, history
    excluded.  Rows-only check (trained); recall is tested on the
    embeddings, ``knn_seeded_cells`` has a twin."""
    from driftrank.operators.cells import search_cells
    from driftrank.operators.recommend import history_arrays
    t = _t(spark, d)
    q = t.user_vectors.join(history_arrays(t.history), "user_idx", "left")
    approx = t.cell_index
    return search_cells(q, approx.table, approx.model, K, probes=approx.probes, rerank=approx.rerank,
                        query_id="user_idx", exclude="history")


@register("knn_seeded_cells", sql=with_views("ev_l", "index_l", extra=STATE_SQL + [
    ("cen", "SELECT item_idx AS cell, v AS c FROM index_l WHERE item_idx < 32"),
    ("own", "SELECT i.item_idx, arg_max(cen.cell, (" + cos_sql("i.v", "cen.c") + ", -cen.cell)) AS cell, any_value(i.v) AS v "
            "FROM index_l i JOIN cen ON true GROUP BY i.item_idx"),
    ("near", "SELECT q.user_idx, q.u, cen.cell, row_number() OVER (PARTITION BY q.user_idx ORDER BY "
             + cos_sql("q.u", "cen.c") + " DESC, cen.cell) AS r FROM uq q JOIN cen ON true"),
    ("pairs", "SELECT n.user_idx, o.item_idx, " + cos_sql("n.u", "o.v") + " AS score FROM near n JOIN own o USING (cell) "
              "WHERE n.r <= 12 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_idx = n.user_idx AND h.item_idx = o.item_idx)"),
    ("best", "SELECT user_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS INTEGER) AS rank, "
             "item_idx, score FROM pairs"),
]) + f"SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM best WHERE rank <= {K}")
def q_knn_seeded_cells(spark, d):
    """V4 with the items below 32 as centroids: 12 of 32 cells probed, all
    items in them scored exactly, history excluded."""
    import numpy as np
    from driftrank.operators.cells import CellModel, cell_table, search_cells
    from driftrank.operators.knn import _unit_rows
    from driftrank.operators.recommend import history_arrays
    t = _t(spark, d)
    seeds = t.item_index.where("item_idx < 32").orderBy("item_idx").select("features").collect()
    model = CellModel(_unit_rows(np.array([r[0] for r in seeds], dtype=np.float64)))
    q = t.user_vectors.join(history_arrays(t.history), "user_idx", "left")
    return _shown(search_cells(q, cell_table(t.item_index, model), model, K, probes=12, query_id="user_idx", exclude="history"))


@register("exclude_history", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + (
    "SELECT DISTINCT k.user_idx, k.item_idx FROM acc k WHERE k.event_type = 'click' AND NOT EXISTS "
    "(SELECT 1 FROM hist h WHERE h.user_idx = k.user_idx AND h.item_idx = k.item_idx)"))
def q_exclude_history(spark, d):
    """clicked items not already owned (anti join on user and item)."""
    from driftrank.operators.recommend import exclude_items
    t = _t(spark, d)
    clicks = (t.accepted_events.where(F.col("event_type") == "click")
              .select("user_idx", "item_idx").distinct())
    return exclude_items(clicks, t.history)


@register("list_diversity", sql=with_views("ev_l", "index_l", extra=KNN_SQL + [
    ("dl", "SELECT k.user_idx, k.item_idx, i.v FROM knn k JOIN iv i ON k.item_idx = i.item_idx"),
    ("dn", "SELECT user_idx, count(*) AS n FROM dl GROUP BY user_idx"),
    ("dp", "SELECT a.user_idx, avg(1 - " + cos_sql("a.v", "b.v") + ") AS dv FROM dl a JOIN dl b "
           "ON a.user_idx = b.user_idx AND a.item_idx < b.item_idx GROUP BY a.user_idx"),
]) + ("SELECT n.user_idx, CAST(n.n AS INTEGER) AS n_items, round(CASE WHEN n.n < 2 THEN 0.0 "
      "ELSE p.dv END, 6) AS diversity FROM dn n LEFT JOIN dp p ON n.user_idx = p.user_idx"))
def q_list_diversity(spark, d):
    """A10: intra-list diversity of each user's top-10 list."""
    from driftrank.operators.recommend import list_diversity
    t = _t(spark, d)
    lists = q_knn_users(spark, d)
    return list_diversity(lists, t.item_index).select(
        "user_idx", "n_items", F.round("diversity", 6).alias("diversity"))


# ------------------------------------------------------- recommendation

def _reco(spark, d, lam=1.0):
    from driftrank.operators.recommend import recommend
    t = _t(spark, d)
    return _shown(recommend(t.users, t.user_vectors, t.item_index, t.history, t.trending,
                            k=K, diversity_lambda=lam))


@register("recommend_topk", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=RECO_SQL)
          + "SELECT * FROM reco")
def q_recommend_topk(spark, d):
    """RC1 (lambda = 1): personalised top-10 per user, trending fallback."""
    return _reco(spark, d, 1.0)


# the same state and answers from trained user vectors (prior) that the events drift
_SEEDED = [
    ("prior", "SELECT m.user_idx, CAST(e.embedding AS FLOAT[]) AS v FROM embeddings e "
              "JOIN user_map_l m ON m.user_idx = CAST(e.vec_id AS INTEGER)"),
    ("eterm", "SELECT user_idx, (CASE WHEN rn = 1 AND user_idx NOT IN (SELECT user_idx FROM prior) THEN 1.0 ELSE c END) "
              "* exp(suf) AS coef, unnest(range(len(v))) AS pos, unnest(v) AS x FROM eco "
              "UNION ALL SELECT p.user_idx, coalesce(a.f, 1.0), unnest(range(len(p.v))), unnest(p.v) FROM prior p "
              "LEFT JOIN (SELECT user_idx, exp(sum(ln(1 - c))) AS f FROM eco GROUP BY user_idx) a USING (user_idx)"),
]


def _seeded(sql):
    return [x for name, body in sql for x in (_SEEDED if name == "eterm" else [(name, body)])]


@register("ema_with_prior", sql=with_views("ev_l", "index_l", extra=_seeded(STATE_SQL))
          + "SELECT user_idx, pos, value FROM uvec")
def q_ema_with_prior(spark, d):
    """ST2: trained user vectors drifted by EMA over accepted events."""
    return _t(spark, d).seeded_vectors.select("user_idx", F.posexplode("features").alias("pos", "value")).select(
        "user_idx", F.col("pos").cast("int"), "value")


@register("recommend_seeded", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=_seeded(RECO_SQL))
          + "SELECT * FROM reco")
def q_recommend_seeded(spark, d):
    """RC1 (lambda = 1) served from drifted trained vectors: most users are known."""
    from driftrank.operators.recommend import recommend
    t = _t(spark, d)
    return _shown(recommend(t.users, t.seeded_vectors, t.item_index, t.history, t.trending, k=K, diversity_lambda=1.0))


@register("recommend_fallback", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=RECO_SQL)
          + "SELECT * FROM fb")
def q_recommend_fallback(spark, d):
    """The fallback rows only (cold-start users get trending[:k])."""
    return _reco(spark, d, 1.0).where(F.col("source") == S.SOURCE_TRENDING)


def _mmr_sql(cands: str, lam: float | str, k: int | str) -> list[tuple[str, str]]:
    """Recursive twin of greedy MMR over (user_idx, rank, item_idx, score)
    candidates: each step picks, per user, the unpicked candidate with the
    best lambda*rel - (1-lambda)*max_sim (ties: better rank), then raises
    every candidate's max_sim by its similarity to the pick."""
    lam_s = f"CAST({lam} AS DOUBLE)"
    return [
        ("mc", f"SELECT c.user_idx, c.rank AS pos, c.item_idx, c.score, i.v FROM {cands} c "
               "JOIN iv i ON c.item_idx = i.item_idx"),
        ("mrel", "SELECT *, count(*) OVER w AS n, CASE WHEN max(score) OVER w - min(score) OVER w > 0 "
                 "THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) "
                 "ELSE 1.0 END AS ns FROM mc WINDOW w AS (PARTITION BY user_idx)"),
        ("mm(step, user_idx, pos, item_idx, score, v, n, ns, ms, picked)",
         "SELECT 0, user_idx, pos, item_idx, score, v, n, ns, CAST(0.0 AS DOUBLE), 0 FROM mrel "
         "UNION ALL "
         "SELECT step + 1, user_idx, pos, item_idx, score, v, n, ns, "
         "greatest(ms, " + cos_sql("v", "bv") + "), CASE WHEN pos = bpos THEN step + 1 ELSE picked END "
         "FROM (SELECT *, first_value(pos) OVER w AS bpos, first_value(v) OVER w AS bv FROM mm "
         f"WINDOW w AS (PARTITION BY user_idx ORDER BY (picked > 0), "
         f"{lam_s} * ns - (CAST(1.0 AS DOUBLE) - {lam_s}) * ms DESC, pos)) "
         f"WHERE step < least({k}, n)"),
        ("mpick", f"SELECT user_idx, CAST(picked AS INTEGER) AS rank, item_idx, score FROM mm "
                  f"WHERE step = least({k}, n) AND picked > 0"),
    ]


_MMR_RECO_SQL = KNN_SQL + TREND_SQL + [("k20", "SELECT * FROM kr WHERE rank <= 20")] + _mmr_sql(
    "k20", S.DEFAULT_LAMBDA, K) + [
    ("personal", "SELECT user_idx, rank, item_idx, round(score, 6) AS score, 'personalized' AS source, 'known' AS user_type, "
                 "CAST(NULL AS VARCHAR) AS reason FROM mpick"),
] + RECO_SQL[len(KNN_SQL) + len(TREND_SQL) + 1:]


@register("recommend_mmr", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=_MMR_RECO_SQL)
          + "SELECT * FROM reco")
def q_recommend_mmr(spark, d):
    """RC1 with MMR (lambda = 0.8, over-fetch 20 -> 10), trending fallback."""
    return _reco(spark, d, S.DEFAULT_LAMBDA)


@register("mmr_rerank", sql=with_views("ev_l", "index_l", extra=STATE_SQL + [
    ("kp0", "SELECT q.user_idx, i.item_idx, " + cos_sql("q.u", "i.v") + " AS score "
            "FROM uq q JOIN iv i ON true"),
    ("k0", "SELECT user_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) "
           "AS INTEGER) AS rank, item_idx, score FROM kp0"),
    ("k20", "SELECT * FROM k0 WHERE rank <= 20"),
] + _mmr_sql("k20", 0.5, K)) + "SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM mpick")
def q_mmr_rerank(spark, d):
    """M1: MMR re-rank (lambda 0.5) of each user's 20 nearest items."""
    from driftrank.operators.knn import knn
    from driftrank.operators.mmr import mmr_rerank
    t = _t(spark, d)
    cands = knn(t.user_vectors, t.item_index, 20, query_id="user_idx")
    return _shown(mmr_rerank(cands, t.item_index, 0.5, K))


@register("recs_by_source", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=RECO_SQL) + (
    "SELECT source, q.user_type, reason, count(DISTINCT q.user_idx) AS requests FROM "
    "(SELECT r.user_idx, CASE WHEN u.user_idx IS NOT NULL THEN 'known' ELSE 'cold_start' END AS user_type "
    "FROM req r LEFT JOIN uq u ON u.user_idx = r.user_idx) q LEFT JOIN reco USING (user_idx) "
    "GROUP BY source, q.user_type, reason"))
def q_recs_by_source(spark, d):
    """ME5: requests by source x user type (and fallback reason); one that
    nothing answers counts with no source."""
    from driftrank.operators.recommend import answer_counts
    t = _t(spark, d)
    return answer_counts(t.users, t.user_vectors, _reco(spark, d, 1.0))


@register("exclusion_counts", sql=with_views("ev_l", "index_l", extra=STATE_SQL + [
    ("req", "SELECT user_idx FROM user_map_l"),
    ("cart", "SELECT DISTINCT user_idx, item_idx FROM ev_l WHERE event_type = 'add_to_cart' AND item_idx IS NOT NULL"),
    ("srch", "SELECT DISTINCT q.user_idx FROM req r JOIN uq q ON r.user_idx = q.user_idx"),
]) + ("SELECT (SELECT count(*) FROM srch JOIN hist h USING (user_idx)) AS excluded_history, "
      "(SELECT count(*) FROM srch JOIN cart c USING (user_idx)) AS excluded_explicit, "
      "(SELECT count(*) FROM srch) AS searched_users"))
def q_exclusion_counts(spark, d):
    """ME6: items excluded by history and by the request's own list (the
    carted items) over the request table."""
    from driftrank.operators.recommend import history_arrays
    t = _t(spark, d)
    cart = (t.events.where((F.col("event_type") == "add_to_cart") & F.col("item_idx").isNotNull())
            .groupBy("user_idx").agg(F.collect_set("item_idx").alias("cart")))
    asked = (t.users.join(t.user_vectors.select("user_idx"), "user_idx").join(history_arrays(t.history), "user_idx", "left")
             .join(cart, "user_idx", "left"))
    return asked.agg(F.sum(F.coalesce(F.size("history"), F.lit(0))).alias("excluded_history"),
                     F.sum(F.coalesce(F.size("cart"), F.lit(0))).alias("excluded_explicit"),
                     F.count(F.lit(1)).alias("searched_users"))


@register("explain_recs", sql=with_views("ev_l", "index_l", "tx_l", "item_map_l", extra=RECO_SQL + [
    ("hh", "SELECT user_idx, item_idx AS hist_item_idx, row_number() OVER (PARTITION BY user_idx "
           "ORDER BY last_purchase_at ASC, CAST(item_idx AS VARCHAR) ASC) AS h FROM hist"),
    ("ep", "SELECT p.user_idx, p.rank AS rec_rank, p.item_idx AS rec_item_idx, hh.hist_item_idx, hh.h, "
           "ix.prod_name AS item_name, " + cos_sql("rv.v", "ix.v") + " AS sim FROM personal p "
           "JOIN iv rv ON rv.item_idx = p.item_idx JOIN hh ON hh.user_idx = p.user_idx AND hh.h <= 20 "
           "JOIN index_l ix ON ix.item_idx = hh.hist_item_idx"),
    ("et", "SELECT *, row_number() OVER (PARTITION BY user_idx, rec_item_idx ORDER BY sim DESC, h) AS pos "
           "FROM ep"),
    ("etop", "SELECT *, sum(sim) OVER (PARTITION BY user_idx, rec_item_idx) AS tot FROM et WHERE pos <= 3"),
]) + ("SELECT user_idx, rec_rank, rec_item_idx, CAST(pos AS INTEGER) AS pos, hist_item_idx, item_name, "
      "round_even(sim, 4) AS similarity, round_even(sim / CASE WHEN tot = 0 THEN 1.0 ELSE tot END * 100.0, 1) "
      "AS contribution_pct FROM etop"))
def q_explain_recs(spark, d):
    """Top-3 history items behind each personalised recommendation."""
    from driftrank.operators.recommend import explain
    t = _t(spark, d)
    return explain(_reco(spark, d, 1.0), t.history, t.item_index, top_k=3)


# -------------------------------------------------------------- profile

@register("user_activity", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + (
    "SELECT user_idx, CAST(count(*) AS INTEGER) AS total_purchases, min(last_purchase_at) AS first_purchase_at, "
    "max(last_purchase_at) AS last_purchase_at FROM hist GROUP BY user_idx"))
def q_user_activity(spark, d):
    """Purchases (distinct items), first and last purchase time."""
    from driftrank.operators.profile import user_activity
    return user_activity(_t(spark, d).history)


@register("recent_purchases", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + (
    "SELECT user_idx, pos, item_idx, last_purchase_at FROM (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY user_idx ORDER BY last_purchase_at DESC, CAST(item_idx AS VARCHAR) ASC) AS INTEGER) AS pos "
    "FROM hist) WHERE pos <= 10"))
def q_recent_purchases(spark, d):
    """Ten newest purchases per user."""
    from driftrank.operators.profile import recent_items
    return recent_items(_t(spark, d).history, 10)


def _topcat_sql(field: str) -> str:
    return with_views("ev_l", "index_l", extra=STATE_SQL + [
        ("hc", f"SELECT h.user_idx, i.{field} AS name, CAST(count(*) AS INTEGER) AS count, "
               "max(h.last_purchase_at) AS recent FROM hist h JOIN index_l i ON h.item_idx = i.item_idx "
               f"WHERE i.{field} IS NOT NULL AND i.{field} <> '' GROUP BY h.user_idx, i.{field}"),
        ("hr", "SELECT *, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY count DESC, recent DESC, name) "
               "AS INTEGER) AS pos, sum(count) OVER (PARTITION BY user_idx) AS tot FROM hc"),
    ]) + ("SELECT user_idx, pos, name, count, round_even(count / tot * 100.0, 1) AS percentage "
          "FROM hr WHERE pos <= 5")


@register("top_categories", sql=_topcat_sql("product_group_name"))
def q_top_categories(spark, d):
    """A5: top-5 product groups of each user's history with percentages."""
    from driftrank.operators.profile import top_categories
    t = _t(spark, d)
    return top_categories(t.history, t.item_index, "product_group_name", 5)


@register("top_types", sql=_topcat_sql("product_type_name"))
def q_top_types(spark, d):
    """A5: top-5 product types of each user's history with percentages."""
    from driftrank.operators.profile import top_categories
    t = _t(spark, d)
    return top_categories(t.history, t.item_index, "product_type_name", 5)


@register("user_profile", sql=with_views("ev_l", "index_l", "customers_l", "user_map_l", extra=STATE_SQL) + (
    "SELECT q.user_idx, m.customer_id, CAST(coalesce(a.n, 0) AS INTEGER) AS total_purchases, "
    "a.f AS first_purchase_at, a.l AS last_purchase_at FROM uq q "
    "LEFT JOIN (SELECT user_idx, count(*) AS n, min(last_purchase_at) AS f, max(last_purchase_at) AS l "
    "FROM hist GROUP BY user_idx) a ON q.user_idx = a.user_idx "
    "LEFT JOIN user_map_l m ON m.user_idx = q.user_idx"))
def q_user_profile(spark, d):
    """UP1 (flat part): users with a vector, their totals and times."""
    from driftrank.operators.profile import user_profiles
    t = _t(spark, d)
    return user_profiles(t.user_vectors, t.history, t.item_index, t.user_map, nested=False)


@register("user_profile_nested")
def q_user_profile_nested(spark, d):
    """UP1 (full): with recent purchases and top groups/types as arrays."""
    from driftrank.operators.profile import user_profiles
    t = _t(spark, d)
    return user_profiles(t.user_vectors, t.history, t.item_index, t.user_map, nested=True)


# ------------------------------------------------------------ purchases

_PURCHASE_SQL = [
    ("preq", "SELECT event_id, user_idx, item_idx FROM ev_l WHERE event_type = 'purchase'"),
    ("pv", "SELECT p.event_id, p.user_idx, p.item_idx, m.customer_id, "
           "CASE WHEN i.article_id <> '' THEN i.article_id END AS article_id, "
           "CASE WHEN m.customer_id IS NULL THEN 'user_not_found' "
           "WHEN i.article_id IS NULL OR i.article_id = '' THEN 'item_not_found' ELSE 'accepted' END AS status "
           "FROM preq p LEFT JOIN user_map_l m ON p.user_idx = m.user_idx "
           "LEFT JOIN index_l i ON p.item_idx = i.item_idx"),
]


def _purchase_requests(t: Tables):
    return t.events.where(F.col("event_type") == "purchase").select("event_id", "user_idx", "item_idx")


@register("validate_purchases", sql=with_views("ev_l", "index_l", "user_map_l", extra=_PURCHASE_SQL)
          + "SELECT * FROM pv")
def q_validate_purchases(spark, d):
    """ST7/J9: purchase requests checked against user map and index."""
    from driftrank.operators.purchases import validate_purchases
    t = _t(spark, d)
    req = _purchase_requests(t)
    v = validate_purchases(req.select("user_idx", "item_idx", F.col("event_id").alias("timestamp")),
                           t.user_map, t.item_index)
    return v.select(F.col("timestamp").alias("event_id"), "user_idx", "item_idx", "customer_id",
                    "article_id", "status")


@register("purchase_outcomes", sql=with_views("ev_l", "index_l", "user_map_l", extra=_PURCHASE_SQL)
          + "SELECT status, count(*) AS count FROM pv GROUP BY status")
def q_purchase_outcomes(spark, d):
    """ME9: purchase intake outcomes."""
    return q_validate_purchases(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("count"))


# --------------------------------------------------------------- metrics

@register("event_rate", sql=with_views("ev_l", "index_l", extra=STATE_SQL) + (
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 MINUTE, make_timestamp(CAST(round(ts * 1e6) AS BIGINT)))) "
    "AS BIGINT) AS window_start, event_type, count(*) AS count, round(count(*) / 60.0, 6) AS per_second "
    "FROM eva GROUP BY 1, 2"))
def q_event_rate(spark, d):
    """ME1: processed events per type per 1-minute window, and the rate."""
    from driftrank.operators.metrics import event_rate
    from driftrank.operators.state import drop_missing_items
    t = _t(spark, d)
    processed = drop_missing_items(t.accepted_events, t.item_vectors)
    return event_rate(processed, "1 minute").select(
        "window_start", "event_type", "count", F.round("per_second", 6).alias("per_second"))


_HIST_SQL = [
    ("dl", "SELECT k.user_idx, k.item_idx, i.v FROM knn k JOIN iv i ON k.item_idx = i.item_idx"),
    ("dn", "SELECT user_idx, count(*) AS n FROM dl GROUP BY user_idx"),
    ("dp", "SELECT a.user_idx, avg(1 - " + cos_sql("a.v", "b.v") + ") AS dv FROM dl a JOIN dl b "
           "ON a.user_idx = b.user_idx AND a.item_idx < b.item_idx GROUP BY a.user_idx"),
    ("dv", "SELECT n.user_idx, CASE WHEN n.n < 2 THEN 0.0 ELSE p.dv END AS diversity FROM dn n "
           "LEFT JOIN dp p ON n.user_idx = p.user_idx WHERE n.n >= 2"),
    ("bounds(le, ub, ord)", "VALUES " + ", ".join(
        f"('{b}', {b}, {i})" for i, b in enumerate(S.DIVERSITY_BUCKETS)) +
     f", ('+Inf', 'Infinity'::DOUBLE, {len(S.DIVERSITY_BUCKETS)})"),
    ("buckets", "SELECT b.le, b.ub, b.ord, (SELECT count(*) FROM dv WHERE round(diversity, 6) <= b.ub) AS count "
                "FROM bounds b"),
]


@register("diversity_histogram", sql=with_views("ev_l", "index_l", extra=KNN_SQL + _HIST_SQL)
          + "SELECT le, count FROM buckets")
def q_diversity_histogram(spark, d):
    """ME7: cumulative diversity histogram (le buckets) of the top-10 lists."""
    from driftrank.operators.metrics import bucket_histogram
    return bucket_histogram(_diversities(spark, d), "diversity", S.DIVERSITY_BUCKETS).select("le", "count")


def _diversities(spark, d):
    lists = q_list_diversity(spark, d)
    return lists.where(F.col("n_items") >= 2)


@register("histogram_quantile", sql=with_views("ev_l", "index_l", extra=KNN_SQL + _HIST_SQL + [
    ("qs(q)", "VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))"),
    ("bk", "SELECT le, ub, ord, count, coalesce(lag(ub) OVER (ORDER BY ord), 0.0) AS lb, "
           "coalesce(lag(count) OVER (ORDER BY ord), 0) AS prev, max(count) OVER () AS total FROM buckets"),
    ("hit", "SELECT q.q, min(b.ord) AS ord FROM qs q JOIN bk b ON b.count >= q.q * b.total "
            "AND b.total > 0 GROUP BY q.q"),
]) + ("SELECT h.q AS quantile, round(CASE WHEN b.le = '+Inf' THEN b.lb "
      "WHEN b.count = b.prev THEN b.ub ELSE b.lb + (b.ub - b.lb) * (h.q * b.total - b.prev) / (b.count - b.prev) END, 6) "
      "AS value FROM hit h JOIN bk b ON h.ord = b.ord"))
def q_histogram_quantile(spark, d):
    """ME8: p50 and p95 of diversity from the cumulative buckets."""
    from driftrank.operators.metrics import bucket_histogram, histogram_quantile
    b = bucket_histogram(_diversities(spark, d), "diversity", S.DIVERSITY_BUCKETS)
    return histogram_quantile(b, [0.5, 0.95]).select(
        "quantile", F.round("value", 6).alias("value"))
