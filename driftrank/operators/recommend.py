"""RC1 recommend for a whole table of users, T3 trending fallback, E1
explanations, F3 exclusions, A10 list diversity.

Plan: users -> (left) vectors and history arrays -> filtered, exclusion-
masked exact kNN with over-fetch -> MMR on one packed row per user (only
when lambda < 1) -> top k; users with no vector, or with no surviving
candidate, get trending[:k].  All set-oriented; nothing per user on the
driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank import schema as S
from driftrank.functions.columns import dot, unit
from driftrank.operators.cells import CellIndex
from driftrank.operators.knn import DEFAULT_SHARD_ROWS, catalog_filter, knn
from driftrank.operators.mmr import mmr_rerank

def _empty_ints() -> F.Column:
    return F.array().cast("array<int>")


def history_arrays(history: DataFrame) -> DataFrame:
    """(user_idx, history array<int>) -- bounded by the history limit."""
    return history.groupBy("user_idx").agg(
        F.collect_list(F.col("item_idx").cast("int")).alias("history"))


def exclude_items(cands: DataFrame, history: DataFrame, explicit: DataFrame | None = None,
                  key: str = "user_idx") -> DataFrame:
    """drop candidates the user owns or explicitly excluded (anti join on
    (user, item))."""
    ex = history.select(key, "item_idx")
    if explicit is not None:
        ex = ex.unionByName(explicit.select(key, "item_idx"))
    return cands.join(ex, [key, "item_idx"], "left_anti")


def trending_list(trending: DataFrame, k: int) -> F.Column:
    """The first k trending entries as one array value (a scalar subquery over
    at most k rows), so fallback users explode it instead of a cross join."""
    top = trending.where(F.col("rank") <= k)
    return top.agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("item_idx").cast("int").alias("item_idx"),
        F.col("score").cast("double").alias("score")))).alias("l")).scalar()


def fallback(users: DataFrame, trending: DataFrame, k: int, reason_col: str | None = None) -> DataFrame:
    """Every row of ``users`` gets trending[:k] (rank, item_idx, score)."""
    lst = trending_list(trending, k)
    cols = ["user_idx"] + ([reason_col] if reason_col else [])
    return users.select(*cols, F.explode(F.coalesce(lst, F.array())).alias("_t")).select(
        *cols, F.col("_t.rank").alias("rank"), F.col("_t.item_idx").alias("item_idx"),
        F.col("_t.score").alias("score"))


def recommend(users: DataFrame, user_vectors: DataFrame, index: DataFrame,
              history: DataFrame, trending: DataFrame, k: int = S.DEFAULT_K,
              diversity_lambda: float = S.DEFAULT_LAMBDA, product_group: str | None = None,
              product_type: str | None = None, exclude_groups: list[str] | None = None,
              exclude_types: list[str] | None = None, exclude_col: str | None = None,
              fallback_respects_filters: bool = False,
              shard_rows: int = DEFAULT_SHARD_ROWS, approx: CellIndex | None = None) -> DataFrame:
    """RC1: top-k per user with source/user_type; with ``approx`` the candidates come from its cells.

    ``users`` has user_idx (and optionally an array<int> ``exclude_col`` of
    explicit exclusions).  Output rows: (user_idx, rank, item_idx, score,
    source, user_type, reason) where reason is null for personalised rows
    and ``cold_start`` / ``no_results`` for fallback rows.
    """
    S.check_args(k=k, diversity_lambda=diversity_lambda)
    n_fetch = S.fetch_limit(k, diversity_lambda)
    u = users.select("user_idx", *([exclude_col] if exclude_col else [])).dropDuplicates(["user_idx"])
    uv = user_vectors.select(F.col("id").alias("user_idx") if "id" in user_vectors.columns
                             else F.col("user_idx"), "features")
    known = u.join(uv, "user_idx").join(history_arrays(history), "user_idx", "left")
    excl = F.coalesce(F.col("history"), _empty_ints())
    if exclude_col:
        excl = F.array_union(excl, F.coalesce(F.col(exclude_col), _empty_ints()))
    known = known.withColumn("_excl", excl)
    flt = catalog_filter(product_group, product_type, None, exclude_groups, exclude_types)
    asked = {"query_id": "user_idx", "exclude": "_excl", "item_filter": flt, "shard_rows": shard_rows}
    cands = knn(known, index, n_fetch, **asked) if approx is None else approx.search(known, n_fetch, **asked)
    if diversity_lambda < 1.0:
        picked = mmr_rerank(cands, index, diversity_lambda, k)
    else:
        picked = cands.where(F.col("rank") <= k)
    # one packed list per user (at most k entries), so the search feeds the
    # answer alone and users without a list take the trending one in place
    lists = picked.groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("item_idx").cast("int").alias("item_idx"),
        F.col("score").cast("double").alias("score")))).alias("_mine"))
    trend = trending
    if fallback_respects_filters and flt is not None:
        trend = trending.join(index.where(flt).select("item_idx"), "item_idx", "left_semi")
        trend = trend.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    answered = (u.select("user_idx").join(uv.select("user_idx", F.lit(True).alias("_has_vec")), "user_idx", "left")
                .join(lists, "user_idx", "left"))
    mine = F.col("_mine").isNotNull()
    known_user = F.coalesce(F.col("_has_vec"), F.lit(False))
    rows = answered.select(
        "user_idx",
        F.when(mine, F.lit(S.SOURCE_PERSONALIZED)).otherwise(F.lit(S.SOURCE_TRENDING)).alias("source"),
        F.when(known_user, F.lit(S.USER_KNOWN)).otherwise(F.lit(S.USER_COLD)).alias("user_type"),
        F.when(~mine, F.when(known_user, F.lit("no_results")).otherwise(F.lit("cold_start"))).alias("reason"),
        F.explode(F.coalesce(F.col("_mine"), trending_list(trend, k), F.array())).alias("_r"))
    return rows.select("user_idx", "_r.rank", "_r.item_idx", "_r.score", "source", "user_type", "reason")


def answer_counts(users: DataFrame, user_vectors: DataFrame, answers: DataFrame) -> DataFrame:
    """ME5: requests by (source, user_type, reason); an unanswered one has neither source nor reason."""
    has = user_vectors.select(F.col("id").alias("user_idx") if "id" in user_vectors.columns else F.col("user_idx"),
                              F.lit(True).alias("_has_vec"))
    given = answers.select("user_idx", "source", "reason").distinct()
    asked = users.select("user_idx").dropDuplicates(["user_idx"]).join(has, "user_idx", "left").join(given, "user_idx", "left")
    kind = F.when(F.col("_has_vec"), F.lit(S.USER_KNOWN)).otherwise(F.lit(S.USER_COLD))
    return asked.groupBy("source", kind.alias("user_type"), "reason").agg(F.count(F.lit(1)).alias("requests"))


REQUEST_ARGS = ("k", "diversity_lambda", "must_group", "must_type", "not_groups", "not_types", "exclude")


def recommend_requests(requests: DataFrame, user_vectors: DataFrame, index: DataFrame, history: DataFrame,
                       trending: DataFrame, request_id: str = "request_id", shard_rows: int = DEFAULT_SHARD_ROWS) -> DataFrame:
    """RC1 with every request's own arguments: one search for all of them.

    ``requests`` has one row per request: ``request_id``, ``user_idx`` and the
    columns ``REQUEST_ARGS`` (missing ones and nulls take the service's
    defaults).  A request out of range has no answer and the reason
    ``invalid``; one that neither the user's vector nor the trending list can
    answer has the reason it would have had and no item (rank 0).
    Output: (request_id, user_idx, rank, item_idx, score, source, user_type, reason).
    """
    have = {c.lower() for c in requests.columns}
    empty = F.array().cast("array<string>")
    defaults = {"k": (F.lit(S.DEFAULT_K), "int"), "diversity_lambda": (F.lit(S.DEFAULT_LAMBDA), "double"),
                "must_group": (F.lit(None), "string"), "must_type": (F.lit(None), "string"),
                "not_groups": (empty, "array<string>"), "not_types": (empty, "array<string>"),
                "exclude": (_empty_ints(), "array<int>")}
    args = [(F.coalesce(F.col(c).cast(t), d.cast(t)) if c in have else d.cast(t)).alias(c) for c, (d, t) in defaults.items()]
    asked = requests.select(F.col(request_id).cast("long").alias("request_id"), "user_idx", *args)
    valid = F.col("k").between(1, S.MAX_K) & F.col("diversity_lambda").between(0.0, 1.0)
    asked = asked.withColumn("valid", valid).withColumn("fetch", F.when(F.col("diversity_lambda") >= 1.0, F.col("k")).otherwise(
        F.least(F.col("k") * 2, F.col("k") + 20, F.lit(S.MAX_K))))
    uv = user_vectors.select(F.col("id").alias("user_idx") if "id" in user_vectors.columns else F.col("user_idx"), "features")
    known = (asked.where("valid").join(uv, "user_idx").join(history_arrays(history), "user_idx", "left")
             .withColumn("_excl", F.array_union(F.coalesce(F.col("history"), _empty_ints()), F.col("exclude"))))
    cands = knn(known, index, "fetch", query_id="request_id", exclude="_excl", per_query_filters=True, shard_rows=shard_rows)
    cands = cands.join(asked.select("request_id", "diversity_lambda", "k"), "request_id")
    picked = mmr_rerank(cands, index, "diversity_lambda", "k", query_id="request_id")
    lists = picked.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("item_idx").cast("int").alias("item_idx"),
        F.col("score").cast("double").alias("score")))).alias("_mine"))
    answered = (asked.join(uv.select("user_idx", F.lit(True).alias("_has_vec")), "user_idx", "left")
                .join(lists, "request_id", "left"))
    mine, known_user = F.col("_mine").isNotNull(), F.coalesce(F.col("_has_vec"), F.lit(False))
    trend = F.slice(F.coalesce(trending_list(trending, S.MAX_K), F.array()), 1, F.greatest(F.col("k"), F.lit(1)))
    chosen = F.when(~F.col("valid"), F.lit(None)).when(mine, F.col("_mine")).otherwise(trend)
    rows = answered.select(
        "request_id", "user_idx",
        F.when(F.col("valid"), F.when(mine, F.lit(S.SOURCE_PERSONALIZED)).otherwise(F.lit(S.SOURCE_TRENDING))).alias("source"),
        F.when(known_user, F.lit(S.USER_KNOWN)).otherwise(F.lit(S.USER_COLD)).alias("user_type"),
        F.when(~F.col("valid"), F.lit("invalid")).when(~mine, F.when(known_user, F.lit("no_results"))
                                                       .otherwise(F.lit("cold_start"))).alias("reason"),
        F.explode_outer(chosen).alias("_r"))
    nothing = F.col("_r").isNull()
    return rows.select("request_id", "user_idx", F.coalesce("_r.rank", F.lit(0)).alias("rank"), "_r.item_idx", "_r.score",
                       F.when(~nothing, F.col("source")).alias("source"), "user_type", "reason")


_EXPLAIN_OUT = T.StructType([
    T.StructField("user_idx", T.LongType()),
    T.StructField("rec_rank", T.IntegerType()),
    T.StructField("rec_item_idx", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("hist_item_idx", T.IntegerType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("sim", T.DoubleType()),
    T.StructField("total", T.DoubleType()),
])


def _explain_batches(batches, top_k: int):
    """Per user: (recs x history) cosine block in numpy, top_k per rec."""
    cols = [f.name for f in _EXPLAIN_OUT.fields]
    # a few users at a time, as lists of structs are many Python objects
    for pdf in (batch.slice(at, 128).to_pandas() for batch in batches for at in range(0, batch.num_rows, 128)):
        out = []
        for row in pdf.itertuples(index=False):
            if row.hist is None or len(row.hist) == 0 or row.recs is None or len(row.recs) == 0:
                continue
            R = np.stack([np.asarray(r["features"], dtype=np.float64) for r in row.recs])
            H = np.stack([np.asarray(h["features"], dtype=np.float64) for h in row.hist])
            nr = np.linalg.norm(R, axis=1)
            nh = np.linalg.norm(H, axis=1)
            dots = R @ H.T
            denom = np.outer(nr, nh)
            sims = np.where(denom == 0, 0.0, dots / np.where(denom == 0, 1.0, denom))
            hpos = np.arange(len(row.hist))
            for i, r in enumerate(row.recs):
                order = np.lexsort((hpos, -sims[i]))[:top_k]
                total = float(sims[i, order].sum())
                for p, j in enumerate(order, start=1):
                    h = row.hist[j]
                    out.append((int(row.user_idx), int(r["rank"]), int(r["item_idx"]), p,
                                int(h["hist_item_idx"]), h["item_name"], float(sims[i, j]), total))
        if out:
            made = pd.DataFrame(out, columns=cols).astype({"rec_rank": "int32", "rec_item_idx": "int32", "pos": "int32", "hist_item_idx": "int32"})
            yield pa.RecordBatch.from_pandas(made, preserve_index=False)


def explain(recs: DataFrame, history: DataFrame, index: DataFrame,
            top_k: int = S.EXPLAIN_DEFAULT_TOP_K, n_history: int = S.EXPLAIN_HISTORY,
            which: str = "oldest") -> DataFrame:
    """For each personalised recommendation, the ``top_k`` history items
    most similar to it (cosine), with similarity rounded to 4 places and
    the share of the shown total in percent (1 place, half-even; divisor 1
    when the shown total is exactly 0; negative similarities kept).

    History is read oldest first and cut to ``n_history`` items as the
    original service does (``which='newest'`` takes the latest instead).
    Both sides are bounded per user (k recs, n_history items), so each user
    is one packed row and its similarities are one small numpy block.
    """
    S.check_args(explain_top_k=top_k)
    order = (F.col("last_purchase_at").asc() if which == "oldest"
             else F.col("last_purchase_at").desc())
    hw = Window.partitionBy("user_idx").orderBy(order, F.col("item_idx").cast("string").asc())
    hist = (history.withColumn("_h", F.row_number().over(hw)).where(F.col("_h") <= n_history)
            .select("user_idx", F.col("item_idx").alias("hist_item_idx"), "_h"))
    hvec = index.select(F.col("item_idx").alias("hist_item_idx"), "features",
                        F.coalesce(F.col("prod_name"), F.lit(S.UNKNOWN_NAME)).alias("item_name"))
    hpack = (hist.join(hvec, "hist_item_idx").groupBy("user_idx").agg(
        F.sort_array(F.collect_list(F.struct("_h", "hist_item_idx", "item_name", "features")))
        .alias("hist")))
    r = recs.where(F.col("source") == S.SOURCE_PERSONALIZED).select("user_idx", "rank", "item_idx")
    rpack = (r.join(index.select("item_idx", "features"), "item_idx").groupBy("user_idx").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_idx", "features"))).alias("recs")))
    packed = rpack.join(hpack, "user_idx").select(
        F.col("user_idx").cast("long").alias("user_idx"), "recs", "hist")
    k = int(top_k)
    raw = packed.mapInArrow(lambda it: _explain_batches(it, k), _EXPLAIN_OUT)
    div = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total"))
    return raw.select(
        F.col("user_idx").cast(recs.schema["user_idx"].dataType).alias("user_idx"),
        "rec_rank", "rec_item_idx", "pos", "hist_item_idx", "item_name",
        F.bround(F.col("sim"), 4).alias("similarity"),
        F.bround(F.col("sim") / div * 100.0, 1).alias("contribution_pct"))


def list_diversity(lists: DataFrame, vectors: DataFrame, key: str = "user_idx") -> DataFrame:
    """A10: mean pairwise cosine distance inside each list; 0 for < 2 items.

    With unit vectors (zero stays zero) the pairwise similarity sum is
    (|sum u|^2 - sum |u|^2) / 2, so the whole metric is one linear
    aggregate per list -- no self-join, any list length.
    """
    v = vectors.select("item_idx", unit(F.col("features"), as_float=False).alias("_u"))
    x = lists.select(key, "item_idx").join(v, "item_idx")
    dims = x.select(key, F.posexplode("_u").alias("pos", "x"))
    sums = dims.groupBy(key, "pos").agg(F.sum("x").alias("s"))
    sq = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("sum_sq"))
    per = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                             F.sum(dot(F.col("_u"), F.col("_u"))).alias("self_sq"))
    j = per.join(sq, key, "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    sim_sum = (F.coalesce(F.col("sum_sq"), F.lit(0.0)) - F.col("self_sq")) / 2.0
    return j.select(key, F.col("n").cast("int").alias("n_items"),
                    F.when(F.col("n") < 2, F.lit(0.0))
                    .otherwise((pairs - sim_sum) / pairs).alias("diversity"))



def nest_recommendations(recs: DataFrame, index: DataFrame,
                         explanations: DataFrame | None = None) -> DataFrame:
    """The response shape: one row per user with ``source`` and a ranked
    ``recommendations`` array of (item_idx, score, metadata, explanation).

    Metadata is the item payload (empty strings when absent, as stored);
    explanation is null unless ``explanations`` (from ``explain``) has rows
    for that recommendation.  Each array holds at most k entries.
    """
    meta = index.select("item_idx", F.struct(*S.PAYLOAD_COLS).alias("metadata"))
    rows = recs.join(meta, "item_idx", "left")
    if explanations is not None:
        ex = explanations.groupBy("user_idx", F.col("rec_item_idx").alias("item_idx")).agg(
            F.sort_array(F.collect_list(F.struct(
                "pos", "hist_item_idx", "item_name", "similarity", "contribution_pct"))).alias("_ex"))
        rows = rows.join(ex, ["user_idx", "item_idx"], "left").withColumn(
            "explanation", F.transform("_ex", lambda e: F.struct(
                e["hist_item_idx"].alias("item_idx"), e["item_name"].alias("item_name"),
                e["similarity"].alias("similarity"),
                e["contribution_pct"].alias("contribution_pct"))))
    else:
        rows = rows.withColumn("explanation", F.lit(None).cast(
            "array<struct<item_idx:int,item_name:string,similarity:double,contribution_pct:double>>"))
    packed = rows.groupBy("user_idx", "source", "user_type").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "item_idx", "score", "metadata", "explanation"))).alias("_r"))
    return packed.select("user_idx", "source", "user_type", F.transform("_r", lambda r: F.struct(
        r["item_idx"].alias("item_idx"), r["score"].alias("score"), r["metadata"].alias("metadata"),
        r["explanation"].alias("explanation"))).alias("recommendations"))
