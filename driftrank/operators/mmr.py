"""M1 maximal-marginal-relevance re-rank, batched over users.

Each user's candidate list is bounded by the over-fetch rule (<= 50), so it
is packed into one row; lists of equal length are re-ranked together as a
(users x n x n) numpy tensor, one greedy step for all users at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mmr_select(scores: np.ndarray, vectors: np.ndarray, lam: float | np.ndarray, k: int) -> np.ndarray:
    """Greedy MMR for a batch of equal-length lists.

    scores (B, n), vectors (B, n, d) -> chosen indices (B, min(k, n));
    ``lam`` is one value or one per list.
    Relevance is min-max scaled per list (all ones when the range is 0);
    the running max similarity starts at 0, so a negative similarity never
    helps; argmax takes the first maximum (the better-ranked candidate).
    Computed in float64 (the service used float32; only near-ties can
    differ).
    """
    s = np.asarray(scores, dtype=np.float64)
    B, n = s.shape
    if n == 0:
        return np.zeros((B, 0), dtype=np.int64)
    k = min(k, n)
    lo, hi = s.min(axis=1, keepdims=True), s.max(axis=1, keepdims=True)
    rng = hi - lo
    rel = np.where(rng > 0, (s - lo) / np.where(rng > 0, rng, 1), 1.0)
    v = np.asarray(vectors, dtype=np.float64)
    norms = np.linalg.norm(v, axis=2, keepdims=True)
    norms[norms == 0] = 1
    u = v / norms
    sim = np.einsum("bid,bjd->bij", u, u)
    max_sims = np.zeros((B, n), dtype=np.float64)
    taken = np.zeros((B, n), dtype=bool)
    out = np.zeros((B, k), dtype=np.int64)
    lam = np.broadcast_to(np.asarray(lam, dtype=np.float64), (B,))[:, None]
    rows = np.arange(B)
    for step in range(k):
        m = lam * rel - (1.0 - lam) * max_sims
        m[taken] = -np.inf
        best = np.argmax(m, axis=1)
        out[:, step] = best
        taken[rows, best] = True
        max_sims = np.maximum(max_sims, sim[rows, :, best])
    return out


_OUT = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("item_idx", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])


#: lists re-ranked at a time
LISTS = 256


def _rerank_batches(batches):
    for pdf in (batch.slice(at, LISTS).to_pandas() for batch in batches for at in range(0, batch.num_rows, LISTS)):
        lens = pdf["ids"].map(len).to_numpy()
        outs = []
        for n in np.unique(lens):
            sub = pdf[lens == n]
            if n == 0:
                continue
            ids = np.stack([np.asarray(x, dtype=np.int64) for x in sub["ids"]])
            sc = np.stack([np.asarray(x, dtype=np.float64) for x in sub["scores"]])
            vec = np.stack([np.stack([np.asarray(v, dtype=np.float64) for v in vs])
                            for vs in sub["vecs"]])
            k = sub["k"].to_numpy(dtype=np.int64)
            pick = mmr_select(sc, vec, sub["lam"].to_numpy(dtype=np.float64), int(k.max()))
            B, kk = pick.shape
            r, at = np.nonzero(np.arange(kk)[None, :] < k[:, None])
            outs.append(pd.DataFrame({
                "qid": sub["qid"].to_numpy(dtype=np.int64)[r],
                "rank": (at + 1).astype(np.int32),
                "item_idx": ids[r, pick[r, at]].astype(np.int32),
                "score": sc[r, pick[r, at]],
            }))
        if outs:
            yield pa.RecordBatch.from_pandas(pd.concat(outs, ignore_index=True), preserve_index=False)


def mmr_rerank(cands: DataFrame, vectors: DataFrame, diversity_lambda: float | str, k: int | str,
               query_id: str = "user_idx") -> DataFrame:
    """M1: re-rank each query's candidates (query_id, rank, item_idx, score)
    by MMR and keep k; the score stays the original cosine.  ``vectors``
    supplies (item_idx, features) for the candidates.  ``diversity_lambda``
    and ``k`` are values for all queries or name columns of ``cands`` that
    hold each query's own."""
    own = [F.col(x) if isinstance(x, str) else F.lit(x) for x in (diversity_lambda, k)]
    cands = cands.select(query_id, "rank", "item_idx", "score", own[0].cast("double").alias("_lam"), own[1].cast("int").alias("_k"))
    with_vec = cands.join(vectors.select("item_idx", "features"), "item_idx")
    packed = with_vec.groupBy(query_id).agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_idx", "score", "features"))).alias("_c"),
        F.first("_lam").alias("lam"), F.first("_k").alias("k"))
    packed = packed.select(
        F.col(query_id).cast("long").alias("qid"),
        F.col("_c.item_idx").alias("ids"), F.col("_c.score").alias("scores"),
        F.col("_c.features").alias("vecs"), "lam", "k")
    out = packed.mapInArrow(_rerank_batches, _OUT)
    return out.select(F.col("qid").cast(cands.schema[query_id].dataType).alias(query_id),
                      "rank", "item_idx", "score")
