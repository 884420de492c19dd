"""V4: approximate search by an inverted file of cells with product-quantised
residuals, multi-probe, and an exact re-rank.

- **Train.** Spark ML's k-means (cosine) finds the cell centroids on a sample
  of at most about ``sample_rows`` items, the first by hash; per subspace a
  codebook of the residuals (item less centroid) is trained on the same
  sample, one bounded group per subspace.
- **Store.** Every item lies in the cell of its nearest centroid, with one
  byte per subspace as its code; ``publish_cells`` writes the table
  partitioned by cell.
- **Search.** A query probes its ``probes`` nearest cells only.  As in
  ``knn``, queries are packed into blocks and items hashed into shards; a
  shard holds its items by cell, and each cell is scored by one matrix
  product of the queries that probe it with the vectors its codes stand for;
  filters and exclusions act there.  Of all probed items the ``rerank`` best
  per query are ranked by the exact cosine, ties by item id, like ``knn``;
  the real vectors lie in the shard beside the codes, so that a candidate
  has its exact cosine where it is found.

Without codes (``rerank=None``) all probed items are scored exactly.  A cell
is spread over all shards and its queries over all blocks, so every group is
bounded however hot a cell is; centroids and codebooks are bounded
parameters that travel with the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank.operators.knn import (DEFAULT_QUERY_ROWS, DEFAULT_SHARD_ROWS, RESCORED, Shard, _PAIR_OUT, _stack, _unit_rows, asked_of,
                                     make_shard, matrix, meet, numbers, score_block, shards_and_blocks, source_queries)

SAMPLE_ROWS = 1 << 16
#: items of a shard that is scored by codes; each query leaves up to ``rerank`` candidates a shard
CODE_SHARD_ROWS = 1 << 16
CODES = 256


@dataclass
class CellModel:
    """Unit centroids (cells x dim) and, unless search is exact, codebooks (subspaces x codes x part of dim)."""
    centroids: np.ndarray
    codebooks: np.ndarray | None = None

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, ties by smaller cell."""
        near = _unit_rows(vectors) @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: centroid and residual."""
        return self.centroids[cell] + np.concatenate([book[code[:, s]] for s, book in enumerate(self.codebooks)], axis=1)

    def encode(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """One byte per subspace: the nearest code of the residual's part."""
        rest = vectors - self.centroids[cell]
        m, _, d = self.codebooks.shape
        out = np.empty((len(vectors), m), dtype=np.uint8)
        for s in range(m):
            part, book = rest[:, s * d:(s + 1) * d], self.codebooks[s]
            out[:, s] = ((book ** 2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
        return out


@dataclass
class CellIndex:
    """A trained model, the table of its cells and the search settings."""
    model: CellModel
    table: DataFrame
    probes: int
    rerank: int | None = None

    def search(self, queries: DataFrame, k: int, **kwargs) -> DataFrame:
        return search_cells(queries, self.table, self.model, k, probes=self.probes, rerank=self.rerank, **kwargs)


def _sample(index: DataFrame, sample_rows: int) -> DataFrame:
    items = index.where(F.col("features").isNotNull()).select("item_idx", "features")
    share = min(1.0, sample_rows / max(1, items.count()))
    return items.where(F.pmod(F.xxhash64("item_idx"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))


def _codebook(x: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's k-means of one subspace's parts; empty codes keep their place."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), size=codes, replace=len(x) < codes)].copy()
    for _ in range(rounds):
        near = ((book ** 2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)
        n = np.bincount(near, minlength=codes)
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=codes) for j in range(x.shape[1])], axis=1)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def train_cells(index: DataFrame, n_cells: int, subspaces: int = 16, sample_rows: int = SAMPLE_ROWS, rounds: int = 8,
                seed: int = 42) -> CellModel:
    """Centroids and codebooks from a bounded sample of ``index`` (item_idx, features)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    sample = _sample(index, sample_rows)
    points = sample.select("item_idx", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    points = points.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism), "item_idx").sortWithinPartitions("item_idx")
    fitted = KMeans(k=n_cells, distanceMeasure="cosine", maxIter=rounds, seed=seed).fit(points)
    centroids = _unit_rows(np.stack(fitted.clusterCenters()))
    model = CellModel(centroids)
    dim = centroids.shape[1]
    if dim % subspaces:
        raise ValueError(f"{subspaces} subspaces do not divide {dim} dimensions")
    d = dim // subspaces

    def parts(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = _unit_rows(_stack(list(pdf["features"])))
            rest = v - model.centroids[model.nearest(v, 1)[:, 0]]
            yield pd.DataFrame({"sub": np.tile(np.arange(subspaces, dtype=np.int32), len(v)),
                                "item_idx": np.repeat(pdf["item_idx"].to_numpy(np.int64), subspaces),
                                "part": list(rest.reshape(-1, d))})

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_idx")
        made = _codebook(np.stack(pdf["part"].to_numpy()), CODES, rounds, seed)
        return pd.DataFrame({"sub": [int(pdf["sub"].iloc[0])], "book": [made.ravel().tolist()]})

    rows = (sample.mapInPandas(parts, "sub int, item_idx long, part array<double>")
            .groupBy("sub").applyInPandas(book, "sub int, book array<double>").orderBy("sub").collect())
    model.codebooks = np.stack([np.array(r["book"]).reshape(CODES, d) for r in rows])
    return model


def cell_table(index: DataFrame, model: CellModel) -> DataFrame:
    """``index`` with the cell of each item and, if the model has codebooks, its code."""
    items = index.where(F.col("features").isNotNull())
    fields = [*items.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())]

    def place(batches):
        for pdf in batches:
            v = _unit_rows(_stack(list(pdf["features"]), model.centroids.shape[1]))
            cell = model.nearest(v, 1)[:, 0]
            code = [None] * len(v) if model.codebooks is None else [c.tobytes() for c in model.encode(v, cell)]
            yield pdf.assign(cell=cell.astype(np.int32), code=code)

    return items.mapInPandas(place, T.StructType(fields))


def publish_cells(index: DataFrame, model: CellModel, path: str) -> DataFrame:
    """The cell table written below ``path``, one folder per cell, and read back."""
    table = cell_table(index, model)
    table.repartition(F.col("cell"), F.pmod(F.xxhash64("item_idx"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    return index.sparkSession.read.schema(table.schema).parquet(path)


def probed(queries: DataFrame, model: CellModel, probes: int, query_id: str = "user_idx", vector: str = "features") -> DataFrame:
    """(qid, cell, qvec): the cells each query looks into."""
    def cells(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = _stack(list(pdf["qvec"]), model.centroids.shape[1])
            near = model.nearest(v, probes)
            row = np.repeat(np.arange(len(v)), near.shape[1])
            yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[row], "cell": near.ravel().astype(np.int32),
                                "qvec": [pdf["qvec"].iloc[i] for i in row]})

    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("qvec"))
    return q.mapInPandas(cells, "qid long, cell int, qvec array<float>")


_CODE_OUT = T.StructType([*_PAIR_OUT.fields, T.StructField("exact", T.ArrayType(T.DoubleType()))])


@dataclass
class CellShard:
    """Items in order of their cell, ``ends`` of which are where each cell ends; and the ids, in
    order, and vectors of all rows of the shard, filtered out or not."""
    shard: Shard
    ends: np.ndarray
    ids: np.ndarray
    vecs: np.ndarray


def _cell_shard(row: dict, model: CellModel, exact: bool, has_filters: bool) -> CellShard:
    ids, cell, vecs = numbers(row["ids"]).astype(np.int64), numbers(row["cells"]), matrix(row["vecs"])
    order = np.argsort(cell, kind="stable")
    fits = np.isfinite(vecs).all(axis=1) & numbers(row["fits"]).astype(bool)
    order = order[fits[order]]
    more = [numbers(row[c])[order] for c in ("groups", "types")] if has_filters else [None, None]
    if exact:
        scored = make_shard(ids[order], vecs[order], *more)
    else:
        code = np.frombuffer(b"".join(row["codes"].as_py()), dtype=np.uint8).reshape(len(ids), -1)[order]
        scored = make_shard(ids[order], model.decode(cell[order], code), *more, metric="dot")
    by_id = np.argsort(ids, kind="stable")
    return CellShard(scored, np.searchsorted(cell[order], np.arange(len(model.centroids)), side="right"),
                     ids[by_id], vecs[by_id].astype(np.float32))


def _true(unit: np.ndarray, held: CellShard, r: np.ndarray, ids: np.ndarray) -> pa.Array:
    """For each candidate the exact cosines of all rows of its item, one unless the item is there repeatedly."""
    first, last = np.searchsorted(held.ids, ids, side="left"), np.searchsorted(held.ids, ids, side="right")
    n = last - first
    ends = np.cumsum(n)
    at = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(first, n)
    r = np.repeat(r, n)
    value = [np.einsum("ij,ij->i", unit[r[lo:lo + RESCORED]], _unit_rows(held.vecs[at[lo:lo + RESCORED]].astype(np.float64)))
             for lo in range(0, len(r), RESCORED)]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate([np.zeros(0), *value])))


def _probe(held: CellShard, row: dict, model: CellModel, keep: int, probes: int, exact: bool, has_excl: bool, has_filters: bool):
    """The ``keep`` best items of the shard in the cells that each query probes, by codes or exactly."""
    q = matrix(row["qvecs"])
    shard, ends = held.shard, held.ends
    looked = np.zeros((len(q), len(model.centroids)), dtype=bool)
    np.put_along_axis(looked, model.nearest(q, probes), True, axis=1)

    def product(rows, lo, hi):
        scores = np.full((hi - lo, len(shard.ids)), -np.inf, dtype=rows.dtype)
        for cell, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            some = np.flatnonzero(looked[lo:hi, cell])
            if b > a and len(some):
                scores[some, a:b] = rows[some] @ shard.rough[a:b].T
        return scores

    unit = _unit_rows(q)
    r, c, score = score_block(unit, shard, keep, metric="dot", product=product, **asked_of(row, has_excl, has_filters))
    found = numbers(row["qids"])[r], shard.ids[c], score
    return found if exact else (*found, _true(unit, held, r, shard.ids[c]))


def candidates(queries: DataFrame, table: DataFrame, model: CellModel, keep: int, *, probes: int, exact: bool,
               query_id: str = "user_idx", vector: str = "features", exclude: str | None = None,
               item_filter: Column | None = None, per_query_filters: bool = False,
               shard_rows: int = DEFAULT_SHARD_ROWS, query_rows: int = DEFAULT_QUERY_ROWS) -> DataFrame:
    """(qid, item_idx, score): up to ``keep`` items per query and shard, by codes or exactly; by codes
    with ``exact``, the cosines of all rows of the item."""
    if exact:
        items = (table if item_filter is None else table.where(item_filter)).withColumn("_fits", F.lit(True))
    else:
        items = table.withColumn("_fits", F.lit(True) if item_filter is None else F.coalesce(item_filter, F.lit(False)))
    item_cols = {"item_idx": "ids", "cell": "cells", "features": "vecs", "_fits": "fits", **({} if exact else {"code": "codes"})}
    asked = queries.where(F.col(vector).isNotNull())
    qcols = {"qid": F.col(query_id).cast("long"), "qvec": F.col(vector).cast("array<float>")}
    shards, blocks = shards_and_blocks(items, asked, item_cols, qcols, exclude, per_query_filters, shard_rows, query_rows)
    has_excl, has_f = bool(exclude), per_query_filters
    return meet(shards, blocks, ["shard", "qgroup"], lambda row: _cell_shard(row, model, exact, has_f),
                lambda held, row: _probe(held, row, model, keep, probes, exact, has_excl, has_f), _PAIR_OUT if exact else _CODE_OUT)


def search_cells(queries: DataFrame, table: DataFrame, model: CellModel, k: int, *, probes: int, rerank: int | None = None,
                 query_id: str = "user_idx", vector: str = "features", exclude: str | None = None,
                 item_filter: Column | None = None, per_query_filters: bool = False,
                 shard_rows: int | None = None) -> DataFrame:
    """Approximate top-k items for every query row, arguments and output as in ``knn``.

    ``table`` is a ``cell_table``.  ``rerank`` items per query (at least k)
    are chosen by their codes and then scored exactly; None scores all items
    of the probed cells exactly.  A query without a vector has no rows.
    """
    exact = rerank is None or model.codebooks is None
    keep = k if exact else max(k, rerank)
    found = candidates(queries, table, model, keep, probes=probes, exact=exact, query_id=query_id, vector=vector,
                       exclude=exclude, item_filter=item_filter, per_query_filters=per_query_filters,
                       shard_rows=shard_rows or (DEFAULT_SHARD_ROWS if exact else CODE_SHARD_ROWS))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item_idx").asc())
    if not exact:
        found = (found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep)
                 .select("qid", "item_idx", F.explode("exact").alias("score")))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").cast(queries.schema[query_id].dataType).alias(query_id),
                         F.col("rank").cast("int"), "item_idx", "score")


def similar_in_cells(sources: DataFrame, index: DataFrame, approx: CellIndex, k: int, source_col: str = "item_idx",
                     exclude: str | None = None, item_filter: Column | None = None, per_query_filters: bool = False) -> DataFrame:
    """V3 by cells: arguments and output as in ``similar_items``."""
    asked = source_queries(sources, index, source_col, exclude, per_query_filters)
    return approx.search(asked, k, query_id="source_item_idx", exclude="_excl", item_filter=item_filter,
                         per_query_filters=per_query_filters)
