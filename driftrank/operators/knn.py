"""Vector search: V1 item index, V2 exact top-k by cosine with filters and
exclusions applied before the cut, V3 similar items, V5 lookups, V6 status.

Exact search is a sharded block product.  Items are hashed into shards of
about ``shard_rows`` rows (one packed row per shard, so every shard is a
bounded group); queries are packed per Arrow batch into blocks.  Each query
block is copied once per shard -- never one row per (query, item) pair --
and shuffled to it; a partition is read shard by shard, the shard before its
blocks, so a task holds one shard and one block at a time and nothing passes
through the driver.  A numpy matmul scores them in slices of bounded size,
and only the per-shard top-k of each query leaves the task.  A final
``row_number`` per query keeps k of the <= k x shards survivors.

A dot product is at most the product of the norms.  So for ``metric='dot'``
all queries first meet the items of the largest norms only; what each has
found by then tells which of the other items, in shards of falling norm,
can still come among its k best, and it meets those shards alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank import schema as S
from driftrank.functions.columns import norm, unit
from driftrank.session import scratch_path

DEFAULT_SHARD_ROWS = 32768
DEFAULT_QUERY_ROWS = 512
#: scores and rescored pairs that a task holds at a time
SCORES, RESCORED = 1 << 22, 1 << 16
#: dot products: the items of the largest norms, so many at least, come first; classes of norm are a tenth wide
HEAD_ROWS, NORM_STEP = 8192, 1.1
#: rounding of norms and products, and the norm that a squared one is lost below
NORM_SLACK, NORM_LOST = 1e-9, 1e-150

FILTER_COLS = ("must_group", "must_type", "not_groups", "not_types")


def build_item_index(factors: DataFrame, item_map: DataFrame, articles: DataFrame,
                     normalize: bool = True) -> DataFrame:
    """Factors (id, features) inner item_map, left articles; payload
    nulls filled with ''; vectors unit-normalised (float32, zero stays zero)
    as a cosine store keeps them."""
    f = factors.select(F.col("id").cast("int").alias("item_idx"), "features")
    joined = (f.join(item_map.select(F.col("item_idx").cast("int"), "article_id"), "item_idx")
              .join(articles, "article_id", "left"))
    feats = unit(F.col("features")) if normalize else F.col("features")
    return joined.select(
        "item_idx", feats.alias("features"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in S.PAYLOAD_COLS])


def catalog_filter(product_group: str | None = None, product_type: str | None = None,
                   exclude_ids: list[int] | None = None,
                   exclude_groups: list[str] | None = None,
                   exclude_types: list[str] | None = None) -> Column | None:
    """one composed predicate over the item index, or None for no filter.

    Blank group/type means no filter; negative matches coalesce null to ''
    so a missing value passes a must-not (``NOT IN`` on null drops rows).
    """
    conds: list[Column] = []
    if product_group and product_group.strip():
        conds.append(F.col("product_group_name") == product_group.strip())
    if product_type and product_type.strip():
        conds.append(F.col("product_type_name") == product_type.strip())
    if exclude_ids:
        conds.append(~F.col("item_idx").isin([int(i) for i in exclude_ids]))
    groups = [g.strip() for g in (exclude_groups or []) if g and g.strip()]
    types = [t.strip() for t in (exclude_types or []) if t and t.strip()]
    if groups:
        conds.append(~F.coalesce(F.col("product_group_name"), F.lit("")).isin(groups))
    if types:
        conds.append(~F.coalesce(F.col("product_type_name"), F.lit("")).isin(types))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def filter_catalog(index: DataFrame, **kwargs) -> DataFrame:
    cond = catalog_filter(**kwargs)
    return index if cond is None else index.where(cond)


# --------------------------------------------------------------------------
# numpy kernels (run inside tasks)

def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    n[n == 0] = 1.0
    return m / n[:, None]


def _stack(vectors, d: int | None = None) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, d or 0), dtype=np.float64)
    return np.asarray(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _floor(scores: np.ndarray, most: int) -> np.ndarray:
    """Per row a value that at least ``most`` scores reach, little below the most-th best: the
    most-th best of the maxima over strided groups of columns (few columns: the most-th best itself)."""
    nq, ni = scores.shape
    groups = max(2 * most, 128)
    deep = ni // groups
    if deep >= 4:
        row, col = scores.strides
        scores = np.lib.stride_tricks.as_strided(scores, (nq, deep, groups), (row, groups * col, col), writeable=False).max(axis=1)
    return -np.partition(-scores, most - 1, axis=1)[:, most - 1]


def topk_rows(scores: np.ndarray, item_ids: np.ndarray, k: int | np.ndarray, exact, slack: float | None = None):
    """Per row: the k best finite scores, ties by smaller item id; k is one number or one per row.

    Returns (row, col, score) arrays in rank order.  ``scores`` may carry the
    rounding of a blocked matrix product, which can differ between equal
    vectors; whatever comes within that error (``slack``, by default that of
    double precision) of the k-th value is scored again by
    ``exact(rows, cols)``, whose result depends on the two vectors alone, and
    ranked by that.
    """
    nq, ni = scores.shape
    if nq == 0 or ni == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    most = int(np.max(k))
    if ni > most:
        kth = _floor(scores, most)
        if slack is None:
            slack = 1e-12 * np.where(np.isfinite(scores), np.abs(scores), 0.0).max(axis=1)
        keep = scores >= (kth - slack)[:, None].astype(np.float64)
        if not np.isfinite(kth).all():
            keep &= np.isfinite(scores)
    else:
        keep = np.isfinite(scores)
    rows, cols = np.divmod(np.flatnonzero(keep), ni)
    value = (np.concatenate([exact(rows[at:at + RESCORED], cols[at:at + RESCORED]) for at in range(0, len(rows), RESCORED)])
             if len(rows) else np.zeros(0))
    order = np.lexsort((item_ids[cols], -value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    # position inside each row; cut at k
    starts = np.searchsorted(rows, rows, side="left")
    pos = np.arange(len(rows)) - starts
    sel = pos < np.broadcast_to(k, (nq,))[rows]
    return rows[sel], cols[sel], value[sel]


def _as_tuple(v) -> tuple:
    if v is None:
        return ()
    return tuple(x for x in v if x is not None and str(x).strip() != "")


def _filter_mask(groups: np.ndarray, types: np.ndarray, must_group, must_type,
                 not_groups, not_types) -> np.ndarray:
    mask = np.ones(len(groups), dtype=bool)
    if must_group:
        mask &= groups == must_group
    if must_type:
        mask &= types == must_type
    if not_groups is not None and len(not_groups):
        mask &= ~np.isin(groups, np.asarray(list(not_groups), dtype=object))
    if not_types is not None and len(not_types):
        mask &= ~np.isin(types, np.asarray(list(not_types), dtype=object))
    return mask


def mask_scores(scores: np.ndarray, item_ids: np.ndarray, excludes=None, filters=None, groups=None, types=None) -> None:
    """Sets what a query excludes or filters out to minus infinity, in place."""
    if excludes is not None and len(item_ids):
        order = np.argsort(item_ids, kind="stable")
        sorted_ids = item_ids[order]
        lens = np.fromiter((0 if e is None else len(e) for e in excludes), dtype=np.int64,
                           count=len(excludes))
        if lens.sum():
            flat = np.concatenate([np.asarray(e, dtype=np.int64) for e in excludes
                                   if e is not None and len(e)])
            qrow = np.repeat(np.arange(len(excludes)), lens)
            pos = np.searchsorted(sorted_ids, flat)
            pos_c = np.minimum(pos, len(sorted_ids) - 1)
            hit = sorted_ids[pos_c] == flat
            scores[qrow[hit], order[pos_c[hit]]] = -np.inf
    if filters is not None:
        cache: dict = {}
        for r, f in enumerate(filters):
            if f is None:
                continue
            key = (f[0] or None, f[1] or None, _as_tuple(f[2]), _as_tuple(f[3]))
            if key == (None, None, (), ()):
                continue
            if key not in cache:
                cache[key] = _filter_mask(groups, types, *key)
            scores[r, ~cache[key]] = -np.inf


@dataclass
class Shard:
    """The items of a shard, ready to be scored: ``vecs`` (unit rows for cosine) for the exact value,
    ``rough`` for the matrix product, whose values for a unit query are off by less than half of ``slack``."""
    ids: np.ndarray
    vecs: np.ndarray
    rough: np.ndarray
    slack: float
    groups: np.ndarray | None = None
    types: np.ndarray | None = None


def make_shard(ids: np.ndarray, vecs: np.ndarray, groups=None, types=None, metric: str = "cosine") -> Shard:
    """Items with a value that is not finite have no score and are left out."""
    fine = np.isfinite(vecs).all(axis=1)
    if not fine.all():
        ids, vecs = ids[fine], vecs[fine]
        groups, types = (x if x is None else x[fine] for x in (groups, types))
    if metric != "dot":
        vecs = _unit_rows(vecs)
    norms = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
    some = norms[norms > 0]
    top = float(some.max()) if len(some) else 1.0
    # single precision where its error is small beside the usual product
    if 1e-15 < top < 1e15 and (not len(some) or top <= 1e3 * float(np.median(some))):
        return Shard(ids, vecs, vecs.astype(np.float32), (vecs.shape[1] + 4) * 2.0 ** -23 * top, groups, types)
    return Shard(ids, vecs, vecs, 1e-12 * top, groups, types)


def score_block(qvecs: np.ndarray, shard: Shard, k: int | np.ndarray, excludes=None, filters=None, metric: str = "cosine",
                product=None):
    """Cosine (or dot-product) scores of a query block against an item
    shard, masked, top-k.  Returns (row, col of the shard, score) arrays.
    ``product(rows, lo, hi)`` replaces the matrix product of the unit rows
    ``rows``, the block's from ``lo`` to ``hi``, with all items.
    """
    if len(qvecs) == 0 or len(shard.ids) == 0:
        return topk_rows(np.zeros((len(qvecs), len(shard.ids))), shard.ids, k, None)
    fine = np.isfinite(qvecs).all(axis=1)
    qvecs = np.where(fine[:, None], qvecs, 0.0)
    unit_q = _unit_rows(qvecs)
    rough_q = unit_q.astype(shard.rough.dtype)
    if metric != "dot":
        qvecs = unit_q
    step = max(1, SCORES // len(shard.ids))
    outs = []
    for lo in range(0, len(qvecs), step):
        hi = min(lo + step, len(qvecs))
        scores = rough_q[lo:hi] @ shard.rough.T if product is None else product(rough_q[lo:hi], lo, hi)
        scores[~fine[lo:hi]] = -np.inf
        mask_scores(scores, shard.ids, None if excludes is None else excludes[lo:hi],
                    None if filters is None else filters[lo:hi], shard.groups, shard.types)
        r, c, value = topk_rows(scores, shard.ids, k if np.ndim(k) == 0 else k[lo:hi],
                                lambda a, b: np.einsum("ij,ij->i", qvecs[lo + a], shard.vecs[b]), shard.slack)
        outs.append((r + lo, c, value))
    return tuple(np.concatenate(x) for x in zip(*outs))


# --------------------------------------------------------------------------
# Spark plan

_PAIR_OUT = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("item_idx", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])


def _pack_queries(batches, names: Sequence[str], query_rows: int):
    """One packed row per ``query_rows`` queries (a bounded block): ``qblock`` and a list per column."""
    import pyspark
    ctx = pyspark.TaskContext.get()
    n = (ctx.partitionId() if ctx else 0) << 24
    for batch in batches:
        for lo in range(0, batch.num_rows, query_rows):
            piece = batch.slice(lo, query_rows)
            lists = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(i))
                     for i in range(piece.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists], names=["qblock", *names])
            n += 1


def pack_queries(asked: DataFrame, names: dict[str, str], query_rows: int) -> DataFrame:
    """``asked`` as blocks: the columns that ``names`` maps, as lists under their new names."""
    rows = asked.select(*names)
    schema = T.StructType([T.StructField("qblock", T.LongType()),
                           *[T.StructField(names[f.name], T.ArrayType(f.dataType)) for f in rows.schema.fields]])
    lists = list(names.values())
    return rows.mapInArrow(lambda it: _pack_queries(it, lists, query_rows), schema)


def matrix(lists) -> np.ndarray:
    """The vectors of an Arrow list of lists, a row each."""
    vectors = lists.values
    n = len(vectors)
    if n == 0:
        return np.zeros((0, 0))
    d = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (d != d[0]).any():
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, int(d[0]))


def numbers(values) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False)


def excluded(lists) -> list[np.ndarray]:
    """The ids that each query of a block excludes."""
    each = lists.values
    ids = each.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(each.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(ids, ends[:-1].astype(np.int64)) if len(ends) else []


def asked_of(row: dict, has_excl: bool, has_filters: bool) -> dict:
    """``excludes`` and ``filters`` of a block."""
    out = {"excludes": excluded(row["qexcl"]) if has_excl else None, "filters": None}
    if has_filters:
        out["filters"] = list(zip(*(row[c].as_py() for c in FILTER_COLS)))
    return out


def shard_of(row: dict, has_filters: bool, metric: str = "cosine") -> Shard:
    more = [numbers(row[c]) for c in ("groups", "types")] if has_filters else [None, None]
    return make_shard(numbers(row["ids"]).astype(np.int64), matrix(row["vecs"]), *more, metric=metric)


def meet(shards: DataFrame, blocks: DataFrame, keys: Sequence[str], prepare: Callable, score: Callable,
         out: T.StructType) -> DataFrame:
    """``score(prepare(shard row), block row)`` for every block and the shard of its ``keys``.

    Both sides are shuffled by the keys and a partition is read in their
    order, the shard first: a shard reaches its task once, not once per
    block, and neither side is ever broadcast.
    """
    names = tuple(keys)
    both = (shards.withColumn("_block", F.lit(False))
            .unionByName(blocks.withColumn("_block", F.lit(True)), allowMissingColumns=True)
            .repartition(*names).sortWithinPartitions(*names, "_block"))
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    arrow = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in out.fields])

    def run(batches):
        at, shard = None, None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in columns.items()}
                key = tuple(row[c].as_py() for c in names)
                if not row["_block"].as_py():
                    at, shard = key, prepare(row)
                elif key == at:
                    found = score(shard, row)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(found, arrow)], schema=arrow)

    return both.mapInArrow(run, out)


def _found(shard: Shard, row: dict, k: int | None, has_excl: bool, has_filters: bool, metric: str):
    own = numbers(row["qk"]).astype(np.int64) if k is None else k
    r, c, score = score_block(matrix(row["qvecs"]), shard, own, metric=metric, **asked_of(row, has_excl, has_filters))
    return numbers(row["qids"])[r], shard.ids[c], score


def shards_and_blocks(items: DataFrame, asked: DataFrame, item_cols: dict[str, str], qcols: dict[str, Column],
                      exclude: str | None, per_query_filters: bool, shard_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Items hashed into shards, queries packed into blocks, both keyed by (shard, qgroup): a block
    has a copy per shard, a shard one per group of blocks."""
    n_items = items.agg(F.count(F.lit(1))).scalar()
    n_shards = F.greatest(F.lit(1), F.ceil(n_items / F.lit(shard_rows)).cast("int"))
    placed = items.withColumn("shard", F.pmod(F.xxhash64("item_idx"), n_shards).cast("int"))
    return placed_shards_and_blocks(placed, n_shards, n_shards, asked, item_cols, qcols, exclude, per_query_filters, query_rows)


def placed_shards_and_blocks(placed: DataFrame, n_shards: Column, reach: Column, asked: DataFrame, item_cols: dict[str, str],
                             qcols: dict[str, Column], exclude: str | None, per_query_filters: bool,
                             query_rows: int) -> tuple[DataFrame, DataFrame]:
    """The same for items that name their ``shard`` of ``n_shards``; a block goes to the first ``reach`` of them."""
    cores = max(1, placed.sparkSession.sparkContext.defaultParallelism)
    n_groups = F.greatest(F.lit(1), F.ceil(F.lit(2 * cores) / n_shards).cast("int"))
    item_cols = dict(item_cols)
    if per_query_filters:
        item_cols |= {"product_group_name": "groups", "product_type_name": "types"}
    # one list of structs keeps an item's fields together, nulls included
    shards = (placed.groupBy("shard").agg(F.collect_list(F.struct(*item_cols)).alias("_i"))
              .select("shard", *[F.col(f"_i.{c}").alias(to) for c, to in item_cols.items()])
              .withColumn("qgroup", F.explode(F.sequence(F.lit(0), n_groups - 1))))
    names = {"qid": "qids", "qvec": "qvecs"}
    qcols = dict(qcols)
    if exclude:
        qcols["qexcl"] = F.coalesce(F.col(exclude), F.array().cast("array<int>"))
    if per_query_filters:
        qcols |= {c: F.col(c).cast("string" if c.startswith("must") else "array<string>") for c in FILTER_COLS}
    packed = pack_queries(asked.select(*[v.alias(c) for c, v in qcols.items()]), {c: names.get(c, c) for c in qcols}, int(query_rows))
    blocks = (packed.withColumn("qgroup", F.pmod(F.xxhash64("qblock"), n_groups).cast("int"))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), reach - 1))))
    return shards, blocks


@dataclass
class NormGroup:
    """Neighbouring classes of norm: their items meet queries together."""
    classes: list[int]
    rows: int
    top: float


def with_norm_class(items: DataFrame) -> DataFrame:
    """``_norm`` and its ``_class``, which rises with it; what has no finite norm counts as the largest."""
    size = F.coalesce(norm(F.col("features")), F.lit(float("inf")))
    known = items.withColumn("_norm", F.when(F.isnan(size), F.lit(float("inf"))).otherwise(size))
    return known.withColumn("_class", F.when(F.col("_norm") < NORM_LOST, F.lit(-(1 << 20)))
                            .when(F.col("_norm") == float("inf"), F.lit(1 << 20))
                            .otherwise(F.floor(F.log(F.col("_norm")) / float(np.log(NORM_STEP))).cast("int")))


def norm_groups(items: DataFrame, head_rows: int, shard_rows: int) -> list[NormGroup]:
    """The classes of norm from the largest down, the first ``head_rows`` items at least in one
    group, the others in groups of up to ``shard_rows`` items or one class (a few thousand classes
    at most, however many items)."""
    found = (items.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.max("_norm").alias("top"))
             .orderBy(F.desc("_class")).collect())
    groups: list[NormGroup] = []
    for r in found:
        last = groups[-1] if groups else None
        if last and (last.rows < head_rows if len(groups) == 1 else last.rows + r["n"] <= shard_rows):
            last.classes.append(r["_class"])
            last.rows += r["n"]
        else:
            groups.append(NormGroup([r["_class"]], r["n"], r["top"]))
    return groups


def in_reach(asked: DataFrame, found: DataFrame, groups: list[NormGroup], shards: list[int], vector: Column) -> DataFrame:
    """The queries that an item of ``groups`` can still matter to, with ``_reach``: how many of the
    groups' shards, from the first on.  ``found`` (_qid, _least) is what an item has to score."""
    tops = F.lit([max(g.top, NORM_LOST) * (1 + NORM_SLACK) for g in groups])
    ends = F.lit([int(x) for x in np.cumsum(shards)])
    size = F.coalesce(norm(vector), F.lit(float("inf")))
    near = asked.withColumn("_size", size).join(found, "_qid", "left")
    many = F.size(F.filter(tops, lambda top: F.col("_least").isNull() | (top * F.greatest("_size", F.lit(NORM_LOST)) >= F.col("_least"))))
    return near.withColumn("_many", many).where("_many > 0").withColumn("_reach", F.element_at(ends, F.col("_many")))


def knn(queries: DataFrame, index: DataFrame, k: int | str, query_id: str = "user_idx",
        vector: str = "features", exclude: str | None = None,
        item_filter: Column | None = None, per_query_filters: bool = False,
        shard_rows: int = DEFAULT_SHARD_ROWS, query_rows: int = DEFAULT_QUERY_ROWS,
        metric: str = "cosine", head_rows: int = HEAD_ROWS) -> DataFrame:
    """V2: exact top-k items by cosine (``metric='dot'``: dot product) for
    every query row.

    ``exclude`` names an array<int> column of item ids to skip for that
    query (history plus explicit ids); ``item_filter`` is a catalog-wide
    predicate (pushed to the index scan); with ``per_query_filters`` the
    query rows carry must_group / must_type / not_groups / not_types.
    ``k`` is a number or names an int column with each query's own (a query
    whose k is null or below 1 has no rows).  Filters and exclusions act before the cut, so k results survive when k
    items qualify.  Output: (query_id, rank, item_idx, score).

    Work split: S = ceil(items / shard_rows) item shards of bounded size;
    query blocks are spread over G = ceil(2 x cores / S) groups and each
    shard is replicated once per group, so the (block, shard) pairs land in
    S x G join partitions -- enough tasks even when the catalog is one
    shard, without ever pairing single queries with single items.  Exact
    search costs queries x items x dim and copies each query block once per
    shard; for catalogs of tens of millions use ``knn_lsh``.  Dot products
    do less where norms differ: ``head_rows`` items of the largest norms come
    first, and a query meets only those of the others whose norm can still
    give one of its k best.
    """
    items = index if item_filter is None else index.where(item_filter)
    items = items.where(F.col("features").isNotNull())
    item_cols = {"item_idx": "ids", "features": "vecs"}
    qcols = {"qid": F.col(query_id).cast("long"), "qvec": F.col(vector).cast("array<float>")}
    own_k = isinstance(k, str)
    asked = queries.where(F.col(vector).isNotNull())
    if own_k:
        asked = asked.where(F.col(k) > 0)
        qcols["qk"] = F.col(k).cast("long")
    has_excl, has_f, m = bool(exclude), per_query_filters, metric
    fixed = None if own_k else k
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item_idx").asc())

    def scored(shards: DataFrame, blocks: DataFrame) -> DataFrame:
        return meet(shards, blocks, ["shard", "qgroup"], lambda row: shard_of(row, has_f, m),
                    lambda shard, row: _found(shard, row, fixed, has_excl, has_f, m), _PAIR_OUT)

    groups = []
    if metric == "dot" and not own_k:
        items = with_norm_class(items)
        groups = norm_groups(items, head_rows, int(shard_rows))
    if len(groups) > 1:
        rest = groups[1:]
        head = items.where(F.col("_class") >= groups[0].classes[-1])
        first = scored(*shards_and_blocks(head, asked, item_cols, qcols, exclude, per_query_filters, shard_rows, query_rows))
        first = _kept(first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "first-found")
        # the other groups, each in shards of its own
        parts = [-(-g.rows // int(shard_rows)) for g in rest]
        begin = np.cumsum([0, *parts])
        ends = F.lit([g.classes[-1] for g in rest])  # the lowest class of each
        at = F.array_position(ends, F.array_max(F.filter(ends, lambda c: c <= F.col("_class")))).cast("int")
        placed = items.where(F.col("_class") < groups[0].classes[-1]).withColumn("shard", (
            F.element_at(F.lit([int(x) for x in begin[:-1]]), at)
            + F.pmod(F.xxhash64("item_idx"), F.element_at(F.lit(parts), at))).cast("int"))
        least = first.where(F.col("rank") == k).select(F.col("qid").alias("_qid"), F.col("score").alias("_least"))
        still = in_reach(asked.withColumn("_qid", qcols["qid"]), least, rest, parts, qcols["qvec"]).sortWithinPartitions("_reach")
        shards, blocks = placed_shards_and_blocks(placed, F.lit(int(begin[-1])), F.array_max("_reach"), still, item_cols,
                                                  {**qcols, "_reach": F.col("_reach")}, exclude, per_query_filters, query_rows)
        every = first.drop("rank").unionByName(scored(shards, blocks.drop("_reach")))
    else:
        every = scored(*shards_and_blocks(items, asked, item_cols, qcols, exclude, per_query_filters, shard_rows, query_rows))
    ranked = every.withColumn("rank", F.row_number().over(w))
    if own_k:
        ranked = ranked.join(asked.select(F.col(query_id).cast("long").alias("qid"), F.col(k).alias("_k")), "qid")
    ranked = ranked.where(F.col("rank") <= (F.col("_k") if own_k else k))
    return ranked.select(F.col("qid").cast(queries.schema[query_id].dataType).alias(query_id),
                         F.col("rank").cast("int"), "item_idx", "score")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: it is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_queries(sources: DataFrame, index: DataFrame, source_col: str = "item_idx", exclude: str | None = None,
                   per_query_filters: bool = False) -> DataFrame:
    """Source items as queries: their vectors, and ``_excl``, the source and the ids in ``exclude``."""
    src = sources.select(F.col(source_col).cast("int").alias("source_item_idx"),
                         *([exclude] if exclude else []),
                         *(list(FILTER_COLS) if per_query_filters else []))
    vec = index.select(F.col("item_idx").alias("source_item_idx"), "features")
    excl = F.array(F.col("source_item_idx"))
    if exclude:
        excl = F.array_union(excl, F.coalesce(F.col(exclude), F.array().cast("array<int>")))
    return src.join(vec, "source_item_idx").withColumn("_excl", excl)


def similar_items(sources: DataFrame, index: DataFrame, k: int = S.DEFAULT_K,
                  source_col: str = "item_idx", exclude: str | None = None,
                  item_filter: Column | None = None, per_query_filters: bool = False,
                  shard_rows: int = DEFAULT_SHARD_ROWS) -> DataFrame:
    """V3: top-k neighbours of each source item; the source itself is always
    excluded (plus ids in ``exclude``).  Sources absent from the index get
    no rows (see ``similar_items_status``)."""
    q = source_queries(sources, index, source_col, exclude, per_query_filters)
    return knn(q, index, k, query_id="source_item_idx", exclude="_excl",
               item_filter=item_filter, per_query_filters=per_query_filters,
               shard_rows=shard_rows)


def similar_items_status(sources: DataFrame, index: DataFrame,
                         source_col: str = "item_idx") -> DataFrame:
    """V6: per requested source item, ``success`` if it is in the index,
    otherwise ``not_found``."""
    ids = index.select(F.col("item_idx").alias("_found"))
    return (sources.select(F.col(source_col).cast("int").alias("source_item_idx"))
            .join(ids, F.col("source_item_idx") == F.col("_found"), "left")
            .select("source_item_idx",
                    F.when(F.col("_found").isNotNull(), F.lit("success"))
                    .otherwise(F.lit("not_found")).alias("status")))


def lookup(index: DataFrame, ids: DataFrame, id_col: str = "item_idx",
           cols: tuple[str, ...] = ("features",) + S.PAYLOAD_COLS) -> DataFrame:
    """V5: fetch vectors/payload for the requested ids (left join keeps
    misses as nulls)."""
    return ids.join(index.select(F.col("item_idx").alias(id_col), *cols), id_col, "left")


# --------------------------------------------------------------------------
# V4: approximate search by random-hyperplane LSH, re-ranked exactly

_SIG_OUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("lsh_table", T.IntegerType()),
    T.StructField("bucket", T.LongType()),
])


def hyperplanes(dim: int, n_tables: int, n_bits: int, seed: int) -> np.ndarray:
    """(n_tables, n_bits, dim) Gaussian hyperplanes from a fixed seed; a small
    parameter array (tables x bits x dim floats), shipped with the task."""
    return np.random.default_rng(seed).standard_normal((n_tables, n_bits, dim))


def _signatures(batches, planes: np.ndarray, id_col: str, vec_col: str):
    weights = (1 << np.arange(planes.shape[1], dtype=np.int64))
    for pdf in batches:
        if len(pdf) == 0:
            continue
        m = _stack(list(pdf[vec_col]), planes.shape[2])
        proj = np.einsum("nd,tbd->ntb", m, planes) > 0
        buckets = (proj.astype(np.int64) * weights).sum(axis=2)  # (n, tables)
        n, t = buckets.shape
        yield pd.DataFrame({
            "id": np.repeat(pdf[id_col].to_numpy(dtype=np.int64), t),
            "lsh_table": np.tile(np.arange(t, dtype=np.int32), n),
            "bucket": buckets.ravel(),
        })


def _lsh_groups(df: DataFrame, id_col: str, vec_col: str, planes: np.ndarray,
                rows_per_group: int) -> tuple[DataFrame, DataFrame]:
    """(id, lsh_table, bucket, grp): each (table, bucket) is split into groups
    of about ``rows_per_group`` rows, so a hot bucket is several bounded
    groups rather than one huge one.  And the number of groups of each."""
    sig = df.select(id_col, vec_col).mapInPandas(
        lambda it: _signatures(it, planes, id_col, vec_col), _SIG_OUT)
    counts = sig.groupBy("lsh_table", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (table, bucket): at most tables x 2^bits rows
    nsub = counts.select("lsh_table", "bucket",
                         F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_group)))
                         .cast("long").alias("_nsub"))
    return (sig.join(F.broadcast(nsub), ["lsh_table", "bucket"])
            .withColumn("grp", F.pmod(F.xxhash64("id"), F.col("_nsub")))
            .drop("_nsub")), nsub


def knn_lsh(queries: DataFrame, index: DataFrame, k: int, query_id: str = "user_idx",
            vector: str = "features", exclude: str | None = None,
            item_filter: Column | None = None, n_tables: int = 4, n_bits: int = 6,
            seed: int = 42, shard_rows: int = DEFAULT_SHARD_ROWS,
            query_rows: int = 4096) -> DataFrame:
    """V4: approximate top-k.  Queries meet only the items that share an LSH
    bucket with them in at least one of ``n_tables`` tables (sign patterns
    of ``n_bits`` random hyperplanes, i.e. angular / cosine LSH); those
    candidates are scored exactly and ranked like ``knn``.  Recall grows
    with tables and shrinks with bits; compare against ``knn``."""
    items = index if item_filter is None else index.where(item_filter)
    items = items.where(F.col("features").isNotNull())
    first = items.select("features").first()  # one row, to size the hyperplanes
    dim = len(first[0]) if first is not None else 1
    planes = hyperplanes(dim, n_tables, n_bits, seed)

    ig, parts = _lsh_groups(items.select(F.col("item_idx").cast("long").alias("id"), "features"),
                     "id", "features", planes, shard_rows)
    shards = (ig.join(items.select(F.col("item_idx").cast("long").alias("id"), "features"), "id")
              .groupBy("lsh_table", "bucket", "grp")
              .agg(F.collect_list(F.col("id").cast("int")).alias("ids"),
                   F.collect_list("features").alias("vecs")))
    q = queries.where(F.col(vector).isNotNull()).select(
        F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("qvec"),
        *([F.coalesce(F.col(exclude), F.array().cast("array<int>")).alias("qexcl")] if exclude else []))
    qg = _lsh_groups(q, "qid", "qvec", planes, query_rows)[0].withColumnRenamed("id", "qid")
    qcols = [F.collect_list("qid").alias("qids"), F.collect_list("qvec").alias("qvecs")]
    if exclude:
        qcols.append(F.collect_list("qexcl").alias("qexcl"))
    blocks = (qg.join(q, "qid").groupBy("lsh_table", "bucket", "grp").agg(*qcols).drop("grp"))
    # a block has a copy per group of its bucket's items
    blocks = (blocks.join(F.broadcast(parts), ["lsh_table", "bucket"])
              .withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nsub") - 1))).drop("_nsub"))
    has_excl = bool(exclude)
    scored = meet(shards, blocks, ["lsh_table", "bucket", "grp"], lambda row: shard_of(row, False),
                  lambda shard, row: _found(shard, row, k, has_excl, False, "cosine"), _PAIR_OUT)
    best = scored.groupBy("qid", "item_idx").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item_idx").asc())
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").cast(queries.schema[query_id].dataType).alias(query_id),
                         F.col("rank").cast("int"), "item_idx", "score")
