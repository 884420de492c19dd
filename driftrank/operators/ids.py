"""Dense id maps: I1 assign, I2 stable incremental update, I3 frequency index,
J4 new ids (left anti)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | row position
MAX_INT_ID = 2**31 - 1


def assign_ids(df: DataFrame, id_col: str, idx_col: str, start: int | F.Column = 0,
               num_partitions: int | None = None) -> DataFrame:
    """Dense 0..n-1 (+start) over the distinct ids, in ascending id order.

    Distributed: range-partition the distinct ids, sort inside each
    partition, take the in-partition position from
    ``monotonically_increasing_id`` and add the count of all earlier
    partitions (a table with one row per partition, broadcast).  No global
    single-partition window over the ids, no driver round trip.  The
    positioned ids are checkpointed once so that positions and counts agree
    even if a stage is recomputed after an executor loss.
    """
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    ranged = (ids.repartitionByRange(num_partitions, id_col) if num_partitions
              else ids.repartitionByRange(id_col))
    ranged = ranged.sortWithinPartitions(id_col).withColumn(
        "_mid", F.monotonically_increasing_id())
    ranged = ranged.select(
        id_col,
        F.shiftright("_mid", _POS_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1).alias("_pos"),
    )
    # Range bounds come from sampling, which may differ if the exchange is
    # recomputed; positions and per-partition counts must come from one
    # materialisation, so cut the lineage here (shared checkpoint dir).
    from driftrank.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a proven-small table, safe to broadcast
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, F.Column) else F.lit(start)
    out = ranged.join(F.broadcast(offsets), "_pid").select(
        id_col, (F.col("_off") + F.col("_pos") + start_col).alias("_idx"))
    guarded = F.when(F.col("_idx") <= MAX_INT_ID, F.col("_idx").cast("int")).otherwise(
        F.raise_error(F.lit("id space exceeds int range")))
    return out.select(id_col, guarded.alias(idx_col))


def new_ids(current: DataFrame, existing: DataFrame, id_col: str) -> DataFrame:
    """Ids present now but absent from the existing map."""
    return (current.select(id_col).where(F.col(id_col).isNotNull()).distinct()
            .join(existing.select(id_col), id_col, "left_anti"))


def update_mapping(existing: DataFrame | None, current: DataFrame, id_col: str,
                   idx_col: str) -> DataFrame:
    """Old ids keep their index; new ids get max+1, max+2, ... in id order.

    Returns only the rows to append (the caller appends them, never rewriting
    the table it reads).  ``existing=None`` creates the map from scratch.
    """
    if existing is None:
        return assign_ids(current, id_col, idx_col, 0)
    fresh = new_ids(current, existing, id_col)
    # scalar subquery: stays inside one plan, no collect to the driver
    start = existing.agg(F.coalesce(F.max(idx_col) + 1, F.lit(0))).scalar()
    return assign_ids(fresh, id_col, idx_col, start)


def full_mapping(existing: DataFrame | None, current: DataFrame, id_col: str,
                 idx_col: str) -> DataFrame:
    """The map after the update: existing rows plus the appended ones."""
    added = update_mapping(existing, current, id_col, idx_col)
    if existing is None:
        return added
    return existing.select(id_col, F.col(idx_col).cast("int")).unionByName(added)


def string_index(df: DataFrame, col: str, out_col: str) -> DataFrame:
    """Frequency-ordered index (most frequent -> 0, ties by value asc),
    like ``StringIndexer(stringOrderType='frequencyDesc')``; returns the
    label table (value, index, count).  Unseen values at transform time map
    to ``n`` (handleInvalid='keep')."""
    freq = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col(col).isNotNull())
    # rank by (count desc, value asc): a distributed sort of the distinct
    # labels; the dense position comes from assign_ids over a sort key.
    keyed = freq.select(
        col, "_cnt",
        F.concat(F.lpad((F.lit(2**62) - F.col("_cnt")).cast("string"), 20, "0"),
                 F.lit("\u0000"), F.col(col).cast("string")).alias("_key"))
    idx = assign_ids(keyed, "_key", out_col)
    return keyed.join(idx, "_key").select(col, F.col(out_col).cast("double").alias(out_col),
                                          F.col("_cnt").alias("count"))


def apply_index(df: DataFrame, labels: DataFrame, col: str, out_col: str) -> DataFrame:
    """Transform with a label table; unseen or null values get index n (keep)."""
    n = labels.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (df.join(labels.select(col, out_col), col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), n)))
