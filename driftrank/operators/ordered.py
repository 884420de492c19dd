"""Per-key ordered scans that stay parallel when one key is huge.

A per-key fold (debounce anchor, suffix sums) is sequential inside a key.
Instead of hashing a key into one task, rows are *range*-partitioned by
(key, order): a hot key is cut into many partitions, each a contiguous,
sorted slice.  Every partition is processed in parallel; only the first and
last key segment of a partition can continue into a neighbour, so a small
boundary table (at most two rows per partition) carries what crosses the
cut, and a second parallel pass applies it.  The positioned rows are
checkpointed once, so both passes see the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PID = "_pid"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str],
           num_partitions: int | None = None) -> DataFrame:
    """Range-partition by (keys, order), sort each partition, tag rows with
    their partition id and cut the lineage (shared checkpoint dir)."""
    from driftrank.session import ensure_checkpoint_dir
    cols = [*keys, *order]
    r = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    r = r.sortWithinPartitions(*cols).withColumn(PID, F.spark_partition_id())
    ensure_checkpoint_dir(df.sparkSession)
    return r.checkpoint(eager=True)


def key_change(kdf, n: int):
    """Boolean array: row i starts a new key segment (row 0 always does)."""
    import numpy as np
    import pandas as pd
    change = np.ones(n, dtype=bool)
    if n > 1:
        same = np.ones(n - 1, dtype=bool)
        for k in kdf.columns:
            col = kdf[k].to_numpy()
            a, b = col[1:], col[:-1]
            eq = np.asarray(a == b, dtype=bool)
            na = np.asarray(pd.isna(a) | pd.isna(b), dtype=bool)
            same &= eq & ~na
        change[1:] = ~same
    return change


def not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond
