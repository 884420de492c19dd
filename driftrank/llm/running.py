"""Running totals over ordered rows, with one shuffle and groups of any size.

Rows are range-partitioned by (key, order), so a key with a third of all
rows lies in several partitions.  Each task adds up its sorted rows as they
stream by; what a partition's first key brings along from the partitions
before it is one row per partition, added at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .tables import fresh, written

_MORE = {"add": np.add, "xor": np.bitwise_xor}


def _totals(batches, keys, sums, how):
    """Adds place in the partition and local running totals to sorted batches."""
    last, carried, row = None, [np.int64(0)] * len(sums), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = first != last
        last = tuple(c[-1] for c in cols)
        group = np.cumsum(new)
        starts = np.flatnonzero(new)
        out = []
        for i, (s, h) in enumerate(zip(sums, how)):
            v = batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                run = _MORE[h].accumulate(v)
                before = np.concatenate([[np.int64(0)], run])[starts]
                if h == "add":
                    base = np.concatenate([[-carried[i]], before])
                    run = run - base[group]
                else:
                    base = np.concatenate([[carried[i]], before])
                    run = run ^ base[group]
            carried[i] = run[-1]
            out.append(pa.array(run))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + n)), *out],
                                         [*batch.schema.names, "_row", *[f"{s}_run" for s in sums]])
        row += n


def running(df: DataFrame, keys: list[str], order: list[Column], name: str, *, add: list[str] = (),
            xor: list[str] = ()) -> DataFrame:
    """``df`` with ``<column>_run``: the sum (or exclusive or) up to and with each row, per key in order.

    ``keys`` and the summed columns are longs without nulls; an empty list
    of keys makes one order over all rows.  Sums per key must fit 64 bits.  Rows that
    are equal in key and order come in any order, but are kept in one.
    """
    sums, how = [*add, *xor], ["add"] * len(add) + ["xor"] * len(xor)
    spark = df.sparkSession
    tie, width = fresh(df, "_tie"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order, F.col(tie)]
    dealt = (df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(width, *by)
             .sortWithinPartitions(*by).drop(tie).withColumn("_part", F.spark_partition_id()))
    schema = T.StructType([*dealt.schema.fields, T.StructField("_row", T.LongType()),
                           *[T.StructField(f"{s}_run", T.LongType()) for s in sums]])
    local = written(dealt.mapInArrow(lambda b: _totals(b, keys, sums, how), schema), name)

    # one row per partition: first and last key, totals of the last key
    of_key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_one"))
    ends = (local.groupBy("_part").agg(F.min_by(of_key, "_row").alias("first"), F.max_by(of_key, "_row").alias("last"),
                                       F.max_by(F.struct(*[f"{s}_run" for s in sums]), "_row").alias("total"))
            .collect())
    rows, last, carried = [], None, [0] * len(sums)
    for r in sorted(ends, key=lambda r: r["_part"]):
        goes_on = r["first"] == last
        rows.append((r["_part"], [r["first"][k] for k in keys], carried if goes_on else [0] * len(sums)))
        whole = goes_on and r["first"] == r["last"]
        carried = [(c + t if h == "add" else c ^ t) if whole else t for c, t, h in zip(carried, r["total"], how)]
        last = r["last"]
    brought = spark.createDataFrame(rows, "_part int, _first array<long>, _carry array<long>")
    out = local.join(F.broadcast(brought), "_part")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col("_first")[i])
    for i, (s, h) in enumerate(zip(sums, how)):
        run, more = F.col(f"{s}_run"), F.when(same, F.col("_carry")[i]).otherwise(0)
        out = out.withColumn(f"{s}_run", run + more if h == "add" else run.bitwiseXOR(more))
    return out.drop("_part", "_row", "_first", "_carry")

