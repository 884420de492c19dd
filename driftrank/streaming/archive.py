"""ST5/K3 archive stream: event values -> parse -> project to transactions ->
checkpointed micro-batch sink, idempotent per batch id."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.operators.archive import count_by_type, events_to_transactions
from driftrank.sources.events import parse_events

VALID = "_valid"


def archive_batch(out: str, metrics_out: str | None = None):
    """foreachBatch body: skip empty batches; write the batch's valid rows to
    ``out/batch_id=<n>`` with overwrite, so a replayed batch replaces its own
    output (at-least-once delivery, exactly-once table).  Per-type counts of
    the archived rows, plus the count of rejected (unparseable) events, go
    to ``metrics_out`` the same way.  A batch without a ``_valid`` column is
    archived whole."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # the batch feeds the emptiness test, the write and the reject count
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            store(batch, batch_id)
        finally:
            batch.unpersist()

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        target = f"{out.rstrip('/')}/batch_id={batch_id}"
        has_flag = VALID in batch.columns
        good = batch.where(F.col(VALID)).drop(VALID) if has_flag else batch
        good.write.mode("overwrite").parquet(target)
        if metrics_out:
            # count from the written files instead of recomputing the batch
            written = batch.sparkSession.read.parquet(target)
            counts = count_by_type(written).select(F.lit("archived").alias("kind"), "event_type", "count")
            if has_flag:
                rejected = batch.where(~F.col(VALID)).agg(F.count(F.lit(1)).alias("count")).select(
                    F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("event_type"),
                    "count")
                counts = counts.unionByName(rejected)
            counts.write.mode("overwrite").parquet(f"{metrics_out.rstrip('/')}/batch_id={batch_id}")

    return run


def archive_stream(values: DataFrame, out: str, checkpoint: str,
                   metrics_out: str | None = None, trigger: dict | None = None):
    """Start the archive query over a stream with a ``value`` column (JSON of
    the 7-field event).  Rows whose keys fail to parse are not archived; they
    are counted as rejects."""
    parsed = parse_events(values)
    ok = (F.col("user_idx").isNotNull() & F.col("item_idx").isNotNull()
          & F.col("timestamp").isNotNull())
    flagged = parsed.withColumn(VALID, F.coalesce(ok, F.lit(False)))
    tx = events_to_transactions(flagged, keep=(VALID,))
    w = (tx.writeStream.foreachBatch(archive_batch(out, metrics_out))
         .option("checkpointLocation", checkpoint))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
