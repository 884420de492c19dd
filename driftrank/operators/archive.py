"""P3 event -> transaction projection and A4 per-batch counts (the archive
stream's batch logic; the stream itself is ``streaming.archive``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank import schema as S


def events_to_transactions(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename ids, unix seconds -> date (session zone pinned to UTC),
    constant price and channel; user_idx, item_idx and quantity dropped
    (``keep`` carries extra columns through)."""
    return events.select(
        F.to_date(F.timestamp_seconds(F.col("timestamp"))).alias("t_dat"),
        F.col("user_id").alias("customer_id"),
        F.col("item_id").alias("article_id"),
        F.lit(S.ARCHIVE_PRICE).cast("double").alias("price"),
        F.lit(S.ARCHIVE_SALES_CHANNEL).cast("int").alias("sales_channel_id"),
        F.col("event_type"),
        *keep,
    )


def count_by_type(df: DataFrame) -> DataFrame:
    """A4: rows per event type."""
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


def valid_events(parsed: DataFrame) -> DataFrame:
    """Events with both keys present (a corrupt message parses to nulls)."""
    return parsed.where(F.col("user_idx").isNotNull() & F.col("item_idx").isNotNull()
                        & F.col("timestamp").isNotNull())
