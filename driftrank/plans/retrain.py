"""The retraining loop: what the stream has archived joins the history, new
ids join the maps, and the ratings are built anew.

Every step may be repeated: the archive and the maps are versioned tables,
so a step that has been done for a version does nothing the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftrank.operators.ids import update_mapping
from driftrank.operators.interactions import interactions, merge_events
from driftrank.sources.versions import append_version, read_versions, versions

ARCHIVE, USERS, ITEMS = "archive", "user_map", "item_map"


def archive_events(events: DataFrame, base: str, version: str) -> bool:
    """K2: archived transactions of one batch, appended once."""
    return append_version(events, f"{base}/{ARCHIVE}", version)


def extend_map(current: DataFrame, base: str, name: str, version: str, id_col: str, idx_col: str) -> DataFrame:
    """The map below ``base`` with ids for every id of ``current``; old ids keep theirs.

    Reads only the versions before this one, so a repeated call gives the same ids.
    """
    spark, path = current.sparkSession, f"{base}/{name}"
    if version not in versions(spark, path):
        before = [v for v in versions(spark, path) if v < version]
        existing = read_versions(spark, path, max(before)) if before else None
        append_version(update_mapping(existing, current, id_col, idx_col), path, version)
    return read_versions(spark, path, version).select(id_col, F.col(idx_col).cast("int").alias(idx_col))


def retrain(history: DataFrame, base: str, version: str) -> DataFrame:
    """Ratings of ``history`` and, if there is one, the archive up to ``version``, over the extended maps."""
    spark = history.sparkSession
    archived = read_versions(spark, f"{base}/{ARCHIVE}", version)
    merged = merge_events(history, None if archived is None else archived.drop("version"))
    users = extend_map(merged, base, USERS, version, "customer_id", "user_idx")
    items = extend_map(merged, base, ITEMS, version, "article_id", "item_idx")
    return interactions(merged, users, items)
