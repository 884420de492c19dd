"""S4 event stream source and S5 JSON parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftrank import schema as S


def event_source(spark: SparkSession, fmt: str = "kafka", schema: T.StructType | None = None,
                 path: str | None = None, **options) -> DataFrame:
    """A streaming DataFrame of events.

    ``fmt='kafka'`` reads a topic (``subscribe=...``) starting at the latest
    offset and tolerating data loss, like the original consumer; any file
    format (``parquet``, ``json``) reads a folder, which tests use.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", "failOnDataLoss": "false", **options}
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path) if path else reader.load()


def parse_events(df: DataFrame, value_col: str = "value",
                 schema: T.StructType = S.EVENT_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON bytes/text -> the fixed 7-field event struct, flattened.

    A corrupt message parses to all-null fields (PERMISSIVE); callers drop
    rows with null keys and count them as rejects.
    """
    parsed = F.from_json(F.col(value_col).cast("string"), schema)
    # inline(array(struct)) expands the fields through one Generate, so the
    # JSON is parsed once per row (a plain "_e.*" lets the optimizer copy
    # from_json into every field reference)
    return df.select(*keep, F.inline(F.array(parsed)))


def events_as_json(events: DataFrame, schema: T.StructType = S.EVENT_SCHEMA,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode event rows as the JSON ``value`` a producer would publish."""
    return events.select(*keep, F.to_json(F.struct(*[F.col(f.name) for f in schema.fields]))
                         .alias("value"))
