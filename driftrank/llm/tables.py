"""Table readers and scratch tables of the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftrank.session import ensure_checkpoint_dir, hadoop_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor never recomputes what lies before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Frees the disk of finished steps.

    Deletes the scratch tables ``done``, which no later plan may read, and
    collects the driver's garbage: Spark removes shuffle files once their
    plans are gone, which on an idle driver can take half an hour.
    """
    for df in done:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, path = hadoop_path(spark, folder)
            fs.delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id, folds: int = 5):
    """True for ids whose crc32 (of the decimal text) is divisible by ``folds``; null id: False."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` lacks (case does not count)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on the driver; operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)
