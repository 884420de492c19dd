"""K2/S3: tables that grow by versions, each appended exactly once.

A version's rows are written to a folder of the attempt's own below
``data/``; the version counts from the moment its manifest, a small file
named after it, has been created below ``versions/``.  Creating that file
fails if it is there already, so of several attempts (a retried job, two
writers) the first to finish wins and the others change nothing.  Readers
follow the manifests and never see rows of an attempt that did not finish.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from driftrank.session import hadoop_path


def _safe(version: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", version):
        raise ValueError(f"not a version name: {version!r}")
    return version


def versions(spark: SparkSession, path: str) -> dict[str, dict]:
    """The committed versions of the table at ``path``, by name; empty if there is no table."""
    fs, folder = hadoop_path(spark, f"{path.rstrip('/')}/versions")
    if not fs.exists(folder):
        return {}
    out = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json"):
            text = "".join(r[0] for r in spark.read.text(status.getPath().toString()).collect())
            if text:                            # one that is being written has no text yet
                out[name.removesuffix(".json")] = json.loads(text)
    return out


def append_version(df: DataFrame, path: str, version: str) -> bool:
    """Appends ``df`` as ``version``; True if this call did it, False if the version was there.

    The rows of a failed or beaten attempt are deleted.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    if _safe(version) in versions(spark, base):
        return False
    attempt = f"{version}-{uuid.uuid4().hex[:12]}"
    target = f"{base}/data/{attempt}"
    df.write.parquet(target)
    fs, manifest = hadoop_path(spark, f"{base}/versions/{version}.json")
    body = json.dumps({"folder": attempt, "schema": df.schema.json()}).encode()
    try:
        out = fs.create(manifest, False)
    except Py4JJavaError:
        if not fs.exists(manifest):
            raise
        _, mine = hadoop_path(spark, target)
        fs.delete(mine, True)
        return False
    out.write(bytearray(body))
    out.close()
    return True


def read_versions(spark: SparkSession, path: str, upto: str | None = None) -> DataFrame | None:
    """S3: all rows of the table's versions (by name up to ``upto``) with ``version``; None without any.

    Versions may differ in columns: missing ones are null.
    """
    found = {v: m for v, m in sorted(versions(spark, path).items()) if upto is None or v <= upto}
    out = None
    for version, m in found.items():
        part = (spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{path.rstrip('/')}/data/{m['folder']}")
                .withColumn("version", F.lit(version)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
