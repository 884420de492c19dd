"""Session helpers: one place for the settings the operators rely on.

On a cluster the session already exists; ``configure`` only fills in what
is unset so that a cluster's own choices (shuffle width, checkpoint dir)
win.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# What the operators rely on, for keys that the session leaves at Spark's
# default.  The time zone is pinned because unix seconds -> date conversions
# depend on it.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # packed vector blocks are large rows: bound Arrow batches by bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    # a task sorts and hashes what one partition holds, many times its size
    # when compressed: bound that, so that tasks become more and not larger
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Set each of ``DEFAULT_CONF`` that nobody has set, and ship the package."""
    given = spark.conf.getAll
    for key, value in DEFAULT_CONF.items():
        if key not in given:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Name the state store that the stateful stream needs, unless the cluster names one itself."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ROCKSDB)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) for a name that only Spark's own readers may be able to open."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors' Python workers.

    The Arrow operators (mapInPandas, applyInPandas, the stateful stream)
    call functions of this package inside tasks, so the workers must import
    it.  The package is zipped once per application into the shared
    checkpoint folder and added with ``addPyFile``, which ships it to every
    executor, like ``--py-files``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    # functions and classes of this package travel by value inside the
    # pickled closures, so workers that never saw the zip (e.g. the
    # stateful-stream runner) need no import of it
    import driftrank
    from pyspark import cloudpickle
    try:
        cloudpickle.register_pickle_by_value(driftrank)
    except ValueError:
        pass
    import io
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    target = f"{scratch_path(spark, 'pyfiles')}/driftrank.zip"
    fs, path = hadoop_path(spark, target)
    out = fs.create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "driftrank") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    configure(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Set our own only where a local session has none (tests); on any other
    master a missing folder is an error, since a folder of this machine
    would not be seen by the executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        current = tempfile.mkdtemp(prefix="driftrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local
    on a cluster, since the checkpoint dir is the cluster's shared one)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    fs, folder = hadoop_path(spark, path)
    fs.mkdirs(folder)
    return path
