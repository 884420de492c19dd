"""Embedding whitening (11) with Spark MLlib's BlockMatrix.

Entries are counted in steps of 1/256 (``x = floor(256 c)``), so sums and
deviations are exact integers.  The fit list holds each distinct vector x
once, so copies do not pull the covariance.

- **Fit.** The centred rows of the fit list are cut into blocks of
  ``block_entries`` entries (a matrix of one block column).  A transposed
  times A gives the scatter matrix; the product is split along the rows into
  as many partial products as keep a task's blocks bounded.  The scatter (d by
  d) goes to the driver, where ``eigh`` gives the components.
- **Projection.** All rows, copies included, are centred and cut into blocks
  that lie in a grid of about as many block rows as block columns; the
  whitening matrix stands on the diagonal of a second BlockMatrix, so the
  product projects each block once and spreads over the whole grid.
- **Check.** The fit list is projected the same way; its covariance comes
  from a BlockMatrix product as well and gives ``identity_error``.

Only d by d matrices and one number per block reach the driver.

Cases: null vectors, vectors with null or non-finite entries, and entries
beyond what a long can count in steps of 1/256 are dropped; vectors of
another length than most (of equal counts the longer one) cannot be compared
and are dropped, empty ones too; repeated rows are projected each for itself
and count once in the fit; equal eigenvalues keep the order ``eigh`` gives,
and each component's largest entry is positive; a component without variance
(an eigenvalue under d * 2^-52 of the largest) cannot be scaled and has no
rows, so one distinct vector alone gives none; a deviation beyond a long is
null; an empty table gives no rows; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tables import written

STEPS = 256
BLOCK_ENTRIES = 1 << 18
BLOCKS_PER_TASK = 8


@dataclass
class Whitening:
    """Bounded by the dimension: mean as exact sums, components and their eigenvalues, falling."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        """Columns project a centred row on a component, over its deviation."""
        return self.components / np.sqrt(self.eigenvalues)


def counted(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(uid, vec_id, x): the usable rows with integer vectors of one length, written."""
    v = F.col("v")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(2.0 ** 54)))
    some = (rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .filter(v.isNotNull() & (F.size(v) > 0)).filter(usable))
    some = written(some.select(F.monotonically_increasing_id().alias("uid"), "vec_id",
                               F.transform(v, lambda c: F.floor(c * STEPS)).alias("x")), "counted")
    most = some.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return some.filter(F.size("x") == F.lit(most or 0))


def _sums(batches):
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0)
            x = x.flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))],
                                             ["n", "s"])


def centred_blocks(rows: DataFrame, n: int, sums: list[int], block_rows: int) -> DataFrame:
    """(block, uids, values): centred rows of ``rows`` (uid, x) in blocks, short ones filled with zero rows; written.

    ``block`` counts from 0 without gaps; ``values`` are doubles, column by column.
    """
    total = np.array(sums, dtype=np.int64)

    def cut(batches):
        held, have = [], 0

        def block(uid, x):
            out = np.zeros((block_rows, x.shape[1]))
            out[:len(x)] = (n * x - total) / n
            return pa.RecordBatch.from_arrays([pa.array([uid], pa.list_(pa.int64())), pa.array([out.tobytes("F")], pa.binary())],
                                              ["uids", "values"])
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)))
            have += batch.num_rows
            while have >= block_rows:
                uid, x = (np.concatenate(c) for c in zip(*held))
                yield block(uid[:block_rows], x[:block_rows])
                held, have = [(uid[block_rows:], x[block_rows:])], have - block_rows
        if have:
            yield block(*(np.concatenate(c) for c in zip(*held)))

    return _numbered(rows.select("uid", "x").mapInArrow(cut, "uids array<long>, values binary"), "blocks")


_BLOCK = T.StructType([
    T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])),
    T.StructField("matrix", MatrixUDT())])


def _block(row: int, column: int, n_rows: int, n_cols: int, values: pa.Array) -> pa.RecordBatch:
    """One row of ``_BLOCK``: a dense matrix, ``values`` (a list of doubles) column by column."""
    none = pa.nulls(1, pa.list_(pa.int32()))
    matrix = pa.StructArray.from_arrays(
        [pa.array([1], pa.int8()), pa.array([n_rows], pa.int32()), pa.array([n_cols], pa.int32()), none, none, values,
         pa.array([False])], ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
    at = pa.StructArray.from_arrays([pa.array([row]), pa.array([column])], ["row", "column"])
    return pa.RecordBatch.from_arrays([at, matrix], ["at", "matrix"])


def _matrix(blocks: DataFrame, n_rows: int, n_cols: int) -> BlockMatrix:
    """Rows of ``_BLOCK`` as a BlockMatrix.

    MLlib's own constructor goes the same way from a table, but takes an RDD
    of Python matrices first, which turns every entry into a Python float.
    """
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, n_rows, n_cols, 0, 0), n_rows, n_cols)


def block_matrix(blocks: DataFrame, place, n_rows: int, n_cols: int) -> BlockMatrix:
    """The blocks as a BlockMatrix; ``place`` says at which (block row, block column) a block lies."""
    def rows(batches):
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _block(*place(block), n_rows, n_cols,
                             pa.array([np.frombuffer(values.as_buffer(), dtype=np.float64)], pa.list_(pa.float64())))

    return _matrix(blocks.select("block", "values").mapInArrow(rows, _BLOCK), n_rows, n_cols)


def gram(a: BlockMatrix, splits: int) -> np.ndarray:
    """A transposed times A, the middle dimension dealt over ``splits`` tasks.

    The number of splits is an argument of Spark's BlockMatrix that its
    Python class leaves out, hence the call of the Java matrix.
    """
    left, right = a.transpose()._java_matrix_wrapper._java_model, a._java_matrix_wrapper._java_model
    made = BlockMatrix(left.multiply(right, splits), a.colsPerBlock, a.colsPerBlock)
    return made.toLocalMatrix().toArray()


def _tall(block: int) -> tuple[int, int]:
    return block, 0


def project(spark: SparkSession, blocks: DataFrame, matrix: np.ndarray, block_rows: int) -> DataFrame:
    """(uid, z): the centred rows times ``matrix``, by a BlockMatrix product over a grid of blocks."""
    d, k = matrix.shape
    n_blocks = blocks.count()
    side = max(1, int(np.ceil(np.sqrt(n_blocks))))
    a = block_matrix(blocks, lambda b: (b // side, b % side), block_rows, d)
    entries = matrix.ravel(order="F")

    def diagonal(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield _block(i, i, d, k, pa.array([entries], pa.list_(pa.float64())))

    # the product gets as many tasks as the larger operand has partitions
    tasks = max(side, -(-n_blocks // BLOCKS_PER_TASK))
    made = a.multiply(_matrix(spark.range(0, side, 1, tasks).mapInArrow(diagonal, _BLOCK), d, k))

    def rows(batches):
        for batch in batches:
            at, m = batch.column(0), batch.column(1)
            for i, j, n, flat, turned in zip(at.field(0).to_pylist(), at.field(1).to_pylist(), m.field("numRows").to_pylist(),
                                             m.field("values"), m.field("isTransposed").to_pylist()):
                z = flat.values.to_numpy().reshape((n, k) if turned else (k, n))
                z = np.ascontiguousarray(z if turned else z.T)
                yield pa.RecordBatch.from_arrays([pa.array([i * side + j], pa.int64()), pa.array([z.tobytes()], pa.binary())],
                                                 ["block", "z"])

    done = callMLlibFunc("getMatrixBlocks", made._java_matrix_wrapper._java_model).mapInArrow(rows, "block long, z binary")

    def unpack(batches):
        for batch in batches:
            for uids, z in zip(batch.column(0), batch.column(1)):
                uid = uids.values.to_numpy()
                z = np.frombuffer(z.as_buffer(), dtype=np.float64).reshape(-1, k)[:len(uid)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), k).cast(pa.list_(pa.float64()))],
                    ["uid", "z"])

    return (blocks.select("block", "uids").join(done, "block").select("uids", "z")
            .mapInArrow(unpack, "uid long, z array<double>"))


def fit(distinct: DataFrame, block_entries: int = BLOCK_ENTRIES) -> tuple[Whitening | None, DataFrame | None]:
    """The whitening of the fit list (uid, x), and its centred blocks; None without any row."""
    partial = distinct.select("x").mapInArrow(_sums, "n long, s array<long>")
    got = partial.select("n", F.posexplode("s").alias("pos", "s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = got.orderBy("pos").collect()
    if not got:
        return None, None
    n, sums = got[0]["n"], [r["s"] for r in got]
    d = len(sums)
    block_rows = max(1, block_entries // d)
    blocks = centred_blocks(distinct, n, sums, block_rows)
    splits = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    values, vectors = np.linalg.eigh(gram(block_matrix(blocks, _tall, block_rows, d), splits) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    use = values > max(values[0], 0.0) * d * 2.0 ** -52
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors[:, use], values[use], float(values.sum())), blocks


def whiten(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int | None = None,
           block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(vec_id, n, deviation, z, explained, identity_error) per usable row; arrays over the components.

    ``deviation`` is the sum over dimensions of (n x - S)^2, ``z`` the row
    whitened, ``explained`` the components' shares of the variance.
    """
    spark = rows.sparkSession
    every = counted(rows, vec_id, vector)
    distinct = written(every.select("x").distinct().withColumn("uid", F.monotonically_increasing_id()).select("uid", "x"), "fit")
    made, blocks = fit(distinct, block_entries)
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation long, z array<double>, explained array<double>, identity_error double"
    if made is None or not len(made.eigenvalues):
        return spark.createDataFrame([], schema)
    k = min(components or len(made.eigenvalues), len(made.eigenvalues))
    matrix = np.ascontiguousarray(made.matrix[:, :k])
    d, block_rows = len(made.sums), max(1, block_entries // len(made.sums))

    # the fit list's own rows, projected: how far their covariance is from the identity
    own = written(project(spark, blocks, matrix, block_rows), "projected")
    error = _identity_error(own, made.n, k, block_entries)

    whole = centred_blocks(every, made.n, made.sums, block_rows)
    z = project(spark, whole, matrix, block_rows)
    part = F.zip_with("x", F.lit(made.sums), lambda x, s: (x * made.n).cast("decimal(38,0)") - s)
    wide = F.aggregate(part, F.lit(0).cast("decimal(38,0)"), lambda acc, v: (acc + v * v).cast("decimal(38,0)"))
    out = every.select("uid", "vec_id", wide.try_cast("long").alias("deviation")).join(z, "uid")
    return out.select("vec_id", F.lit(made.n).cast("long").alias("n"), "deviation", "z",
                      F.lit([float(x) for x in made.eigenvalues[:k] / made.trace]).alias("explained"),
                      F.lit(float(error)).alias("identity_error"))


def _identity_error(projected: DataFrame, n: int, k: int, block_entries: int) -> float:
    """Largest absolute entry of the covariance of (uid, z), centred, less the identity."""
    mean = np.array([r["m"] for r in projected.select(F.posexplode("z").alias("pos", "v")).groupBy("pos")
                     .agg((F.sum("v") / n).alias("m")).orderBy("pos").collect()])
    block_rows = max(1, block_entries // k)

    def cut(batches):
        for batch in batches:
            z = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1) - mean
            for at in range(0, len(z), block_rows):
                out = np.zeros((block_rows, k))
                out[:len(z) - at] = z[at:at + block_rows]
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes("F")], pa.binary())], ["values"])

    numbered = _numbered(projected.select("z").mapInArrow(cut, "values binary"), "whitened")
    splits = max(1, -(-numbered.count() // BLOCKS_PER_TASK))
    cov = gram(block_matrix(numbered, _tall, block_rows, k), splits) / n
    return float(np.abs(cov - np.eye(k)).max())


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks`` written, with ``block``, a number from 0 without gaps."""
    local = written(blocks.withColumn("uid", F.monotonically_increasing_id()), name)
    part = F.shiftright("uid", 33)
    at, first = 0, []
    for r in local.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row per partition
        first.append((r["part"], at))
        at += r["n"]
    start = local.sparkSession.createDataFrame(first, "part long, start long")
    return local.withColumn("part", part).join(F.broadcast(start), "part").withColumn(
        "block", F.col("start") + F.col("uid").bitwiseAND((1 << 33) - 1)).drop("part", "start", "uid")
