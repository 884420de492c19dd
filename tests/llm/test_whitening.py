import numpy as np
from pyspark.sql import functions as F

from driftrank.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k):
    """(n, deviations, z up to signs, explained) of integer vectors, in numpy."""
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(np.float64))
    u = np.unique(x, axis=0)
    n, mean = len(u), u.sum(axis=0) / len(u)
    values, comps = np.linalg.eigh((u - mean).T @ (u - mean) / n)
    values, comps = values[::-1], comps[:, ::-1]
    dev = ((n * x - u.sum(axis=0)) ** 2).sum(axis=1)
    return n, dev, (x - mean) @ comps[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_equals_numpy_over_several_blocks_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32).tolist()
    good += [good[0]] * 150                                   # a third of the rows is one vector
    rows = list(enumerate(good))
    bad = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [float("inf")] * 6),
           (904, [1.0, 2.0]), (905, []), (906, [1e30] * 6)]
    table = spark.createDataFrame(rows + bad, SCHEMA).withColumn("label", F.lit(1)).withColumn("uid", F.lit(2)).repartition(4)
    got = sorted(whiten(table, components=4, block_entries=60).collect(), key=lambda r: r["vec_id"])
    n, dev, z, explained = brute(good, 4)
    assert [r["vec_id"] for r in got] == list(range(len(good)))
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got] == dev.astype(int).tolist()
    mine = np.array([r["z"] for r in got])
    sign = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * sign - z).max() < 1e-10
    assert np.allclose(got[0]["explained"], explained, rtol=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_all_components_and_a_flat_dimension(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i == 3 else i, [float(a), float(b), 1.0]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 40 and all(len(r["z"]) == 2 for r in got)
    z = np.array([r["z"] for r in got])
    assert np.allclose(z.T @ z / 40, np.eye(2), atol=1e-9)


def test_nothing_to_scale(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).isEmpty()
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).isEmpty()
