import random

from pyspark.sql import functions as F

from driftrank.llm.running import running


def test_running_totals_equal_a_loop_also_over_a_key_with_most_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, -5]), i, rng.randrange(-50, 50), rng.getrandbits(63)) for i in range(3000)]
    rng.shuffle(rows)
    got = running(spark.createDataFrame(rows, "k long, t long, v long, x long").repartition(5), ["k"], [F.col("t")], "test",
                  add=["v"], xor=["x"]).collect()
    total, mixed, want = {}, {}, {}
    for k, t, v, x in sorted(rows):
        total[k], mixed[k] = total.get(k, 0) + v, mixed.get(k, 0) ^ x
        want[t] = (total[k], mixed[k])
    assert len(got) == len(rows)
    assert all((r["v_run"], r["x_run"]) == want[r["t"]] for r in got)


def test_running_totals_without_key_and_of_no_rows(spark):
    rows = spark.range(1000).select("id", F.lit(1).cast("long").alias("one"))
    got = running(rows, [], [F.col("id")], "test", add=["one"])
    assert got.filter("one_run != id + 1").isEmpty() and got.count() == 1000
    assert running(rows.filter("id < 0"), ["id"], [F.col("id")], "test", add=["one"]).isEmpty()
