import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftrank import schema as S
from driftrank.operators.ids import assign_ids, full_mapping, update_mapping
from driftrank.operators.profile import top_categories
from driftrank.operators.trending import recent, trending


def test_assign_ids_dense_sorted(spark):
    df = spark.createDataFrame([(str(i),) for i in range(500)] * 2, "id string").repartition(7)
    m = assign_ids(df, "id", "idx", num_partitions=5).collect()
    pairs = sorted((r.id, r.idx) for r in m)
    assert [p[1] for p in pairs] == list(range(500))


def test_incremental_mapping(spark):
    existing = spark.createDataFrame([("a", 0), ("b", 1)], "k string, idx int")
    current = spark.createDataFrame([("b",), ("c",), ("d",)], "k string")
    added = {r.k: r.idx for r in update_mapping(existing, current, "k", "idx").collect()}
    assert added == {"c": 2, "d": 3}
    full = {r.k: r.idx for r in full_mapping(existing, current, "k", "idx").collect()}
    assert full == {"a": 0, "b": 1, "c": 2, "d": 3}


def _tx(spark, rows):
    return spark.createDataFrame(rows, "t_dat date, customer_id string, article_id string")


def test_trending_window_and_ties(spark):
    d = dt.date(2020, 3, 31)
    rows = [(d, "u1", "0000000002"), (d, "u2", "0000000001"),
            (d - dt.timedelta(days=30), "u3", "0000000003"),
            (d - dt.timedelta(days=31), "u4", "0000000004")]
    tx = _tx(spark, rows)
    assert sorted(r.article_id for r in recent(tx).collect()) == ["0000000001", "0000000002", "0000000003"]
    top = trending(tx, k=2).orderBy("rank").collect()
    assert [(r.rank, r.article_id) for r in top] == [(1, "0000000001"), (2, "0000000002")]


def test_top_categories_percentages(spark):
    hist = spark.createDataFrame([(1, i, float(i)) for i in range(4)],
                                 "user_idx int, item_idx int, last_purchase_at double")
    index = spark.createDataFrame(
        [(0, "Upper"), (1, "Upper"), (2, "Upper"), (3, "Lower")],
        "item_idx int, product_group_name string")
    got = [(r.name, r["count"], r.percentage) for r in
           top_categories(hist, index, "product_group_name").orderBy("pos").collect()]
    assert got == [("Upper", 3, 75.0), ("Lower", 1, 25.0)]


def test_check_args():
    S.check_args()
    for bad in [dict(k=0), dict(k=51), dict(explain_top_k=11), dict(diversity_lambda=1.5),
                dict(diversity_lambda=-0.1), dict(recent_limit=0), dict(top_categories=11)]:
        with pytest.raises(ValueError):
            S.check_args(**bad)
    assert S.fetch_limit(5, 1.0) == 5
    assert S.fetch_limit(10, 0.8) == 20
    assert S.fetch_limit(50, 0.5) == 50


def test_trending_ranks_have_no_gaps_when_an_item_has_no_index(spark):
    from driftrank.operators.recommend import fallback
    from driftrank.operators.trending import enrich_trending
    top = spark.createDataFrame([(f"a{i}", 10.0 - i, i + 1) for i in range(4)], "article_id string, score double, rank int")
    item_map = spark.createDataFrame([("a0", 7), ("a2", 8), ("a3", 9)], "article_id string, item_idx int")
    articles = spark.createDataFrame([], "article_id string, prod_name string, product_type_name string, "
                                         "product_group_name string, graphical_appearance_name string")
    out = enrich_trending(top, item_map, articles)
    assert [(r["rank"], r["item_idx"]) for r in out.collect()] == [(1, 7), (2, 8), (3, 9)]
    users = spark.createDataFrame([(1,)], "user_idx int")
    assert [r["item_idx"] for r in fallback(users, out, 2).orderBy("rank").collect()] == [7, 8]


def test_day_sets_give_the_trending_list_and_sketches_come_close(spark):
    import random
    from driftrank.operators.trending import daily_buyers, daily_sketches, distinct_buyers, trending_from_days
    rng = random.Random(8)
    rows = [(f"2024-01-{rng.randrange(1, 29):02d}", f"c{rng.randrange(40_000)}", f"{min(int(rng.expovariate(0.3)), 30):010d}")
            for _ in range(20_000)]
    tx = (spark.createDataFrame(rows, "d string, customer_id string, article_id string")
          .withColumn("t_dat", F.col("d").cast("date")).drop("d"))
    users = spark.createDataFrame([(f"c{i}", i) for i in range(40_000)], "customer_id string, user_idx int")
    want = [tuple(r) for r in trending(tx, days=10, k=8).select("rank", "article_id", "score").collect()]
    days = daily_buyers(tx.where("t_dat < '2024-01-20'"), users).unionByName(
        daily_buyers(tx.where("t_dat >= '2024-01-20'"), users)).unionByName(daily_buyers(tx.where("t_dat = '2024-01-20'"), users))
    assert [tuple(r) for r in trending_from_days(days, 10, 8).select("rank", "article_id", "score").collect()] == want
    assert days.groupBy("t_dat", "article_id").count().agg(F.max("count")).first()[0] > 1   # ids beyond one bitmap
    exact = {r[0]: r[1] for r in distinct_buyers(recent(tx, 10)).collect()}
    close = {r["article_id"]: r["score"] for r in trending_from_days(daily_sketches(tx), 10, 50).collect()}
    worst = max(abs(close[a] - n) / n for a, n in exact.items())
    print("largest error of the sketches", worst)
    assert set(close) == set(exact) and worst < 4 * 1.04 / 2 ** 6      # four standard errors of 2^12 registers


def test_day_set_of_one_buyer_is_small(spark, tmp_path):
    from driftrank.operators.trending import daily_buyers
    tx = spark.range(2000).selectExpr("date '2024-01-01' AS t_dat", "concat('c', id) AS customer_id", "concat('a', id) AS article_id")
    users = spark.range(2000).selectExpr("concat('c', id) AS customer_id", "cast(id * 50 AS int) AS user_idx")
    days = daily_buyers(tx, users)
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" not in plan
    rows = days.collect()
    assert len(rows) == 2000 and all(len(r["buyers"]) == 1 for r in rows)
    assert sorted((r["bucket"] - 1) * 32768 + r["buyers"][0] for r in rows) == [50 * i for i in range(2000)]
