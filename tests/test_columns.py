import math
import random

import pytest
from pyspark.sql import functions as F

from driftrank.functions.columns import (cosine, event_weight, pad_id, parse_csv_list,
                                         unit)


def test_pad_id(spark):
    df = spark.createDataFrame([("108775015",), (None,), ("x1",), ("3000000000",)], "v string")
    out = [r[0] for r in df.select(pad_id("v")).collect()]
    assert out == ["0108775015", None, None, "3000000000"]


def test_event_weight_rating(spark):
    df = spark.createDataFrame([("purchase",), ("add_to_cart",), ("click",), (None,), ("view",)],
                               "t string")
    total = df.agg(F.log1p(F.sum(event_weight("t")))).first()[0]
    assert total == pytest.approx(math.log(3.6))
    only_view = spark.createDataFrame([("view",)], "t string")
    assert only_view.agg(F.log1p(F.sum(event_weight("t")))).first()[0] == 0.0


def test_parse_csv_list(spark):
    df = spark.createDataFrame([(" 3, 5,,7 ,x",), (None,), ("",)], "s string")
    rows = df.select(parse_csv_list("s").alias("a"), parse_csv_list("s", as_int=True).alias("b")).collect()
    assert rows[0].a == ["3", "5", "7", "x"] and rows[0].b == [3, 5, 7]
    assert rows[1].a == [] and rows[2].b == []


def _cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def test_cosine_equals_plain_python(spark):
    rng = random.Random(8)
    pairs = [([rng.uniform(-4, 4) for _ in range(5)], [rng.uniform(-4, 4) for _ in range(5)]) for _ in range(20)]
    pairs += [([0.0] * 5, pairs[0][0]), ([0.0] * 5, [0.0] * 5), (pairs[1][0], [-7.5 * x for x in pairs[1][0]])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    for r in df.select("i", cosine(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == pytest.approx(_cosine(*pairs[r.i]), abs=1e-9)


def test_unit_keeps_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "a array<float>")
    rows = [r[0] for r in df.select(unit(F.col("a"))).collect()]
    assert rows[0] == [0.0, 0.0]
    assert rows[1] == pytest.approx([0.6, 0.8])


def test_list_diversity_equals_all_pairs(spark):
    from driftrank.operators.recommend import list_diversity
    rng = random.Random(9)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(3)] for _ in range(30)] + [[0.0] * 3]
    lists = {u: rng.sample(range(31), u) for u in (1, 2, 3, 5, 12)}
    vec = spark.createDataFrame(list(enumerate(vectors)), "item_idx int, features array<float>")
    rows = spark.createDataFrame([(u, i) for u, items in lists.items() for i in items], "user_idx int, item_idx int")
    for r in list_diversity(rows, vec).collect():
        pairs = [1 - _cosine(vectors[i], vectors[j]) for n, i in enumerate(lists[r.user_idx]) for j in lists[r.user_idx][:n]]
        assert r.diversity == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.0, abs=1e-6)
        assert r.n_items == len(lists[r.user_idx])
