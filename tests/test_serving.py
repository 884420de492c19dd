"""Request/response cases restated as set operations over small tables."""
import pytest

from driftrank.operators.knn import similar_items, similar_items_status
from driftrank.operators.profile import user_profiles
from driftrank.operators.purchases import intake_purchases, validate_purchases
from driftrank.operators.recommend import explain, recommend

IDX = "item_idx int, features array<float>, article_id string, prod_name string, " \
      "product_type_name string, product_group_name string, graphical_appearance_name string, " \
      "index_group_name string"


@pytest.fixture(scope="module")
def world(spark):
    items = []
    for i in range(1, 41):
        v = [float(i % 5 == j) + 0.01 * i for j in range(5)]
        items.append((i * 100, v, f"{i:010d}", f"Item {i}", "T-shirt" if i % 2 else "Trousers",
                      "Garment Upper body" if i % 3 else "Garment Lower body", "", ""))
    index = spark.createDataFrame(items, IDX)
    vectors = spark.createDataFrame([(1, [1.0, 0.2, 0.0, 0.0, 0.1]), (2, [0.0, 1.0, 0.0, 0.3, 0.0])],
                                    "user_idx int, features array<float>")
    history = spark.createDataFrame([(1, 100, 1700000000.0), (1, 200, 1700001000.0)],
                                    "user_idx int, item_idx int, last_purchase_at double")
    trending = spark.createDataFrame([(1, 1200, 100.0), (2, 1300, 90.0)],
                                     "rank int, item_idx int, score double")
    return index, vectors, history, trending


def _users(spark, ids, excl=None):
    rows = [(u, excl.get(u) if excl else None) for u in ids]
    return spark.createDataFrame(rows, "user_idx int, ex array<int>")


def test_personalised_and_fallback(spark, world):
    index, vectors, history, trending = world
    out = recommend(_users(spark, [1, 3]), vectors, index, history, trending, k=5,
                    diversity_lambda=1.0, exclude_col="ex").collect()
    u1 = [r for r in out if r.user_idx == 1]
    u3 = sorted((r.rank, r.item_idx, r.source, r.user_type) for r in out if r.user_idx == 3)
    assert len(u1) == 5 and {r.source for r in u1} == {"personalized"}
    assert u3 == [(1, 1200, "trending_now", "cold_start"), (2, 1300, "trending_now", "cold_start")]


def test_k_and_lambda_limits(spark, world):
    index, vectors, history, trending = world
    one = recommend(_users(spark, [1]), vectors, index, history, trending, k=1,
                    diversity_lambda=1.0).collect()
    assert len(one) == 1
    for bad in [dict(k=100), dict(k=0), dict(diversity_lambda=1.5), dict(diversity_lambda=-0.1)]:
        with pytest.raises(ValueError):
            recommend(_users(spark, [1]), vectors, index, history, trending, **bad)


def test_history_and_explicit_exclusions(spark, world):
    index, vectors, history, trending = world
    out = recommend(_users(spark, [1], {1: [300, 400]}), vectors, index, history, trending,
                    k=36, diversity_lambda=1.0, exclude_col="ex").collect()
    got = {r.item_idx for r in out}
    assert not got & {100, 200, 300, 400}
    assert len(got) == 36  # exclusions act before the cut: 40 - 4 remain


def test_filters_before_cut_and_mmr_permutation(spark, world):
    index, vectors, history, trending = world
    flt = recommend(_users(spark, [2]), vectors, index, history, trending, k=5,
                    diversity_lambda=1.0, product_type="T-shirt").collect()
    ids = {r.item_idx for r in flt}
    assert len(ids) == 5 and all((i // 100) % 2 == 1 for i in ids)
    mmr = recommend(_users(spark, [2]), vectors, index, history, trending, k=5,
                    diversity_lambda=0.5).collect()
    assert sorted(r.rank for r in mmr) == [1, 2, 3, 4, 5] and len({r.item_idx for r in mmr}) == 5


def test_explain_top_k_and_no_fallback_explanations(spark, world):
    index, vectors, history, trending = world
    recs = recommend(_users(spark, [1, 3]), vectors, index, history, trending, k=3,
                     diversity_lambda=1.0)
    ex = explain(recs, history, index, top_k=2).collect()
    assert ex and {r.user_idx for r in ex} == {1}
    per = {}
    for r in ex:
        per.setdefault(r.rec_item_idx, []).append(r)
    for rows in per.values():
        assert len(rows) <= 2
        total = sum(r.contribution_pct for r in rows)
        assert abs(total - 100.0) < 0.2 or all(r.similarity <= 0 for r in rows)
    assert {r.item_name for r in ex} <= {"Item 1", "Item 2"}


def test_profile_cases(spark, world):
    index, vectors, history, trending = world
    um = spark.createDataFrame([(1, "customer_abc123"), (2, "c2")], "user_idx int, customer_id string")
    prof = {r.user_idx: r for r in user_profiles(vectors, history, index, um, recent_limit=1).collect()}
    p1 = prof[1]
    assert (p1.total_purchases, p1.first_purchase_at, p1.last_purchase_at) == (2, 1700000000.0, 1700001000.0)
    assert [x.item_idx for x in p1.recent_purchases] == [200]
    assert prof[2].total_purchases == 0 and prof[2].recent_purchases == []
    assert 3 not in prof  # no vector: not found


def test_similar_items_status_and_self(spark, world):
    index, _, _, _ = world
    src = spark.createDataFrame([(100,), (999,)], "item_idx int")
    st = {r.source_item_idx: r.status for r in similar_items_status(src, index).collect()}
    assert st == {100: "success", 999: "not_found"}
    sim = similar_items(src, index, 3).collect()
    assert len(sim) == 3 and all(r.item_idx != 100 for r in sim)


def test_purchase_intake(spark, world):
    index, _, _, _ = world
    um = spark.createDataFrame([(1, "customer_abc123")], "user_idx int, customer_id string")
    req = spark.createDataFrame([(1, 100, 5.0), (7, 100, 6.0), (1, 12345, 7.0)],
                                "user_idx int, item_idx int, timestamp double")
    status = {(r.user_idx, r.item_idx): r.status for r in validate_purchases(req, um, index).collect()}
    assert status == {(1, 100): "accepted", (7, 100): "user_not_found", (1, 12345): "item_not_found"}
    acc, rej = intake_purchases(req, um, index)
    a = acc.collect()
    assert len(a) == 1 and a[0].user_id == "customer_abc123" and a[0].item_id == "0000000001"
    assert a[0].event_type == "purchase" and a[0].quantity == 1
    assert rej.count() == 2


def test_nested_response(spark, world):
    from driftrank.operators.recommend import nest_recommendations
    index, vectors, history, trending = world
    recs = recommend(_users(spark, [1, 3]), vectors, index, history, trending, k=3,
                     diversity_lambda=1.0)
    out = {r.user_idx: r for r in nest_recommendations(recs, index, explain(recs, history, index)).collect()}
    assert out[1].source == "personalized" and len(out[1].recommendations) == 3
    assert out[1].recommendations[0].metadata.prod_name.startswith("Item")
    assert out[1].recommendations[0].explanation is not None
    assert out[3].source == "trending_now" and out[3].recommendations[0].explanation is None


def test_fallback_respects_filters_and_newest_history(spark, world):
    index, vectors, history, trending = world
    trend = spark.createDataFrame([(1, 1200, 100.0), (2, 1300, 90.0), (3, 500, 80.0)],
                                  "rank int, item_idx int, score double")
    out = recommend(_users(spark, [3]), vectors, index, history, trend, k=5, diversity_lambda=1.0,
                    product_type="T-shirt", fallback_respects_filters=True).collect()
    # items 1200 and 1300 are odd/even: only T-shirts (odd i) survive, re-ranked densely
    assert [(r.rank, r.item_idx) for r in sorted(out, key=lambda r: r.rank)] == [(1, 1300), (2, 500)]
    recs = recommend(_users(spark, [1]), vectors, index, history, trend, k=2, diversity_lambda=1.0)
    newest = explain(recs, history, index, top_k=3, n_history=1, which="newest").collect()
    oldest = explain(recs, history, index, top_k=3, n_history=1, which="oldest").collect()
    assert {r.hist_item_idx for r in newest} == {200}
    assert {r.hist_item_idx for r in oldest} == {100}


def test_lookup_and_string_index(spark, world):
    from driftrank.operators.ids import apply_index, string_index
    from driftrank.operators.knn import lookup
    index, _, _, _ = world
    ids = spark.createDataFrame([(100,), (7,)], "item_idx int")
    got = {r.item_idx: r.prod_name for r in lookup(index, ids).collect()}
    assert got == {100: "Item 1", 7: None}
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("c",)], "v string")
    labels = string_index(df, "v", "idx")
    assert {r.v: r.idx for r in labels.collect()} == {"b": 0.0, "c": 1.0, "a": 2.0}
    new = spark.createDataFrame([("a",), ("zz",)], "v string")
    assert {r.v: r.idx for r in apply_index(new, labels, "v", "idx").collect()} == {"a": 2.0, "zz": 3.0}


def test_sliding_rate_and_approx_buyers(spark):
    from driftrank.operators.metrics import event_rate
    from driftrank.operators.trending import distinct_buyers
    ev = spark.createDataFrame([(0.0, "click"), (30.0, "click"), (70.0, "click")],
                               "timestamp double, event_type string")
    rows = {r.window_start: r["count"] for r in event_rate(ev, "1 minute", "30 seconds").collect()}
    assert rows == {-30: 1, 0: 2, 30: 2, 60: 1}
    tx = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u1", "a")], "customer_id string, article_id string")
    assert distinct_buyers(tx, approx_rsd=0.05).first().score == 2.0


def test_known_user_without_survivors_falls_back(spark, world):
    index, vectors, history, trending = world
    out = recommend(_users(spark, [1]), vectors, index, history, trending, k=3,
                    diversity_lambda=1.0, product_group="No such group").collect()
    assert {(r.source, r.user_type, r.reason) for r in out} == {("trending_now", "known", "no_results")}
    assert sorted(r.item_idx for r in out) == [1200, 1300]
