"""Empty inputs must give empty (or zero) results, not errors."""
from driftrank.operators.knn import knn, knn_lsh, similar_items
from driftrank.operators.mmr import mmr_rerank
from driftrank.operators.recommend import list_diversity, recommend
from driftrank.operators.state import debounce, ema_vectors, user_history
from driftrank.operators.trending import trending

EV = "event_id long, user_idx int, item_idx int, event_type string, timestamp double"


def test_empty_state_ops(spark):
    ev = spark.createDataFrame([], EV)
    iv = spark.createDataFrame([], "item_idx int, features array<float>")
    assert debounce(ev).count() == 0
    assert ema_vectors(ev, iv).count() == 0
    assert user_history(ev, as_of=0.0).count() == 0


def test_empty_search_ops(spark):
    iv = spark.createDataFrame([], "item_idx int, features array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "user_idx int, features array<float>")
    assert knn(q, iv, 5).count() == 0
    assert knn_lsh(q, iv, 5).count() == 0
    assert similar_items(iv.select("item_idx"), iv, 5).count() == 0
    cands = spark.createDataFrame([], "user_idx int, rank int, item_idx int, score double")
    assert mmr_rerank(cands, iv, 0.5, 5).count() == 0
    assert list_diversity(cands, iv).count() == 0


def test_empty_recommend_and_trending(spark):
    iv = spark.createDataFrame([], "item_idx int, features array<float>, product_group_name string, "
                                   "product_type_name string")
    uv = spark.createDataFrame([], "user_idx int, features array<float>")
    hist = spark.createDataFrame([], "user_idx int, item_idx int, last_purchase_at double")
    trend = spark.createDataFrame([], "rank int, item_idx int, score double")
    users = spark.createDataFrame([(1,)], "user_idx int")
    assert recommend(users, uv, iv, hist, trend, k=3, diversity_lambda=0.8).count() == 0
    tx = spark.createDataFrame([], "t_dat date, customer_id string, article_id string")
    assert trending(tx).count() == 0
