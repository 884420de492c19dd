import tempfile


from driftrank.plans.batch_job import run_batch, serve_recommendations
from driftrank.sources.tables import load_model, read_table

SF = "/root/testdata/sf0.001"


def test_run_batch_twice_keeps_ids(spark):
    out = tempfile.mkdtemp(prefix="driftrank-batch-")
    p = run_batch(spark, SF, out)
    um1 = {r.customer_id: r.user_idx for r in read_table(spark, p["mappings/user_map"]).collect()}
    assert sorted(um1.values()) == list(range(len(um1)))
    idx = read_table(spark, p["serve/item_index"])
    assert idx.count() > 0 and len(idx.first().features) == 32
    tr = read_table(spark, p["serve/trending"]).orderBy("rank").collect()
    assert [r["rank"] for r in tr] == list(range(1, len(tr) + 1))
    model = load_model(p["models/als"])
    assert model.rank == 32
    # serve from the published tables: known users personalised, others trending
    users = spark.createDataFrame([(0,), (1,), (10 ** 6,)], "user_idx int")
    recs = serve_recommendations(spark, p, users, k=5).collect()
    by_user = {}
    for r in recs:
        by_user.setdefault(r.user_idx, set()).add(r.source)
    assert by_user[10 ** 6] == {"trending_now"}
    assert by_user[0] == {"personalized"} and len([r for r in recs if r.user_idx == 0]) == 5
    # second run: nothing new, maps unchanged
    p2 = run_batch(spark, SF, out)
    um2 = {r.customer_id: r.user_idx for r in read_table(spark, p2["mappings/user_map"]).collect()}
    assert um1 == um2
