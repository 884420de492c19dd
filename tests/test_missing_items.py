"""F5 as registered: every item with a vector counts as one that has it."""
import datetime as dt
import uuid

import driftrank.plans.catalog as catalog


def test_events_without_a_vector_are_all_those_and_no_others(spark, tmp_path):
    d = str(tmp_path / uuid.uuid4().hex)
    at = dt.datetime(2024, 1, 1)

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")

    put("customer", [(1,), (2,)], "c_custkey long")
    put("part", [(k, f"p{k}", "Brand#1", "ECONOMY", 5) for k in range(8)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    put("embeddings", [(k, [1.0, float(k)]) for k in range(8) if k != 5], "vec_id long, embedding array<float>")
    put("events", [(10 * u + k, at + dt.timedelta(hours=k), u, "click", '{"k": %d}' % k) for u in (1, 2) for k in range(8)],
        "event_id long, ts timestamp, user_id long, event_type string, props string")
    got = catalog.QUERIES["events_missing_item"](spark, d).collect()
    assert sorted(map(tuple, got)) == [(15, 5), (25, 5)]
