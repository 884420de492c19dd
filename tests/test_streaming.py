import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftrank import adapters
from driftrank.operators.interactions import known_events
from driftrank.operators.state import debounce, ema_vectors
from driftrank.sources.events import parse_events
from driftrank.streaming.archive import archive_batch
from driftrank.streaming.user_state import latest_vectors, user_state_stream

SF = "/root/testdata/sf0.001"


def test_corrupt_json_is_rejected(spark):
    from driftrank.operators.archive import valid_events
    df = spark.createDataFrame([('{bad',), ('{"user_idx": 1, "item_idx": 2, "timestamp": 5.0}',)], "value string")
    parsed = parse_events(df)
    assert parsed.count() == 2
    assert valid_events(parsed).count() == 1


def test_archive_replay_is_idempotent(spark):
    out = tempfile.mkdtemp(prefix="archive-")
    batch = spark.createDataFrame([(1, "click"), (2, "purchase")], "customer_id int, event_type string")
    run = archive_batch(out)
    run(batch, 0)
    run(batch, 0)           # replayed micro-batch
    run(batch.limit(0), 1)  # empty batches are skipped
    got = spark.read.parquet(out)
    assert got.count() == 2
    assert not os.path.exists(f"{out}/batch_id=1")


@pytest.mark.parametrize("n_batches", [1, 3, 7])
def test_stream_state_equals_batch_over_microbatches(spark, n_batches):
    """Events split into time-ordered files, one file per micro-batch: the
    stateful stream ends with the same vectors as the batch closed form."""
    raw = adapters.table(spark, SF, "events")
    src = tempfile.mkdtemp(prefix="events-src-")
    bounds = raw.select(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, hi = bounds.lo, bounds.hi
    cuts = [lo + (hi - lo) * i / n_batches for i in range(n_batches)] + [None]
    for i in range(n_batches):
        part = raw.where(F.col("ts") >= cuts[i])
        if cuts[i + 1] is not None:
            part = part.where(F.col("ts") < cuts[i + 1])
        part.coalesce(1).write.parquet(f"{src}/p{i}")
    index = spark.createDataFrame(
        adapters.item_factors(spark, SF).withColumnRenamed("id", "item_idx").toPandas())
    stream = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    log = user_state_stream(adapters.events_from_raw(stream), index)
    out, ckpt = tempfile.mkdtemp(prefix="state-out-"), tempfile.mkdtemp(prefix="state-ckpt-")
    q = (log.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(q.recentProgress) >= n_batches
    streamed = {r.user_idx: r.features for r in latest_vectors(spark.read.parquet(out)).collect()}
    ev = adapters.events(spark, SF)
    batch = {r.user_idx: r.features for r in
             ema_vectors(debounce(known_events(ev)), index).collect()}
    assert streamed.keys() == batch.keys()
    for u in batch:
        assert np.allclose(streamed[u], batch[u], atol=1e-6)


def test_archive_stream_counts_rejects(spark):
    from driftrank.streaming.archive import archive_stream
    src = tempfile.mkdtemp(prefix="json-src-")
    spark.createDataFrame([('{bad',), ('{"user_id": "7", "user_idx": 7, "item_id": "0000000003", '
                                       '"item_idx": 3, "event_type": "click", "timestamp": 86400.5, '
                                       '"quantity": 1}',)], "value string").write.text(f"{src}/in")
    values = spark.readStream.schema("value string").text(f"{src}/in")
    out, ckpt, met = (tempfile.mkdtemp(prefix=p) for p in ("arch-", "arch-ck-", "arch-m-"))
    q = archive_stream(values, out, ckpt, metrics_out=met, trigger={"availableNow": True})
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0].customer_id == "7" and str(rows[0].t_dat) == "1970-01-02"
    m = {(r.kind, r.event_type): r["count"] for r in spark.read.parquet(met).collect()}
    assert m == {("archived", "click"): 1, ("rejected", None): 1}


def test_stream_with_initial_vectors_equals_batch_with_prior(spark):
    ev = adapters.events(spark, SF)
    index = spark.createDataFrame(
        adapters.item_factors(spark, SF).withColumnRenamed("id", "item_idx").toPandas())
    prior = spark.createDataFrame([(u, [float((u + j) % 5) - 2.0 for j in range(64)]) for u in range(0, 15, 2)],
                                  "id int, features array<float>")
    log = user_state_stream(ev.select("user_idx", "item_idx", "event_type", "timestamp", "event_id"),
                            index, initial_vectors=prior)
    streamed = {r.user_idx: r.features for r in latest_vectors(log).collect()}
    batch = {r.user_idx: r.features for r in
             ema_vectors(debounce(known_events(ev)), index, user_vectors=prior).collect()}
    for u in streamed:
        assert np.allclose(streamed[u], batch[u], atol=1e-5)
    assert set(streamed) <= set(batch)


def _run_batches(spark, batches, index, **kw):
    """Each list of rows is one micro-batch; returns the changelog and the checkpoint."""
    src = tempfile.mkdtemp(prefix="late-src-")
    schema = "event_id long, user_idx int, item_idx int, event_type string, timestamp double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/p{i}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, ckpt = tempfile.mkdtemp(prefix="late-out-"), tempfile.mkdtemp(prefix="late-ckpt-")
    q = (user_state_stream(stream, index, **kw).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).collect(), ckpt


def test_out_of_order_arrival_over_three_batches_equals_the_batch_operator(spark):
    rng = np.random.default_rng(3)
    index = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(4)], "item_idx int, features array<float>")
    schema = "event_id long, user_idx int, item_idx int, event_type string, timestamp double"
    rows = [(i, int(rng.integers(3)), int(rng.integers(5)), "click" if i % 3 else "purchase", float(t))
            for i, t in enumerate(np.sort(rng.uniform(1000, 4000, size=90)).round(2))]
    last = [(999, 9, 0, "click", 1e6)]                      # moves the watermark past all others
    mixed = list(rows)
    rng.shuffle(mixed)
    batches = [[tuple(x) for x in part] for part in (mixed[:30], mixed[30:60], mixed[60:])]
    batches = [[(int(a), int(b), int(c), str(d), float(e)) for a, b, c, d, e in part] for part in batches]
    log, _ = _run_batches(spark, [*batches, last, [(1000, 9, 0, "click", 1e6 + 1)]], index, watermark="2 hours")
    got = {r["user_idx"]: r for r in sorted(log, key=lambda r: (r["timestamp"], r["event_id"]))}
    ev = spark.createDataFrame(rows, schema)
    want = {r["user_idx"]: r["features"] for r in ema_vectors(debounce(known_events(ev)), index).collect()}
    assert set(got) - {9} == set(want)
    assert all(np.allclose(got[u]["features"], want[u], atol=1e-6) for u in want)
    kept = {r["event_id"] for r in debounce(known_events(ev)).where("item_idx < 4").collect()}
    assert {r["event_id"] for r in log if r["user_idx"] != 9} == kept


def test_state_of_an_idle_user_disappears(spark):
    index = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "item_idx int, features array<float>")
    batches = [[(1, 7, 0, "purchase", 1000.0), (2, 8, 0, "purchase", 1000.0)], [(3, 8, 1, "click", 2000.0)],
               [(4, 8, 1, "click", 9000.0)], [(5, 8, 1, "click", 9500.0)], [(6, 8, 0, "click", 9900.0)]]
    log, ckpt = _run_batches(spark, batches, index, watermark="10 seconds", ttl=3000.0, forget_after=5000.0)
    state = (spark.read.format("statestore").option("path", ckpt).option("stateVarName", "user").load()
             .select("key.user_idx", "value.*").collect())
    by = {r["user_idx"]: r for r in state}
    assert set(by) == {8}                                    # user 7 is forgotten whole
    assert by[8]["history"] == [] and by[8]["v"] is not None  # the purchase set has expired, the vector stays
    assert all(t["ts"] >= 9000.0 for t in by[8]["anchors"])
    assert [r["action"] for r in log if r["user_idx"] == 7] == ["created"]
