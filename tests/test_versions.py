import pytest
from pyspark.sql import functions as F

from driftrank.plans.retrain import archive_events, extend_map, retrain
from driftrank.session import hadoop_path
from driftrank.sources.versions import append_version, read_versions, versions


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"x{i}") for i in ids], "id long, text string")


def test_append_once_however_often_it_is_tried(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_versions(spark, path) is None and versions(spark, path) == {}
    assert append_version(rows(spark, 1, 2), path, "b1")
    assert not append_version(rows(spark, 1, 2), path, "b1")
    assert append_version(rows(spark, 3).withColumn("more", F.lit(7)), path, "b2")
    got = sorted(map(tuple, read_versions(spark, path).select("id", "text", "version", "more").collect()))
    assert got == [(1, "x1", "b1", None), (2, "x2", "b1", None), (3, "x3", "b2", 7)]
    assert read_versions(spark, path, "b1").count() == 2
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    with pytest.raises(ValueError):
        append_version(rows(spark, 1), path, "../b")


def test_an_attempt_without_manifest_is_not_read_and_a_beaten_one_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows(spark, 9).write.parquet(path + "/data/b1-killed")        # a job that died before its manifest
    assert read_versions(spark, path) is None
    assert append_version(rows(spark, 1), path, "b1")
    # a second writer that looked before the first one had finished
    import driftrank.sources.versions as v
    monkeypatch.setattr(v, "versions", lambda *a: {})
    assert not append_version(rows(spark, 2), path, "b1")
    monkeypatch.undo()
    assert [r["id"] for r in read_versions(spark, path).collect()] == [1]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2    # the killed one and the winner
    fs, empty = hadoop_path(spark, path + "/versions/b2.json")
    fs.create(empty, False).close()                               # just created, nothing written yet
    assert set(versions(spark, path)) == {"b1"}


def test_maps_keep_old_ids_and_repeated_rounds_change_nothing(spark, tmp_path):
    base = str(tmp_path)
    table = lambda *c: spark.createDataFrame([(x,) for x in c], "customer_id string")
    one = {r[0]: r[1] for r in extend_map(table("b", "a"), base, "m", "1", "customer_id", "user_idx").collect()}
    two = {r[0]: r[1] for r in extend_map(table("0", "b", "z", None), base, "m", "2", "customer_id", "user_idx").collect()}
    again = {r[0]: r[1] for r in extend_map(table("other"), base, "m", "2", "customer_id", "user_idx").collect()}
    assert one == {"a": 0, "b": 1} and two == again == {"a": 0, "b": 1, "0": 2, "z": 3}


def test_ratings_with_and_without_an_archive(spark, tmp_path):
    base = str(tmp_path)
    schema = "customer_id string, article_id string, event_type string"
    history = spark.createDataFrame([("u", "i", None)], schema)
    assert [tuple(r) for r in retrain(history, base, "1").select("user_idx", "item_idx").collect()] == [(0, 0)]
    batch = spark.createDataFrame([("u", "i", "click"), ("v", "j", "purchase")], schema)
    assert archive_events(batch, base, "1-0") and not archive_events(batch, base, "1-0")
    got = {(r[0], r[1]): round(r[2], 5) for r in retrain(history, base, "2").collect()}
    assert got == {(0, 0): round(0.7419373, 5), (1, 1): round(0.6931472, 5)}
    assert {(r[0], r[1]): round(r[2], 5) for r in retrain(history, base, "2").collect()} == got
