"""Committed versions, cascades over the relation, and one log for streams and batches."""

import threading

import pytest
from pyspark.sql import functions as F

from retainx.operators import history as H, lifecycle as LC, models as M, score as SC
from retainx.plans import scorecard as CARD, views as V
from retainx.session import shared_dir
from retainx.sources import sinks as SK
from retainx.sources.snapshots import ConflictError, SnapshotStore
from retainx.streaming.scoring import start_scoring_stream, stream_identity

from conftest import SF_SMALL

REGISTRY = "id long, user_id long, is_active boolean, uploaded_at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def store_with(spark, **tables):
    store = SnapshotStore(spark, shared_dir(spark, "store"))
    store.commit(tables)
    return store


def test_activation_is_committed_and_old_readers_keep_their_version(spark):
    ds = spark.createDataFrame([(1, 7, True, 1), (2, 7, False, 2), (3, 8, True, 3), (4, None, True, 4)], REGISTRY)
    store = store_with(spark, datasets=ds)
    first = store.snapshot()
    reader = store.table("datasets", first)
    second = LC.set_active(store, "datasets", spark.createDataFrame([(7, 2)], "user_id long, id long"))
    fresh = SnapshotStore(spark.newSession(), store.path)
    assert second.version == 2 == fresh.snapshot().version and fresh.versions() == [1, 2]
    assert rows(fresh.table("datasets").where("is_active").select("id")) == [(2,), (3,), (4,)]
    assert rows(reader) == rows(ds) == rows(store.table("datasets", store.snapshot(1)))
    for wrong in ([(7, 3)], [(7, 1), (7, 2)], [(9, 1)]):
        with pytest.raises(ValueError):
            LC.set_active(store, "datasets", spark.createDataFrame(wrong, "user_id long, id long"))
    LC.add_dataset(store, spark.createDataFrame([(5, 7, False, 9)], REGISTRY))
    assert rows(store.table("datasets").where("is_active").select("id")) == [(3,), (4,), (5,)]
    assert H.resolve_active(store.table("datasets").where("user_id = 7")).first()["id"] == 5


def test_two_writers_give_one_error(spark):
    log = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, user_id long")
    store = store_with(spark, predictions=log)
    base, outcome = store.snapshot(), []

    def write(user):
        try:
            outcome.append(LC.clear_history(SnapshotStore(spark, store.path), user, base).version)
        except ConflictError:
            outcome.append("conflict")

    threads = [threading.Thread(target=write, args=(u,)) for u in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, outcome)) == ["2", "conflict"] and store.table("predictions").count() == 20
    with pytest.raises(ConflictError):                                 # a late writer that still stands on version 1
        store.commit({"predictions": log}, base)
    folders = {t["folder"] for v in store.versions() for t in store.snapshot(v).tables.values()}
    fs, path = store._fs, store._path
    held = {f"predictions/{s.getPath().getName()}" for s in fs.listStatus(path(f"{store.path}/predictions"))}
    assert held == folders                                             # the loser's files are gone


def test_failed_commit_leaves_the_store_as_it_was(spark):
    store = store_with(spark, t=spark.range(3).toDF("id"))
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.commit({"t": spark.range(9).toDF("id"), "u": bad})
    assert store.versions() == [1] and store.table("t").count() == 3
    with pytest.raises(ValueError, match="never committed"):
        store.snapshot(5)
    with pytest.raises(ValueError, match="no table"):
        store.table("u")


def test_unchanged_tables_keep_their_files_and_types(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    store = store_with(spark, a=a, b=spark.createDataFrame([], "id long, when timestamp_ntz, m map<string,string>"))
    second = store.commit({"a": a.where("id = 2")})
    assert second.tables["b"] == store.snapshot(1).tables["b"] and second.tables["a"] != store.snapshot(1).tables["a"]
    assert store.table("b").dtypes == [("id", "bigint"), ("when", "timestamp_ntz"), ("m", "map<string,string>")]
    assert store.table("a").count() == 0 and store.table("a").dtypes == a.dtypes
    first = store.snapshot(1).tables["a"]["folder"]
    store.commit({"a": a})
    assert store.forget(before=3) == sorted([first, second.tables["a"]["folder"]])
    assert store.versions() == [3] and store.table("a").count() == 1 and store.table("b").count() == 0


def test_partitioned_tables_prune_and_keep_their_columns(spark):
    log = spark.createDataFrame([(i, i % 4 if i % 5 else None, f"c{i}") for i in range(40)], "id long, user_id long, v string")
    store = SnapshotStore(spark, shared_dir(spark, "store"))
    store.commit({"predictions": log}, partition_by={"predictions": ("user_id",)})
    LC.clear_history(store, 2)
    left = store.table("predictions")
    assert rows(left.select("id", "user_id", "v")) == rows(log.where("user_id <> 2 OR user_id IS NULL"))
    assert "PartitionFilters: [isnotnull(user_id" in left.where("user_id = 1")._jdf.queryExecution().executedPlan().toString()


def relation(spark):
    frame = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} long" for n in names.split()))
    return {"users": frame([(1,), (2,)], "id"),
            "datasets": frame([(10, 1), (11, 1), (20, 2), (30, None)], "id user_id"),
            "models": frame([(100, 10, 1), (110, 11, 1), (200, 20, 2), (300, None, 2), (None, 10, 1), (201, 20, 1)], "id dataset_id user_id"),
            "predictions": frame([(1, 100, 10, 1), (2, None, 10, 1), (3, 110, 11, 2), (4, 200, None, 2), (5, None, None, 2), (6, 300, 10, 2),
                                  (7, None, None, None), (8, 999, 998, 2), (9, 201, 20, 2)], "id model_id dataset_id user_id")}


@pytest.mark.parametrize("roots,left", [
    ({"users": [1]}, {"users": {2}, "datasets": {20, 30}, "models": {200, 300}, "predictions": {4, 5, 7, 8}}),
    ({"datasets": [10]}, {"datasets": {11, 20, 30}, "models": {110, 200, 300, 201}, "predictions": {3, 4, 5, 7, 8, 9}}),
    ({"models": [200, 300], "predictions": [7]}, {"models": {100, 110, 201, None}, "predictions": {1, 2, 3, 5, 8, 9}}),
    ({"users": [5]}, {"users": {1, 2}, "datasets": {10, 11, 20, 30}, "models": {100, 110, 200, 300, 201, None}, "predictions": set(range(1, 10))}),
])
def test_cascade_reaches_three_levels(spark, roots, left):
    ids = {n: spark.createDataFrame([(i,) for i in v] + [(None,)], "id long") for n, v in roots.items()}
    out = LC.cascade(relation(spark), ids)
    assert {n: {r["id"] for r in df.collect()} for n, df in out.items()} == left
    assert all(df.columns == relation(spark)[n].columns for n, df in out.items())


def test_deletes_are_one_commit_of_all_tables(spark):
    store = store_with(spark, **relation(spark))
    LC.delete_dataset(store, 1, 10)
    snap = store.snapshot()
    assert snap.version == 2 and snap.tables["users"] == store.snapshot(1).tables["users"]
    assert {n: df.count() for n, df in store.tables().items()} == {"users": 2, "datasets": 3, "models": 4, "predictions": 6}
    with pytest.raises(ValueError):
        LC.delete_dataset(store, 2, 11)                                # another user's
    with pytest.raises(ValueError):
        LC.cascade(relation(spark), {"nothing": spark.range(1)})
    with pytest.raises(ValueError, match="circle"):
        LC.parents_first((LC.Link("a", "b_id", "b"), LC.Link("b", "a_id", "a")))


# ---- the log ----------------------------------------------------------------------------------

def start(spark, src, schema, log, ckpt, user):
    scorer = lambda b: SC.score_batch(b, CARD.scorecard_probability(b))
    q = start_scoring_stream(spark, src, schema, scorer, log, ckpt, user_id=user, key_col="customerID", dataset_id=3)
    q.awaitTermination(300)
    return str(q.id)


def test_two_streams_and_a_batch_keep_all_rows(spark):
    customers = V.telco(spark, SF_SMALL).dropDuplicates()
    src, log = shared_dir(spark, "src"), shared_dir(spark, "log")
    customers.limit(60).write.parquet(src)
    assert SK.read_prediction_log(spark, log).count() == 0
    one, two = shared_dir(spark, "ckpt"), shared_dir(spark, "ckpt")
    name = start(spark, src, customers.schema, log, one, 7)
    assert stream_identity(spark, one) == name
    start(spark, src, customers.schema, log, two, 7)
    SK.append_prediction_log(V.predictions(spark, SF_SMALL).limit(25), log)
    got = SK.read_prediction_log(spark, log)
    assert got.count() == 60 + 60 + 25 and got.select("id").where("user_id = 7").distinct().count() >= 120
    assert got.schema == SK.LOG_SCHEMA
    scored = got.where("dataset_id = 3")
    assert scored.where("size(input_data) = 10 AND size(top_factors) BETWEEN 1 AND 5").count() == 120
    # a restarted stream goes on with its next epoch; what arrived since is added once
    customers.limit(10).write.mode("append").parquet(src)
    start(spark, src, customers.schema, log, one, 7)
    assert SK.read_prediction_log(spark, log).count() == 60 + 60 + 25 + 10


def test_replayed_epoch_adds_none_even_with_other_users(spark):
    log = shared_dir(spark, "log")
    records = V.predictions(spark, SF_SMALL).limit(40)
    SK.append_prediction_log(records, log, 0, "a")
    SK.append_prediction_log(records, log, 0, "b")
    SK.append_prediction_log(records.withColumn("user_id", F.col("user_id") + 100), log, 0, "a")
    got = SK.read_prediction_log(spark, log)
    assert got.count() == 80 and got.where("user_id >= 100").count() == 40


def test_older_models_are_neither_active_nor_best(spark):
    schema = "dataset_id long, id long, f1_score double, is_best boolean, is_active boolean, user_id long"
    old = spark.createDataFrame([(1, 1, 90.0, True, True, 5), (2, 2, 50.0, True, True, 5)], schema)
    new = spark.createDataFrame([(1, 3, 40.0, True, True, 5), (1, 4, 30.0, False, False, 5)], schema)
    out = {r["id"]: (r["is_best"], r["is_active"]) for r in M.add_to_registry(old, new).collect()}
    assert out == {1: (False, False), 2: (True, True), 3: (True, True), 4: (False, False)}


def test_rows_without_a_parent_are_spread(spark):
    users = spark.range(100).select("id")
    log = spark.range(8000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 100).alias("user_id"), F.create_map(F.lit("plan"), F.lit("x")).alias("input_data"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = LC.cascade({"users": users, "predictions": log}, {"users": users.where("id < 40")}, (LC.Link("predictions", "user_id", "users"),))["predictions"]
        tasks = left.where("user_id IS NULL").groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
        assert left.columns == log.columns and left.where("user_id IS NOT NULL").agg(F.min("user_id"), F.count("id")).first()[:] == (40, 1200)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks.sum() == 6000 and tasks.max() < 3000, tasks.tolist()
