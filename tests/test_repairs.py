"""Exact splits on few feature rows, crash inputs, null users, loads, stored packages, refusals."""

import json
import os

import pytest
from pyspark.sql import functions as F

from retainx.operators import features as FE, history as H, models as M, stats as D
from retainx.params import Params
from retainx.plans import registry as R, views as V
from retainx.session import shared_dir
from retainx.sources import sinks as SK
from retainx.sources.csv import read_customer_csv

from conftest import SF_SMALL


def test_split_is_exact_when_feature_rows_repeat(spark):
    rows = [(i, "A" if i % 2 else "B", "Yes" if i % 10 < 3 else "No") for i in range(10_000)]
    df = spark.createDataFrame(rows, "customer_id long, plan string, Churn string")
    prep = FE.prepare(df, "Churn", ["customer_id"], row_key=True)
    lab = FE.map_target(prep, "Churn", "Yes")
    got = {(r["label"], r["is_test"]): r["count"] for r in
           FE.train_test_split(lab, key_cols=[FE.ROW_KEY]).groupBy("label", "is_test").count().collect()}
    assert got == {(0, True): 1400, (0, False): 5600, (1, True): 600, (1, False): 2400}


def test_split_is_exact_without_any_key(spark):
    df = spark.createDataFrame([("A" if i % 2 else "B", int(i % 10 < 3)) for i in range(1000)], "plan string, label int")
    got = {(r["label"], r["is_test"]): r["count"] for r in FE.train_test_split(df).groupBy("label", "is_test").count().collect()}
    assert got == {(0, True): 140, (0, False): 560, (1, True): 60, (1, False): 240}


def test_correlation_of_many_and_constant_columns(spark):
    df = spark.createDataFrame([(float(i), *[float((i * k) % 11) for k in range(1, 11)], 3.0) for i in range(50)],
                               ", ".join(f"c{k} double" for k in range(12)))
    got = {(r["x"], r["y"]): r["value"] for r in D.correlation_matrix(df).collect()}
    assert len(got) == 144 and got["c0", "c0"] == 1.0 and all(got["c11", f"c{k}"] == 0.0 for k in range(12))
    assert len(D.correlation_matrix(df, Params.screens()).collect()) == 64


def test_cuts_are_arguments(spark):
    df = spark.createDataFrame([(f"v{i:02d}", float(i % 5), "Yes" if i % 2 else "No") for i in range(30)], "c string, x double, t string")
    assert D.categorical_values(df).where("column_name = 'c'").count() == 30
    assert D.categorical_values(df, Params.screens()).where("column_name = 'c'").count() == 20
    assert D.category_by_target(df, "t").where("feature = 'c'").count() == 60
    assert D.category_by_target(df, "t", Params.screens()).where("feature = 'c'").count() == 0
    few = df.limit(5)
    assert D.numeric_histogram(few).count() == 8 and D.numeric_histogram(few, None, Params.screens()).count() == 0


def test_history_limit_is_honoured(spark):
    log = spark.createDataFrame([(i, 1, f"c{i}", i) for i in range(2000)], "id long, user_id long, customer_identifier string, created_at long")
    got = [r["id"] for r in H.history_query(log, 1, limit=1000, offset=300).collect()]
    assert got == list(range(1699, 699, -1))
    with pytest.raises(ValueError):
        H.history_query(log, 1, limit=0)


def test_deletes_keep_rows_without_a_user(spark):
    log = spark.createDataFrame([(1, 3), (2, None), (3, 4)], "id long, user_id long")
    assert sorted(r["id"] for r in H.delete_records(log, user_id=3).collect()) == [2, 3]
    assert sorted(r["id"] for r in H.delete_records(log, ids=log.where("id = 3").select("id")).collect()) == [1, 2]


def _write(spark, text):
    path = f"{shared_dir(spark, 'csv')}/t.csv"
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_quotes_breaks_big_numbers_and_booleans(spark):
    path = _write(spark, 'id,note,account,flag\n1,"He said ""hi"", ok",12345678901234567890123,True\n2,"two\nlines",5,False\n')
    df = read_customer_csv(spark, path, multi_line=True)
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "account": "string", "flag": "boolean"}
    assert sorted(map(tuple, df.collect())) == [(1, 'He said "hi", ok', "12345678901234567890123", True), (2, "two\nlines", "5", False)]


def test_loads_share_one_table_and_replace_themselves(spark):
    path = shared_dir(spark, "log")
    one = spark.createDataFrame([(1, 7, "a"), (2, None, "b")], "id long, user_id long, v string")
    two = spark.createDataFrame([(3, 7, "c")], one.schema)
    for load, rows in (("x", one), ("y", two), ("y", two)):
        SK.append_prediction_log(rows, path, load)
    got = SK.read_prediction_log(spark, path, one.schema)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 7, "a"), (2, None, "b"), (3, 7, "c")]))
    assert "PartitionFilters: [isnotnull(user_id" in got.where("user_id = 7")._jdf.queryExecution().executedPlan().toString()


def test_same_customers_streamed_twice_get_new_ids(spark):
    from retainx.operators import score as SC
    from retainx.plans import scorecard as CARD
    from retainx.streaming.scoring import log_records
    t = V.telco(spark, SF_SMALL).dropDuplicates().limit(40)
    scored = SC.score_batch(t, CARD.scorecard_probability(t))
    ids = [r["id"] for load in ("stream-0", "stream-1") for r in log_records(scored, 1, None, "customerID", ["tenure"], load=load).collect()]
    assert len(set(ids)) == len(ids) == 80


def test_stored_package_scores_like_the_fresh_model(spark):
    trained = R._trained(spark, SF_SMALL, ("Decision Tree", "Logistic Regression"))
    telco = V.telco(spark, SF_SMALL)
    path = M.save_package(trained, "Decision Tree", shared_dir(spark, "package"))
    pipeline, schema, meta = M.load_package(spark.newSession(), path)
    assert schema == trained.schema and meta["metrics"]["algorithm_name"] == "Decision Tree"
    before = M.score_with_model(telco, trained, "Decision Tree")
    after = M.score_package(telco, pipeline, schema)
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    factors = [tuple(x) for x in json.loads(meta["metrics"]["feature_importances"])]
    got = M.score_customers(R._typed_by_hand(telco), pipeline, schema, factors, "customerID").collect()
    assert len(got) == telco.count() and all(abs(r["churn_probability"] + r["retention_probability"] - 100) < 1e-9 for r in got)
    assert all(1 <= len(r["top_factors"]) <= 5 for r in got)


def test_registry_has_one_active_model(spark):
    rows = R.QUERIES["model_registry"](spark, SF_SMALL).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3] and [r["id"] for r in rows if r["is_active"]] in ([2], [3])
    idle = spark.createDataFrame([r.asDict() | {"is_active": False} for r in rows], R.QUERIES["model_registry"](spark, SF_SMALL).schema)
    assert M.active_model(idle).first()["f1_score"] == max(r["f1_score"] for r in rows)


def test_schema_survives_json_with_typed_classes(spark):
    import datetime
    import decimal
    schema = FE.FeatureSchema("t", [], [], [], [], positive=decimal.Decimal("1.50"), classes=[decimal.Decimal("0.50"), datetime.date(2024, 1, 2)])
    text = json.dumps(schema.to_dict(), default=M._json_value)
    assert FE.FeatureSchema.from_dict(json.loads(text, object_hook=M._python_value)) == schema


def test_wide_targets_and_categories_are_refused(spark):
    wide = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("name"), (F.col("id") % 2).cast("string").alias("Churn"))
    with pytest.raises(ValueError, match="classes"):
        FE.positive_class(wide, "name")
    with pytest.raises(ValueError, match="categories in: name"):
        FE.fit_schema(wide, "Churn", params=Params(max_categories=1000))


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    import retainx.session as S

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(Session())
