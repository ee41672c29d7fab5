"""Rows-only operators (Spark ML) checked by invariants."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from retainx.operators import features as FE, models as M
from retainx.plans import views as V

from conftest import SF_SMALL
from presets import preset_profiles


def test_split_is_disjoint_and_stratified(spark):
    t = V.telco(spark, SF_SMALL)
    prep = FE.prepare(t, "Churn", ["customerID"])
    lab = FE.map_target(prep, "Churn", FE.positive_class(prep, "Churn")[0])
    sp = FE.train_test_split(lab, "label", 0.2, 42).cache()
    n, nt = sp.count(), sp.where("is_test").count()
    assert nt == -(-n * 2 // 10) or abs(nt - 0.2 * n) <= 2
    r_all = sp.agg(F.avg("label")).first()[0]
    r_test = sp.where("is_test").agg(F.avg("label")).first()[0]
    assert abs(r_all - r_test) < 0.02


def test_train_and_compare_invariants(spark):
    ts = E.queries()["train_and_compare"](spark, SF_SMALL).collect()
    assert [r["algorithm_name"] for r in ts] == ["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting"]
    assert sum(r["is_best"] for r in ts) == 1
    for r in ts:
        assert 0 <= r["accuracy"] <= 100 and 0 <= r["roc_auc"] <= 100
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0
    best = max(ts, key=lambda r: (0.5 * r["f1_score"] + 0.5 * r["roc_auc"], -r["ordinal"]))
    assert best["is_best"]
    imp = E.queries()["feature_importance"](spark, SF_SMALL).collect()
    by_model = {a: [r for r in imp if r["algorithm_name"] == a] for a in {r["algorithm_name"] for r in imp}}
    assert len(by_model) == 4 and all(len(v) == 20 for v in by_model.values())          # every feature, strongest first
    for v in by_model.values():
        w = [abs(r["importance"]) for r in sorted(v, key=lambda r: r["rank"])]
        assert w == sorted(w, reverse=True)


def test_scoring_consistency_and_presets(spark):
    sc = E.queries()["score_customers"](spark, SF_SMALL).collect()
    for r in sc:
        p = r["churn_probability"]
        assert 0 <= p <= 100 and abs(p + r["retention_probability"] - 100) < 1e-9
        assert r["prediction"] == ("Churn" if p >= 50 else "No Churn")
        assert r["risk_level"] == ("Low Risk" if p < 35 else "Medium Risk" if p < 65 else "High Risk")
    from retainx.plans.registry import _trained
    ts = _trained(spark, SF_SMALL)
    pre = M.score_with_model(preset_profiles(spark), ts, "Logistic Regression")
    got = {r["preset"]: r["Churn_Probability_%"] for r in pre.collect()}
    assert got["high_risk"] > got["moderate"] > got["loyal"]


def test_metrics_follow_from_the_scored_test_rows(spark):
    """Flags, cells and rates of the trees recomputed from stored (label, prediction, score) rows by DuckDB."""
    import duckdb
    from retainx.plans import registry as R
    from retainx.session import shared_dir
    ts = R._trained(spark, SF_SMALL, ("Decision Tree", "Logistic Regression"))
    _, prep, vec = M.fit_features(V.telco(spark, SF_SMALL), "Churn", ["customerID"])
    for name, model in ts.models.items():
        p = model.transform(vec.where("is_test"))
        path = shared_dir(spark, "scored-rows")
        p.select("label", F.col("prediction").cast("int").alias("prediction"), M.churn_probability(p).alias("score")).write.parquet(path)
        tp, fp, fn, tn, auc = duckdb.sql(f"""
            WITH t AS (SELECT * FROM read_parquet('{path}/*.parquet')),
            pairs AS (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS u
                      FROM t a, t b WHERE a.label = 1 AND b.label = 0)
            SELECT count(*) FILTER (label = 1 AND prediction = 1), count(*) FILTER (label = 0 AND prediction = 1),
                   count(*) FILTER (label = 1 AND prediction = 0), count(*) FILTER (label = 0 AND prediction = 0), any_value(u)
            FROM t, pairs""").fetchall()[0]
        m = ts.metrics.where(F.col("algorithm_name") == name).first()
        assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (tp, fp, fn, tn)
        assert abs(m["accuracy"] - 100 * (tp + tn) / (tp + fp + fn + tn)) < 0.006 and abs(m["roc_auc"] - 100 * auc) < 0.006


def test_rows_only_queries_return_their_rows(spark):
    q = E.queries()
    customers = V.telco(spark, SF_SMALL).count()
    want = {"logistic_regression": 1, "decision_tree": 1, "random_forest": 1, "gradient_boosting": 1, "train_and_compare": 4,
            "feature_importance": 80, "training_time": 4, "score_customers": customers, "model_store": customers, "model_registry": 3}
    for name in sorted(set(q) - set(E.oracle_sql())):
        if name in want:
            assert q[name](spark, SF_SMALL).count() == want[name], name
        else:
            assert name == "pipeline" or name.startswith("op"), name            # these have tests of their own


def test_fits_run_in_as_many_tasks_as_cores(spark, monkeypatch):
    """However many files the prepared rows lie in: each task of a level merges a histogram of its own."""
    rows = [(f"c{i}", float(i % 37), "ab"[i % 2], "Yes" if i % 3 == 0 else "No") for i in range(400)]
    df = spark.createDataFrame(rows, "customerID string, tenure double, plan string, Churn string")
    cores = spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": 5 * cores, "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        vec = M.fit_features(df, "Churn", ["customerID"], keep=True)[2]
        assert vec.count() == 400 and vec.rdd.getNumPartitions() == cores
        vec.unpersist()
        monkeypatch.setattr(M, "TASK_VECTORS", 400 // (2 * cores))
        vec = M.fit_features(df, "Churn", ["customerID"], keep=True)[2]
        assert vec.count() == 400 and vec.rdd.getNumPartitions() >= 2 * cores
        vec.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
