"""Stored trees as node tables: another engine that only knows the table gives the model's scores."""

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retainx.operators import features as FE, models as M, trees as TR
from retainx.params import Params
from retainx.plans import views as V
from retainx.session import shared_dir

from conftest import SF_SMALL

QUICK = Params(rf_trees=7, rf_max_depth=6, gb_rounds=6)
DESCENT = """
WITH RECURSIVE walk AS (
  SELECT x.row_key, x.v, n.tree, n.node FROM x, n WHERE n.node = 0
  UNION ALL
  SELECT w.row_key, w.v, w.tree, CASE WHEN coalesce(w.v[n.feature_index + 1] <= n.threshold, list_contains(n.left_values, w.v[n.feature_index + 1]))
    THEN n.left ELSE n.right END
  FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE n.left IS NOT NULL)
SELECT w.row_key, sum(n.weight * n.answer) AS s, sum(n.weight) AS w FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE n.left IS NULL GROUP BY w.row_key
"""


@pytest.fixture(scope="module")
def trained(spark):
    return M.train_and_compare(V.telco(spark, SF_SMALL), "Churn", ["customerID"], ["Decision Tree", "Random Forest", "Gradient Boosting"], QUICK)


@pytest.mark.parametrize("name", ["Decision Tree", "Random Forest", "Gradient Boosting"])
def test_another_engine_scores_alike(spark, trained, name):
    import math
    model = trained.models[name]
    _, _, vec = M.fit_features(V.telco(spark, SF_SMALL), "Churn", ["customerID"], QUICK)
    scored = model.transform(vec)
    want = {r["k"]: r["p"] for r in scored.select(F.col(FE.ROW_KEY).alias("k"), M.churn_probability(scored).alias("p")).collect()}
    nodes = TR.export_nodes(spark, model, trained.names)
    n = nodes.toArrow()                                                 # noqa: F841 - read by DuckDB
    x = vec.select(F.col(FE.ROW_KEY).alias("row_key"), vector_to_array("features").alias("v")).toArrow()  # noqa: F841
    boosted = name == "Gradient Boosting"
    got = {k: 1 / (1 + math.exp(-2 * s)) if boosted else s / w for k, s, w in duckdb.connect().execute(DESCENT).fetchall()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    ours = {r[0]: r[1] for r in TR.scores_by_nodes(vec, nodes, TR.max_depth(nodes), boosted, FE.ROW_KEY).collect()}
    assert max(abs(ours[k] - want[k]) for k in want) < 1e-9
    assert set(n.column("feature").drop_null().to_pylist()) <= set(trained.names)
    by_nodes = {r["feature"]: r["importance"] for r in TR.importances_by_nodes(nodes, boosted).collect()}
    assert all(abs(by_nodes.get(f, 0.0) - v) < 1e-9 for f, v in zip(trained.names, model.featureImportances.toArray()))


def test_stored_packages_give_their_nodes(spark, trained):
    path = M.save_package(trained, "Random Forest", shared_dir(spark, "package"))
    nodes = TR.node_table(spark, TR.stored_classifier(path), trained.names)
    assert nodes.select("tree").distinct().count() == 7 and 1 <= TR.max_depth(nodes) <= 6
    assert nodes.where("node = 0").agg(F.min("rows")).first()[0] > 0


def test_models_without_trees_are_refused(spark):
    ts = M.train_and_compare(V.telco(spark, SF_SMALL), "Churn", ["customerID"], ["Logistic Regression"])
    with pytest.raises(ValueError, match="no trees"):
        TR.export_nodes(spark, ts.models["Logistic Regression"], ts.names)
    with pytest.raises(ValueError, match="no trees"):
        TR.stored_classifier(M.save_package(ts, "Logistic Regression", shared_dir(spark, "package")))


def test_large_domains_are_joined(spark):
    base = FE.fit_schema(V.telco(spark, SF_SMALL), "Churn", ["customerID"])[0]
    many = [f"City {i:04d}" for i in range(500)]
    schema = FE.FeatureSchema.from_dict({**base.to_dict(), "domains": {**base.domains, "Contract": many}, "defaults": {**base.defaults, "Contract": many[3]}})
    typed = spark.createDataFrame([(1, " cITY 0042 "), (2, ""), (3, None), (4, "elsewhere"), (5, "City 0499")], "id int, CONTRACT string")
    out = FE.normalize_scoring_input(typed, schema)
    assert {r["id"]: r["Contract"] for r in out.collect()} == {1: "City 0042", 2: "City 0003", 3: "City 0003", 4: "elsewhere", 5: "City 0499"}
    assert "City 0042" not in out._jdf.queryExecution().optimizedPlan().expressions().toString()


def test_nodes_are_shipped_to_the_rows(spark, trained):
    _, _, vec = M.fit_features(V.telco(spark, SF_SMALL), "Churn", ["customerID"], QUICK)
    nodes = TR.export_nodes(spark, trained.models["Random Forest"], trained.names).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as for forests beyond it
    try:
        plan = TR.descend(vec, nodes, 3, FE.ROW_KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan, plan
