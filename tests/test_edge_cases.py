"""Edge tables: empty, single row, one class, constant / all-null columns,
numeric-like thresholds, duplicates, booleans, odd header names."""

import pytest
from pyspark.sql import functions as F

from retainx.operators import features as FE, profile as P, rows as R, score as SC, stats as D
from retainx.operators import evaluate as EV


def _prof(df):
    return {r["column_name"]: r for r in P.column_profile(df).collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b long")
    checks = {r["seq"]: r for r in P.validation_checks(df).collect()}
    assert checks[1]["status"] == "failed"
    assert any(r["kind"] == "error" for r in checks.values())
    assert P.is_valid(df).first()["is_valid"] is False


def test_single_row_and_constant_column(spark):
    df = spark.createDataFrame([("x", 1, None)], "a string, b long, c double")
    p = _prof(df)
    assert p["a"]["is_single_value"] is False          # needs more than one row
    assert p["c"]["missing_count"] == 1 and p["c"]["unique_count"] == 0
    st = {r["column_name"]: r for r in D.numeric_stats(df).collect()}
    assert "c" not in st and st["b"]["std"] == 0.0 and st["b"]["skew"] == 0.0


def test_numeric_like_threshold(spark):
    # 10 rows: 8 numbers = 80 % is not > 80 %; 9 numbers is
    at80 = spark.createDataFrame([(str(i),) for i in range(8)] + [(" ",), ("n/a",)], "t string")
    at90 = spark.createDataFrame([(f" {i} ",) for i in range(9)] + [("x",)], "t string")
    assert _prof(at80)["t"]["is_numerical"] is False
    assert _prof(at90)["t"]["is_numerical"] is True
    assert D.numeric_like_columns(at90) == ["t"]
    # '12d' and 'nan' are not numbers here (pandas rejects / counts NaN missing)
    odd = spark.createDataFrame([("12d",), ("nan",), ("1e3",), (".5",)], "t string")
    assert [r["v"] for r in odd.select(FE.guarded_double(F.col("t")).alias("v")).collect()] == [None, None, 1000.0, 0.5]


def test_duplicates_and_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "a")], "id long, v string")
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 2
    assert R.distinct_rows(df, ["id"]).count() == 2


def test_boolean_is_numeric_in_profile_categorical_in_stats(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "flag boolean")
    assert _prof(df)["flag"]["is_numerical"] is True
    cs = D.categorical_stats(df).first()
    assert cs["column_name"] == "flag" and cs["top_value"] == "True" and cs["top_frequency"] == 2


def test_odd_header_names(spark):
    df = spark.createDataFrame([(1.0, "a", 2)], ["Churn_Probability_%", "col.with.dot", "has space"])
    p = _prof(df)
    assert set(p) == {"Churn_Probability_%", "col.with.dot", "has space"}
    assert P.sample_values(df).count() == 3


def test_id_and_target_name_rules(spark):
    rows = [(i, f"n{i}", "Yes" if i % 2 else "No", "x" if i % 3 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, ["prepaid", "Customer_ID", "Exited", "plan"])
    p = _prof(df)
    assert p["prepaid"]["is_id_candidate"]            # suffix "id" (kept as in the reference)
    assert p["Customer_ID"]["is_id_candidate"]
    assert p["Exited"]["name_is_target"] and p["plan"]["is_target_candidate"]
    assert P.detect_target(df).first()["target_column"] == "Exited"


def test_one_class_guard_and_split(spark):
    df = spark.createDataFrame([(i, "No") for i in range(30)], "k long, t string")
    assert P.class_count_guard(df, "t").first()["can_train"] is False
    with pytest.raises(ValueError):
        P.class_count_guard(df, "t", raise_error=True)
    lab = FE.map_target(df, "t", FE.positive_class(df, "t")[0])
    sp = FE.train_test_split(lab, "label", 0.2, 42)          # falls back to a plain split
    assert sp.where("is_test").count() == 6


def test_map_target_fallbacks(spark):
    two = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    assert FE.positive_class(two, "t")[0] == "b"             # second class when nothing matches
    num = spark.createDataFrame([(0,), (1,)], "t long")
    assert FE.positive_class(num, "t")[0] == 1
    lab = FE.map_target(two, "t", "b").orderBy("t").collect()
    assert [r["label"] for r in lab] == [0, 0, 1]           # null -> 0


def test_unseen_and_case_insensitive_categories(spark):
    train = spark.createDataFrame([("Yes", 1.0), ("No", 2.0), ("No", None)], "Contract string, x double")
    schema, _ = FE.fit_schema(train.withColumn("y", F.lit("No")), "y")
    batch = spark.createDataFrame([("yes", "7"), ("Maybe", "bad"), ("", None)], "contract string, X string")
    out = FE.normalize_scoring_input(batch, schema, derive_total=False).collect()
    assert [r["Contract"] for r in out] == ["Yes", "Maybe", schema.defaults["Contract"]]
    assert [r["x"] for r in out] == [7.0, 1.5, 1.5]
    oh = FE.one_hot(batch.select(F.col("contract").alias("Contract")), {"Contract": ["No", "Yes"]}).collect()
    assert [tuple(r) for r in oh] == [(0, 0), (0, 0), (0, 0)]   # case matters after normalisation


def test_explain_rules_and_fallback(spark):
    rows = [("Month-to-month", 3, 80.5, "No", "No", "Electronic check"),
            ("Two year", 20, 50.0, "Yes", "Yes", "Mailed check")]
    df = spark.createDataFrame(rows, "Contract string, tenure long, MonthlyCharges double, TechSupport string, "
                                     "OnlineSecurity string, PaymentMethod string")
    imps = [("tenure", 0.3), ("Gadget", 0.2)]
    out = {r["Contract"]: r["f"] for r in df.select("Contract", SC.explain_rules(df, imps).alias("f")).collect()}
    first = out["Month-to-month"]
    assert len(first) == 5 and first[1]["value"] == "3 months" and first[2]["value"] == "$80.50"
    assert [f["feature"] for f in out["Two year"]] == ["Contract Type"]
    mid = df.where("Contract = 'Two year'").drop("Contract")
    fb = mid.select(SC.explain_rules(mid, imps).alias("f")).first()["f"]
    assert [(f["feature"], f["value"], f["impact"]) for f in fb] == [
        ("tenure", "20", "Primary Model Driver"), ("Gadget", "Active", "Primary Model Driver")]


def test_risk_tier_edges(spark):
    df = spark.createDataFrame([(34.9,), (35.0,), (64.9,), (65.0,), (50.0,), (49.9,)], "p double")
    scored = SC.score_batch(df, F.col("p") / 100.0).collect()
    assert [r["Risk_Level"] for r in scored] == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk",
                                                 "Medium Risk", "Medium Risk"]
    assert [r["Predicted_Churn"] for r in scored][-2:] == ["Churn", "No Churn"]


def test_auc_single_class_falls_back_to_accuracy(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2)], "label int, prediction int, score double")
    assert EV.roc_auc(df).first()["roc_auc"] == 50.0


def test_histogram_constant_column_widens(spark):
    df = spark.createDataFrame([(5.0,)] * 12, "x double")
    h = {r["bin_index"]: r for r in D.numeric_histogram(df).collect()}
    assert h[4]["count"] == 12 and sum(r["count"] for r in h.values()) == 12
    assert h[0]["bin"] == "4.5-4.6"


def test_approximate_switches(spark):
    from retainx.params import Params
    rows = [(float(i % 97), f"v{i % 13}") for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, c string")
    exact = D.numeric_stats(df).first()
    approx = D.numeric_stats(df, Params(approx_quantiles=True)).first()
    assert abs(exact["median"] - approx["median"]) <= 1.0
    u = P.unique_counts(df, Params(approx_distinct=True)).collect()
    lo, hi = sorted(r["unique_count"] for r in u)
    assert abs(lo - 13) <= 1 and abs(hi - 97) <= 8          # HyperLogLog error


def test_single_file_variant_parameters(spark):
    from retainx.params import Params
    v = Params.single_file()
    rows = [(float(i), "Month-to-month" if i % 2 else "Two year", i % 40, 60.0 + i % 30) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, Contract string, tenure long, MonthlyCharges double")
    st = D.numeric_stats(df, v)
    assert "q25" not in st.columns and "q75" not in st.columns
    h = D.numeric_histogram(df, None, v).where("feature = 'x'").orderBy("bin_index").collect()
    assert len(h) == 6 and h[0]["bin"] == "0-6"
    f = df.select(SC.explain_rules(df, None, v).alias("f")).first()["f"]
    assert all(x["importance"] is None for x in f)


def test_churn_kpis_class_choice(spark):
    one = spark.createDataFrame([("a",), ("a",)], "t string")
    nopos = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "t string")
    pos = spark.createDataFrame([("No",), ("No",), ("Yes",), (None,)], "t string")
    assert D.churn_kpis(one, "t").first()["churned_customers"] == 2        # the only class
    assert D.churn_kpis(nopos, "t").first()["churned_customers"] == 1      # runner-up by count, then value
    r = D.churn_kpis(pos, "t").first()
    assert (r["churned_customers"], r["non_churned_customers"], r["churn_rate"]) == (1, 3, 25.0)
