"""Forms of the model queries that hold at size: scans, stripping, brackets."""

import re

from pyspark.sql import functions as F

from retainx.functions import sql as SQ
from retainx.functions.expr import as_double, guarded_double, strip_ws
from retainx.operators import features as FE, models as M
from retainx.plans import ranking

TEXTS = ["", " ", " a ", "\ta b\r\n", "a\u0085", "a \u0085", " a\n ", " ", "a   ", " a ", "\x0b1.5\f", "nan", None, "b \n ", "é "]


def customers(spark, n=400):
    rows = [(f"c{i}", float(i % 37), "ab"[i % 2], "Yes" if i % 3 == 0 else "No") for i in range(n)]
    return spark.createDataFrame(rows, "customerID string, tenure double, plan string, Churn string")


def test_stripping_is_that_of_the_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("t", strip_ws("t").alias("a"), F.expr(SQ.strip_ws("t")).alias("b"),
                    F.regexp_replace("t", r"^\s+|\s+$", "").alias("want")).collect()
    assert all(r["a"] == r["want"] and r["b"] == r["want"] for r in got)


def test_numbers_are_aligned_without_a_text(spark):
    """Whole numbers and doubles were printed, matched and parsed again for every customer."""
    df = spark.createDataFrame([(3, 2.5, " 4 "), (None, float("nan"), "x"), (-(2 ** 62) - 1, float("inf"), None), (0, -0.0, "1e3"), (1, 1e-7, "")],
                               "n bigint, x double, t string")
    got = df.select(*[as_double(df, c).alias(c) for c in df.columns], *[guarded_double(F.col(c).cast("string")).alias(f"{c}_text") for c in df.columns]).collect()
    assert all(repr(r[c]) == repr(r[f"{c}_text"]) for r in got for c in df.columns)
    schema = FE.FeatureSchema("t", [], ["n", "x"], ["n", "x"], [])
    assert "RLIKE" not in FE.align_batch(df, schema)._jdf.queryExecution().optimizedPlan().toString()


def test_the_split_is_kept_while_features_are_fitted(spark, monkeypatch):
    """Medians, scaling, categories, weights and vectors each hashed every row anew."""
    seen = []
    fitted = FE.train_medians
    monkeypatch.setattr(FE, "train_medians", lambda train, *a: seen.append(train._jdf.queryExecution().withCachedData().toString()) or fitted(train, *a))
    cached = spark.sparkContext._jsc.getPersistentRDDs
    before = set(cached())
    vec = M.fit_features(customers(spark), "Churn", ["customerID"])[2]
    assert re.search("InMemoryRelation", seen[0])
    assert set(cached()) <= before                                   # nothing is left in memory
    assert vec.count() == 400
    vec = M.fit_features(customers(spark), "Churn", ["customerID"], keep=True)[2]
    assert len(set(cached()) - before) == 1 and vec.count() == 400     # the vectors alone
    vec.unpersist()


def test_categories_are_counted_by_one_pass(spark):
    kept = []
    wide = FE._refuse_wide
    FE._refuse_wide = lambda counts, params: kept.append(counts.storageLevel.useMemory) or wide(counts, params)
    try:
        assert FE.category_domains(customers(spark), ["plan"]) == {"plan": ["a", "b"]}
        FE.fit_schema(customers(spark), "Churn", ["customerID"])
    finally:
        FE._refuse_wide = wide
    assert kept == [True, True]


def test_few_brackets_are_compared_as_many_are(spark):
    rows = [("a", float(i % 50)) for i in range(300)] + [("b", float(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, x double")
    for probs in ([0.5], [0.25, 0.5, 0.75], [0.0, 1.0]):
        bounds = ranking._brackets(df, ["g"], "x", probs, 20)
        frozen = spark.createDataFrame(bounds.collect(), bounds.schema)
        few, many = (ranking._around(df, ["g"], "x", frozen, n) for n in (len(probs), None))
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
        assert "exists(" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_file_are_scored_by_many_tasks(spark):
    """A small compressed file is one partition however many customers it holds."""
    df = customers(spark)
    prep = M.prep_pipeline(FE.FeatureSchema("Churn", ["customerID"], ["tenure", "plan"], ["tenure"], ["plan"]), {}, {}).fit(df)
    model = M.make_estimator("Logistic Regression", M.P, 400).fit(M.FE.map_target(prep.transform(df), "Churn", "Yes").withColumn("weight", F.lit(1.0)))
    schema = FE.FeatureSchema("Churn", ["customerID"], ["tenure", "plan"], ["tenure"], ["plan"])
    one = df.coalesce(1)
    scored = M.score_package(one, M.PipelineModel(stages=[prep, model]), schema)
    assert "RepartitionByExpression" in str(scored._jdf.queryExecution().optimizedPlan()) or "Repartition " in str(scored._jdf.queryExecution().optimizedPlan())
    assert scored.count() == 400
