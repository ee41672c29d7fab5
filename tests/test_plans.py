"""Physical-plan properties the scale design relies on, and hot-key inputs
(one key holding a third of all rows)."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from retainx.operators import history as H, profile as P, stats as D
from retainx.plans.ranking import exact_quantiles
from retainx.plans import views as V
from retainx.sources.tables import read_table

from conftest import SF_SMALL


def final_plan(df) -> str:
    """The executed (adaptive, final) physical plan as text."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_top_n_per_group_is_limited_before_the_shuffle(spark):
    plan = final_plan(P.sample_values(read_table(spark, SF_SMALL, "lineitem")))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_log_scan_reads_only_needed_columns(spark):
    df = H.history_query(V.predictions(spark, SF_SMALL), user_id=1, risk_level="High Risk")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_orderpriority" not in schema and "o_totalprice" not in schema and "o_orderstatus" not in schema


def test_wide_aggregates_stay_in_codegen(spark):
    df = D.correlation_matrix(read_table(spark, SF_SMALL, "lineitem"))
    plan = final_plan(df)
    agg_lines = [ln for ln in plan.splitlines() if "partial_covar_pop" in ln]
    assert agg_lines and all(re.search(r"\*\(\d+\)", ln) for ln in agg_lines), agg_lines


def test_hot_user_latest_predictions(spark):
    # user 0 holds a third of the log
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 7, f"2024-01-{1 + i % 28:02d}") for i in range(3000)]
    log = spark.createDataFrame(rows, "id long, user_id long, d string").withColumn("created_at", F.to_timestamp("d"))
    got = H.latest_predictions(log, 5)
    assert got.where("user_id = 0").count() == 5
    assert got.groupBy("user_id").count().where("count <> 5").count() == 0
    assert "WindowGroupLimit" in final_plan(got)
    counts = {r["user_id"]: r["total_predictions"] for r in H.prediction_count(log).collect()}
    assert counts[0] == 1000


def test_hot_value_profile_and_quantiles(spark):
    # one value is a third of the column
    data = [(7.0 if i % 3 == 0 else float(i),) for i in range(3000)]
    df = spark.createDataFrame(data, "x double")
    prof = P.column_profile(df).first()
    assert prof["unique_count"] == 2000          # 7.0 also occurs among the others
    q = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "x", [0.25, 0.5], buckets=40).collect()}
    import numpy as np
    arr = np.array([v for (v,) in data])
    assert q[0.25] == float(np.quantile(arr, 0.25)) and q[0.5] == float(np.quantile(arr, 0.5))
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 1000


def test_registered_queries_read_whole_tables(spark, tmp_path):
    # on tables with every row four times, what counts rows gives four times as many
    q = E.queries()
    for t in ("customer", "orders", "lineitem"):
        df = read_table(spark, SF_SMALL, t)
        df.union(df).union(df).union(df).write.parquet(f"{tmp_path}/{t}.parquet")
    small, large = (lambda name: q[name](spark, SF_SMALL).collect()), (lambda name: q[name](spark, str(tmp_path)).collect())
    for name, column in (("column_profile", "total_rows"), ("numeric_stats", "count"), ("table_shape", "total_rows"), ("prediction_count", "total_predictions")):
        key = "column_name" if name in ("column_profile", "numeric_stats") else "user_id" if name == "prediction_count" else "total_columns"
        one, four = ({r[key]: r[column] for r in rows} for rows in (small(name), large(name)))
        assert four == {k: 4 * n for k, n in one.items()}, name
    for name in ("score_batch", "history_with_model", "coerce_numeric"):
        assert len(large(name)) == 4 * len(small(name)), name


def test_log_partitions_prune_to_one_user(spark):
    from retainx.session import shared_dir
    from retainx.sources.sinks import append_prediction_log
    path = append_prediction_log(V.predictions(spark, SF_SMALL), shared_dir(spark, "log_prune"))
    log = spark.read.parquet(path)
    df = H.history_query(log, user_id=2, risk_level="High Risk")
    plan = final_plan(df)
    assert "PartitionFilters: [isnotnull(user_id" in plan and "(user_id" in plan and "= 2)" in plan
    assert df.count() == V.predictions(spark, SF_SMALL).where("user_id = 2 AND risk_level = 'High Risk'").limit(100).count()


def _scans_and_reuse(plan: str) -> tuple[int, int]:
    return plan.count("FileScan parquet"), plan.count("ReusedExchange")


def test_crosstab_reads_the_table_once(spark):
    # the count, the category list and the class list share one shuffle of one scan
    plan = final_plan(D.category_by_target(V.telco(spark, SF_SMALL), "Churn"))
    scans, reused = _scans_and_reuse(plan)
    assert scans == 1 and reused >= 2, (scans, reused)


def test_churn_kpis_read_the_table_once(spark):
    plan = final_plan(D.churn_kpis(V.telco(spark, SF_SMALL), "Churn"))
    scans, reused = _scans_and_reuse(plan)
    assert scans == 1 and reused >= 2, (scans, reused)


def test_materialized_prepare_reads_the_checkpoint(spark):
    from retainx.operators import features as FE
    t = V.telco(spark, SF_SMALL)
    lazy = FE.prepare(t, "Churn", ["customerID"])
    mat = FE.prepare(t, "Churn", ["customerID"], materialize=True)
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, mat.collect()))
    plan = final_plan(mat)
    # the dedup shuffle ran once, when the table was written to the shared dir
    ckpt = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert "Exchange" not in plan and "FileScan parquet" in plan and "/prepared-" in plan and ckpt in plan, plan
