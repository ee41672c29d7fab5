"""The registered queries: one per operator of the inventory.

Each entry maps a name to a callable (spark, sf_dir) -> DataFrame reading
the driver tables (or views Spark derives from them).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from retainx.operators import profile as P, sketches as SKE
from retainx.params import Params
from retainx.plans import views as V
from retainx.session import shared_dir
from retainx.sources.tables import read_table

QUERIES: dict = {}
SCREENS = Params.screens()      # the application's cuts of lists and charts


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ---- profiling ---------------------------------------------------------------
@query("table_shape")
def q_table_shape(spark, sf):
    return P.table_shape(_t(spark, sf, "lineitem"))


@query("duplicate_rows")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(V.telco(spark, sf))


@query("repeated_rows")
def q_repeated_rows(spark, sf):
    return P.duplicate_rows(_t(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("distinct_sketches")
def q_distinct_sketches(spark, sf):
    """Line items profiled load by load (one load twice) and merged: counts, and whether the distinct estimates are within 3 %."""
    li, path = _t(spark, sf, "lineitem"), shared_dir(spark, "sketches")
    for k in (0, 1, 2, 1):
        SKE.add_load(li.where(F.col("l_partkey") % 3 == k), path, f"load-{k}")
    merged = SKE.merged_profile(SKE.read_profiles(spark, path))
    exact = P.unique_counts(li)
    return merged.join(exact, "ordinal").select("column_name", "total_rows", "missing_count", (
        F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 0.03 * F.col("unique_count")).alias("close"))


@query("missing_by_column")
def q_missing_by_column(spark, sf):
    return P.missing_by_column(V.predictions(spark, sf))


@query("unique_by_column")
def q_unique_by_column(spark, sf):
    li = _t(spark, sf, "lineitem")
    return P.column_profile(li).select("column_name", "unique_count")


@query("numeric_like")
def q_numeric_like(spark, sf):
    return P.numeric_like(V.telco(spark, sf))


@query("id_columns")
def q_id_columns(spark, sf):
    return P.id_columns(_t(spark, sf, "customer"))


@query("target_candidates")
def q_target_candidates(spark, sf):
    return P.target_candidates(V.telco(spark, sf))


@query("detect_target")
def q_detect_target(spark, sf):
    return P.detected_target_classes(V.telco(spark, sf))


@query("zero_variance_columns")
def q_zero_variance(spark, sf):
    return P.zero_variance_columns(V.datasets(spark, sf))


@query("high_cardinality_columns")
def q_high_cardinality(spark, sf):
    return P.high_cardinality_columns(_t(spark, sf, "lineitem"))


@query("feature_type_lists")
def q_feature_type_lists(spark, sf):
    return P.feature_type_lists(V.telco(spark, sf))


@query("sample_values")
def q_sample_values(spark, sf):
    return P.sample_values(_t(spark, sf, "lineitem"))


@query("column_profile")
def q_column_profile(spark, sf):
    return P.column_profile(V.telco(spark, sf))


@query("validation_checks")
def q_validation_checks(spark, sf):
    return P.validation_checks(V.telco(spark, sf))


@query("is_valid")
def q_is_valid(spark, sf):
    return P.is_valid(V.telco(spark, sf))


@query("configure_target")
def q_configure_target(spark, sf):
    return P.configure_target(V.telco(spark, sf), "Contract", id_column="tenure")


@query("configure_target_classes")
def q_configure_target_classes(spark, sf):
    out = P.configured_summary(V.telco(spark, sf), "Contract", id_column="tenure")
    return out.withColumn("target_classes", F.array_join("target_classes", "|")).withColumn("id_columns", F.array_join("id_columns", "|"))


@query("profile_with_samples")
def q_profile_with_samples(spark, sf):
    return P.profile_with_samples(V.telco(spark, sf)).select(
        "ordinal", "column_name", "unique_count", F.array_join("sample_values", "|").alias("sample_values"))


@query("sample_decimals")
def q_sample_decimals(spark, sf):
    # decimals and single floats sort as numbers
    li = _t(spark, sf, "lineitem")
    return P.sample_values(li.select(F.col("l_quantity").cast("decimal(12,2)").alias("dec"), F.col("l_quantity").cast("float").alias("single")))


@query("sample_large_and_small")
def q_sample_large_and_small(spark, sf):
    # numbers that Python prints without an exponent and the engine with one, and the other way round
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("k"))
    return P.sample_values(o.select((F.col("k") * 12345678.5 + 1e7).alias("large"), ((F.col("k") + 1) / 8192).alias("small"),
                                    ((F.col("k") + 1) * 0.0625e-6).alias("tiny"), (F.col("k") * -1e17 - 1e16).alias("huge")))


@query("class_count_guard")
def q_class_count_guard(spark, sf):
    return P.class_count_guard(_t(spark, sf, "labels"), "quality")


# ---- descriptive statistics ---------------------------------------------------
from retainx.operators import stats as D  # noqa: E402


@query("coerce_numeric")
def q_coerce_numeric(spark, sf):
    return D.coerce_numeric(V.telco(spark, sf))


@query("numeric_stats")
def q_numeric_stats(spark, sf):
    return D.numeric_stats(D.coerce_numeric(_t(spark, sf, "lineitem")))


@query("categorical_stats")
def q_categorical_stats(spark, sf):
    return D.categorical_stats(D.coerce_numeric(_t(spark, sf, "orders")))


@query("categorical_values")
def q_categorical_values(spark, sf):
    return D.categorical_values(D.coerce_numeric(_t(spark, sf, "orders")))


@query("categorical_values_screen")
def q_categorical_values_screen(spark, sf):
    return D.categorical_values(D.coerce_numeric(_t(spark, sf, "orders")), SCREENS)


@query("target_distribution")
def q_target_distribution(spark, sf):
    return D.target_distribution(_t(spark, sf, "lineitem"), "l_returnflag")


@query("category_by_target")
def q_category_by_target(spark, sf):
    return D.category_by_target(D.coerce_numeric(V.telco(spark, sf)), "Churn")


@query("category_by_target_screen")
def q_category_by_target_screen(spark, sf):
    return D.category_by_target(D.coerce_numeric(V.telco(spark, sf)), "Churn", SCREENS)


@query("crosstab_cells")
def q_crosstab_cells(spark, sf):
    # thousands of categories by hundreds of classes
    orders = _t(spark, sf, "orders").select("o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"),
                                            F.concat(F.lit("d"), F.date_format("o_orderdate", "MMdd")).alias("day"))
    return D.crosstab_cells(orders, "day")


@query("numeric_histogram")
def q_numeric_histogram(spark, sf):
    return D.numeric_histogram(D.coerce_numeric(_t(spark, sf, "lineitem")), "l_linestatus")


@query("numeric_histogram_screen")
def q_numeric_histogram_screen(spark, sf):
    return D.numeric_histogram(D.coerce_numeric(_t(spark, sf, "lineitem")), "l_linestatus", SCREENS)


@query("histogram_large_values")
def q_histogram_large_values(spark, sf):
    # edges beyond 64-bit tenths, and a column that does not vary
    return D.numeric_histogram(_t(spark, sf, "orders").select(
        (F.col("o_orderkey") * F.lit(1e15)).alias("big"), F.lit(7.0).alias("flat")))


@query("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return D.correlation_matrix(D.coerce_numeric(_t(spark, sf, "lineitem")))


@query("correlation_wide")
def q_correlation_wide(spark, sf):
    # twelve columns, one of them constant and one with missing values
    li = _t(spark, sf, "lineitem")
    return D.correlation_matrix(li.select(
        *D.numeric_columns(li), F.lit(1.0).alias("flat"), (F.col("l_quantity") * 2).alias("twice"), (-F.col("l_tax")).alias("minus"),
        F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("partly")))


def _power(x: Column, n: int) -> Column:
    """x to the power n; the third rounded once, since Java's ``pow`` may miss the last bit, and remainders of large numbers show it."""
    if n < 3:
        return F.pow(x, F.lit(n))
    x = x.cast("double")

    def product(a: Column, b: Column) -> tuple[Column, Column]:
        """(a * b, what its rounding left out)."""
        high = lambda v: F.lit(134217729.0) * v - (F.lit(134217729.0) * v - v)
        p, c, d = a * b, high(a), high(b)
        return p, (a - c) * (b - d) - (((p - c * d) - (a - c) * d) - c * (b - d))

    square, rest = product(x, x)
    cube, more = product(square, x)
    return cube + (more + rest * x)


@query("correlation_many")
def q_correlation_many(spark, sf):
    # beyond the columns whose pairs are aggregated one by one; one far from zero, one with missing values, one constant
    li = _t(spark, sf, "lineitem")
    return D.correlation_matrix(li.select(
        *[(_power(F.col(c) + k, 1 + k % 3) % (97 + k)).alias(f"{c}_{k}") for c in D.numeric_columns(li) for k in range(3)],
        (F.col("l_quantity") + 1e9).alias("far"), F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("partly"), F.lit(0.1).alias("flat")))


@query("dataset_analysis")
def q_dataset_analysis(spark, sf):
    return D.dataset_analysis(V.telco(spark, sf), "Churn")


@query("analysis_bundle")
def q_analysis_bundle(spark, sf):
    return D.analysis_bundle(V.telco(spark, sf), "Churn")


@query("analysis_bundle_screen")
def q_analysis_bundle_screen(spark, sf):
    return D.analysis_bundle(V.telco(spark, sf), "Churn", SCREENS)


@query("churn_kpis")
def q_churn_kpis(spark, sf):
    return D.churn_kpis(V.telco(spark, sf), "Churn")


@query("display_class")
def q_display_class(spark, sf):
    return D.display_classes(V.telco(spark, sf), "Churn")


# ---- row sets -----------------------------------------------------------------
from retainx.operators import features as FE, rows as R  # noqa: E402


@query("preview")
def q_preview(spark, sf):
    return R.preview(V.telco(spark, sf), ["customerID"], 100)


@query("search_any_column")
def q_search_any_column(spark, sf):
    return R.search_any_column(V.telco(spark, sf), "fiber")


@query("class_filter")
def q_class_filter(spark, sf):
    return R.class_filter(V.telco(spark, sf), "Churn", "churn")


@query("random_customer")
def q_random_customer(spark, sf):
    return R.random_customer(V.telco(spark, sf), "Churn", "loyal", ["customerID"], seed=42)


@query("distinct_rows")
def q_distinct_rows(spark, sf):
    return R.distinct_rows(V.telco(spark, sf), ["customerID"])


@query("drop_columns")
def q_drop_columns(spark, sf):
    return R.drop_columns(V.telco(spark, sf), ["customerID", "Churn"])


# ---- features -----------------------------------------------------------------
def _prepared(spark, sf):
    # the chain's later jobs read the deduplicated rows from one checkpoint
    return FE.prepare(V.telco(spark, sf), "Churn", ["customerID"], materialize=True)


def _keyed(spark, sf):
    prep = FE.prepare(V.telco(spark, sf), "Churn", ["customerID"], materialize=True, row_key=True)
    pos, _ = FE.positive_class(prep, "Churn")
    return FE.map_target(prep, "Churn", pos)


def _labelled(spark, sf):
    return _keyed(spark, sf).drop(FE.ROW_KEY)


def _split(spark, sf):
    return FE.train_test_split(_keyed(spark, sf), "label", 0.2, 42, stratify=True, key_cols=[FE.ROW_KEY]).drop(FE.ROW_KEY)


@query("prepare")
def q_prepare(spark, sf):
    return _prepared(spark, sf)


@query("map_target")
def q_map_target(spark, sf):
    t = V.telco(spark, sf)
    pos, _ = FE.positive_class(t, "Churn")
    return FE.map_target(t, "Churn", pos).select("customerID", "Churn", "label")


@query("split_feature_types")
def q_split_feature_types(spark, sf):
    return FE.feature_types_frame(_prepared(spark, sf), "Churn")


@query("normalize_categories")
def q_normalize_categories(spark, sf):
    prep = _prepared(spark, sf)
    _, cat = FE.split_feature_types(prep, "Churn")
    return FE.normalize_categories(prep, cat)


@query("category_domain")
def q_category_domain(spark, sf):
    prep = _prepared(spark, sf)
    _, cat = FE.split_feature_types(prep, "Churn")
    return FE.category_domain(prep, cat)


@query("numeric_ranges")
def q_numeric_ranges(spark, sf):
    prep = _prepared(spark, sf)
    num, _ = FE.split_feature_types(prep, "Churn")
    out = FE.numeric_ranges(prep, num)
    return out.withColumn("mean", F.round("mean", 9))


@query("train_test_split")
def q_train_test_split(spark, sf):
    return _split(spark, sf)


@query("split_few_feature_rows")
def q_split_few_feature_rows(spark, sf):
    # thousands of customers, five different feature rows
    few = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("plan"),
        F.when(F.col("o_orderkey") % 10 < 3, "Yes").otherwise("No").alias("Churn"))
    prep = FE.prepare(few, "Churn", ["id"], materialize=True, row_key=True)
    lab = FE.map_target(prep, "Churn", FE.positive_class(prep, "Churn")[0])
    return FE.train_test_split(lab, key_cols=[FE.ROW_KEY])


@query("impute_median")
def q_impute_median(spark, sf):
    sp = _split(spark, sf)
    num, _ = FE.split_feature_types(sp.drop("label", "is_test"), "Churn")
    med = FE.train_medians(sp.where(~F.col("is_test")), num)
    return FE.impute_median(sp, med)


@query("impute_mode")
def q_impute_mode(spark, sf):
    sp = _split(spark, sf)
    _, cat = FE.split_feature_types(sp.drop("label", "is_test"), "Churn")
    return FE.category_modes(sp.where(~F.col("is_test")), cat)


@query("fill_missing_categories")
def q_fill_missing_categories(spark, sf):
    sp = _split(spark, sf)
    _, cat = FE.split_feature_types(sp.drop("label", "is_test"), "Churn")
    modes = {r["column_name"]: r["mode"] for r in FE.category_modes(sp.where(~F.col("is_test")), cat).collect()}   # one per column
    holes = sp.withColumn("Contract", F.when(F.col("tenure") % 7 != 0, F.col("Contract"))) \
        .withColumn("PaymentMethod", F.when(F.col("tenure") % 5 != 0, F.col("PaymentMethod")))
    return FE.impute_mode(holes, modes)


@query("standard_scale")
def q_standard_scale(spark, sf):
    sp = _split(spark, sf)
    num, _ = FE.split_feature_types(sp.drop("label", "is_test"), "Churn")
    imp = FE.impute_median(sp, FE.train_medians(sp.where(~F.col("is_test")), num))
    stats = FE.scaler_stats(imp.where(~F.col("is_test")), num)
    out = FE.standard_scale(imp, stats)
    return out.select(*[F.round(c, 6).alias(c) if c in num else F.col(c) for c in out.columns])


@query("one_hot")
def q_one_hot(spark, sf):
    sp = _split(spark, sf)
    _, cat = FE.split_feature_types(sp.drop("label", "is_test"), "Churn")
    norm = FE.normalize_categories(sp, cat)
    dom = FE.category_domains(norm.where(~F.col("is_test")), cat)                # categories seen in training
    return FE.one_hot(norm, dom, keep=["label", "is_test"])


@query("derive_total_charges")
def q_derive_total_charges(spark, sf):
    t = V.telco(spark, sf)
    return FE.derive_total_charges(t).select("customerID", "MonthlyCharges", "tenure", "TotalCharges")


@query("balanced_class_weight")
def q_balanced_class_weight(spark, sf):
    return FE.balanced_class_weight(_labelled(spark, sf)).select("Churn", "label", "weight")


# ---- scoring and evaluation -----------------------------------------------------------
from retainx.functions.expr import churn_label, risk_tier  # noqa: E402
from retainx.operators import evaluate as EV, score as SC  # noqa: E402
from retainx.plans import scorecard as CARD  # noqa: E402

# Importances of the full scorecard (points / 100), strongest first: the
# fallback list of the explanation rules.
SCORECARD_IMPORTANCES = [("Contract", 0.35), ("tenure", 0.25), ("InternetService", 0.18), ("PaymentMethod", 0.15),
                         ("TechSupport", 0.12), ("OnlineSecurity", 0.10), ("MonthlyCharges", 0.10), ("SeniorCitizen", 0.08)]


def _scored(spark, sf):
    t = V.telco(spark, sf)
    return SC.score_batch(t, CARD.scorecard_probability(t))


def _scorecard_predictions(spark, sf, terms=None):
    lab = _labelled(spark, sf)
    p = CARD.scorecard_probability(lab, terms)
    return lab.select("label", (p > 0.5).cast("int").alias("prediction"), p.alias("score"))


def _scorecard_long(spark, sf):
    """(algorithm_name, ordinal, label, prediction, score) for the four scorecards in one pass."""
    lab = _labelled(spark, sf)
    structs = []
    for i, (name, terms) in enumerate(CARD.SCORECARDS.items()):
        p = CARD.scorecard_probability(lab, terms)
        structs.append(F.struct(F.lit(name).alias("algorithm_name"), F.lit(i).alias("ordinal"),
                                (p > 0.5).cast("int").alias("prediction"), p.alias("score")))
    return lab.select("label", F.inline(F.array(*structs)))


def _scorecard_registry(spark, sf):
    m = EV.evaluate(_scorecard_long(spark, sf), ["algorithm_name", "ordinal"])
    return EV.mark_best(m.withColumn("training_time", F.lit(0.0)).withColumn("dataset_id", F.lit(1)))


@query("score_batch")
def q_score_batch(spark, sf):
    return _scored(spark, sf)


@query("churn_label")
def q_churn_label(spark, sf):
    p = V.predictions(spark, sf)
    return p.select("id", "churn_probability", churn_label("churn_probability").alias("prediction"))


@query("risk_tier")
def q_risk_tier(spark, sf):
    p = V.predictions(spark, sf)
    return p.select("id", "churn_probability", risk_tier("churn_probability").alias("risk_level"))


@query("batch_summary")
def q_batch_summary(spark, sf):
    return SC.batch_summary(_scored(spark, sf))


@query("share_of_total")
def q_share_of_total(spark, sf):
    counts = _scored(spark, sf).groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("count"))
    return SC.share_of_total(counts, "count", 1)


@query("batch_preview")
def q_batch_preview(spark, sf):
    return SC.batch_preview(_scored(spark, sf), ["customerID"], id_col="customerID")


@query("batch_preview_features")
def q_batch_preview_features(spark, sf):
    out = SC.batch_preview(_scored(spark, sf), ["customerID", "tenure"], id_col="customerID", feature_cols=["Contract", "tenure", "TotalCharges"])
    return out.select("row_index", "customer_identifier", *[F.col("features")[c].alias(c) for c in ("Contract", "tenure", "TotalCharges")])


@query("explain_rules")
def q_explain_rules(spark, sf):
    return SC.explain_long(V.telco(spark, sf), "customerID", SCORECARD_IMPORTANCES)


@query("explain_fallback")
def q_explain_fallback(spark, sf):
    return SC.explain_long(V.telco(spark, sf).drop("Contract"), "customerID", SCORECARD_IMPORTANCES)


@query("customer_identifier")
def q_customer_identifier(spark, sf):
    ev = _t(spark, sf, "events")
    return ev.select("event_id", SC.customer_identifier(None, F.col("event_id")).alias("customer_identifier"))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(_scorecard_predictions(spark, sf))


@query("binary_metrics")
def q_binary_metrics(spark, sf):
    return EV.binary_metrics(_scorecard_predictions(spark, sf))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return EV.roc_auc(_scorecard_predictions(spark, sf))


@query("select_best")
def q_select_best(spark, sf):
    return EV.select_best(EV.evaluate(_scorecard_long(spark, sf), ["algorithm_name", "ordinal"]))


@query("model_comparison")
def q_model_comparison(spark, sf):
    return EV.model_comparison(_scorecard_registry(spark, sf)).select(
        "dataset_id", "algorithm_name", "rank", "accuracy", "precision", "recall", "f1_score", "roc_auc", "is_best",
        "best_algorithm", "total_training_time")


# ---- prediction log, registry, sources and sinks -------------------------------------------
from retainx.operators import history as H  # noqa: E402
from retainx.sources import csv as CSV, sinks as SK  # noqa: E402


@query("history_query")
def q_history_query(spark, sf):
    return H.history_query(V.predictions(spark, sf), user_id=1, search="12", risk_level="High Risk")


@query("history_page")
def q_history_page(spark, sf):
    # a second page of more rows than one screen holds
    return H.history_query(V.predictions(spark, sf), user_id=2, limit=1000, offset=700)


@query("history_cursor")
def q_history_cursor(spark, sf):
    # the same rows as the page at offset 700, by the cursor of the 700 rows before
    preds = V.predictions(spark, sf)
    first = H.history_page(preds, user_id=2, limit=700)
    return H.history_page(preds, user_id=2, after=H.cursor_after(first), limit=1000)


@query("history_with_model")
def q_history_with_model(spark, sf):
    return H.history_with_model(V.predictions(spark, sf), V.model_names(spark, drop_ids=(4,)))


@query("latest_predictions")
def q_latest_predictions(spark, sf):
    return H.latest_predictions(V.predictions(spark, sf), 5)


@query("prediction_count")
def q_prediction_count(spark, sf):
    return H.prediction_count(V.predictions(spark, sf))


@query("resolve_active")
def q_resolve_active(spark, sf):
    return H.resolve_active(V.datasets(spark, sf))


@query("activate")
def q_activate(spark, sf):
    ds = V.datasets(spark, sf)
    return H.activate(ds, H.resolve_active(ds).select("user_id", "id"))


@query("delete_records")
def q_delete_records(spark, sf):
    deleted_models = V.model_names(spark).where(F.col("id") == 4)
    return H.delete_records(_some_without_user(V.predictions(spark, sf)), user_id=3, parents=deleted_models)


def _some_without_user(preds):
    return preds.withColumn("user_id", F.when(F.col("id") % 11 != 0, F.col("user_id")))


@query("delete_by_id")
def q_delete_by_id(spark, sf):
    preds = _some_without_user(V.predictions(spark, sf))
    return H.delete_records(preds, ids=preds.where(F.col("risk_level") == "Low Risk").select("id"))


@query("list_datasets")
def q_list_datasets(spark, sf):
    return H.list_datasets(V.datasets(spark, sf), 2)


@query("search_batch_result")
def q_search_batch_result(spark, sf):
    return H.search_batch_result(_scored(spark, sf), "high")


@query("dashboard_summary")
def q_dashboard_summary(spark, sf):
    kpis = D.churn_kpis(V.telco(spark, sf), "Churn")
    return H.dashboard_summary(kpis, V.predictions(spark, sf), V.model_names(spark), user_id=1)


@query("dashboard")
def q_dashboard(spark, sf):
    return H.dashboard(V.predictions(spark, sf), V.model_names(spark, drop_ids=(4,)), V.model_registry(spark, sf), user_id=1)


@query("csv_source")
def q_csv_source(spark, sf):
    path = shared_dir(spark, "telco_csv") + ".csv"
    V.telco(spark, sf).write.option("header", True).csv(path)
    return CSV.read_customer_csv(spark, path)


@query("csv_quoted_text")
def q_csv_quoted_text(spark, sf):
    # doubled quotes, commas and line breaks in text, 23-digit numbers, true / false
    path = shared_dir(spark, "quoted_csv") + ".csv"
    _t(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('He said "hi",\nthen '), "c_name").alias("note"),
        F.concat(F.lit("12345678901234"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("account"),
        (F.col("c_custkey") % 2 == 0).alias("even")).write.option("header", True).option("escape", '"').csv(path)
    return CSV.read_customer_csv(spark, path, multi_line=True)


@query("history_export_user")
def q_history_export_user(spark, sf):
    return SK.history_export(V.predictions(spark, sf), V.model_names(spark), user_id=4)


@query("history_export")
def q_history_export(spark, sf):
    return SK.history_export(V.predictions(spark, sf), V.model_names(spark, drop_ids=(4,)))


@query("flatten_input_data")
def q_flatten_input_data(spark, sf):
    return SK.flatten_input_data(V.events_input_data(spark, sf))


@query("scored_csv_sink")
def q_scored_csv_sink(spark, sf):
    path = SK.write_scored_csv(_scored(spark, sf), shared_dir(spark, "scored") + ".csv")
    return CSV.read_customer_csv(spark, path)


@query("prediction_log_append")
def q_prediction_log_append(spark, sf):
    path = shared_dir(spark, "prediction_log")
    log = V.predictions(spark, sf)
    SK.append_prediction_log(log.where(F.col("id") % 3 == 0), path, "first")
    for _ in range(2):                                     # the second load is retried
        SK.append_prediction_log(log.where(F.col("id") % 3 != 0), path, "second")
    return SK.read_prediction_log(spark, path, log.schema)


@query("log_inputs_and_factors")
def q_log_inputs_and_factors(spark, sf):
    """One log of two streams' epochs (one replayed with other users) and a batch, with inputs and risk factors."""
    path = shared_dir(spark, "shared_log")
    customers = V.telco(spark, sf).dropDuplicates()
    inputs = F.map_from_arrays(F.array(*[F.lit(c) for c in V.LOG_INPUTS]), F.array(*[F.col(c).cast("string") for c in V.LOG_INPUTS]))
    about = customers.select(F.concat(F.lit("CUST-"), F.expr("substr(customerID, 2)")).alias("customer_identifier"),
                             inputs.alias("input_data"), SC.explain_rules(customers).alias("top_factors"))
    log = V.predictions(spark, sf).join(about, "customer_identifier", "left")
    part = lambda k: log.where(F.col("id") % 4 == k)
    SK.append_prediction_log(part(0), path, 0, "stream-a")
    SK.append_prediction_log(part(1).withColumn("user_id", F.col("user_id") + 50), path, 0, "stream-b")
    SK.append_prediction_log(part(1), path, 0, "stream-b")              # the epoch is replayed, its users have changed
    SK.append_prediction_log(part(2), path, 1, "stream-b")
    SK.append_prediction_log(part(3), path)
    factors = F.transform("top_factors", lambda f: F.concat_ws(":", f["feature"], f["value"], f["impact"], f["importance"].cast("decimal(4,2)").cast("string")))
    return SK.read_prediction_log(spark, path).select(
        "id", "user_id", "model_id", "customer_identifier", "prediction", "churn_probability", "risk_level", "created_at",
        *[F.col("input_data")[c].alias(c) for c in V.LOG_INPUTS], F.array_join(factors, "|").alias("factors"))


from retainx.operators import lifecycle as LC  # noqa: E402
from retainx.sources.snapshots import SnapshotStore  # noqa: E402


@query("activate_committed")
def q_activate_committed(spark, sf):
    """The dataset registry before and after an activation was committed, as a new session reads them."""
    path = shared_dir(spark, "registry")
    ds = V.datasets(spark, sf)
    before = SnapshotStore(spark, path).commit({"datasets": ds})
    newest = ds.where(F.col("user_id") != 3).groupBy("user_id").agg(F.max("id").alias("id"))
    LC.set_active(SnapshotStore(spark, path), "datasets", newest)
    later = SnapshotStore(spark.newSession(), path)
    rows = [later.table("datasets", later.snapshot(v)).select(F.lit(v).alias("version"), "id", "user_id", "is_active")
            for v in later.versions()]
    assert before.version == 1 and len(rows) == 2
    return rows[0].unionByName(rows[1])


@query("delete_cascade")
def q_delete_cascade(spark, sf):
    """What is left of users, datasets, models and predictions when users and datasets go with all that belongs to them."""
    store = SnapshotStore(spark, shared_dir(spark, "relation"))
    tables = V.relation(spark, sf)
    store.commit(tables)
    LC.delete(store, {"users": tables["users"].where(F.col("id") % 50 == 7).select("id"),
                      "datasets": tables["datasets"].where(F.col("id") % 90 == 11).select("id")})
    left = store.tables()
    none = F.lit(None).cast("bigint")
    return left["users"].select(F.lit("users").alias("table_name"), "id", none.alias("user_id"), none.alias("dataset_id"), none.alias("model_id")) \
        .unionByName(left["datasets"].select(F.lit("datasets").alias("table_name"), "id", "user_id", none.alias("dataset_id"), none.alias("model_id"))) \
        .unionByName(left["models"].select(F.lit("models").alias("table_name"), "id", "user_id", "dataset_id", none.alias("model_id"))) \
        .unionByName(left["predictions"].select(F.lit("predictions").alias("table_name"), "id", "user_id", "dataset_id", "model_id"))


# ---- Spark ML: training, comparison, scoring (rows-only checks) --------------------------
from retainx.operators import models as M  # noqa: E402
from retainx.params import ALGORITHMS  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

_TRAINED: dict = {}


def _trained(spark, sf, algorithms=ALGORITHMS):
    """Models trained on the telco view, kept per session like a model cache."""
    key, whole = (spark.sparkContext.applicationId, sf, tuple(algorithms)), (spark.sparkContext.applicationId, sf, tuple(ALGORITHMS))
    if key not in _TRAINED and whole in _TRAINED:                     # some of the models that are there
        ts = _TRAINED[whole]
        rows = ts.metrics.drop("is_best").where(F.col("algorithm_name").isin(*algorithms))
        best = EV.mark_best(rows).select(*ts.metrics.columns)
        _TRAINED[key] = M.TrainedSet(ts.schema, ts.prep, {a: ts.models[a] for a in algorithms}, best, ts.names, ts.total_training_time)
    if key not in _TRAINED:
        _TRAINED[key] = M.train_and_compare(V.telco(spark, sf), "Churn", ["customerID"], list(algorithms))
    return _TRAINED[key]


@query("assemble_features")
def q_assemble_features(spark, sf):
    schema, prep, vec = M.fit_features(V.telco(spark, sf), "Churn", ["customerID"])
    names = F.array(*[F.lit(n) for n in M.feature_names(prep, schema)])
    return vec.select(FE.ROW_KEY, "is_test", F.explode(F.arrays_zip(
        names.alias("feature"), vector_to_array("features").alias("value"))).alias("x")) \
        .select(F.col(FE.ROW_KEY).alias("row_key"), "is_test", F.col("x.feature").alias("feature"), F.round("x.value", 6).alias("value"))


def _one(name):
    def run(spark, sf):
        return _trained(spark, sf, (name,)).metrics        # fits this model only
    return run


QUERIES["logistic_regression"] = _one("Logistic Regression")
QUERIES["decision_tree"] = _one("Decision Tree")
QUERIES["random_forest"] = _one("Random Forest")
QUERIES["gradient_boosting"] = _one("Gradient Boosting")


@query("train_and_compare")
def q_train_and_compare(spark, sf):
    return _trained(spark, sf).metrics


@query("feature_importance")
def q_feature_importance(spark, sf):
    ts = _trained(spark, sf)
    rows = [(name, i + 1, f, v) for name, m in ts.models.items() for i, (f, v) in enumerate(M.importances(m, ts.names))]
    return spark.createDataFrame(rows, "algorithm_name string, rank int, feature string, importance double")


@query("logistic_optimum")
def q_logistic_optimum(spark, sf):
    """The penalised gradient at the fitted coefficients, to 4 decimals: zero at the unique optimum."""
    model = _trained(spark, sf, ("Logistic Regression",)).models["Logistic Regression"]
    schema, prep, vec = M.fit_features(V.telco(spark, sf), "Churn", ["customerID"])
    scored = model.transform(vec.where(~F.col("is_test")))
    names = [*M.feature_names(prep, schema), "(intercept)"]
    beta = [*[float(c) * model.getRegParam() for c in model.coefficients], 0.0]
    error = F.col("weight") * (M.churn_probability(scored) - F.col("label"))
    terms = scored.select("weight", F.posexplode(F.transform(
        F.concat(vector_to_array("features"), F.array(F.lit(1.0))), lambda x: x * error)).alias("i", "g"))
    sums = terms.groupBy("i").agg((F.sum("g") / F.sum("weight")).alias("g"))
    of = F.array(*[F.lit(n) for n in names])
    penalty = F.array(*[F.lit(b) for b in beta])
    return sums.select(F.get(of, F.col("i")).alias("feature"), (F.round(F.col("g") + F.get(penalty, F.col("i")), 4) + 0.0).alias("gradient"))


from retainx.operators import trees as TR  # noqa: E402

_TREES = ("Decision Tree", "Random Forest", "Gradient Boosting")


def _node_tables(spark, sf):
    """(algorithm, model, its nodes, whether boosted) of the trained tree models, read back from stored copies."""
    ts = _trained(spark, sf)
    return [(a, ts.models[a], TR.export_nodes(spark, ts.models[a], ts.names), a == "Gradient Boosting") for a in _TREES], ts


def _all_of(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("tree_descent")
def q_tree_descent(spark, sf):
    """Test rows by algorithm and label, and how many the walk down the stored nodes scores otherwise than the model."""
    _, _, vec = M.fit_features(V.telco(spark, sf), "Churn", ["customerID"])
    test = vec.where("is_test").select(FE.ROW_KEY, "label", "features")
    out = []
    for name, model, nodes, boosted in _node_tables(spark, sf)[0]:
        ours = TR.scores_by_nodes(test, nodes, TR.max_depth(nodes), boosted, FE.ROW_KEY)
        scored = model.transform(test)
        both = scored.select(FE.ROW_KEY, "label", M.churn_probability(scored).alias("p")).join(ours, FE.ROW_KEY, "left")
        out.append(both.groupBy(F.lit(name).alias("algorithm_name"), "label").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(F.abs(F.col("p") - F.col("score")) < 1e-9, F.lit(False))).alias("disagreements")))
    return _all_of(out)


@query("tree_importances")
def q_tree_importances(spark, sf):
    """Features by algorithm, those whose importance by the stored nodes is not the model's, and the sum of importances."""
    out = []
    tables, ts = _node_tables(spark, sf)
    for name, model, nodes, boosted in tables:
        theirs = spark.createDataFrame(list(zip(ts.names, [float(x) for x in model.featureImportances.toArray()])), "feature string, theirs double")
        both = theirs.join(TR.importances_by_nodes(nodes, boosted), "feature", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        out.append(both.agg(F.lit(name).alias("algorithm_name"), F.count(F.lit(1)).alias("features"),
                            F.count_if(F.abs(F.col("theirs") - F.col("importance")) > 1e-9).alias("disagreements"),
                            F.round(F.sum("importance"), 9).alias("total")))
    return _all_of(out)


@query("tree_leaf_rows")
def q_tree_leaf_rows(spark, sf):
    """The decision tree's training rows by label, and leaves whose rows or (balanced) share of class 1 are not those stored."""
    _, _, vec = M.fit_features(V.telco(spark, sf), "Churn", ["customerID"])
    nodes = next(n for a, _, n, _ in _node_tables(spark, sf)[0] if a == "Decision Tree")
    train = vec.where("NOT is_test")
    leaves = TR.descend(train, nodes, TR.max_depth(nodes), FE.ROW_KEY).join(train.select(FE.ROW_KEY, "label", "weight"), FE.ROW_KEY)
    seen = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * F.col("label")).alias("one"), F.sum("weight").alias("w"),
                                      F.count_if(F.col("label") == 1).alias("positives"))
    both = nodes.where("left IS NULL").join(seen, "node", "left")
    wrong = ~F.coalesce((F.col("n") == F.col("rows")) & (F.abs(F.col("one") / F.col("w") - F.col("answer")) < 1e-9), F.lit(False))
    return both.agg(F.sum("n").alias("rows"), F.sum("positives").alias("positives"), F.count_if(wrong).alias("wrong_leaves"))


@query("decision_tree_root")
def q_decision_tree_root(spark, sf):
    """The decision tree's first split: its feature, gain and weighted Gini impurity."""
    nodes = next(n for a, _, n, _ in _node_tables(spark, sf)[0] if a == "Decision Tree")
    return nodes.where("node = 0").select("feature", F.round("gain", 6).alias("gain"), F.round("impurity", 6).alias("impurity"), "rows")


@query("training_time")
def q_training_time(spark, sf):
    return _trained(spark, sf).metrics.select("algorithm_name", "training_time", "total_training_time")


def _registry(spark, sf):
    """Registry rows and packages of two trainings of one dataset, newest last."""
    base = shared_dir(spark, "models")
    first = M.register_models(_trained(spark, sf, ("Logistic Regression",)), f"{base}/1", dataset_id=1, user_id=1)
    second = M.register_models(_trained(spark, sf, ("Decision Tree", "Logistic Regression")), f"{base}/2", dataset_id=1, user_id=1, first_id=2)
    return M.add_to_registry(first, second)


def _active_package(spark, sf):
    row = M.active_model(_registry(spark, sf)).where(F.col("user_id") == 1).first()       # one row per user
    return M.load_package(spark, row["model_path"])


@query("active_models")
def q_active_models(spark, sf):
    reg = V.model_registry(spark, sf)
    return M.active_model_details(reg.select("*", (F.col("id") % 2111 == 5).alias("is_active"), (F.col("accuracy") / 2 + 50).alias("roc_auc"),
                                             (F.col("id") % 7).alias("dataset_id")))


@query("linear_scores")
def q_linear_scores(spark, sf):
    """Test rows by label, and how many the logistic model's coefficients score otherwise than the model."""
    model = _trained(spark, sf, ("Logistic Regression",)).models["Logistic Regression"]
    _, _, vec = M.fit_features(V.telco(spark, sf), "Churn", ["customerID"])
    scored = model.transform(M.linear_scores(vec.where("is_test"), list(model.coefficients), model.intercept))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(
        F.abs(F.col("score") - M.churn_probability(scored)) > 1e-9).alias("disagreements"))


@query("stored_scores")
def q_stored_scores(spark, sf):
    """Customers scored by each stored package, and how many otherwise than by the model it was stored from."""
    t, base, out = V.telco(spark, sf), shared_dir(spark, "packages"), []
    ts = _trained(spark, sf, ("Decision Tree", "Logistic Regression"))
    for i, name in enumerate(ts.models):
        pm, schema, _ = M.load_package(spark, M.save_package(ts, name, f"{base}/{i}"))
        pct = lambda df, by: df.select("customerID", "TotalCharges", F.col("`Churn_Probability_%`").alias("p"), "Risk_Level", F.lit(by).alias("by"))
        both = pct(M.score_package(t, pm, schema), "stored").unionByName(pct(M.score_with_model(t, ts, name), "fresh"))
        # each distinct row once, with the sides it is found on: both are scored once and dealt out once
        sides = both.groupBy("customerID", "TotalCharges", "p", "Risk_Level").agg(
            F.bool_or(F.col("by") == "stored").alias("stored"), F.bool_or(F.col("by") == "fresh").alias("fresh"))
        out.append(sides.where("stored").agg(F.lit(name).alias("algorithm_name"), F.count(F.lit(1)).alias("customers"),
                                             F.count_if(~F.col("fresh")).alias("disagreements")))
    return _all_of(out)


@query("customers_as_typed")
def q_customers_as_typed(spark, sf):
    """C08 against the batch path: customers typed by hand get the scores of their rows, with retention, tier and label to match."""
    pm, schema, _ = _active_package(spark, sf)
    t = V.telco(spark, sf).dropDuplicates()
    typed = M.score_customers(_typed_by_hand(t), pm, schema, id_col="customerID")
    derived = FE.derive_total_charges(t.withColumn("TotalCharges", F.col("TotalCharges").try_cast("double")))
    batch = M.score_package(derived, pm, schema).select(F.col("customerID").alias("customer_identifier"), F.col("`Churn_Probability_%`").alias("p"))
    both = typed.join(batch, "customer_identifier", "left")
    p = F.col("churn_probability")
    return both.agg(F.count(F.lit(1)).alias("customers"), F.count_if(~F.coalesce(p == F.col("p"), F.lit(False))).alias("other_probability"),
                    F.count_if(F.abs(p + F.col("retention_probability") - 100) > 1e-9).alias("other_retention"),
                    F.count_if(risk_tier("churn_probability") != F.col("risk_level")).alias("other_tier"),
                    F.count_if(churn_label("churn_probability") != F.col("prediction")).alias("other_label"))


@query("model_registry")
def q_model_registry(spark, sf):
    return _registry(spark, sf).drop("created_at", "model_path", "training_time")


@query("score_customers")
def q_score_customers(spark, sf):
    pm, schema, meta = _active_package(spark, sf)
    factors = [tuple(x) for x in json.loads(meta["metrics"]["feature_importances"])]
    return M.score_customers(_typed_by_hand(V.telco(spark, sf)), pm, schema, factors, id_col="customerID")


@query("active_model_schema")
def q_active_model_schema(spark, sf):
    return M.schema_frame(spark, _active_package(spark, sf)[1])


@query("model_store")
def q_model_store(spark, sf):
    pm, schema, _ = _active_package(spark, sf)
    return M.score_package(V.telco(spark, sf), pm, schema)


def _schema(spark, sf):
    return FE.fit_schema(V.telco(spark, sf), "Churn", ["customerID"])[0]


@query("normalize_scoring_input")
def q_normalize_scoring_input(spark, sf):
    schema = _schema(spark, sf)
    return FE.normalize_scoring_input(_typed_by_hand(V.telco(spark, sf)), schema)


def _typed_by_hand(t):
    """The same customers typed by hand: other column-name case, lower-case categories, blank numbers."""
    return t.select("customerID", F.col("Contract").alias("CONTRACT"), F.lower("InternetService").alias("internetservice"),
                    F.upper("PaymentMethod").alias("PaymentMethod"), "TechSupport", "OnlineSecurity",
                    F.col("tenure").cast("string").alias("Tenure"), "MonthlyCharges", "TotalCharges", "SeniorCitizen")


@query("align_batch")
def q_align_batch(spark, sf):
    return FE.align_batch(V.telco(spark, sf).drop("PaymentMethod", "TotalCharges"), _schema(spark, sf))


@query("history_export_compact")
def q_history_export_compact(spark, sf):
    return SK.history_export(V.predictions(spark, sf), V.model_names(spark), layout="compact")
