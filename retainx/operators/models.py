"""Model training and comparison on Spark ML.

Preprocessing is a fitted ``PipelineModel``: a SQLTransformer carrying the
exact train-set medians and population scaling (scikit-learn semantics),
StringIndexer (alphabetical, unseen -> extra index) and OneHotEncoder (the
extra index dropped, so unseen categories give all zeros), then a
VectorAssembler. Feature vectors are cached once and shared by every
algorithm; only per-model metrics and parameters return to the driver.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from retainx.operators import evaluate as EV
from retainx.operators import features as FE
from retainx.functions import sql as SQ
from retainx.functions.columns import qcol
from retainx.functions.expr import py_round
from retainx.operators.history import resolve_active
from retainx.operators.score import customer_identifier, explain_rules, score_batch
from retainx.params import ALGORITHMS, Params

P = Params()

#: Vectors that one task of a fit holds at most, where there are more than the cores share evenly.
TASK_VECTORS = 500_000


def _sql_ident(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def prep_pipeline(schema: FE.FeatureSchema, medians: dict, scaler: dict, modes: dict | None = None,
                  params: Params = P) -> Pipeline:
    """numeric impute+scale and categorical normalise as SQL, then index,
    one-hot and assemble into ``features``."""
    sel = ["*"]
    num_out, cat_out = [], []
    for i, c in enumerate(schema.numerical_cols):
        x = f"CAST({_sql_ident(c)} AS DOUBLE)"
        filled = f"coalesce(CASE WHEN NOT isnan({x}) THEN {x} END, {_lit(medians.get(c) or 0.0)})"
        mean, std = scaler.get(c, (0.0, 1.0))
        sel.append(f"({filled} - {_lit(mean)}) / {_lit(std)} AS __num_{i}")
        num_out.append(f"__num_{i}")
    for i, c in enumerate(schema.categorical_cols):
        x = f"CAST({_sql_ident(c)} AS STRING)"
        if params.null_category == "mode" and modes and c in modes:
            x = f"coalesce({x}, '{modes[c].replace(chr(39), chr(39) * 2)}')"
        else:
            x = f"coalesce({x}, 'nan')"
        sel.append(f"{SQ.strip_ws(x)} AS __cat_{i}")
        cat_out.append(f"__cat_{i}")
    stages = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    vec_in = list(num_out)
    if cat_out:
        idx = [f"{c}_idx" for c in cat_out]
        ohe = [f"{c}_ohe" for c in cat_out]
        stages += [StringIndexer(inputCols=cat_out, outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]
        vec_in += ohe
    stages.append(VectorAssembler(inputCols=vec_in, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def feature_names(prep: PipelineModel, schema: FE.FeatureSchema) -> list[str]:
    """Numeric names, then ``<column>_<category>`` per one-hot slot (sorted)."""
    names = list(schema.numerical_cols)
    for st in prep.stages:
        if hasattr(st, "labelsArray"):
            for c, labels in zip(schema.categorical_cols, st.labelsArray):
                names += [f"{c}_{v}" for v in labels]
    return names


def make_estimator(name: str, params: Params, n_train: int):
    """M01-M04 with the reference hyper-parameters (see README for the mapping)."""
    common = dict(featuresCol="features", labelCol="label")
    if name == "Logistic Regression":
        # scikit-learn's C * sum(w * loss) + |b|^2 / 2 equals Spark's objective
        # with regParam = 1 / (C * sum(w)); balanced weights sum to n.
        # The optimum is unique, so the tolerance decides how many digits are right.
        return LogisticRegression(maxIter=params.lr_max_iter, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, weightCol="weight", tol=params.lr_tol, **common)
    if name == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=params.dt_max_depth, minInstancesPerNode=params.dt_min_leaf,
                                      maxBins=params.max_bins, weightCol="weight", seed=params.seed, checkpointInterval=10,
                                      cacheNodeIds=True, **common)
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=params.rf_trees, maxDepth=params.rf_max_depth,
                                      minInstancesPerNode=params.rf_min_leaf, featureSubsetStrategy="sqrt", maxBins=params.max_bins,
                                      weightCol="weight", seed=params.seed, checkpointInterval=10,
                                      cacheNodeIds=True, maxMemoryInMB=1024, **common)
    if name == "Gradient Boosting":
        return GBTClassifier(maxIter=params.gb_rounds, stepSize=params.gb_step, maxDepth=params.gb_max_depth,
                             subsamplingRate=params.gb_subsample, maxBins=params.max_bins, seed=params.seed, checkpointInterval=10,
                             **common)
    return None


def importances(model, names: list[str], top: int | None = None) -> list[tuple[str, float]]:
    """Tree importances or signed LR coefficients, rounded to 4, by |value|."""
    if hasattr(model, "featureImportances"):
        raw = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        raw = model.coefficients.toArray().tolist()
    else:
        return []
    pairs = [(n, round(float(v), 4)) for n, v in zip(names, raw)]
    pairs.sort(key=lambda p: -abs(p[1]))          # stable: ties keep feature order
    return pairs[:top]


def churn_probability(pred: DataFrame) -> F.Column:
    return vector_to_array(F.col("probability"))[1]


class TrainedSet:
    """Everything one training run produces (the model package)."""

    def __init__(self, schema, prep, models, metrics, names, total_time):
        self.schema, self.prep, self.models = schema, prep, models
        self.metrics, self.names, self.total_training_time = metrics, names, total_time


def dealt_for_fits(vec: DataFrame, rows: int) -> DataFrame:
    """Vectors in no more partitions than the cluster has cores (or ``rows`` needs, at ``TASK_VECTORS`` each).

    A tree fit builds and merges one histogram of every node per task and level, whatever
    rows the task holds, so that its cost would grow with the number of stored files."""
    return vec.coalesce(max(vec.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_VECTORS)))


def fit_features(df: DataFrame, target: str, id_cols=(), params: Params = P, keep: bool = False):
    """Prepare, label, split, fit the preprocessing on train, vectorise both sides.

    ``keep`` persists the vectors for fits that read them many times; the caller unpersists them."""
    # the deduplicated rows are written once to the shared folder and read by
    # every step below (no session-long cache of the full table to release)
    schema, prepared = FE.fit_schema(df, target, id_cols, params, materialize=True, row_key=True)
    labelled = FE.map_target(prepared, target, schema.positive)
    # each step reads the split rows again: kept, so that hashes are computed and numbers parsed once
    split = FE.train_test_split(labelled, "label", params.test_size, params.seed, stratify=True, key_cols=[FE.ROW_KEY]) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    train = split.where(~F.col("is_test"))
    medians = FE.train_medians(train, schema.numerical_cols, params)
    imputed = FE.impute_median(train, medians)
    scaler = FE.scaler_stats(imputed, schema.numerical_cols)
    modes = None
    if params.null_category == "mode" and schema.categorical_cols:
        modes = {r["column_name"]: r["mode"] for r in FE.category_modes(train, schema.categorical_cols).collect()}
    prep = prep_pipeline(schema, medians, scaler, modes, params).fit(train)
    vec = prep.transform(FE.balanced_class_weight(split)).select(FE.ROW_KEY, "label", "weight", "is_test", "features")
    if keep:
        vec = dealt_for_fits(vec, prepared.count()).persist(StorageLevel.MEMORY_AND_DISK)
        vec.count()                                                   # from here on the vectors are read, not the split rows
    split.unpersist()
    return schema, prep, vec


def _timed_fit(est, train):
    """Wall clock of one ``fit`` (3 decimals)."""
    t0 = time.perf_counter()
    model = est.fit(train)
    return model, round(time.perf_counter() - t0, 3)


def train_and_compare(df: DataFrame, target: str, id_cols=(), algorithms=ALGORITHMS, params: Params = P) -> TrainedSet:
    """Preprocess once, fit every known algorithm (unknown names are
    skipped), time each fit, evaluate all on the test rows in one pass and
    flag the best by 0.5 F1 + 0.5 AUC (the first wins ties)."""
    spark = df.sparkSession
    schema, prep, vec = fit_features(df, target, id_cols, params, keep=True)
    train, test = vec.where(~F.col("is_test")), vec.where(F.col("is_test"))
    n_train = train.count()
    names = feature_names(prep, schema)
    models, timings, preds = {}, {}, []
    todo = [(i, name, est) for i, name in enumerate(algorithms)
            if (est := make_estimator(name, params, n_train)) is not None]
    t_all = time.perf_counter()
    # One after another by default, so that a fit's time is its own; the fits are
    # independent, and ``fit_parallelism`` submits them from several driver
    # threads, as CrossValidator(parallelism=...) does.
    fitted = {}
    with ThreadPoolExecutor(max_workers=max(1, min(len(todo), params.fit_parallelism))) as pool:
        # boosting rounds are strictly sequential: the critical path, start it first
        first = sorted(todo, key=lambda t: t[1] != "Gradient Boosting")
        futs = {name: pool.submit(inheritable_thread_target(spark)(_timed_fit), est, train)
                for _, name, est in first}
        for _, name, _ in todo:
            fitted[name] = futs[name].result()
    for i, name, _ in todo:
        models[name], timings[name] = fitted[name]
        p = models[name].transform(test)
        preds.append(p.select(F.lit(name).alias("algorithm_name"), F.lit(i).alias("ordinal"), "label",
                              F.col("prediction").cast("int").alias("prediction"), churn_probability(p).alias("score")))
    total = round(time.perf_counter() - t_all, 2)
    if not preds:
        return TrainedSet(schema, prep, {}, None, names, total)
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    # Score the test rows once for all metric passes (models are shipped once).
    allp = allp.persist(StorageLevel.MEMORY_AND_DISK)
    met = EV.evaluate(allp, ["algorithm_name", "ordinal"], params)
    met = spark.createDataFrame(met.collect(), met.schema)        # one row per algorithm
    allp.unpersist()
    imps = {n: json.dumps(importances(m, names, params.top_importances)) for n, m in models.items()}
    extra = spark.createDataFrame([(n, timings[n], imps[n]) for n in models],
                                  "algorithm_name string, training_time double, feature_importances string")
    met = EV.mark_best(met.join(extra, "algorithm_name")).withColumn("total_training_time", F.lit(total))
    metrics = spark.createDataFrame(met.collect(), met.schema).orderBy("ordinal")
    vec.unpersist()
    return TrainedSet(schema, prep, models, metrics, names, total)


def dealt_for_scores(df: DataFrame) -> DataFrame:
    """Rows dealt over the session's shuffle partitions: a small compressed file of many rows is read by
    few tasks, and a row's scoring costs far more than its transport."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def score_with_model(df: DataFrame, trained: TrainedSet, algorithm: str) -> DataFrame:
    """C01 / C08 with a trained model: align the batch to the fitted schema,
    transform, and add label, percentages and tier next to the original columns."""
    keep = df.select(*[F.col("`" + c + "`").alias(f"__orig_{i}") for i, c in enumerate(df.columns)],
                     *[F.col("`" + c + "`") for c in df.columns])
    aligned = FE.align_batch(dealt_for_scores(keep), trained.schema)
    pred = trained.models[algorithm].transform(trained.prep.transform(aligned))
    base = pred.select(*[F.col(f"__orig_{i}").alias(c) for i, c in enumerate(df.columns)],
                       churn_probability(pred).alias("_p"))
    return score_batch(base, F.col("_p")).drop("_p")


def score_package(df: DataFrame, pipeline: PipelineModel, schema: FE.FeatureSchema) -> DataFrame:
    """C01 from a stored package alone: original columns, label, percentages and tier."""
    keep = df.select(*[qcol(c).alias(f"__orig_{i}") for i, c in enumerate(df.columns)], *[qcol(c) for c in df.columns])
    pred = pipeline.transform(FE.align_batch(dealt_for_scores(keep), schema))
    base = pred.select(*[F.col(f"__orig_{i}").alias(c) for i, c in enumerate(df.columns)], churn_probability(pred).alias("_p"))
    return score_batch(base, F.col("_p")).drop("_p")


def score_customers(df: DataFrame, pipeline: PipelineModel, schema: FE.FeatureSchema, importances_=None,
                    id_col: str | None = None) -> DataFrame:
    """Customers as typed in (other letter case, blank or bad numbers),
    scored one by one: identifier, label, churn percentage, retention as
    100 minus it, tier and risk factors."""
    typed = FE.normalize_scoring_input(dealt_for_scores(df), schema)
    pred = pipeline.transform(typed)
    keep = [c for c in typed.columns]
    scored = score_batch(pred.select(*[qcol(c) for c in keep], churn_probability(pred).alias("_p")), F.col("_p"))
    ident = customer_identifier(qcol(id_col).cast("string") if id_col and id_col in keep else None,
                                *[qcol(c) for c in schema.feature_columns])
    pct = qcol("Churn_Probability_%")
    return scored.select(ident.alias("customer_identifier"), qcol("Predicted_Churn").alias("prediction"),
                         pct.alias("churn_probability"), py_round(F.lit(100.0) - pct, 1).alias("retention_probability"),
                         qcol("Risk_Level").alias("risk_level"), explain_rules(scored, importances_).alias("top_factors"))


def save_package(trained: TrainedSet, algorithm: str, path: str) -> str:
    """Preprocessing + classifier as one PipelineModel, plus the fitted
    schema, metrics and importances as JSON (class values keep their types)."""
    pm = PipelineModel(stages=[trained.prep, trained.models[algorithm]])
    pm.write().overwrite().save(path + "/pipeline")
    spark = trained.metrics.sparkSession
    row = next(r for r in trained.metrics.collect() if r["algorithm_name"] == algorithm)     # one row per algorithm
    meta = {"algorithm_name": algorithm, "feature_names": trained.names, "schema": trained.schema.to_dict(), "metrics": row.asDict()}
    spark.createDataFrame([(json.dumps(meta, default=_json_value),)], "metadata string").write.mode("overwrite").json(path + "/metadata")
    return path


def _json_value(v):
    if isinstance(v, decimal.Decimal | datetime.date | datetime.datetime):
        return {"type": type(v).__name__, "value": str(v)}
    raise TypeError(f"a class value of type {type(v).__name__} can't be stored")


def _python_value(d: dict):
    kinds = {"Decimal": decimal.Decimal, "date": datetime.date.fromisoformat, "datetime": datetime.datetime.fromisoformat}
    return kinds[d["type"]](d["value"]) if set(d) == {"type", "value"} and d["type"] in kinds else d


def load_package(spark, path: str) -> tuple[PipelineModel, FE.FeatureSchema, dict]:
    """(pipeline, fitted schema, metadata) of a stored package: all that scoring needs."""
    pm = PipelineModel.load(path + "/pipeline")
    meta = json.loads(spark.read.json(path + "/metadata").first()["metadata"], object_hook=_python_value)
    return pm, FE.FeatureSchema.from_dict(meta["schema"]), meta


def register_models(trained: TrainedSet, base: str, dataset_id: int, user_id: int, first_id: int = 1) -> DataFrame:
    """Store every model's package under ``base`` and return its registry
    rows; the best model is the active one."""
    spark = trained.metrics.sparkSession
    rows = trained.metrics.orderBy("ordinal").collect()                 # one row per algorithm
    paths = [save_package(trained, r["algorithm_name"], f"{base.rstrip('/')}/model-{first_id + i}") for i, r in enumerate(rows)]
    ids = spark.createDataFrame([(r["algorithm_name"], first_id + i, p) for i, (r, p) in enumerate(zip(rows, paths))],
                                "algorithm_name string, id long, model_path string")
    return trained.metrics.join(ids, "algorithm_name").select(
        "id", F.lit(dataset_id).cast("bigint").alias("dataset_id"), F.lit(user_id).cast("bigint").alias("user_id"), "algorithm_name",
        "accuracy", "precision", "recall", "f1_score", "roc_auc", "tp", "fp", "fn", "tn", "feature_importances", "training_time",
        "model_path", "is_best", F.col("is_best").alias("is_active"), F.current_timestamp().alias("created_at"))


def add_to_registry(registry: DataFrame, added: DataFrame) -> DataFrame:
    """The registry with new rows; earlier models of the same datasets are no longer active, nor the best."""
    fresh = added.select("dataset_id").distinct()
    old = registry.join(fresh.withColumn("_new", F.lit(True)), "dataset_id", "left") \
        .withColumn("is_active", F.col("is_active") & F.col("_new").isNull()) \
        .withColumn("is_best", F.col("is_best") & F.col("_new").isNull()).select(*added.columns)
    return old.unionByName(added)


def active_model(registry: DataFrame) -> DataFrame:
    """Of each user the active model, else the one with the highest F1."""
    return resolve_active(registry, [F.col("f1_score").desc(), F.col("id").desc()])


def active_model_details(registry: DataFrame) -> DataFrame:
    """Of each user the active model (else the one with the highest F1) with what the scoring form shows of it."""
    return active_model(registry).select("user_id", F.col("id").alias("model_id"), "algorithm_name", "accuracy", "f1_score", "roc_auc", "dataset_id")


def linear_scores(vectors: DataFrame, coefficients: list[float], intercept: float, features: str = "features") -> DataFrame:
    """``vectors`` with ``score``: the logistic of the weighted sum, from a stored model's numbers alone."""
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    terms = F.zip_with(vector_to_array(features), weights, lambda x, w: x * w)
    return vectors.withColumn("score", 1.0 / (1.0 + F.exp(-(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + F.lit(float(intercept))))))


def schema_frame(spark, schema: FE.FeatureSchema) -> DataFrame:
    """The fitted feature schema as rows: kind, range, default and domain
    of every feature (bounded by the column count and domains)."""
    rows = []
    for i, c in enumerate(schema.feature_columns):
        if c in schema.numerical_cols:
            r = schema.ranges.get(c, {})
            rows.append((i, c, "numerical", r.get("min"), r.get("max"), round(r.get("mean"), 9), r.get("median"), None, None))
        else:
            dom = schema.domains.get(c, [])
            rows.append((i, c, "categorical", None, None, None, None, schema.defaults.get(c), dom))
    return spark.createDataFrame(rows, "ordinal int, column_name string, kind string, min double, max double, mean double, "
                                       "median double, default_category string, categories array<string>")
