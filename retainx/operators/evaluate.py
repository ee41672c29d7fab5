"""Model evaluation and selection.

Metrics are conditional sums in one aggregate; ROC AUC is exact with tied
scores averaged, computed from distinct-score counts and a bucketed prefix
sum (no global sort through one task). Every function takes a ``model``
key column, so several models are evaluated in the same pass.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from retainx.functions.expr import py_round
from retainx.params import Params
from retainx.plans.ranking import prefix_sums

P = Params()


def _counts(pred: DataFrame, keys) -> DataFrame:
    y, p = F.col("label").cast("int"), F.col("prediction").cast("int")
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return pred.groupBy(*keys).agg(s((y == 1) & (p == 1)).alias("tp"), s((y == 0) & (p == 1)).alias("fp"),
                                   s((y == 1) & (p == 0)).alias("fn"), s((y == 0) & (p == 0)).alias("tn"))


def confusion_matrix(pred: DataFrame, keys=()) -> DataFrame:
    """The four cells (actual, predicted, count) of [[tn, fp], [fn, tp]]."""
    c = _counts(pred, list(keys))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("count"))
                      for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*keys, F.inline(cells))


def binary_metrics(pred: DataFrame, keys=(), params: Params = P) -> DataFrame:
    """Accuracy, precision, recall, F1 in percent (zero division -> 0)."""
    c = _counts(pred, list(keys))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    d = params.metric_decimals
    return c.select(*keys, "tp", "fp", "fn", "tn",
                    py_round(ratio(tp + tn, tp + tn + fp + fn) * 100.0, d).alias("accuracy"),
                    py_round(ratio(tp, tp + fp) * 100.0, d).alias("precision"),
                    py_round(ratio(tp, tp + fn) * 100.0, d).alias("recall"),
                    py_round(ratio(2 * tp, 2 * tp + fp + fn) * 100.0, d).alias("f1_score"))


def roc_auc(pred: DataFrame, keys=(), params: Params = P) -> DataFrame:
    """Area under the ROC curve of ``score``, ties averaged; falls back
    to accuracy when the labels hold a single class.

    Runs eagerly on one read of the input: the counts per distinct score are
    kept for the passes of the prefix sum; the result has one row per key."""
    keys = list(keys)
    y, p = F.col("label").cast("int"), F.col("prediction").cast("int")
    vc = pred.groupBy(*keys, "score").agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg"),
        F.count_if(y == p).alias("hit")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranked = prefix_sums(vc, keys, "score", ["neg"])
        auc = ranked.groupBy(*keys).agg(
            F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)).alias("_u"),
            F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum("hit").alias("_hit"))
        raw = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).otherwise(
            F.col("_hit") / (F.col("_p") + F.col("_n")))
        out = auc.select(*keys, py_round(raw * 100.0, params.metric_decimals).alias("roc_auc"))
        return pred.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        vc.unpersist()


def evaluate(pred: DataFrame, keys=(), params: Params = P) -> DataFrame:
    """E01-E03 in one row per model key (confusion cells as columns).

    Runs eagerly: the result is one row per compared model, so it comes back
    as a small local frame and later steps (best pick, ranking) do not
    re-run the evaluation.
    """
    m = binary_metrics(pred, keys, params)
    a = roc_auc(pred, keys, params)
    out = m.join(a, list(keys)) if keys else m.crossJoin(a)
    return pred.sparkSession.createDataFrame(out.collect(), out.schema)


def select_best(metrics: DataFrame) -> DataFrame:
    """The model with the highest 0.5 F1 + 0.5 AUC; the earliest wins ties."""
    score = F.lit(0.5) * F.col("f1_score") + F.lit(0.5) * F.col("roc_auc")
    return metrics.agg(F.min_by("algorithm_name", F.struct(-score, F.col("ordinal"))).alias("best_algorithm"),
                       F.max(score).alias("best_score"))


def mark_best(metrics: DataFrame) -> DataFrame:
    best = select_best(metrics).select("best_algorithm")
    return metrics.crossJoin(best).withColumn("is_best", F.col("algorithm_name") == F.col("best_algorithm")).drop("best_algorithm")


def model_comparison(registry: DataFrame) -> DataFrame:
    """Registry rows by F1 (descending) with the best model (flagged,
    else the top-F1 one) and the summed training time on every row."""
    w = Window.partitionBy("dataset_id").orderBy(F.col("f1_score").desc(), "ordinal")   # one dataset's models
    ranked = registry.withColumn("rank", F.row_number().over(w))
    summ = ranked.groupBy("dataset_id").agg(
        F.coalesce(F.min_by(F.when(F.col("is_best"), F.col("algorithm_name")), F.when(F.col("is_best"), F.col("rank"))),
                   F.min_by("algorithm_name", "rank")).alias("best_algorithm"),
        py_round(F.sum("training_time"), 2).alias("total_training_time"))
    return ranked.join(summ, "dataset_id")       # one row per dataset: no hint, AQE decides
