"""Fitted tree models as tables that plain SQL can read, score with and check.

A stored classifier becomes one row per node: which tree and node, the feature and
threshold it tests, its children, how many training rows it saw with what
impurity, and what a leaf answers. Scoring by such a table is a walk of joins, one
for each level; importances are sums over its rows. Both are independent of the
library that fitted the model, so that stored models can be checked, and used by
engines that only know tables.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from retainx.session import shared_dir

#: A boosted score is the logistic of twice the margin.
MARGIN_SCALE = 2.0
#: Up to so many nodes are shipped whole to the rows; their number is bound by trees and depth, not by rows.
MOST_SHIPPED = 1_000_000


def node_table(spark: SparkSession, stored: str, names: list[str]) -> DataFrame:
    """The nodes of a classifier saved under ``stored``; ``names`` are its features in order.

    Columns: tree, weight (of the tree), node, feature_index, feature, threshold,
    left_values, left, right (null in leaves), rows, weighted_rows, impurity, gain,
    answer. A row goes left if its feature is at most the threshold or, where the
    feature is a category (the columns of 0 and 1), one of the left values.
    ``answer`` is a single tree's or forest tree's probability of class 1 among the
    (weighted) training rows of the node, a boosted tree's value of the node.
    """
    meta = json.loads(spark.read.text(f"{stored}/metadata").first()[0])
    kind = meta["class"].rsplit(".", 1)[-1]
    data = spark.read.parquet(f"{stored}/data")
    if kind == "DecisionTreeClassificationModel":
        flat = data.select(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), "*")
    elif kind in ("RandomForestClassificationModel", "GBTClassificationModel"):
        weights = spark.read.parquet(f"{stored}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
        flat = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(weights, "tree")         # one row per tree
    else:
        raise ValueError(f"{kind} has no trees")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)          # classification: the weight of each class
    boosted = kind == "GBTClassificationModel"                          # regression: weight, sum and sum of squares
    inner = F.col("leftChild") >= 0
    at = F.col("split.featureIndex")
    return flat.select(
        "tree", "weight", F.col("id").alias("node"), F.when(inner, at).alias("feature_index"),
        F.when(inner, F.get(F.array(*[F.lit(n) for n in names]), at)).alias("feature"),
        F.when(inner & (F.col("split.numCategories") < 0), F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner & (F.col("split.numCategories") >= 0), F.col("split.leftCategoriesOrThreshold")).alias("left_values"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.col("rawCount").alias("rows"), (F.get(stats, F.lit(0)) if boosted else total).alias("weighted_rows"), "impurity",
        F.when(inner, F.col("gain")).alias("gain"), (F.col("prediction") if boosted else F.get(stats, F.lit(1)) / total).alias("answer"))


def export_nodes(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """The node table of a model in memory, by way of a stored copy."""
    path = shared_dir(spark, "tree-model")
    model.write().save(path)
    return node_table(spark, path, names)


def stored_classifier(package: str) -> str:
    """Folder of the classifier within a stored package: the last stage of its pipeline."""
    stages = PipelineModel.load(package + "/pipeline").stages
    model = stages[-1]
    if not isinstance(model, DecisionTreeClassificationModel | RandomForestClassificationModel | GBTClassificationModel):
        raise ValueError(f"{type(model).__name__} has no trees")
    return f"{package}/pipeline/stages/{len(stages) - 1}_{model.uid}"


def max_depth(nodes: DataFrame) -> int:
    """Levels below the roots, by walking down once per level."""
    level, depth = nodes.where("node = 0").select("tree", "node"), 0
    inner = nodes.where("left IS NOT NULL").select("tree", "node", "left", "right")
    while True:
        level = level.join(inner, ["tree", "node"]).select("tree", F.explode(F.array("left", "right")).alias("node"))
        if level.isEmpty():
            return depth
        depth += 1


def _shipped(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= MOST_SHIPPED else nodes


def descend(vectors: DataFrame, nodes: DataFrame, depth: int, key: str = "row_key", features: str = "features") -> DataFrame:
    """(key, tree, node) of the leaf that every row reaches in every tree: one join for each level.

    ``vectors`` holds ``key`` and the feature vector. Rows keep their vector; the joins
    are on (tree, node), and the node table is shipped to the rows, which stay where
    they are, unless it has more than ``MOST_SHIPPED`` nodes.
    """
    flat = vectors.select(key, vector_to_array(features).alias("_x"))
    test = _shipped(nodes.select("tree", "node", "feature_index", "threshold", "left_values", "left", "right"))
    at = flat.crossJoin(F.broadcast(nodes.where("node = 0").select("tree"))).withColumn("node", F.lit(0))    # one row per tree
    for _ in range(depth):
        x = F.get("_x", F.col("feature_index"))
        goes_left = F.coalesce(x <= F.col("threshold"), F.array_contains("left_values", x))
        step = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = at.join(test, ["tree", "node"]).select(key, "_x", "tree", step.alias("node"))
    return at.select(key, "tree", "node")


def scores_by_nodes(vectors: DataFrame, nodes: DataFrame, depth: int, boosted: bool, key: str = "row_key", features: str = "features") -> DataFrame:
    """(key, score): probability of class 1, from the leaves' answers alone."""
    leaves = descend(vectors, nodes, depth, key, features).join(_shipped(nodes.select("tree", "node", "weight", "answer")), ["tree", "node"])
    total = leaves.groupBy(key).agg(F.sum(F.col("weight") * F.col("answer")).alias("_sum"), F.sum("weight").alias("_weight"))
    score = 1.0 / (1.0 + F.exp(-MARGIN_SCALE * F.col("_sum"))) if boosted else F.col("_sum") / F.col("_weight")
    return total.select(key, score.alias("score"))


def importances_by_nodes(nodes: DataFrame, boosted: bool) -> DataFrame:
    """E04 (feature, importance): gains times node weights by feature, as shares of all.

    A forest's trees count alike, whatever their gains; boosted ones by their gains.
    """
    gains = nodes.where("feature_index IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weighted_rows")).alias("_g"))
    if not boosted:
        gains = gains.join(gains.groupBy("tree").agg(F.sum("_g").alias("_t")), "tree").withColumn("_g", F.col("_g") / F.col("_t"))
    by_feature = gains.groupBy("feature").agg(F.sum("_g").alias("_g"))
    return by_feature.crossJoin(F.broadcast(by_feature.agg(F.sum("_g").alias("_all")))).select(          # one row
        "feature", (F.col("_g") / F.col("_all")).alias("importance"))
