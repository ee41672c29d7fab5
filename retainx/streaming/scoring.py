"""Scoring of arriving customers with Structured Streaming (C08 + S04).

The reference has no streams; this re-aims single-customer scoring at a
stream: each micro-batch is scored with the same DataFrame functions as the
batch path and added to the prediction log as a load of its own. The load is
known by the query id that Structured Streaming keeps in the stream's checkpoint
and by the epoch, so a replayed epoch replaces its own rows (idempotent sink,
exactly-once results), also after a restart, and any number of streams and
batches fill one log.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from retainx.operators.score import customer_identifier, explain_rules
from retainx.sources.sinks import append_prediction_log


def log_records(scored: DataFrame, user_id: int, model_id: int | None, key_col: str | None,
                feature_cols: list[str], importances=None, load: str = "", dataset_id: int | None = None) -> DataFrame:
    """Shape scored customers as prediction-log rows (single-customer form:
    retention = 100 - churn percentage), with their inputs and risk factors. Ids
    are unique per load: a customer scored again gets a new one."""
    ident = customer_identifier(F.col(key_col).cast("string") if key_col else None,
                                *[F.col(c) for c in feature_cols])
    inputs = F.map_from_arrays(F.array(*[F.lit(c) for c in feature_cols]),
                               F.array(*[F.col(c).cast("string") for c in feature_cols]))
    pct = F.col("`Churn_Probability_%`")
    return scored.select(
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(load), ident, F.to_json(inputs))), 1, 15), 16, 10).cast("bigint").alias("id"),
        F.lit(user_id).cast("bigint").alias("user_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(model_id).cast("bigint").alias("model_id"),
        ident.alias("customer_identifier"),
        F.col("Predicted_Churn").alias("prediction"),
        pct.alias("churn_probability"),
        F.round(F.lit(100.0) - pct, 1).alias("retention_probability"),
        F.col("Risk_Level").alias("risk_level"),
        inputs.alias("input_data"),
        explain_rules(scored, importances).alias("top_factors"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"))


def stream_identity(spark: SparkSession, checkpoint_dir: str) -> str:
    """The query id that a stream keeps in its checkpoint from its first start on."""
    return json.loads(spark.read.text(f"{checkpoint_dir.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]


def start_scoring_stream(spark: SparkSession, source_dir: str, source_schema: T.StructType,
                         scorer: Callable[[DataFrame], DataFrame], log_dir: str, checkpoint_dir: str,
                         user_id: int = 1, model_id: int | None = None, key_col: str | None = None,
                         importances=None, fmt: str = "parquet", available_now: bool = True, dataset_id: int | None = None):
    """Start the stream; ``scorer`` maps a batch of customers to scored rows
    (e.g. ``score_batch`` with a scorecard or a trained model). Streams may share
    a log; each needs a checkpoint of its own."""
    feats = [f.name for f in source_schema.fields if f.name != key_col]
    stream = spark.readStream.schema(source_schema).format(fmt)
    if fmt == "csv":
        stream = stream.option("header", True)
    src = stream.load(source_dir)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        writer = stream_identity(spark, checkpoint_dir)
        records = log_records(scorer(batch), user_id, model_id, key_col, feats, importances, f"{writer}:{epoch_id}", dataset_id)
        append_prediction_log(records, log_dir, epoch_id, writer)

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
