"""Sinks (S02-S04): scored CSV, log export with flattened inputs, log append."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from retainx.operators.history import history_with_model


def write_scored_csv(scored: DataFrame, path: str) -> str:
    """Original columns plus the four result columns as a CSV directory
    (one file per task; no funnelling through a single writer). Quotes are doubled."""
    scored.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


#: Distinct input names that an export turns into columns; more of them are refused.
MOST_INPUTS = 5000


def flatten_input_data(log: DataFrame, input_col: str = "input_data", prefix: str = "Feature_") -> DataFrame:
    """S03 part: one ``Feature_<key>`` column per key of the input map.

    Only the distinct key *names* reach the driver (they become columns), at most
    ``MOST_INPUTS``; values stay in Spark.
    """
    names = log.select(F.explode(F.map_keys(input_col)).alias("k")).distinct().limit(MOST_INPUTS + 1).collect()
    if len(names) > MOST_INPUTS:
        raise ValueError(f"more than {MOST_INPUTS} different inputs can't become columns")
    keys = sorted(r["k"] for r in names)
    return log.select(*[c for c in log.columns if c != input_col],
                      *[F.col(input_col)[k].alias(prefix + k) for k in keys])


def _python_datetime_text(ts):
    """``str(datetime)``: seconds, plus six fraction digits when non-zero."""
    t = ts.cast("timestamp")
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def history_export(preds: DataFrame, models: DataFrame, layout: str = "full", user_id: int | None = None) -> DataFrame:
    """Export columns of the log (newest first), missing model ``N/A``,
    date as ``yyyy-MM-dd HH:mm:ss``; input maps flattened when present (the
    keys of the exported rows). ``user_id`` exports one user's rows.
    ``layout="compact"`` gives the one-file variant's six columns (no model,
    no retention, no inputs; date as Python prints it; unordered)."""
    if user_id is not None:
        preds = preds.where(F.col("user_id") == user_id)
    if layout == "compact":
        return preds.select(F.col("id").alias("ID"), F.col("customer_identifier").alias("Customer_ID"),
                            F.col("prediction").alias("Prediction"), F.col("churn_probability").alias("Churn_Prob_%"),
                            F.col("risk_level").alias("Risk"), _python_datetime_text(F.col("created_at")).alias("Date"))
    j = history_with_model(preds, models, missing="N/A")
    out = j.select(F.col("id").alias("ID"), F.col("customer_identifier").alias("Customer_Identifier"),
                   F.col("model_name").alias("Model"), F.col("prediction").alias("Prediction"),
                   F.col("churn_probability").alias("Churn_Probability_%"),
                   F.col("retention_probability").alias("Retention_Probability_%"),
                   F.col("risk_level").alias("Risk_Level"),
                   F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("Date"),
                   F.col("created_at"), *([F.col("input_data")] if "input_data" in j.columns else []))
    if "input_data" in out.columns:
        out = flatten_input_data(out)
    return out.orderBy(F.col("created_at").desc(), F.col("ID")).drop("created_at")


#: A risk factor of a log row, and the log's columns. Inputs are the customer's features as text.
FACTORS = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.StringType()),
                                    T.StructField("impact", T.StringType()), T.StructField("importance", T.DoubleType())]))
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("dataset_id", T.LongType()),
    T.StructField("model_id", T.LongType()), T.StructField("customer_identifier", T.StringType()),
    T.StructField("input_data", T.MapType(T.StringType(), T.StringType())), T.StructField("prediction", T.StringType()),
    T.StructField("churn_probability", T.DoubleType()), T.StructField("retention_probability", T.DoubleType()),
    T.StructField("risk_level", T.StringType()), T.StructField("top_factors", FACTORS), T.StructField("created_at", T.TimestampNTZType())])


def as_log_records(records: DataFrame) -> DataFrame:
    """``records`` with the log's columns: missing ones null, then any columns of their own."""
    named = LOG_SCHEMA.fieldNames()
    return records.select(*[(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields],
                          *[c for c in records.columns if c not in named])


def append_prediction_log(records: DataFrame, path: str, load: str | int | None = None, writer: str = "") -> str:
    """Add scored records to the log under ``path``, shared by batches and streams.

    What is added is a load, known by its ``writer`` (a stream's query id, a job's
    name) and that writer's own ``load`` number or name (by default a fresh one, so
    that nothing is replaced). A load written again, by a retry or a replayed
    epoch, takes the place of its first version as a whole, even where its users
    have changed; loads of other writers are never touched. Within a load rows are
    partitioned by user, so that a user's history reads only their folders; they
    are rebalanced by user first: a task writes few users' files, and a user with
    a large share of the rows is split over several tasks.
    """
    name = f"{writer}:{uuid.uuid4().hex if load is None else load}"
    (as_log_records(records).hint("rebalance", "user_id").write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("user_id").parquet(f"{path.rstrip('/')}/load={quote(name, safe='')}"))
    return path


def read_prediction_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """The log's rows, of all loads, with declared types (partition columns would
    else get those that discovery infers from folder names); an empty log where
    nothing was added yet."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("load", T.StringType())])).parquet(path) \
            .select(*schema.fieldNames())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
