"""Stand-in views of the reference's inputs, derived from the driver tables.

The SQL texts are shared verbatim with the DuckDB oracles (placeholders in
braces become table names there), so both engines read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from retainx.sources.tables import read_table

# Telco-style customer table (11 of the 21 columns) on top of `customer`:
# integer arithmetic only, 1 in 200 customers duplicated, 1 in 400 with a
# blank TotalCharges text.
TELCO_SQL = """
WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS nk FROM {customer}),
s AS (SELECT id, (id * 7919 + nk * 104729) % 1000 AS a, (id * 15485863 + nk * 31) % 997 AS b,
             (id * 32452843 + nk * 17) % 1000 AS c, (id * 49979687 + nk * 13) % 991 AS d FROM k),
f AS (SELECT id, a, b, c, d,
  CASE WHEN a < 550 THEN 'Month-to-month' WHEN a < 790 THEN 'One year' ELSE 'Two year' END AS Contract,
  CAST(CASE WHEN a < 550 THEN 1 + b % 30 WHEN a < 790 THEN 12 + b % 48 ELSE 36 + b % 37 END AS BIGINT) AS tenure,
  CASE WHEN c < 340 THEN 'DSL' WHEN c < 780 THEN 'Fiber optic' ELSE 'No' END AS InternetService,
  CASE WHEN d % 4 = 0 THEN 'Electronic check' WHEN d % 4 = 1 THEN 'Mailed check'
       WHEN d % 4 = 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
  CAST(CASE WHEN b % 100 < 16 THEN 1 ELSE 0 END AS BIGINT) AS SeniorCitizen FROM s),
g AS (SELECT *,
  CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN b % 7 < 4 THEN 'No' ELSE 'Yes' END AS TechSupport,
  CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN d % 5 < 3 THEN 'No' ELSE 'Yes' END AS OnlineSecurity,
  CAST(2000 + CASE InternetService WHEN 'DSL' THEN 2500 WHEN 'Fiber optic' THEN 4500 ELSE 0 END + d * 4 AS BIGINT) AS cents FROM f),
h AS (SELECT *, CASE Contract WHEN 'Month-to-month' THEN 35 WHEN 'One year' THEN 8 ELSE -15 END
  + CASE WHEN InternetService = 'Fiber optic' THEN 18 ELSE 0 END + CASE WHEN TechSupport = 'No' THEN 12 ELSE 0 END
  + CASE WHEN OnlineSecurity = 'No' THEN 10 ELSE 0 END + CASE WHEN PaymentMethod = 'Electronic check' THEN 15 ELSE 0 END
  + CASE WHEN tenure <= 12 THEN 20 WHEN tenure > 48 THEN -25 ELSE 0 END + 8 * SeniorCitizen AS score FROM g),
t AS (SELECT id, concat('C', CAST(id AS STRING)) AS customerID, SeniorCitizen, tenure, InternetService, OnlineSecurity,
  TechSupport, Contract, PaymentMethod, cents / CAST(100 AS DOUBLE) AS MonthlyCharges,
  CASE WHEN id % 400 = 7 THEN '' ELSE CAST(CAST(FLOOR(cents * tenure / CAST(100 AS DOUBLE)) AS BIGINT) AS STRING) END AS TotalCharges,
  CASE WHEN score + (b * 7 + d * 3) % 121 - 60 > 40 THEN 'Yes' ELSE 'No' END AS Churn FROM h)
SELECT customerID, SeniorCitizen, tenure, InternetService, OnlineSecurity, TechSupport, Contract, PaymentMethod, MonthlyCharges, TotalCharges, Churn
FROM t JOIN (VALUES (0), (1)) d(copy) ON d.copy = 0 OR t.id % 200 = 3
"""

# Prediction log on top of `orders` (15,000 rows at sf0.01, 1 in 50 without a model).
PREDICTIONS_SQL = """
SELECT o_orderkey AS id,
       o_custkey % 5 AS user_id,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey % 4 + 1 END AS model_id,
       concat('CUST-', CAST(o_custkey AS STRING)) AS customer_identifier,
       CASE WHEN pct >= 50 THEN 'Churn' ELSE 'No Churn' END AS prediction,
       pct AS churn_probability,
       CAST((1000 - tenths) AS DOUBLE) / CAST(10 AS DOUBLE) AS retention_probability,
       CASE WHEN pct < 35 THEN 'Low Risk' WHEN pct < 65 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level,
       o_orderdate AS created_at
FROM (SELECT *, (o_orderkey * 7919) % 1001 AS tenths,
             CAST((o_orderkey * 7919) % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) AS pct FROM {orders}) q
"""

# Dataset registry on top of `orders`: one upload per order, newest = latest
# order date; 1 in 97 uploads carries the active flag.
DATASETS_SQL = """
SELECT o_orderkey AS id,
       o_custkey % 5 AS user_id,
       concat('upload_', CAST(o_orderkey AS STRING), '.csv') AS filename,
       CAST(FLOOR(o_totalprice) AS BIGINT) % 5000 + 11 AS rows_count,
       CAST(11 AS BIGINT) AS columns_count,
       'Churn' AS target_column,
       o_orderkey % 97 = 5 AS is_active,
       o_orderdate AS uploaded_at
FROM {orders}
"""

# Model registry on top of `orders`: one trained model per order, 1 in 89 flagged best.
MODELS_SQL = """
SELECT o_orderkey AS id,
       o_custkey % 5 AS user_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'Logistic Regression' WHEN 1 THEN 'Decision Tree' WHEN 2 THEN 'Random Forest'
            ELSE 'Gradient Boosting' END AS algorithm_name,
       CAST(500 + (o_orderkey * 37) % 450 AS DOUBLE) / CAST(10 AS DOUBLE) AS accuracy,
       CAST(400 + (o_orderkey * 53) % 500 AS DOUBLE) / CAST(10 AS DOUBLE) AS f1_score,
       o_orderkey % 89 = 7 AS is_best
FROM {orders}
"""

# The relation user - dataset - model - prediction: one dataset per order (1 in 60
# without an owner), two models each, one prediction per line item (some without a
# model or a dataset, some of another user).
RELATION_SQL = {
    "users": "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name FROM {customer}",
    "datasets": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 60 <> 13 THEN o_custkey END AS user_id FROM {orders}",
    "models": "SELECT o_orderkey * 2 + n AS id, CASE WHEN o_orderkey % 45 <> 2 THEN o_orderkey END AS dataset_id, o_custkey AS user_id "
              "FROM {orders} CROSS JOIN (VALUES (0), (1)) k(n)",
    "predictions": "SELECT l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN l_suppkey ELSE o_custkey END AS user_id, "
                   "CASE WHEN l_linenumber % 5 <> 4 THEN l_orderkey END AS dataset_id, "
                   "CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey * 2 + l_linenumber % 2 END AS model_id, l_quantity AS churn_probability "
                   "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
}

# What the log keeps beside a prediction: the customer's features as inputs.
LOG_INPUTS = ("Contract", "InternetService", "PaymentMethod", "TechSupport", "OnlineSecurity", "tenure")

# Names of the four algorithms keyed by model id (the log's N:1 look-up).
MODEL_NAMES = ((1, "Logistic Regression"), (2, "Decision Tree"), (3, "Random Forest"), (4, "Gradient Boosting"))


def telco(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TELCO_SQL, customer=read_table(spark, sf_dir, "customer"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDICTIONS_SQL, orders=read_table(spark, sf_dir, "orders"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DATASETS_SQL, orders=read_table(spark, sf_dir, "orders"))


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MODELS_SQL, orders=read_table(spark, sf_dir, "orders"))


def relation(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Users, datasets, models and predictions, linked by their keys."""
    tables = {t: read_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    return {name: spark.sql(text, **{t: df for t, df in tables.items() if "{" + t + "}" in text}) for name, text in RELATION_SQL.items()}


def model_names(spark: SparkSession, drop_ids: tuple = ()) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("algorithm_name", T.StringType())])
    return spark.createDataFrame([r for r in MODEL_NAMES if r[0] not in drop_ids], schema)


def events_input_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``props`` parsed into the log's ``input_data`` map."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("input_data", F.from_json("props", T.MapType(T.StringType(), T.StringType())))
