"""Scoring, risk tiers and rule-based explanations.

Every function takes a probability column, of a trained model or any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from retainx.functions.columns import qcol
from retainx.functions.expr import churn_label, guarded_double, py_round, risk_tier
from retainx.operators.stats import _fmt_fixed
from retainx.params import Params

P = Params()

# --- fixed values: explanation rules (feature, value, impact, importance) ---
RULE_CONTRACT_MONTHLY = ("Contract Type", "Increases Churn Risk", 0.28)
RULE_CONTRACT_LONG = ("Contract Type", "Decreases Churn Risk (High Retention)", 0.25)
RULE_TENURE_NEW = ("Customer Tenure", "Increases Churn Risk (New Customer)", 0.22)
RULE_TENURE_LOYAL = ("Customer Tenure", "Decreases Churn Risk (Loyal Customer)", 0.20)
RULE_MONTHLY_HIGH = ("Monthly Charges", "Increases Churn Risk (High Cost)", 0.18)
RULE_TECH_SUPPORT = ("Tech Support", "No Support Subscribed", "Increases Churn Risk", 0.14)
RULE_ONLINE_SECURITY = ("Online Security", "No Online Security", "Increases Churn Risk", 0.12)
RULE_PAYMENT = ("Payment Method", "Increases Churn Risk", 0.10)
FALLBACK_IMPACT = "Primary Model Driver"
FALLBACK_VALUE = "Active"
MAX_FACTORS = 5
# ---------------------------------------------------------------------------------


def score_batch(df: DataFrame, prob: Column) -> DataFrame:
    """Original columns plus label, churn / retention percentages and tier.

    Percentages are the class probabilities x 100 rounded to 1 decimal; the
    label and tier read the rounded churn percentage.
    """
    pct = py_round(prob * 100.0, 1)
    ret = py_round((F.lit(1.0) - prob) * 100.0, 1)
    out = df.withColumn("Churn_Probability_%", pct).withColumn("Retention_Probability_%", ret)
    return (out.withColumn("Predicted_Churn", churn_label(qcol("Churn_Probability_%")))
            .withColumn("Risk_Level", risk_tier(qcol("Churn_Probability_%"))))


def batch_summary(scored: DataFrame) -> DataFrame:
    """Totals by label and tier in one aggregate."""
    lab, tier = qcol("Predicted_Churn"), qcol("Risk_Level")
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return scored.agg(F.count(F.lit(1)).alias("total_records"), cnt(lab == "Churn").alias("churn_count"),
                      cnt(lab != "Churn").alias("non_churn_count"), cnt(tier == "High Risk").alias("high_risk_count"),
                      cnt(tier == "Medium Risk").alias("medium_risk_count"), cnt(tier == "Low Risk").alias("low_risk_count"))


def share_of_total(counts: DataFrame, count_col: str = "count", decimals: int = 1) -> DataFrame:
    """Each count as a percentage of the column total (one-row total, broadcast)."""
    tot = counts.agg(F.sum(count_col).alias("_tot"))
    return counts.crossJoin(F.broadcast(tot)).withColumn(
        "share", F.when(F.col("_tot") > 0, py_round(F.col(count_col) / F.col("_tot") * 100.0, decimals))
        .otherwise(F.lit(0.0))).drop("_tot")


def batch_preview(scored: DataFrame, order_by: list[str], id_col: str | None = None, n: int = 50,
                  feature_cols: list[str] | None = None) -> DataFrame:
    """First ``n`` scored rows by key (a top-n, then numbered), identifier =
    the first ID column, else ``Cust-001``...; ``feature_cols`` adds a map of
    these columns' values as text (missing as '')."""
    head = scored.orderBy(*[qcol(c) for c in order_by]).limit(n)
    w = Window.orderBy(*[qcol(c) for c in order_by])        # over at most n rows
    idx = F.row_number().over(w)
    ident = (qcol(id_col).cast("string") if id_col and id_col in scored.columns
             else F.concat(F.lit("Cust-"), F.lpad(idx.cast("string"), 3, "0")))
    return head.select(idx.alias("row_index"), ident.alias("customer_identifier"),
                       qcol("Predicted_Churn").alias("prediction"), qcol("Churn_Probability_%").alias("churn_probability"),
                       qcol("Retention_Probability_%").alias("retention_probability"), qcol("Risk_Level").alias("risk_level"),
                       *([F.map_from_arrays(F.array(*[F.lit(c) for c in feature_cols]), F.array(*[
                           F.coalesce(qcol(c).cast("string"), F.lit("")) for c in feature_cols])).alias("features")] if feature_cols else []))


def _txt(df, c):
    return F.lower(F.coalesce(qcol(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")


def _factor(feature, value, impact, importance):
    return F.struct(F.lit(feature).alias("feature"), value.cast("string").alias("value"),
                    F.lit(impact).alias("impact"), F.lit(importance).cast("double").alias("importance"))


def explain_rules(df: DataFrame, importances=None, params: Params = P) -> Column:
    """C06 + C07: up to five risk factors per customer as array<struct>.

    Rules fire in a fixed order (contract, tenure, monthly charges, tech
    support, online security, payment); a missing tenure counts as 0 months.
    If no rule fires, the top five model importances are listed instead,
    with the customer's value when the feature is a column, else 'Active'.
    """
    contract, tech, sec, pay = _txt(df, "Contract"), _txt(df, "TechSupport"), _txt(df, "OnlineSecurity"), _txt(df, "PaymentMethod")
    ten = F.coalesce(guarded_double(qcol("tenure").cast("string")), F.lit(0.0)) if "tenure" in df.columns else F.lit(0.0)
    mc = F.coalesce(guarded_double(qcol("MonthlyCharges").cast("string")), F.lit(0.0)) if "MonthlyCharges" in df.columns else F.lit(0.0)
    def raw(c):
        return qcol(c).cast("string") if c in df.columns else F.lit(None).cast("string")

    raw_contract = raw("Contract")
    w = (lambda x: x) if params.explain_weights else (lambda x: None)
    months = F.concat(ten.cast("bigint").cast("string"), F.lit(" months"))
    items = [
        F.when(contract.contains("month"), _factor(RULE_CONTRACT_MONTHLY[0], F.coalesce(raw_contract, F.lit("Month-to-month")),
                                                   RULE_CONTRACT_MONTHLY[1], w(RULE_CONTRACT_MONTHLY[2])))
        .when(contract.contains("two") | contract.contains("one"),
              _factor(RULE_CONTRACT_LONG[0], raw_contract, RULE_CONTRACT_LONG[1], w(RULE_CONTRACT_LONG[2]))),
        F.when(ten <= 12, _factor(RULE_TENURE_NEW[0], months, RULE_TENURE_NEW[1], w(RULE_TENURE_NEW[2])))
        .when(ten >= 36, _factor(RULE_TENURE_LOYAL[0], months, RULE_TENURE_LOYAL[1], w(RULE_TENURE_LOYAL[2]))),
        F.when(mc > 75, _factor(RULE_MONTHLY_HIGH[0], F.concat(F.lit("$"), _fmt_fixed(mc, 2)), RULE_MONTHLY_HIGH[1],
                                w(RULE_MONTHLY_HIGH[2]))),
        F.when(tech == "no", _factor(RULE_TECH_SUPPORT[0], F.lit(RULE_TECH_SUPPORT[1]), RULE_TECH_SUPPORT[2], w(RULE_TECH_SUPPORT[3]))),
        F.when(sec == "no", _factor(RULE_ONLINE_SECURITY[0], F.lit(RULE_ONLINE_SECURITY[1]), RULE_ONLINE_SECURITY[2],
                                    w(RULE_ONLINE_SECURITY[3]))),
        F.when(pay.contains("electronic check"), _factor(RULE_PAYMENT[0], raw("PaymentMethod"), RULE_PAYMENT[1], w(RULE_PAYMENT[2]))),
    ]
    fired = F.filter(F.array(*items), lambda x: x.isNotNull())
    if params.explain_fallback and importances:
        fb = [_factor(f, qcol(f).cast("string") if f in df.columns else F.lit(FALLBACK_VALUE), FALLBACK_IMPACT, imp)
              for f, imp in importances[:MAX_FACTORS]]
        fired = F.when(F.size(fired) == 0, F.array(*fb)).otherwise(fired)
    return F.slice(fired, 1, MAX_FACTORS)


def explain_long(df: DataFrame, key: str, importances=None, params: Params = P) -> DataFrame:
    """Explanations exploded to (key, factor_rank, feature, value, impact, importance)."""
    return (df.select(qcol(key), F.posexplode(explain_rules(df, importances, params)).alias("pos", "f"))
            .select(qcol(key), (F.col("pos") + 1).alias("factor_rank"), "f.feature", "f.value", "f.impact", "f.importance"))


def customer_identifier(ident: Column | None, *key_cols: Column) -> Column:
    """The given identifier, else ``CUST-`` + 6 upper-case hex digits of a
    hash of the key (deterministic instead of random)."""
    gen = F.concat(F.lit("CUST-"), F.upper(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key_cols])), 1, 6)))
    return gen if ident is None else F.coalesce(ident, gen)
