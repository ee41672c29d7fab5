"""A fixed logistic scorecard: the fixture that stands in for a model where a
result is compared with SQL. No operator uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from retainx.functions.columns import qcol

# --- fixed values: scorecard terms in hundredths (sample-generator propensity) ---
# term: (column, condition, points)
SCORECARD_TERMS = {
    "contract": [("Contract", "== 'Month-to-month'", 35), ("Contract", "== 'One year'", 8), ("Contract", "else", -15)],
    "fiber": [("InternetService", "== 'Fiber optic'", 18)],
    "tech_support": [("TechSupport", "== 'No'", 12)],
    "online_security": [("OnlineSecurity", "== 'No'", 10)],
    "electronic_check": [("PaymentMethod", "== 'Electronic check'", 15)],
    "tenure": [("tenure", "<= 12", 20), ("tenure", "> 48", -25)],
    "senior": [("SeniorCitizen", "== 1", 8)],
    "monthly": [("MonthlyCharges", "> 80", 10)],
}
SCORECARD_CENTER = 35          # logistic centre, hundredths
SCORECARD_SLOPE = 3.0
# Four scorecards compared like trained models (subsets of the terms).
SCORECARDS = {
    "scorecard_full": list(SCORECARD_TERMS),
    "scorecard_contract_tenure": ["contract", "tenure"],
    "scorecard_services": ["fiber", "tech_support", "online_security"],
    "scorecard_billing": ["electronic_check", "monthly", "senior"],
}


def _cond(df: DataFrame, col: str, cond: str) -> Column:
    if col not in df.columns:
        return F.lit(False)
    c = qcol(col)
    op, _, lit = cond.partition(" ")
    lit = lit.strip("'")
    if op == "==":
        return F.coalesce(c.cast("string") == F.lit(lit), F.lit(False))
    v = c.cast("double")
    return F.coalesce(v <= float(lit) if op == "<=" else v > float(lit), F.lit(False))


def scorecard_points(df: DataFrame, terms=None) -> Column:
    terms = terms or list(SCORECARD_TERMS)
    total = F.lit(0)
    for t in terms:
        rules = SCORECARD_TERMS[t]
        expr = None
        for col, cond, pts in rules:
            if cond == "else":
                expr = expr.otherwise(F.lit(pts)) if expr is not None else F.lit(pts)
            else:
                c = _cond(df, col, cond)
                expr = F.when(c, F.lit(pts)) if expr is None else expr.when(c, F.lit(pts))
        if not any(cond == "else" for _, cond, _ in rules):
            expr = expr.otherwise(F.lit(0))
        total = total + expr
    return total


def scorecard_probability(df: DataFrame, terms=None) -> Column:
    """P(churn) = 1 / (1 + exp(-3 (score - 0.35))), score in hundredths."""
    s = scorecard_points(df, terms)
    z = F.lit(-SCORECARD_SLOPE) * (s - F.lit(SCORECARD_CENTER)).cast("double") / F.lit(100.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z))
