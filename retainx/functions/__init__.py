from retainx.functions.expr import (  # noqa: F401
    py_round, strip_ws, numeric_text, guarded_double, clean_name, is_numeric_type,
    pandas_dtype, churn_label, risk_tier, display_class, pandas_str,
)
