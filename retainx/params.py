"""Tunable constants of the analytics, plus the fixed vocabularies.

The defaults reproduce the modular variant of the reference application;
``Params.single_file()`` gives the constants of its one-file variant.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values (must equal the reference for identical results) ----------
# Column names that mark a churn target (compared after lower-casing and
# removing "_" and "-").
TARGET_NAMES = (
    "churn", "exited", "customerstatus", "churn_value", "churned",
    "is_churn", "churn_label", "attrition", "status", "target",
)
# Column-name patterns that mark an identifier column (equal, prefix or suffix
# of the cleaned name).
ID_PATTERNS = (
    "id", "customerid", "customer_id", "userid", "user_id",
    "account_id", "accountnumber", "client_id", "cid",
)
# Target values that mean "churned" when mapping the label to 0/1.
POSITIVE_PATTERNS = ("yes", "1", "true", "churn", "exited", "churned", "positive", "y")
# Target values the dashboard counts as churned.
DASHBOARD_POSITIVE = ("yes", "1", "true", "churn", "exited", "churned")
# Class filters of the random-customer sampler (lower-cased, not trimmed).
CHURN_CLASS_VALUES = ("yes", "1", "true", "churn")
LOYAL_CLASS_VALUES = ("no", "0", "false", "retained")
# Tokens pandas' CSV reader treats as missing by default.
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# The four algorithms, in the default training order.
ALGORITHMS = ("Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting")
# Target names of the one-file variant.
SINGLE_FILE_TARGET_NAMES = ("churn", "exited", "customerstatus", "churn_value", "churned", "is_churn", "target")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Everything that differs between the two reference variants."""

    hist_bins: int = 8
    hist_label_decimals: int = 1
    # cuts of lists and charts: None shows everything (``screens`` has the application's numbers)
    crosstab_max_unique: int | None = None
    unique_values_kept: int | None = None
    hist_min_values: int = 1
    top_pct_decimals: int = 2
    numeric_quartiles: bool = True
    correlation: bool = True
    correlation_max_columns: int | None = None
    id_by_suffix: bool = True
    id_unique_ratio: float = 0.95
    id_min_rows: int = 10
    target_names: tuple = TARGET_NAMES
    id_patterns: tuple = ID_PATTERNS
    numeric_like_ratio: float = 0.8
    high_cardinality: int = 50
    sample_values: int = 5
    metric_decimals: int = 2
    top_importances: int | None = None
    null_category: str = "category"        # "category" -> literal 'nan'; "mode" -> impute
    no_positive_fallback: str = "second"   # "second" | "last"
    explain_weights: bool = True
    explain_fallback: bool = True
    # model hyper-parameters
    lr_max_iter: int = 1000
    lr_tol: float = 1e-9                   # relative change of the objective: converged to published digits
    max_bins: int = 128                    # candidate splits of a numeric feature (scikit-learn tries all values)
    dt_max_depth: int = 6
    dt_min_leaf: int = 3
    rf_trees: int = 150
    rf_max_depth: int = 12
    rf_min_leaf: int = 2
    gb_rounds: int = 150
    gb_step: float = 0.08
    gb_max_depth: int = 4
    gb_subsample: float = 0.85
    test_size: float = 0.20
    seed: int = 42
    # scale switches (off = exact, as the reference)
    approx_quantiles: bool = False
    approx_distinct: bool = False
    # execution: estimators fitted at the same time; above 1 a fit's time includes waiting for the others
    fit_parallelism: int = 1
    # what a fitted schema may hold on the driver; more raises an error
    max_classes: int = 1000
    max_categories: int = 10_000
    # cells of a crosstab with its zeros; more raises an error (the cells that hold rows come without a limit)
    max_grid_cells: int = 100_000
    # rows that a first look reads for bounds on the smallest values of the columns
    probe_rows: int = 2000

    @staticmethod
    def screens() -> "Params":
        """The cuts of the application's screens: value lists of 20, charts of up to 10 values, 8 columns, 15 importances."""
        return replace(Params(), crosstab_max_unique=10, unique_values_kept=20, hist_min_values=11,
                       correlation_max_columns=8, top_importances=15)

    @staticmethod
    def single_file() -> "Params":
        return replace(
            Params(), hist_bins=6, hist_label_decimals=0, crosstab_max_unique=8, hist_min_values=11,
            unique_values_kept=10, top_pct_decimals=1, numeric_quartiles=False,
            correlation=False, id_by_suffix=False, id_min_rows=0,
            target_names=SINGLE_FILE_TARGET_NAMES, metric_decimals=1, top_importances=12,
            rf_trees=100, rf_max_depth=10, rf_min_leaf=1, gb_rounds=100,
            gb_subsample=1.0, dt_min_leaf=1, null_category="mode",
            explain_weights=False, explain_fallback=False, no_positive_fallback="last",
        )
