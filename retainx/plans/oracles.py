"""DuckDB twins of the registered queries (the correctness oracle).

Each string runs on the pre-registered driver tables. Derived views (telco,
predictions, datasets) are inlined as CTEs from the very same SQL text the
Spark side runs. Rounding uses ``round_even(x * 10^d, 0) / 10^d``, the same
arithmetic as ``retainx.functions.py_round``.
"""

from __future__ import annotations

from retainx.params import ID_PATTERNS, TARGET_NAMES
from retainx.plans.views import DATASETS_SQL, PREDICTIONS_SQL, TELCO_SQL

NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# (name, kind) with kind i=integer, f=float, s=string, t=timestamp, b=bool
TELCO_COLS = [("customerID", "s"), ("SeniorCitizen", "i"), ("tenure", "i"), ("InternetService", "s"),
              ("OnlineSecurity", "s"), ("TechSupport", "s"), ("Contract", "s"), ("PaymentMethod", "s"),
              ("MonthlyCharges", "f"), ("TotalCharges", "s"), ("Churn", "s")]
LINEITEM_COLS = [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
                 ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")]
CUSTOMER_COLS = [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "f"), ("c_mktsegment", "s")]
ORDERS_COLS = [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "f"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")]
PRED_COLS = [("id", "i"), ("user_id", "i"), ("model_id", "i"), ("customer_identifier", "s"), ("prediction", "s"),
             ("churn_probability", "f"), ("retention_probability", "f"), ("risk_level", "s"), ("created_at", "t")]
LABELS_COLS = [("doc_id", "i"), ("quality", "i"), ("toxic", "i")]

DTYPE = {"i": "int64", "f": "float64", "s": "object", "t": "datetime64[ns]", "b": "bool"}


def telco_cte() -> str:
    return f"telco AS ({TELCO_SQL.replace('{customer}', 'customer')})"


def predictions_cte() -> str:
    return f"predictions AS ({PREDICTIONS_SQL.replace('{orders}', 'orders')})"


def datasets_cte() -> str:
    return f"datasets AS ({DATASETS_SQL.replace('{orders}', 'orders')})"


def r(x: str, d: int) -> str:
    """Python-style rounding, same arithmetic as the Spark helper."""
    s = float(10 ** d)
    return f"(round_even(CAST({x} AS DOUBLE) * {s!r}, 0) / {s!r})"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def numeric_text(x: str) -> str:
    return f"coalesce(regexp_matches({strip(x)}, '{NUMERIC_TEXT}'), false)"


def guarded_double(x: str) -> str:
    return f"(CASE WHEN {numeric_text(x)} THEN TRY_CAST({strip(x)} AS DOUBLE) END)"


def missing(name: str, kind: str) -> str:
    return f"({q(name)} IS NULL OR isnan({q(name)}))" if kind == "f" else f"({q(name)} IS NULL)"


def name_match(cn: str, patterns, prefix_suffix: bool, suffix: bool = True) -> str:
    parts = []
    for p in patterns:
        c = f"{cn} = '{p}'"
        if prefix_suffix:
            c += f" OR starts_with({cn}, '{p}')"
            if suffix:
                c += f" OR ends_with({cn}, '{p}')"
        parts.append(f"({c})")
    return "(" + " OR ".join(parts) + ")"


def profile_cte(cols, src: str = "src") -> str:
    """CTE ``prof`` with one row per column, like ``column_profile``."""
    per = []
    for i, (name, kind) in enumerate(cols):
        parse = f"sum(CASE WHEN {numeric_text(q(name))} THEN 1 ELSE 0 END)" if kind == "s" else "CAST(NULL AS BIGINT)"
        per.append(
            f"SELECT {i} AS ordinal, '{name}' AS column_name, '{DTYPE[kind]}' AS dtype, "
            f"{'true' if kind in 'ifb' else 'false'} AS numeric_dtype, {'true' if kind == 's' else 'false'} AS is_string, "
            f"count(*) AS total_rows, CAST(sum(CASE WHEN {missing(name, kind)} THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
            f"count(DISTINCT CASE WHEN NOT {missing(name, kind)} THEN {q(name)} END) AS unique_count, "
            f"CAST({parse} AS BIGINT) AS parse_count FROM {src}")
    cn = "regexp_replace(lower(column_name), '[_-]', '', 'g')"
    return f"""per AS ({' UNION ALL '.join(per)}),
p1 AS (SELECT *, coalesce(numeric_dtype OR (is_string AND total_rows > 0 AND parse_count / total_rows > 0.8), false) AS is_numerical,
              {name_match(cn, TARGET_NAMES, False)} AS name_is_target,
              {name_match(cn, ID_PATTERNS, True)} AS id_by_name FROM per),
p2 AS (SELECT *, NOT is_numerical AS is_categorical,
              id_by_name OR (unique_count >= total_rows * 0.95 AND NOT is_numerical AND total_rows > 10) AS is_id_candidate FROM p1),
prof AS (SELECT ordinal, column_name, dtype, total_rows, missing_count,
              CASE WHEN total_rows > 0 THEN {r('missing_count / total_rows * 100.0', 2)} ELSE 0.0 END AS missing_percentage,
              unique_count, is_numerical, is_categorical, is_id_candidate,
              name_is_target OR (unique_count = 2 AND NOT is_id_candidate) AS is_target_candidate, name_is_target,
              unique_count = 1 AND total_rows > 1 AS is_single_value,
              is_categorical AND unique_count > 50 AND NOT is_id_candidate AS is_high_cardinality,
              CASE WHEN is_id_candidate THEN 'id' WHEN is_numerical THEN 'numerical' ELSE 'categorical' END AS kind
       FROM p2)"""


def with_src(src_cte: str, body_ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join([src_cte, *body_ctes]) + "\n" + select


def src_table(table: str) -> str:
    if table == "telco":
        return telco_cte() + ", src AS (SELECT * FROM telco)"
    if table == "predictions":
        return predictions_cte() + ", src AS (SELECT * FROM predictions)"
    return f"src AS (SELECT * FROM {table})"


def long_values_cte(cols, src: str = "src") -> str:
    """CTE ``lv``: (ordinal, value text, num) of every non-missing cell."""
    parts = []
    for i, (name, kind) in enumerate(cols):
        num = f"CAST({q(name)} AS DOUBLE)" if kind in "if" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT {i} AS ordinal, CAST({q(name)} AS VARCHAR) AS value, {num} AS num "
                     f"FROM {src} WHERE NOT {missing(name, kind)}")
    return f"lv AS ({' UNION ALL '.join(parts)})"
