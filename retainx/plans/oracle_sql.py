"""DuckDB SQL per registered query (see ``retainx.plans.oracles`` helpers)."""

from __future__ import annotations

from retainx.plans.oracles import (  # noqa: F401
    CUSTOMER_COLS, LINEITEM_COLS, PRED_COLS, TELCO_COLS, datasets_cte, long_values_cte, predictions_cte, profile_cte, q,
    src_table, telco_cte, with_src,
)

from retainx.plans.views import LOG_INPUTS, MODELS_SQL, RELATION_SQL

ORACLES: dict = {}

DATASETS_COLS = [("id", "i"), ("user_id", "i"), ("filename", "s"), ("rows_count", "i"), ("columns_count", "i"),
                 ("target_column", "s"), ("is_active", "b"), ("uploaded_at", "t")]

PROF_COLS = ("ordinal, column_name, dtype, total_rows, missing_count, missing_percentage, unique_count, is_numerical, "
             "is_categorical, is_id_candidate, is_target_candidate, name_is_target, is_single_value, "
             "is_high_cardinality, kind")

ORACLES["table_shape"] = "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns FROM lineitem"

ORACLES["duplicate_rows"] = with_src(src_table("telco"), [
    f"g AS (SELECT count(*) AS n FROM src GROUP BY {', '.join(q(c) for c, _ in TELCO_COLS)})"],
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM g")

ORACLES["missing_by_column"] = with_src(src_table("predictions"), [profile_cte(PRED_COLS)],
                                        "SELECT column_name, missing_count, missing_percentage FROM prof")

ORACLES["unique_by_column"] = with_src(src_table("lineitem"), [profile_cte(LINEITEM_COLS)],
                                       "SELECT column_name, unique_count FROM prof")

ORACLES["numeric_like"] = with_src(src_table("telco"), [profile_cte(TELCO_COLS)],
                                   "SELECT column_name, is_numerical FROM prof")

ORACLES["id_columns"] = with_src(src_table("customer"), [profile_cte(CUSTOMER_COLS)],
                                 "SELECT ordinal, column_name FROM prof WHERE is_id_candidate")

ORACLES["target_candidates"] = with_src(src_table("telco"), [profile_cte(TELCO_COLS)],
                                        "SELECT ordinal, column_name, name_is_target FROM prof WHERE is_target_candidate")

ORACLES["detect_target"] = with_src(src_table("telco"), [
    profile_cte(TELCO_COLS), long_values_cte(TELCO_COLS),
    "pick AS (SELECT arg_min(column_name, (NOT name_is_target, ordinal)) AS target_column, "
    "arg_min(ordinal, (NOT name_is_target, ordinal)) AS tord FROM prof WHERE is_target_candidate)",
    "cls AS (SELECT DISTINCT lv.value, lv.num, pick.target_column FROM lv JOIN pick ON lv.ordinal = pick.tord)"],
    "SELECT target_column, CAST(row_number() OVER (ORDER BY num NULLS LAST, value) AS INTEGER) AS class_rank, "
    "value AS class_value FROM cls")

ORACLES["zero_variance_columns"] = with_src(datasets_cte() + ", src AS (SELECT * FROM datasets)", [profile_cte(DATASETS_COLS)],
                                            "SELECT ordinal, column_name FROM prof WHERE is_single_value")

ORACLES["high_cardinality_columns"] = with_src(src_table("lineitem"), [profile_cte(LINEITEM_COLS)],
                                               "SELECT ordinal, column_name, unique_count FROM prof WHERE is_high_cardinality")

ORACLES["feature_type_lists"] = with_src(src_table("telco"), [profile_cte(TELCO_COLS)],
                                         "SELECT kind, column_name, ordinal FROM prof")

ORACLES["sample_values"] = with_src(src_table("lineitem"), [
    long_values_cte(LINEITEM_COLS),
    "names(ordinal, column_name) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(LINEITEM_COLS)) + ")",
    "d AS (SELECT DISTINCT ordinal, value, num FROM lv)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY num NULLS LAST, value) AS sample_rank FROM d)"],
    "SELECT names.column_name, CAST(sample_rank AS INTEGER) AS sample_rank, value AS sample_value "
    "FROM rk JOIN names USING (ordinal) WHERE sample_rank <= 5")

ORACLES["column_profile"] = with_src(src_table("telco"), [profile_cte(TELCO_COLS)], f"SELECT {PROF_COLS} FROM prof")

_pylist = "CASE WHEN count(*) FILTER (WHERE {c}) = 0 THEN '[]' ELSE '[''' || string_agg(column_name, ''', ''' ORDER BY ordinal) FILTER (WHERE {c}) || ''']' END"
ORACLES["validation_checks"] = with_src(src_table("telco"), [
    profile_cte(TELCO_COLS), long_values_cte(TELCO_COLS),
    f"g AS (SELECT count(*) AS n FROM src GROUP BY {', '.join(q(c) for c, _ in TELCO_COLS)})",
    "dup AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup FROM g)",
    "pick AS (SELECT arg_min(column_name, (NOT name_is_target, ordinal)) AS tgt, "
    "arg_min(ordinal, (NOT name_is_target, ordinal)) AS tord FROM prof WHERE is_target_candidate)",
    "cls AS (SELECT DISTINCT lv.value, lv.num FROM lv JOIN pick ON lv.ordinal = pick.tord)",
    "clist AS (SELECT '[''' || string_agg(value, ''', ''' ORDER BY num NULLS LAST, value) || ''']' AS classes FROM cls)",
    "s AS (SELECT max(total_rows) AS n, count(*) AS cols, sum(missing_count) AS miss, "
    f"{_pylist.format(c='is_single_value')} AS zv, count(*) FILTER (WHERE is_single_value) AS nzv, "
    "string_agg(column_name, ', ' ORDER BY ordinal) FILTER (WHERE is_single_value) AS zvj, "
    f"{_pylist.format(c='is_id_candidate')} AS ids, count(*) FILTER (WHERE is_id_candidate) AS nids FROM prof)",
    "allrows AS ("
    "SELECT 1 AS seq, 'check' AS kind, 'Dataset Loaded' AS name, CASE WHEN n > 0 THEN 'passed' ELSE 'failed' END AS status, "
    "CASE WHEN n > 0 THEN 'Successfully loaded ' || n || ' rows and ' || cols || ' columns.' ELSE 'CSV file contains zero rows.' END AS message FROM s "
    "UNION ALL SELECT 2, 'check', 'Target Column Detection', CASE WHEN tgt IS NOT NULL THEN 'passed' ELSE 'warning' END, "
    "CASE WHEN tgt IS NOT NULL THEN 'Identified ''' || tgt || ''' as candidate target with classes: ' || classes || '.' "
    "ELSE 'No obvious Churn target column found. Please select target column manually.' END FROM s, clist, (SELECT max(tgt) AS tgt FROM (SELECT tgt FROM pick UNION ALL SELECT NULL)) "
    "UNION ALL SELECT 3, 'check', 'Missing Values', CASE WHEN miss = 0 THEN 'passed' ELSE 'warning' END, "
    "CASE WHEN miss = 0 THEN 'Zero missing values detected.' ELSE 'Found ' || miss || ' missing values across dataset. Imputation will be applied.' END FROM s "
    "UNION ALL SELECT 4, 'check', 'Duplicate Rows', CASE WHEN dup = 0 THEN 'passed' ELSE 'warning' END, "
    "CASE WHEN dup = 0 THEN 'Zero duplicate records found.' ELSE 'Found ' || dup || ' duplicate rows. They will be handled automatically.' END FROM dup "
    "UNION ALL SELECT 5, 'check', CASE WHEN nzv > 0 THEN 'Zero Variance Columns' ELSE 'Feature Variance' END, CASE WHEN nzv > 0 THEN 'warning' ELSE 'passed' END, "
    "CASE WHEN nzv > 0 THEN 'Columns with only 1 unique value: ' || zv || '.' ELSE 'All columns contain variable information.' END FROM s "
    "UNION ALL SELECT 6, 'check', 'Identifier Columns', 'passed', 'Identified ID columns to exclude from training: ' || ids || '.' FROM s WHERE nids > 0 "
    "UNION ALL SELECT 7, 'error', NULL, NULL, 'Dataset is empty.' FROM s WHERE n <= 0 "
    "UNION ALL SELECT 8, 'warning', NULL, NULL, 'Target column could not be automatically determined.' FROM s WHERE NOT EXISTS (SELECT 1 FROM pick WHERE tgt IS NOT NULL) "
    "UNION ALL SELECT 9, 'warning', NULL, NULL, 'Found ' || miss || ' missing values across features.' FROM s WHERE miss > 0 "
    "UNION ALL SELECT 10, 'warning', NULL, NULL, dup || ' duplicate rows detected.' FROM dup WHERE dup > 0 "
    "UNION ALL SELECT 11, 'warning', NULL, NULL, 'Zero variance columns detected: ' || zvj || '.' FROM s WHERE nzv > 0)"],
    "SELECT CAST(seq AS INTEGER) AS seq, kind, name, status, message FROM allrows")

ORACLES["is_valid"] = with_src(src_table("telco"), [],
                               "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, "
                               "count(*) > 10 AND 11 >= 2 AS is_valid FROM src")

ORACLES["configure_target"] = with_src(src_table("telco"), [profile_cte(TELCO_COLS)],
                                       "SELECT ordinal, column_name, is_id_candidate OR column_name = 'tenure' AS is_id_candidate, "
                                       "column_name = 'Contract' AS is_target FROM prof")

ORACLES["class_count_guard"] = ("SELECT 'quality' AS target_column, count(DISTINCT quality) AS n_classes, "
                                "count(DISTINCT quality) >= 2 AS can_train FROM labels")


# ---- descriptive statistics ---------------------------------------------------
from retainx.plans.oracles import ORDERS_COLS, guarded_double, r  # noqa: E402

TELCO_COERCED = ("SELECT customerID, SeniorCitizen, tenure, InternetService, OnlineSecurity, TechSupport, Contract, "
                 f"PaymentMethod, MonthlyCharges, {guarded_double('TotalCharges')} AS TotalCharges, Churn FROM telco")
LI_NUM = [c for c, k in LINEITEM_COLS if k in "if"]


def _quantile_ctes(cols):
    lx = " UNION ALL ".join(f"SELECT {i} AS ordinal, CAST({q(c)} AS DOUBLE) AS x FROM src WHERE {q(c)} IS NOT NULL "
                            f"AND NOT isnan(CAST({q(c)} AS DOUBLE))" for i, c in enumerate(cols))
    return [f"lx AS ({lx})",
            "rk AS (SELECT ordinal, x, row_number() OVER (PARTITION BY ordinal ORDER BY x) - 1 AS k FROM lx)",
            "nn AS (SELECT ordinal, count(*) AS n FROM lx GROUP BY ordinal)",
            "tg AS (SELECT ordinal, prob, prob * (n - 1) AS pos, floor(prob * (n - 1)) AS i FROM nn, "
            "(VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) p(prob))",
            "pk AS (SELECT tg.ordinal, tg.prob, pos - i AS t, max(CASE WHEN k = i THEN x END) AS a, "
            "coalesce(max(CASE WHEN k = i + 1 THEN x END), max(CASE WHEN k = i THEN x END)) AS b "
            "FROM tg JOIN rk ON tg.ordinal = rk.ordinal AND (k = i OR k = i + 1) GROUP BY tg.ordinal, tg.prob, pos, i)",
            "qv AS (SELECT ordinal, prob, CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0 - t) ELSE a + (b - a) * t END AS v FROM pk)"]


def _numeric_stats_sql(src_cte, cols):
    per = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, count(x) AS n, count(*) - count(x) AS missing, avg(x) AS mean, "
        f"stddev_samp(x) AS std, min(x) AS mn, max(x) AS mx, skewness(x) AS sk "
        f"FROM (SELECT CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CAST({q(c)} AS DOUBLE) END AS x FROM src)"
        for i, c in enumerate(cols))
    return with_src(src_cte, [f"per AS ({per})", *_quantile_ctes(cols)],
                    f"SELECT column_name, n AS count, missing, {r('mean', 2)} AS mean, "
                    f"{r('CASE WHEN n > 1 THEN std ELSE 0.0 END', 2)} AS std, "
                    f"{r('(SELECT v FROM qv WHERE qv.ordinal = per.ordinal AND prob = 0.5)', 2)} AS median, "
                    f"{r('mn', 2)} AS min, {r('mx', 2)} AS max, "
                    f"{r('(SELECT v FROM qv WHERE qv.ordinal = per.ordinal AND prob = 0.25)', 2)} AS q25, "
                    f"{r('(SELECT v FROM qv WHERE qv.ordinal = per.ordinal AND prob = 0.75)', 2)} AS q75, "
                    f"{r('CASE WHEN n <= 2 THEN 0.0 WHEN sk IS NULL OR isnan(sk) THEN 0.0 ELSE sk END', 2)} AS skew "
                    "FROM per WHERE n > 0")


ORACLES["coerce_numeric"] = f"WITH {telco_cte()} {TELCO_COERCED}"

ORACLES["numeric_stats"] = _numeric_stats_sql(src_table("lineitem"), LI_NUM)

_ORD_CAT = [(c, k) for c, k in ORDERS_COLS if k not in "if"]
ORACLES["categorical_stats"] = with_src(src_table("orders"), [
    long_values_cte(_ORD_CAT),
    "names(ordinal, column_name) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(_ORD_CAT)) + ")",
    "vc AS (SELECT ordinal, value, count(*) AS n FROM lv GROUP BY ordinal, value)",
    "ag AS (SELECT ordinal, sum(n) AS count, count(*) AS unique_count, first(value ORDER BY n DESC, value) AS top_value, "
    "max(n) AS top_frequency FROM vc GROUP BY ordinal)"],
    "SELECT column_name, CAST(count AS BIGINT) AS count, (SELECT count(*) FROM src) - CAST(count AS BIGINT) AS missing, "
    f"unique_count, top_value, top_frequency, {r('top_frequency / count * 100.0', 2)} AS frequency_percentage "
    "FROM ag JOIN names USING (ordinal)")

ORACLES["categorical_values"] = with_src(src_table("orders"), [
    long_values_cte(_ORD_CAT),
    "names(ordinal, column_name) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(_ORD_CAT)) + ")",
    "d AS (SELECT DISTINCT ordinal, value, num FROM lv)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY num NULLS LAST, value) AS value_rank FROM d)"],
    "SELECT column_name, CAST(value_rank AS INTEGER) AS value_rank, value FROM rk JOIN names USING (ordinal)")
ORACLES["categorical_values_screen"] = ORACLES["categorical_values"] + " WHERE value_rank <= 20"

ORACLES["target_distribution"] = (
    "WITH c AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1) "
    f"SELECT k AS name, n AS count, {r('n / (SELECT count(*) FROM lineitem) * 100.0', 1)} AS percentage, "
    "CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS position FROM c")

_TELCO_CT = ["InternetService", "OnlineSecurity", "TechSupport", "Contract", "PaymentMethod"]


def _crosstab_sql(cols) -> str:
    return (f"WITH {telco_cte()}, src AS ({TELCO_COERCED}), long AS ("
            + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(CAST({q(c)} AS VARCHAR), 'nan') AS category, "
                                 f"coalesce(Churn, 'nan') AS target_class FROM src" for c in cols)
            + "), counts AS (SELECT feature, category, target_class, count(*) AS n FROM long GROUP BY ALL), "
            "grid AS (SELECT DISTINCT c.feature, c.category, t.target_class FROM counts c, (SELECT DISTINCT target_class FROM counts) t) "
            "SELECT g.feature, g.category, g.target_class, CAST(coalesce(n, 0) AS BIGINT) AS count FROM grid g "
            "LEFT JOIN counts USING (feature, category, target_class)")


ORACLES["category_by_target"] = _crosstab_sql(["customerID", *_TELCO_CT])
ORACLES["category_by_target_screen"] = _crosstab_sql(_TELCO_CT)
ORACLES["crosstab_cells"] = (
    "WITH long AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS category, 'd' || strftime(o_orderdate, '%m%d') AS target_class FROM orders "
    "UNION ALL SELECT 'customer', 'c' || o_custkey, 'd' || strftime(o_orderdate, '%m%d') FROM orders), "
    "c AS (SELECT feature, category, target_class, count(*) AS count FROM long GROUP BY ALL) "
    "SELECT *, CAST(sum(count) OVER (PARTITION BY feature, category) AS BIGINT) AS category_total, "
    "CAST(sum(count) OVER (PARTITION BY feature, target_class) AS BIGINT) AS class_total FROM c")
ORACLES["sample_large_and_small"] = (
    "WITH o AS (SELECT CAST(o_orderkey AS DOUBLE) AS k FROM orders), v AS (SELECT 'large' AS column_name, k * 12345678.5::DOUBLE + 1e7::DOUBLE AS x FROM o "
    "UNION ALL SELECT 'small', (k + 1) / 8192 FROM o UNION ALL SELECT 'tiny', (k + 1) * 0.0625e-6::DOUBLE FROM o "
    "UNION ALL SELECT 'huge', k * -1e17::DOUBLE - 1e16::DOUBLE FROM o), d AS (SELECT DISTINCT * FROM v) "
    "SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY x) AS INTEGER) AS sample_rank, CAST(x AS VARCHAR) AS sample_value FROM d "
    "QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY x) <= 5")


def _fmt1(x):
    t = f"CAST(round_even(({x}) * 10.0, 0) AS BIGINT)"
    return (f"(CASE WHEN {t} < 0 THEN '-' ELSE '' END || CAST(abs({t}) // 10 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({t}) % 10 AS VARCHAR), 1, '0'))")


def _edge(i):
    return f"(CASE WHEN {i} >= 8 THEN hi ELSE CAST({i} AS DOUBLE) * step + lo END)"


_hl = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS x FROM lineitem WHERE {q(c)} IS NOT NULL"
                         for c in LI_NUM)
ORACLES["numeric_histogram"] = (
    f"WITH long AS ({_hl}), "
    "r0 AS (SELECT feature, count(*) AS n, min(x) AS lo0, max(x) AS hi0 FROM long GROUP BY feature), "
    "rng AS (SELECT feature, lo, hi, (hi - lo) / 8.0 AS step FROM (SELECT feature, "
    "CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi "
    "FROM r0)), "
    "b3 AS (SELECT long.feature, " + " + ".join(
        f"CASE WHEN x >= CAST({k} AS DOUBLE) * step + lo THEN 1 ELSE 0 END" for k in range(1, 8))
    + " AS bin_index FROM long JOIN rng USING (feature)), "
    "counts AS (SELECT feature, bin_index, count(*) AS n FROM b3 GROUP BY ALL), "
    "grid AS (SELECT feature, lo, hi, step, CAST(g.bin_index AS BIGINT) AS bin_index FROM rng, range(0, 8) g(bin_index)) "
    f"SELECT feature, CAST(bin_index AS INTEGER) AS bin_index, {_fmt1(_edge('bin_index'))} || '-' || {_fmt1(_edge('bin_index + 1'))} AS bin, "
    "CAST(coalesce(n, 0) AS BIGINT) AS count FROM grid LEFT JOIN counts USING (feature, bin_index)")
ORACLES["numeric_histogram_screen"] = ORACLES["numeric_histogram"].replace("FROM r0)", "FROM r0 WHERE n > 10)")

_corr_cells = []
for _a in LI_NUM:
    for _b in LI_NUM:
        _corr_cells.append(f"SELECT '{_a}' AS x, '{_b}' AS y, "
                           f"{r(f'CASE WHEN corr({q(_a)}, {q(_b)}) IS NULL OR isnan(corr({q(_a)}, {q(_b)})) THEN 0.0 ELSE corr({q(_a)}, {q(_b)}) END', 2)}"
                           f" AS value FROM lineitem")
ORACLES["correlation_matrix"] = " UNION ALL ".join(_corr_cells)

_WIDE = [*LI_NUM, "flat", "twice", "minus", "partly"]
_MANY = {f"{c}_{k}": f"pow({q(c)} + {k}, {1 + k % 3}) % {97 + k}" for c in LI_NUM for k in range(3)}
_MANY["far"] = "l_quantity + 1e9::DOUBLE"
_MANY["partly"] = "CASE WHEN l_linenumber > 2 THEN l_discount END"
_MANY["flat"] = "0.1::DOUBLE"
ORACLES["correlation_many"] = (
    "WITH w AS (SELECT " + ", ".join(f"{e} AS {q(n)}" for n, e in _MANY.items()) + " FROM lineitem), c AS (SELECT "
    + ", ".join(f"covar_pop({q(a)}, {q(b)}) / nullif(stddev_pop(CASE WHEN {q(b)} IS NOT NULL THEN {q(a)} END) * "
                f"stddev_pop(CASE WHEN {q(a)} IS NOT NULL THEN {q(b)} END), 0) AS c{i}_{j}"
                for i, a in enumerate(_MANY) for j, b in enumerate(_MANY) if j >= i) + " FROM w) "
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'coalesce(c{min(i, j)}_{max(i, j)}, 0.0)', 2)} AS value FROM c"
                         for i, a in enumerate(_MANY) for j, b in enumerate(_MANY)))
ORACLES["correlation_wide"] = (
    "WITH w AS (SELECT *, CAST(1.0 AS DOUBLE) AS flat, l_quantity * 2 AS twice, -l_tax AS minus, "
    "CASE WHEN l_linenumber > 2 THEN l_discount END AS partly FROM lineitem), c AS (SELECT "
    + ", ".join(f"covar_pop({q(a)}, {q(b)}) / nullif(stddev_pop(CASE WHEN {q(b)} IS NOT NULL THEN {q(a)} END) * "
                f"stddev_pop(CASE WHEN {q(a)} IS NOT NULL THEN {q(b)} END), 0) AS c{i}_{j}"
                for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE) if j >= i) + " FROM w) "
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'coalesce(c{min(i, j)}_{max(i, j)}, 0.0)', 2)} AS value FROM c"
                         for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE)))

ORACLES["histogram_large_values"] = (
    "WITH long AS (SELECT 'big' AS feature, o_orderkey * CAST(1e15 AS DOUBLE) AS x FROM orders UNION ALL "
    "SELECT 'flat', CAST(7.0 AS DOUBLE) FROM orders), "
    "r0 AS (SELECT feature, min(x) AS lo0, max(x) AS hi0 FROM long GROUP BY feature), "
    "rng AS (SELECT feature, lo, hi, (hi - lo) / 8.0 AS step FROM (SELECT feature, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
    "CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0)), "
    "b3 AS (SELECT long.feature, " + " + ".join(
        f"CASE WHEN x >= CAST({k} AS DOUBLE) * step + lo THEN 1 ELSE 0 END" for k in range(1, 8))
    + " AS bin_index FROM long JOIN rng USING (feature)), "
    "counts AS (SELECT feature, bin_index, count(*) AS n FROM b3 GROUP BY ALL), "
    "grid AS (SELECT feature, lo, hi, step, CAST(g.bin_index AS BIGINT) AS bin_index FROM rng, range(0, 8) g(bin_index)), "
    f"e AS (SELECT *, {_edge('bin_index')} AS a, {_edge('bin_index + 1')} AS b FROM grid) "
    "SELECT feature, CAST(bin_index AS INTEGER) AS bin_index, printf('%.1f', a) || '-' || printf('%.1f', b) AS bin, "
    "CAST(coalesce(n, 0) AS BIGINT) AS count FROM e LEFT JOIN counts USING (feature, bin_index)")

ORACLES["dataset_analysis"] = (f"WITH {telco_cte()} SELECT count(*) AS rows_count, CAST(11 AS BIGINT) AS columns_count, "
                               "'Churn' AS target_column, CAST(4 AS BIGINT) AS numerical_columns, "
                               "CAST(7 AS BIGINT) AS categorical_columns FROM telco")

ORACLES["churn_kpis"] = (
    f"WITH {telco_cte()}, c AS (SELECT Churn AS k, count(*) AS n FROM telco WHERE Churn IS NOT NULL GROUP BY 1), "
    "rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS rn, "
    "lower(regexp_replace(k, '^\\s+|\\s+$', '', 'g')) IN ('yes', '1', 'true', 'churn', 'exited', 'churned') AS pos FROM c), "
    "p AS (SELECT coalesce((SELECT n FROM rk WHERE pos ORDER BY rn LIMIT 1), (SELECT n FROM rk WHERE rn = 2), "
    "(SELECT n FROM rk WHERE rn = 1), 0) AS churned), t AS (SELECT count(*) AS total FROM telco) "
    "SELECT total AS total_customers, CAST(churned AS BIGINT) AS churned_customers, "
    "CAST(total - churned AS BIGINT) AS non_churned_customers, "
    f"CASE WHEN total > 0 THEN {r('churned / total * 100.0', 1)} ELSE 0.0 END AS churn_rate FROM t, p")

ORACLES["display_class"] = (
    f"WITH {telco_cte()}, c AS (SELECT Churn AS k, count(*) AS n FROM telco WHERE Churn IS NOT NULL GROUP BY 1) "
    f"SELECT k AS name, n AS count, {r('n / (SELECT count(*) FROM telco) * 100.0', 1)} AS percentage, "
    "CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS position, "
    "CASE WHEN lower(k) IN ('1', 'yes') THEN 'Churned' ELSE 'Retained' END AS display_name FROM c")


# ---- row sets -----------------------------------------------------------------
_TC = [c for c, _ in TELCO_COLS]
_TXT = ", ".join(f"coalesce(CAST({q(c)} AS VARCHAR), '') AS {q(c)}" for c in _TC)

ORACLES["preview"] = (f"WITH {telco_cte()} SELECT {_TXT}, (SELECT count(*) FROM telco) AS total_rows "
                      "FROM telco ORDER BY customerID LIMIT 100")
ORACLES["search_any_column"] = (f"WITH {telco_cte()} SELECT * FROM telco WHERE "
                                + " OR ".join(f"coalesce(contains(lower(CAST({q(c)} AS VARCHAR)), 'fiber'), false)" for c in _TC))
ORACLES["class_filter"] = f"WITH {telco_cte()} SELECT * FROM telco WHERE lower(Churn) IN ('yes', '1', 'true', 'churn')"
ORACLES["random_customer"] = (
    f"WITH {telco_cte()} SELECT {_TXT}, Churn AS actual_target FROM telco ORDER BY "
    "CASE WHEN lower(Churn) IN ('no', '0', 'false', 'retained') THEN 0 ELSE 1 END, md5(concat_ws(':', '42', customerID)) LIMIT 1")
ORACLES["distinct_rows"] = (f"WITH {telco_cte()} SELECT {', '.join(q(c) for c in _TC if c != 'customerID')} "
                            "FROM (SELECT DISTINCT * FROM telco)")
ORACLES["drop_columns"] = (f"WITH {telco_cte()} SELECT {', '.join(q(c) for c in _TC if c not in ('customerID', 'Churn'))} FROM telco")

# ---- features -----------------------------------------------------------------
_FEAT = ["SeniorCitizen", "tenure", "InternetService", "OnlineSecurity", "TechSupport", "Contract", "PaymentMethod",
         "MonthlyCharges", "TotalCharges"]
_NUM = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
_CAT = ["InternetService", "OnlineSecurity", "TechSupport", "Contract", "PaymentMethod"]

def _sized(x: str) -> str:
    """A value of a row key: its text after its length, so that no text passes for a border or a null."""
    return f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), 'null')"


_PREP = (f"{telco_cte()}, prep AS (SELECT SeniorCitizen, tenure, InternetService, OnlineSecurity, TechSupport, Contract, "
         f"PaymentMethod, MonthlyCharges, {guarded_double('TotalCharges')} AS TotalCharges, Churn, "
         "md5(concat_ws('|', " + ", ".join(_sized(q(c)) for c in _TC) + ")) AS _row_key "
         "FROM (SELECT DISTINCT * FROM telco))")
_LAB = _PREP + ", lab AS (SELECT *, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label FROM prep)"
# exactly the allocated number of rows per label, in the order of a hash that is unique per row
_SPLIT_OF = (", h AS (SELECT *, md5(concat_ws('|', '42', _row_key)) AS _h FROM lab), "
          "cnt AS (SELECT label, count(*) AS nc FROM h GROUP BY label), "
          "tot AS (SELECT sum(nc) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(nc)) AS BIGINT) AS nt FROM cnt), "
          "al0 AS (SELECT label, floor(nt * nc / n) AS base, nt * nc / n - floor(nt * nc / n) AS frac, nt FROM cnt, tot), "
          "al AS (SELECT label, CAST(base + CASE WHEN row_number() OVER (ORDER BY frac DESC, label) <= nt - sum(base) OVER () "
          "THEN 1 ELSE 0 END AS BIGINT) AS k FROM al0), "
          "rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY _h) AS rn FROM h), "
          "split_keyed AS (SELECT rk.* EXCLUDE (_h, rn), rn <= al.k AS is_test FROM rk JOIN al ON rk.label = al.label), "
          "split AS (SELECT * EXCLUDE (_row_key) FROM split_keyed)")
_SPLIT = _LAB + _SPLIT_OF

ORACLES["split_few_feature_rows"] = (
    "WITH few AS (SELECT o_orderkey AS id, o_orderpriority AS plan, CASE WHEN o_orderkey % 10 < 3 THEN 'Yes' ELSE 'No' END AS Churn FROM orders), "
    f"lab AS (SELECT plan, Churn, md5(concat_ws('|', {_sized('id')}, {_sized('plan')}, {_sized('Churn')})) AS _row_key, "
    "CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label FROM (SELECT DISTINCT * FROM few))" + _SPLIT_OF + " SELECT * FROM split_keyed")

ORACLES["prepare"] = f"WITH {_PREP} SELECT * EXCLUDE (_row_key) FROM prep"
ORACLES["map_target"] = f"WITH {telco_cte()} SELECT customerID, Churn, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label FROM telco"
ORACLES["split_feature_types"] = ("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', '{'numerical' if c in _NUM else 'categorical'}')" for i, c in enumerate(_FEAT)) + ") t(ordinal, column_name, kind)")
ORACLES["normalize_categories"] = (f"WITH {_PREP} SELECT " + ", ".join(
    f"regexp_replace(coalesce(CAST({q(c)} AS VARCHAR), 'nan'), '^\\s+|\\s+$', '', 'g') AS {q(c)}" if c in _CAT else q(c)
    for c in _FEAT + ["Churn"]) + " FROM prep")
ORACLES["category_domain"] = (f"WITH {_PREP} " + " UNION ".join(
    f"SELECT '{c}' AS column_name, regexp_replace(coalesce(CAST({q(c)} AS VARCHAR), 'nan'), '^\\s+|\\s+$', '', 'g') AS value FROM prep"
    for c in _CAT))


def _median_sql(src: str, cols) -> list[str]:
    lx = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({q(c)} AS DOUBLE) AS x FROM {src} "
                            f"WHERE {q(c)} IS NOT NULL AND NOT isnan(CAST({q(c)} AS DOUBLE))" for c in cols)
    return [f"mx AS ({lx})",
            "mrk AS (SELECT column_name, x, row_number() OVER (PARTITION BY column_name ORDER BY x) - 1 AS k FROM mx)",
            "mn AS (SELECT column_name, count(*) AS n FROM mx GROUP BY column_name)",
            "mtg AS (SELECT column_name, 0.5 * (n - 1) AS pos, floor(0.5 * (n - 1)) AS i FROM mn)",
            "mpk AS (SELECT mtg.column_name, pos - i AS t, max(CASE WHEN k = i THEN x END) AS a, "
            "coalesce(max(CASE WHEN k = i + 1 THEN x END), max(CASE WHEN k = i THEN x END)) AS b "
            "FROM mtg JOIN mrk ON mtg.column_name = mrk.column_name AND (k = i OR k = i + 1) GROUP BY mtg.column_name, pos, i)",
            "med AS (SELECT column_name, CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0 - t) ELSE a + (b - a) * t END AS median FROM mpk)"]


ORACLES["numeric_ranges"] = (
    f"WITH {_PREP}, " + ", ".join(_median_sql("prep", _NUM)) + ", ag AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min(CAST({q(c)} AS DOUBLE)) AS mn, max(CAST({q(c)} AS DOUBLE)) AS mxx, "
        f"avg(CAST({q(c)} AS DOUBLE)) AS mean FROM prep" for c in _NUM)
    + ") SELECT column_name, coalesce(mn, 0.0) AS min, coalesce(mxx, 100.0) AS max, round(coalesce(mean, 50.0), 9) AS mean, "
      "coalesce(median, 50.0) AS median FROM ag LEFT JOIN med USING (column_name)")

ORACLES["train_test_split"] = f"WITH {_SPLIT} SELECT * FROM split"

_IMP = (_SPLIT + ", train AS (SELECT * FROM split WHERE NOT is_test), " + ", ".join(_median_sql("train", _NUM))
        + ", imp AS (SELECT " + ", ".join(
            f"coalesce(CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CAST({q(c)} AS DOUBLE) END, "
            f"(SELECT median FROM med WHERE column_name = '{c}')) AS {q(c)}" if c in _NUM else q(c)
            for c in _FEAT + ["Churn", "label", "is_test"]) + " FROM split)")
ORACLES["impute_median"] = f"WITH {_IMP} SELECT * FROM imp"

ORACLES["impute_mode"] = (f"WITH {_SPLIT}, cc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, regexp_replace(coalesce(CAST({q(c)} AS VARCHAR), 'nan'), '^\\s+|\\s+$', '', 'g') AS value "
    "FROM split WHERE NOT is_test" for c in _CAT)
    + "), vc AS (SELECT column_name, value, count(*) AS n FROM cc GROUP BY ALL) "
      "SELECT column_name, first(value ORDER BY n DESC, value) AS mode FROM vc GROUP BY column_name")

ORACLES["fill_missing_categories"] = (
    f"WITH {_SPLIT}, cc AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, regexp_replace(coalesce(CAST({q(c)} AS VARCHAR), 'nan'), '^\\s+|\\s+$', '', 'g') AS value "
        "FROM split WHERE NOT is_test" for c in _CAT)
    + "), vc AS (SELECT column_name, value, count(*) AS n FROM cc GROUP BY ALL), "
      "md AS (SELECT column_name, first(value ORDER BY n DESC, value) AS mode FROM vc GROUP BY column_name) "
      "SELECT * REPLACE (CASE WHEN tenure % 7 <> 0 THEN Contract ELSE (SELECT mode FROM md WHERE column_name = 'Contract') END AS Contract, "
      "CASE WHEN tenure % 5 <> 0 THEN PaymentMethod ELSE (SELECT mode FROM md WHERE column_name = 'PaymentMethod') END AS PaymentMethod) FROM split")

ORACLES["standard_scale"] = (
    f"WITH {_IMP}, st AS (SELECT " + ", ".join(
        f"avg({q(c)}) AS m_{i}, CASE WHEN stddev_pop({q(c)}) IS NULL OR stddev_pop({q(c)}) = 0 THEN 1.0 ELSE stddev_pop({q(c)}) END AS s_{i}"
        for i, c in enumerate(_NUM)) + " FROM imp WHERE NOT is_test) SELECT " + ", ".join(
        f"round(({q(c)} - m_{_NUM.index(c)}) / s_{_NUM.index(c)}, 6) AS {q(c)}" if c in _NUM else q(c)
        for c in _FEAT + ["Churn", "label", "is_test"]) + " FROM imp, st")

_OH_DOM = {"InternetService": ["DSL", "Fiber optic", "No"], "OnlineSecurity": ["No", "No internet service", "Yes"],
           "TechSupport": ["No", "No internet service", "Yes"], "Contract": ["Month-to-month", "One year", "Two year"],
           "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"]}
ORACLES["one_hot"] = (f"WITH {_SPLIT} SELECT label, is_test, " + ", ".join(
    f"CAST(coalesce(regexp_replace(coalesce(CAST({q(c)} AS VARCHAR), 'nan'), '^\\s+|\\s+$', '', 'g') = '{v}', false) AS INTEGER) "
    f"AS {q(c + '_' + v)}" for c, vs in _OH_DOM.items() for v in vs) + " FROM split")

_tc = "TotalCharges"
ORACLES["derive_total_charges"] = (
    f"WITH {telco_cte()} SELECT customerID, MonthlyCharges, tenure, CASE WHEN {_tc} IS NULL OR "
    f"regexp_replace({_tc}, '^\\s+|\\s+$', '', 'g') = '' OR coalesce({guarded_double(_tc)}, 1.0) = 0.0 THEN "
    f"CAST({r('coalesce(' + guarded_double('CAST(MonthlyCharges AS VARCHAR)') + ', 0.0) * greatest(coalesce(' + guarded_double('CAST(tenure AS VARCHAR)') + ', 0.0), 1.0)', 2)} AS VARCHAR) "
    f"ELSE {_tc} END AS {_tc} FROM telco")

ORACLES["balanced_class_weight"] = (
    f"WITH {_LAB} SELECT Churn, label, count(*) OVER () / (2 * count(*) OVER (PARTITION BY label)) AS weight FROM lab")


# ---- scoring and evaluation -----------------------------------------------------------
_SC_TERMS = {
    "contract": "CASE WHEN CAST(Contract AS VARCHAR) = 'Month-to-month' THEN 35 WHEN CAST(Contract AS VARCHAR) = 'One year' THEN 8 ELSE -15 END",
    "fiber": "CASE WHEN CAST(InternetService AS VARCHAR) = 'Fiber optic' THEN 18 ELSE 0 END",
    "tech_support": "CASE WHEN CAST(TechSupport AS VARCHAR) = 'No' THEN 12 ELSE 0 END",
    "online_security": "CASE WHEN CAST(OnlineSecurity AS VARCHAR) = 'No' THEN 10 ELSE 0 END",
    "electronic_check": "CASE WHEN CAST(PaymentMethod AS VARCHAR) = 'Electronic check' THEN 15 ELSE 0 END",
    "tenure": "CASE WHEN CAST(tenure AS DOUBLE) <= 12 THEN 20 WHEN CAST(tenure AS DOUBLE) > 48 THEN -25 ELSE 0 END",
    "senior": "CASE WHEN CAST(SeniorCitizen AS VARCHAR) = '1' THEN 8 ELSE 0 END",
    "monthly": "CASE WHEN CAST(MonthlyCharges AS DOUBLE) > 80 THEN 10 ELSE 0 END",
}
_SC_CARDS = {"scorecard_full": list(_SC_TERMS), "scorecard_contract_tenure": ["contract", "tenure"],
             "scorecard_services": ["fiber", "tech_support", "online_security"],
             "scorecard_billing": ["electronic_check", "monthly", "senior"]}


def _sc_prob(terms):
    pts = "(0 + " + " + ".join(f"({_SC_TERMS[t]})" for t in terms) + ")"
    return f"(1.0 / (1.0 + exp(CAST(-3.0 AS DOUBLE) * CAST({pts} - 35 AS DOUBLE) / 100.0)))"


_P = _sc_prob(list(_SC_TERMS))
_SCORED = (f"{telco_cte()}, p AS (SELECT *, {_P} AS _p FROM telco), scored AS (SELECT * EXCLUDE (_p), "
           f"{r('_p * 100.0', 1)} AS \"Churn_Probability_%\", {r('(1.0 - _p) * 100.0', 1)} AS \"Retention_Probability_%\" FROM p), "
           "scored2 AS (SELECT *, CASE WHEN \"Churn_Probability_%\" >= 50.0 THEN 'Churn' ELSE 'No Churn' END AS Predicted_Churn, "
           "CASE WHEN \"Churn_Probability_%\" < 35.0 THEN 'Low Risk' WHEN \"Churn_Probability_%\" < 65.0 THEN 'Medium Risk' "
           "ELSE 'High Risk' END AS Risk_Level FROM scored)")
ORACLES["score_batch"] = f"WITH {_SCORED} SELECT * FROM scored2"
ORACLES["churn_label"] = (f"WITH {predictions_cte()} SELECT id, churn_probability, "
                          "CASE WHEN churn_probability >= 50.0 THEN 'Churn' ELSE 'No Churn' END AS prediction FROM predictions")
ORACLES["risk_tier"] = (f"WITH {predictions_cte()} SELECT id, churn_probability, CASE WHEN churn_probability < 35.0 THEN 'Low Risk' "
                        "WHEN churn_probability < 65.0 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level FROM predictions")
ORACLES["batch_summary"] = (
    f"WITH {_SCORED} SELECT count(*) AS total_records, "
    "CAST(sum(CASE WHEN Predicted_Churn = 'Churn' THEN 1 ELSE 0 END) AS BIGINT) AS churn_count, "
    "CAST(sum(CASE WHEN Predicted_Churn <> 'Churn' THEN 1 ELSE 0 END) AS BIGINT) AS non_churn_count, "
    "CAST(sum(CASE WHEN Risk_Level = 'High Risk' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count, "
    "CAST(sum(CASE WHEN Risk_Level = 'Medium Risk' THEN 1 ELSE 0 END) AS BIGINT) AS medium_risk_count, "
    "CAST(sum(CASE WHEN Risk_Level = 'Low Risk' THEN 1 ELSE 0 END) AS BIGINT) AS low_risk_count FROM scored2")
ORACLES["share_of_total"] = (f"WITH {_SCORED}, c AS (SELECT Risk_Level, count(*) AS count FROM scored2 GROUP BY 1) "
                             f"SELECT Risk_Level, count, {r('count / (SELECT sum(count) FROM c) * 100.0', 1)} AS share FROM c")
ORACLES["batch_preview"] = (
    f"WITH {_SCORED}, h AS (SELECT * FROM scored2 ORDER BY customerID LIMIT 50) "
    "SELECT CAST(row_number() OVER (ORDER BY customerID) AS INTEGER) AS row_index, customerID AS customer_identifier, "
    "Predicted_Churn AS prediction, \"Churn_Probability_%\" AS churn_probability, "
    "\"Retention_Probability_%\" AS retention_probability, Risk_Level AS risk_level FROM h")


def _fmt2(x):
    t = f"CAST(round_even(({x}) * 100.0, 0) AS BIGINT)"
    return (f"(CASE WHEN {t} < 0 THEN '-' ELSE '' END || CAST(abs({t}) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({t}) % 100 AS VARCHAR), 2, '0'))")


def _fired_sql(has_contract: bool, src: str) -> str:
    """(customerID, slot, feature, value, impact, importance) of every rule that fires for a customer of ``src``."""
    lc = "lower(coalesce(CAST(Contract AS VARCHAR), ''))" if has_contract else "''"
    ten = f"coalesce({guarded_double('CAST(tenure AS VARCHAR)')}, 0.0)"
    mc = f"coalesce({guarded_double('CAST(MonthlyCharges AS VARCHAR)')}, 0.0)"
    months = f"CAST(CAST(trunc({ten}) AS BIGINT) AS VARCHAR) || ' months'"
    rules = [
        (f"contains({lc}, 'month')", "'Contract Type'", "coalesce(Contract, 'Month-to-month')" if has_contract else "NULL",
         "'Increases Churn Risk'", "0.28", 1),
        (f"NOT contains({lc}, 'month') AND (contains({lc}, 'two') OR contains({lc}, 'one'))", "'Contract Type'",
         "Contract" if has_contract else "NULL", "'Decreases Churn Risk (High Retention)'", "0.25", 1),
        (f"{ten} <= 12", "'Customer Tenure'", months, "'Increases Churn Risk (New Customer)'", "0.22", 2),
        (f"{ten} > 12 AND {ten} >= 36", "'Customer Tenure'", months, "'Decreases Churn Risk (Loyal Customer)'", "0.20", 2),
        (f"{mc} > 75", "'Monthly Charges'", f"'$' || {_fmt2(mc)}", "'Increases Churn Risk (High Cost)'", "0.18", 3),
        ("lower(coalesce(CAST(TechSupport AS VARCHAR), '')) = 'no'", "'Tech Support'", "'No Support Subscribed'",
         "'Increases Churn Risk'", "0.14", 4),
        ("lower(coalesce(CAST(OnlineSecurity AS VARCHAR), '')) = 'no'", "'Online Security'", "'No Online Security'",
         "'Increases Churn Risk'", "0.12", 5),
        ("contains(lower(coalesce(CAST(PaymentMethod AS VARCHAR), '')), 'electronic check')", "'Payment Method'",
         "PaymentMethod", "'Increases Churn Risk'", "0.10", 6),
    ]
    parts = [f"SELECT customerID, {slot} AS slot, {feat} AS feature, CAST({val} AS VARCHAR) AS value, {imp} AS impact, "
             f"CAST({w} AS DOUBLE) AS importance FROM {src} WHERE {cond}" for cond, feat, val, imp, w, slot in rules]
    return " UNION ALL ".join(parts)


def _explain_sql(has_contract: bool):
    src = "(SELECT DISTINCT * FROM telco)" if has_contract else "(SELECT DISTINCT * EXCLUDE (Contract) FROM telco)"
    fired = _fired_sql(has_contract, src)
    fb_cols = ["Contract", "tenure", "InternetService", "PaymentMethod", "TechSupport"]
    fb_imp = [0.35, 0.25, 0.18, 0.15, 0.12]
    fb = " UNION ALL ".join(
        f"SELECT customerID, {10 + i} AS slot, '{c}' AS feature, "
        f"{('CAST(' + q(c) + ' AS VARCHAR)') if (c != 'Contract' or has_contract) else repr('Active')} AS value, "
        f"'Primary Model Driver' AS impact, CAST({w} AS DOUBLE) AS importance FROM {src} t "
        f"WHERE NOT EXISTS (SELECT 1 FROM fired f WHERE f.customerID = t.customerID)"
        for i, (c, w) in enumerate(zip(fb_cols, fb_imp)))
    # duplicated customers appear twice in the view: number rows per occurrence
    return (f"WITH {telco_cte()}, fired AS ({fired}), allf AS (SELECT * FROM fired UNION ALL {fb}), "
            "occ AS (SELECT customerID, count(*) AS n FROM telco GROUP BY customerID), "
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY slot) AS factor_rank FROM allf) "
            "SELECT customerID, CAST(factor_rank AS INTEGER) AS factor_rank, feature, value, impact, importance "
            "FROM ranked JOIN occ USING (customerID), range(0, 10) k(i) WHERE factor_rank <= 5 AND i < n")


ORACLES["explain_rules"] = _explain_sql(True)
ORACLES["explain_fallback"] = _explain_sql(False)
ORACLES["customer_identifier"] = ("SELECT event_id, 'CUST-' || upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 6)) "
                                  "AS customer_identifier FROM events")

_EV = (f"{_LAB}, ev AS (SELECT label, CAST({_P} > 0.5 AS INTEGER) AS prediction, {_P} AS score FROM lab), "
       "cnt AS (SELECT CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
       "CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
       "CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
       "CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM ev)")
ORACLES["confusion_matrix"] = (f"WITH {_EV} SELECT 0 AS actual, 0 AS predicted, tn AS count FROM cnt UNION ALL "
                               "SELECT 0, 1, fp FROM cnt UNION ALL SELECT 1, 0, fn FROM cnt UNION ALL SELECT 1, 1, tp FROM cnt")


def _metric_cols(d=2):
    rt = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
    return (f"{r(rt('tp + tn', 'tp + tn + fp + fn') + ' * 100.0', d)} AS accuracy, "
            f"{r(rt('tp', 'tp + fp') + ' * 100.0', d)} AS precision, {r(rt('tp', 'tp + fn') + ' * 100.0', d)} AS recall, "
            f"{r(rt('2 * tp', '2 * tp + fp + fn') + ' * 100.0', d)} AS f1_score")


ORACLES["binary_metrics"] = f"WITH {_EV} SELECT tp, fp, fn, tn, {_metric_cols()} FROM cnt"

_AUC = ("vc AS (SELECT {k} score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY ALL), "
        "rr AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM vc), "
        "au AS (SELECT {k} sum(pos * (nb + neg * 0.5)) AS u, sum(pos) AS p, sum(neg) AS n FROM rr GROUP BY ALL)")
ORACLES["roc_auc"] = (f"WITH {_EV}, {_AUC.format(k='', src='ev', part='')} SELECT "
                      f"{r('CASE WHEN p > 0 AND n > 0 THEN u / (p * n) ELSE (tp + tn) / (tp + tn + fp + fn) END * 100.0', 2)} "
                      "AS roc_auc FROM au, cnt")

_LONG = (f"{_LAB}, lng AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS algorithm_name, {i} AS ordinal, label, CAST({_sc_prob(t)} > 0.5 AS INTEGER) AS prediction, "
    f"{_sc_prob(t)} AS score FROM lab" for i, (name, t) in enumerate(_SC_CARDS.items())) + "), "
    "cnt AS (SELECT algorithm_name, ordinal, CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
    "CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
    "CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM lng GROUP BY ALL), "
    + _AUC.format(k="algorithm_name, ordinal,", src="lng", part="PARTITION BY algorithm_name, ordinal") + ", "
    f"met AS (SELECT cnt.algorithm_name, cnt.ordinal, {_metric_cols()}, "
    f"{r('CASE WHEN p > 0 AND n > 0 THEN u / (p * n) ELSE (tp + tn) / (tp + tn + fp + fn) END * 100.0', 2)} AS roc_auc "
    "FROM cnt JOIN au USING (algorithm_name, ordinal))")
ORACLES["select_best"] = (f"WITH {_LONG} SELECT arg_min(algorithm_name, (-(0.5 * f1_score + 0.5 * roc_auc), ordinal)) AS best_algorithm, "
                          "max(CAST(0.5 AS DOUBLE) * f1_score + CAST(0.5 AS DOUBLE) * roc_auc) AS best_score FROM met")
ORACLES["model_comparison"] = (
    f"WITH {_LONG}, best AS (SELECT arg_min(algorithm_name, (-(0.5 * f1_score + 0.5 * roc_auc), ordinal)) AS b FROM met) "
    "SELECT 1 AS dataset_id, algorithm_name, CAST(row_number() OVER (ORDER BY f1_score DESC, ordinal) AS INTEGER) AS rank, "
    "accuracy, precision, recall, f1_score, roc_auc, algorithm_name = b AS is_best, b AS best_algorithm, "
    "CAST(0.0 AS DOUBLE) AS total_training_time FROM met, best")


# ---- prediction log, registry, sources and sinks -------------------------------------------
_MODELS = "models(id, algorithm_name) AS (VALUES (1, 'Logistic Regression'), (2, 'Decision Tree'), (3, 'Random Forest'), (4, 'Gradient Boosting'))"
_MODELS3 = "models(id, algorithm_name) AS (VALUES (1, 'Logistic Regression'), (2, 'Decision Tree'), (3, 'Random Forest'))"

ORACLES["history_query"] = (f"WITH {predictions_cte()} SELECT * FROM predictions WHERE user_id = 1 AND "
                            "contains(lower(customer_identifier), '12') AND risk_level = 'High Risk' "
                            "ORDER BY created_at DESC, id LIMIT 100")
ORACLES["history_page"] = (f"WITH {predictions_cte()} SELECT * FROM predictions WHERE user_id = 2 "
                           "ORDER BY created_at DESC, id LIMIT 1000 OFFSET 700")
ORACLES["history_cursor"] = ORACLES["history_page"]
ORACLES["history_with_model"] = (f"WITH {predictions_cte()}, {_MODELS3} SELECT p.*, coalesce(m.algorithm_name, 'Classifier') "
                                 "AS model_name FROM predictions p LEFT JOIN models m ON p.model_id = m.id")
ORACLES["latest_predictions"] = (f"WITH {predictions_cte()} SELECT * FROM (SELECT *, CAST(row_number() OVER "
                                 "(PARTITION BY user_id ORDER BY created_at DESC, id) AS INTEGER) AS recency_rank FROM predictions) "
                                 "WHERE recency_rank <= 5")
ORACLES["prediction_count"] = f"WITH {predictions_cte()} SELECT user_id, count(*) AS total_predictions FROM predictions GROUP BY 1"
_RA = ("SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_active DESC, "
       "uploaded_at DESC, id DESC) AS _r FROM datasets) WHERE _r = 1")
ORACLES["resolve_active"] = f"WITH {datasets_cte()} {_RA}"
ORACLES["activate"] = (f"WITH {datasets_cte()}, ch AS ({_RA}) SELECT d.id, d.user_id, d.filename, d.rows_count, "
                       "d.columns_count, d.target_column, coalesce(d.id = ch.id, false) AS is_active, d.uploaded_at "
                       "FROM datasets d LEFT JOIN ch ON d.user_id = ch.user_id")
_NO_USER = "nu AS (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN user_id END AS user_id) FROM predictions)"
ORACLES["delete_records"] = (f"WITH {predictions_cte()}, {_NO_USER} SELECT * FROM nu WHERE user_id IS DISTINCT FROM 3 AND "
                             "(model_id IS NULL OR model_id <> 4)")
ORACLES["delete_by_id"] = f"WITH {predictions_cte()}, {_NO_USER} SELECT * FROM nu WHERE risk_level <> 'Low Risk'"
ORACLES["list_datasets"] = f"WITH {datasets_cte()} SELECT * FROM datasets WHERE user_id = 2 ORDER BY uploaded_at DESC, id DESC"
ORACLES["search_batch_result"] = (f"WITH {_SCORED} SELECT * FROM scored2 WHERE contains(lower(customerID), 'high') OR "
                                  "contains(lower(Predicted_Churn), 'high') OR contains(lower(Risk_Level), 'high')")
ORACLES["dashboard_summary"] = (
    ORACLES["churn_kpis"].replace("SELECT total AS total_customers", ", kp AS (SELECT total AS total_customers", 1)
    + f"), {predictions_cte()}, {_MODELS}, mine AS (SELECT p.*, coalesce(m.algorithm_name, 'Classifier') AS model_name "
      "FROM predictions p LEFT JOIN models m ON p.model_id = m.id WHERE user_id = 1) "
      "SELECT 1 AS user_id, kp.*, (SELECT count(*) FROM mine) AS total_predictions, "
      "(SELECT model_name FROM mine ORDER BY created_at DESC, id LIMIT 1) AS latest_model, "
      "(SELECT max(created_at) FROM mine) AS latest_prediction_at FROM kp")
ORACLES["scored_csv_sink"] = (f"WITH {_SCORED} SELECT * REPLACE (TRY_CAST(NULLIF(TotalCharges, '') AS DOUBLE) "
                              "AS TotalCharges) FROM scored2")
ORACLES["prediction_log_append"] = f"WITH {predictions_cte()} SELECT * FROM predictions"
# the log's newest form: inputs and fired rules of the prediction's customer
ORACLES["log_inputs_and_factors"] = (
    f"WITH {predictions_cte()}, {telco_cte()}, cust AS (SELECT DISTINCT * FROM telco), fired AS ({_fired_sql(True, 'cust')}), "
    "top AS (SELECT * FROM fired QUALIFY row_number() OVER (PARTITION BY customerID ORDER BY slot) <= 5), "
    "fac AS (SELECT customerID, string_agg(feature || ':' || value || ':' || impact || ':' || CAST(CAST(importance AS DECIMAL(4,2)) AS VARCHAR), "
    "'|' ORDER BY slot) AS factors FROM top GROUP BY customerID) "
    "SELECT p.id, p.user_id, p.model_id, p.customer_identifier, p.prediction, p.churn_probability, p.risk_level, p.created_at, "
    + ", ".join(f"CAST(c.{q(c)} AS VARCHAR) AS {q(c)}" for c in LOG_INPUTS)
    + ", CASE WHEN c.customerID IS NOT NULL THEN coalesce(factors, '') END AS factors FROM predictions p "
      "LEFT JOIN cust c ON p.customer_identifier = 'CUST-' || substr(c.customerID, 2) LEFT JOIN fac f ON f.customerID = c.customerID")
ORACLES["activate_committed"] = (
    f"WITH {datasets_cte()}, ch AS (SELECT user_id, max(id) AS id FROM datasets WHERE user_id <> 3 GROUP BY user_id) "
    "SELECT 1 AS version, id, user_id, is_active FROM datasets UNION ALL "
    "SELECT 2, d.id, d.user_id, CASE WHEN ch.id IS NULL THEN d.is_active ELSE d.id = ch.id END FROM datasets d LEFT JOIN ch ON d.user_id = ch.user_id")
_REL = ", ".join(f"r_{name} AS ({text.format(customer='customer', orders='orders', lineitem='lineitem')})" for name, text in RELATION_SQL.items())
ORACLES["delete_cascade"] = (
    f"WITH {_REL}, gu AS (SELECT id FROM r_users WHERE id % 50 = 7), "
    "gd AS (SELECT id FROM r_datasets WHERE id % 90 = 11 OR user_id IN (FROM gu)), "
    "gm AS (SELECT id FROM r_models WHERE user_id IN (FROM gu) OR dataset_id IN (FROM gd)) "
    "SELECT 'users' AS table_name, id, NULL::BIGINT AS user_id, NULL::BIGINT AS dataset_id, NULL::BIGINT AS model_id FROM r_users WHERE id NOT IN (FROM gu) "
    "UNION ALL SELECT 'datasets', id, user_id, NULL, NULL FROM r_datasets WHERE id NOT IN (FROM gd) "
    "UNION ALL SELECT 'models', id, user_id, dataset_id, NULL FROM r_models WHERE id NOT IN (FROM gm) "
    "UNION ALL SELECT 'predictions', id, user_id, dataset_id, model_id FROM r_predictions "
    "WHERE (user_id IN (FROM gu) OR dataset_id IN (FROM gd) OR model_id IN (FROM gm)) IS NOT TRUE")
ORACLES["csv_source"] = (f"WITH {telco_cte()} SELECT customerID, SeniorCitizen, tenure, InternetService, OnlineSecurity, "
                         "TechSupport, Contract, PaymentMethod, MonthlyCharges, TRY_CAST(NULLIF(TotalCharges, '') AS DOUBLE) "
                         "AS TotalCharges, Churn FROM telco")
ORACLES["csv_quoted_text"] = (
    "SELECT c_custkey, 'He said \"hi\",' || chr(10) || 'then ' || c_name AS note, "
    "'12345678901234' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS account, c_custkey % 2 = 0 AS even FROM customer")
ORACLES["history_export_user"] = (
    f"WITH {predictions_cte()}, {_MODELS} SELECT p.id AS ID, customer_identifier AS Customer_Identifier, "
    "coalesce(m.algorithm_name, 'N/A') AS Model, prediction AS Prediction, churn_probability AS \"Churn_Probability_%\", "
    "retention_probability AS \"Retention_Probability_%\", risk_level AS Risk_Level, "
    "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS Date FROM predictions p LEFT JOIN models m ON p.model_id = m.id WHERE user_id = 4")
ORACLES["history_export"] = (
    f"WITH {predictions_cte()}, {_MODELS3} SELECT p.id AS ID, customer_identifier AS Customer_Identifier, "
    "coalesce(m.algorithm_name, 'N/A') AS Model, prediction AS Prediction, churn_probability AS \"Churn_Probability_%\", "
    "retention_probability AS \"Retention_Probability_%\", risk_level AS Risk_Level, "
    "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS Date FROM predictions p LEFT JOIN models m ON p.model_id = m.id")
ORACLES["flatten_input_data"] = "SELECT *, json_extract_string(props, '$.k') AS Feature_k FROM events"


# ---- scoring-input normalisation (F14 / F15) ----------------------------------------------
def _norm_cat(x):
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), 'nan'), '^\\s+|\\s+$', '', 'g')"


_FIT = (f"{_PREP}, " + ", ".join(_median_sql("prep", _NUM)) + ", dom AS (" + " UNION ".join(
    f"SELECT '{c}' AS column_name, {_norm_cat(q(c))} AS value FROM prep" for c in _CAT) + "), "
    "dc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_norm_cat(q(c))} AS value FROM prep" for c in _CAT)
    + "), modes AS (SELECT column_name, first(value ORDER BY n DESC, value) AS mode FROM "
      "(SELECT column_name, value, count(*) AS n FROM dc GROUP BY ALL) GROUP BY column_name)")


def _med(c):
    return f"(SELECT median FROM med WHERE column_name = '{c}')"


def _mode(c):
    return f"(SELECT mode FROM modes WHERE column_name = '{c}')"


ORACLES["align_batch"] = (
    f"WITH {_FIT}, b AS (SELECT * EXCLUDE (PaymentMethod, TotalCharges) FROM telco) SELECT customerID, Churn, "
    + ", ".join(
        (f"coalesce({guarded_double(f'CAST({q(c)} AS VARCHAR)')}, {_med(c)}) AS {q(c)}" if c != "TotalCharges"
         else f"{_med(c)} AS TotalCharges") if c in _NUM else
        (f"{_norm_cat(q(c))} AS {q(c)}" if c != "PaymentMethod" else f"{_mode(c)} AS PaymentMethod")
        for c in _FEAT) + " FROM b")

_TYPED = ("typed AS (SELECT customerID, Contract AS CONTRACT, lower(InternetService) AS internetservice, "
          "upper(PaymentMethod) AS PaymentMethod, TechSupport, OnlineSecurity, CAST(tenure AS VARCHAR) AS tenure, "
          "MonthlyCharges, TotalCharges, SeniorCitizen FROM telco)")
_DERIVED = (
    "der AS (SELECT * REPLACE (CASE WHEN TotalCharges IS NULL OR regexp_replace(TotalCharges, '^\\s+|\\s+$', '', 'g') = '' "
    f"OR coalesce({guarded_double('TotalCharges')}, 1.0) = 0.0 THEN "
    f"CAST({r('coalesce(' + guarded_double('CAST(MonthlyCharges AS VARCHAR)') + ', 0.0) * greatest(coalesce(' + guarded_double('CAST(tenure AS VARCHAR)') + ', 0.0), 1.0)', 2)} AS VARCHAR) "
    "ELSE TotalCharges END AS TotalCharges) FROM typed)")
_SRC_NAME = {"Contract": "CONTRACT", "InternetService": "internetservice"}


def _canon(c):
    src = f"regexp_replace(CAST({q(_SRC_NAME.get(c, c))} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    look = f"(SELECT min(value) FROM dom WHERE column_name = '{c}' AND lower(value) = lower({src}))"
    return f"CASE WHEN {src} IS NULL OR {src} = '' THEN {_mode(c)} ELSE coalesce({look}, {src}) END AS {q(c)}"


ORACLES["normalize_scoring_input"] = (
    f"WITH {_FIT}, {_TYPED}, {_DERIVED} SELECT customerID, " + ", ".join(
        f"coalesce({guarded_double(f'CAST({q(c)} AS VARCHAR)')}, {_med(c)}) AS {q(c)}" if c in _NUM else _canon(c)
        for c in _FEAT) + " FROM der")

ORACLES["history_export_compact"] = (
    f"WITH {predictions_cte()} SELECT id AS ID, customer_identifier AS Customer_ID, prediction AS Prediction, "
    "churn_probability AS \"Churn_Prob_%\", risk_level AS Risk, CASE WHEN strftime(created_at, '%f') = '000000' "
    "THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') END AS Date "
    "FROM predictions")


# ---- fitted schema and feature vectors (H10, F11) -------------------------------------------
ORACLES["active_model_schema"] = (
    f"WITH {_FIT}, ag AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min(CAST({q(c)} AS DOUBLE)) AS mn, max(CAST({q(c)} AS DOUBLE)) AS mxx, "
        f"avg(CAST({q(c)} AS DOUBLE)) AS mean FROM prep" for c in _NUM)
    + "), dl AS (SELECT column_name, list(value ORDER BY value) AS domain FROM dom GROUP BY column_name), "
      "names(ordinal, column_name, kind) AS (VALUES "
    + ", ".join(f"({i}, '{c}', '{'numerical' if c in _NUM else 'categorical'}')" for i, c in enumerate(_FEAT))
    + ") SELECT CAST(ordinal AS INTEGER) AS ordinal, n.column_name, kind, mn AS min, mxx AS max, round(mean, 9) AS mean, median, "
      "mode AS default_category, domain AS categories FROM names n LEFT JOIN ag USING (column_name) LEFT JOIN med USING (column_name) "
      "LEFT JOIN modes USING (column_name) LEFT JOIN dl USING (column_name)")

_VEC = (_LAB + _SPLIT_OF + ", train AS (SELECT * FROM split_keyed WHERE NOT is_test), " + ", ".join(_median_sql("train", _NUM))
        + ", imp AS (SELECT _row_key, is_test, " + ", ".join(
            f"coalesce(CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CAST({q(c)} AS DOUBLE) END, {_med(c)}) AS {q(c)}" if c in _NUM
            else f"{_norm_cat(q(c))} AS {q(c)}" for c in _FEAT) + " FROM split_keyed), "
        "st AS (SELECT " + ", ".join(
            f"avg({q(c)}) AS m_{i}, CASE WHEN stddev_pop({q(c)}) IS NULL OR stddev_pop({q(c)}) = 0 THEN 1.0 ELSE stddev_pop({q(c)}) END AS s_{i}"
            for i, c in enumerate(_NUM)) + " FROM imp WHERE NOT is_test)")
ORACLES["assemble_features"] = (
    f"WITH {_VEC} " + " UNION ALL ".join(
        [f"SELECT _row_key AS row_key, is_test, '{c}' AS feature, round(({q(c)} - m_{i}) / s_{i}, 6) AS value FROM imp, st" for i, c in enumerate(_NUM)]
        + [f"SELECT _row_key, is_test, '{c}_{v}', CAST(CASE WHEN {q(c)} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) FROM imp"
           for c, vs in _OH_DOM.items() for v in vs]))


# ---- bundles (D08, H11), configured target (P16), samples (P12, P13), preview features (C05) ----
_TNAMES = "names(ordinal, column_name) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(TELCO_COLS)) + ")"
ORACLES["configure_target_classes"] = with_src(src_table("telco"), [
    profile_cte(TELCO_COLS), f"g AS (SELECT count(*) AS n FROM src GROUP BY {', '.join(q(c) for c, _ in TELCO_COLS)})"],
    "SELECT 'Contract' AS target_column, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT Contract AS v FROM src)) AS target_classes, "
    "(SELECT string_agg(column_name, '|' ORDER BY ordinal) FROM prof WHERE is_id_candidate OR column_name = 'tenure') AS id_columns, "
    "(SELECT count(*) FROM src) AS total_rows, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g) AS duplicate_rows")

ORACLES["profile_with_samples"] = with_src(src_table("telco"), [
    profile_cte(TELCO_COLS), long_values_cte(TELCO_COLS),
    "d AS (SELECT DISTINCT ordinal, value, num FROM lv)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY num NULLS LAST, value) AS k FROM d)",
    "sm AS (SELECT ordinal, string_agg(value, '|' ORDER BY k) AS sample_values FROM rk WHERE k <= 5 GROUP BY ordinal)"],
    "SELECT prof.ordinal, column_name, unique_count, coalesce(sample_values, '') AS sample_values FROM prof LEFT JOIN sm USING (ordinal)")

ORACLES["sample_decimals"] = (
    "WITH d AS (SELECT DISTINCT l_quantity AS v FROM lineitem), rk AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM d) "
    "SELECT 'dec' AS column_name, CAST(k AS INTEGER) AS sample_rank, printf('%.2f', v) AS sample_value FROM rk WHERE k <= 5 UNION ALL "
    "SELECT 'single', CAST(k AS INTEGER), printf('%.1f', v) FROM rk WHERE k <= 5")

ORACLES["batch_preview_features"] = (
    f"WITH {_SCORED}, h AS (SELECT *, row_number() OVER (ORDER BY customerID, tenure) AS k FROM scored2) "
    "SELECT CAST(k AS INTEGER) AS row_index, customerID AS customer_identifier, Contract, CAST(tenure AS VARCHAR) AS tenure, "
    "coalesce(TotalCharges, '') AS TotalCharges FROM h WHERE k <= 50")

_BEST = "best AS (SELECT * FROM mdl WHERE user_id = 1 ORDER BY is_best DESC, f1_score DESC, id DESC LIMIT 1)"
ORACLES["dashboard"] = (
    f"WITH {predictions_cte()}, {_MODELS3}, mdl AS ({MODELS_SQL.replace('{orders}', 'orders')}), {_BEST}, "
    "mine AS (SELECT p.*, coalesce(m.algorithm_name, 'Classifier') AS model_name FROM predictions p LEFT JOIN models m ON p.model_id = m.id WHERE user_id = 1), "
    "lt AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS k FROM mine) "
    "SELECT 'best_accuracy' AS part, 1 AS position, algorithm_name AS name, accuracy AS number FROM best UNION ALL "
    "SELECT 'best_f1', 1, algorithm_name, f1_score FROM best UNION ALL "
    "SELECT 'latest', CAST(k AS INTEGER), customer_identifier || ' / ' || model_name || ' / ' || risk_level, churn_probability FROM lt WHERE k <= 5 UNION ALL "
    "SELECT 'tiers', NULL, risk_level, CAST(count(*) AS DOUBLE) FROM mine GROUP BY risk_level UNION ALL "
    "SELECT 'labels', NULL, prediction, CAST(count(*) AS DOUBLE) FROM mine GROUP BY prediction")

# the parts of the bundle are the statements of their own queries on the coerced telco table
_TELCO_SRC = f"{telco_cte()}, src AS ({TELCO_COERCED})"
_TELCO_NUM = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
_TELCO_CAT = [(c, "s") for c, k in TELCO_COLS if c not in _TELCO_NUM]
_NUM_ITEMS = ["count", "missing", "mean", "std", "median", "min", "max", "q25", "q75", "skew"]
_CAT_ITEMS = ["count", "missing", "unique_count", "top_frequency", "frequency_percentage"]
_CAT_SQL = with_src(_TELCO_SRC, [
    long_values_cte(_TELCO_CAT),
    "names(ordinal, column_name) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(_TELCO_CAT)) + ")",
    "vc AS (SELECT ordinal, value, count(*) AS n FROM lv GROUP BY ordinal, value)",
    "ag AS (SELECT ordinal, sum(n) AS count, count(*) AS unique_count, first(value ORDER BY n DESC, value) AS top_value, "
    "max(n) AS top_frequency FROM vc GROUP BY ordinal)"],
    "SELECT column_name, CAST(count AS BIGINT) AS count, (SELECT count(*) FROM src) - CAST(count AS BIGINT) AS missing, "
    f"unique_count, top_value, top_frequency, {r('top_frequency / count * 100.0', 2)} AS frequency_percentage FROM ag JOIN names USING (ordinal)")
_HIST_SQL = (
    f"WITH {_TELCO_SRC}, long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS x FROM src WHERE {q(c)} IS NOT NULL" for c in _TELCO_NUM) + "), "
    "r0 AS (SELECT feature, count(*) AS n, min(x) AS lo0, max(x) AS hi0 FROM long GROUP BY feature), "
    "rng AS (SELECT feature, lo, hi, (hi - lo) / 8.0 AS step FROM (SELECT feature, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
    "CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0 WHERE n > 10)), "
    "b3 AS (SELECT long.feature, " + " + ".join(
        f"CASE WHEN x >= CAST({k} AS DOUBLE) * step + lo THEN 1 ELSE 0 END" for k in range(1, 8))
    + " AS bin_index FROM long JOIN rng USING (feature)), counts AS (SELECT feature, bin_index, count(*) AS n FROM b3 GROUP BY ALL), "
    "grid AS (SELECT feature, lo, hi, step, CAST(g.bin_index AS BIGINT) AS bin_index FROM rng, range(0, 8) g(bin_index)) "
    f"SELECT feature, {_fmt1(_edge('bin_index'))} || '-' || {_fmt1(_edge('bin_index + 1'))} AS bin, coalesce(n, 0) AS n "
    "FROM grid LEFT JOIN counts USING (feature, bin_index)")
_CORR = lambda a, b: f"corr({q(a)}, {q(b)})"
ORACLES["analysis_bundle"] = (
    f"WITH num AS ({_numeric_stats_sql(_TELCO_SRC, _TELCO_NUM)}), cat AS ({_CAT_SQL}), hist AS ({_HIST_SQL}), "
    f"ct AS ({ORACLES['category_by_target']}), tl AS ({ORACLES['coerce_numeric']}) "
    "SELECT 'summary' AS part, CAST(NULL AS VARCHAR) AS feature, 'rows_count' AS item, CAST(count(*) AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM tl "
    "UNION ALL SELECT 'target_distribution', 'Churn', Churn, CAST(count(*) AS DOUBLE), NULL FROM tl GROUP BY Churn "
    + "".join(f"UNION ALL SELECT 'numeric', column_name, '{i}', CAST({q(i)} AS DOUBLE), NULL FROM num " for i in _NUM_ITEMS)
    + "".join(f"UNION ALL SELECT 'categorical', column_name, '{i}', CAST({q(i)} AS DOUBLE), NULL FROM cat " for i in _CAT_ITEMS)
    + "UNION ALL SELECT 'categorical', column_name, 'top_value', NULL, top_value FROM cat "
      "UNION ALL SELECT 'histogram', feature, bin, CAST(n AS DOUBLE), NULL FROM hist "
    + "".join(f"UNION ALL SELECT 'correlation', '{a}', '{b}', {r(f'coalesce({_CORR(a, b)}, 0.0)', 2)}, NULL FROM tl " for a in _TELCO_NUM for b in _TELCO_NUM)
    + "UNION ALL SELECT 'crosstab', feature, category || ' / ' || target_class, CAST(count AS DOUBLE), NULL FROM ct")

ORACLES["analysis_bundle_screen"] = ORACLES["analysis_bundle"].replace(ORACLES["category_by_target"], ORACLES["category_by_target_screen"])
# the optimum of the penalised likelihood is where its gradient vanishes
ORACLES["logistic_optimum"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', CAST(0.0 AS DOUBLE))" for n in [*_NUM, *[f"{c}_{v}" for c, vs in _OH_DOM.items() for v in vs], "(intercept)"]) + ") t(feature, gradient)"

# ---- stored trees: what a walk down their nodes must find in the same data ----
_TREE_NAMES = "a(algorithm_name) AS (VALUES ('Decision Tree'), ('Random Forest'), ('Gradient Boosting'))"
_FEATURES = [*_NUM, *[f"{c}_{v}" for c, vs in _OH_DOM.items() for v in vs]]
ORACLES["tree_descent"] = (f"WITH {_SPLIT}, {_TREE_NAMES} SELECT algorithm_name, label, count(*) AS rows, CAST(0 AS BIGINT) AS disagreements "
                           "FROM split_keyed, a WHERE is_test GROUP BY algorithm_name, label")
ORACLES["tree_importances"] = (f"WITH {_TREE_NAMES} SELECT algorithm_name, CAST({len(_FEATURES)} AS BIGINT) AS features, "
                               "CAST(0 AS BIGINT) AS disagreements, CAST(1.0 AS DOUBLE) AS total FROM a")
ORACLES["tree_leaf_rows"] = (f"WITH {_SPLIT} SELECT count(*) AS rows, count(*) FILTER (label = 1) AS positives, CAST(0 AS BIGINT) AS wrong_leaves "
                             "FROM split_keyed WHERE NOT is_test")
_GINI = lambda one, all_: f"(1 - pow(({one}) / ({all_}), 2) - pow(1 - ({one}) / ({all_}), 2))"
ORACLES["decision_tree_root"] = (
    f"WITH {_VEC}, cw AS (SELECT label, (SELECT count(*) FROM split_keyed) / (2.0 * count(*)) AS w FROM split_keyed GROUP BY label), "
    "fx AS (" + " UNION ALL ".join(
        [f"SELECT _row_key, '{c}' AS feature, {q(c)} AS value FROM imp WHERE NOT is_test" for c in _NUM]
        + [f"SELECT _row_key, '{c}_{v}', CASE WHEN {q(c)} = '{v}' THEN 1.0 ELSE 0.0 END FROM imp WHERE NOT is_test" for c, vs in _OH_DOM.items() for v in vs])
    + "), x AS (SELECT feature, value, w, CASE WHEN label = 1 THEN w ELSE 0.0 END AS one FROM fx JOIN split_keyed USING (_row_key) JOIN cw USING (label)), "
      "v AS (SELECT feature, value, sum(w) AS w, sum(one) AS one, count(*) AS n FROM x GROUP BY feature, value), "
      "c AS (SELECT feature, sum(w) OVER l AS lw, sum(one) OVER l AS lo, sum(w) OVER f AS fw, sum(one) OVER f AS fo, sum(n) OVER f AS n, "
      "row_number() OVER (PARTITION BY feature ORDER BY value DESC) AS back FROM v WINDOW l AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)), "
      f"g AS (SELECT feature, CAST(n AS BIGINT) AS rows, {_GINI('fo', 'fw')} AS impurity, {_GINI('fo', 'fw')} - lw / fw * {_GINI('lo', 'lw')} "
      f"- (1 - lw / fw) * {_GINI('fo - lo', 'fw - lw')} AS gain FROM c WHERE back > 1) "
      "SELECT feature, round(gain, 6) AS gain, round(impurity, 6) AS impurity, rows FROM g ORDER BY gain DESC LIMIT 1")

ORACLES["distinct_sketches"] = with_src(src_table("lineitem"), [profile_cte(LINEITEM_COLS)],
                                        "SELECT column_name, total_rows, missing_count, true AS close FROM prof")
ORACLES["repeated_rows"] = ("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM "
                            "lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)")

ORACLES["active_models"] = (
    f"WITH mdl AS ({MODELS_SQL.replace('{orders}', 'orders')}) SELECT user_id, id AS model_id, algorithm_name, accuracy, f1_score, "
    "accuracy / 2 + 50 AS roc_auc, id % 7 AS dataset_id FROM mdl "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id % 2111 = 5 DESC, f1_score DESC, id DESC) = 1")
ORACLES["linear_scores"] = (f"WITH {_SPLIT} SELECT label, count(*) AS rows, CAST(0 AS BIGINT) AS disagreements FROM split_keyed WHERE is_test GROUP BY label")
ORACLES["stored_scores"] = (f"WITH {telco_cte()}, a(algorithm_name) AS (VALUES ('Decision Tree'), ('Logistic Regression')) "
                            "SELECT algorithm_name, (SELECT count(*) FROM (SELECT DISTINCT * FROM telco)) AS customers, CAST(0 AS BIGINT) AS disagreements FROM a")
ORACLES["customers_as_typed"] = (
    f"WITH {telco_cte()} SELECT count(*) AS customers, " + ", ".join(
        f"CAST(0 AS BIGINT) AS other_{x}" for x in ("probability", "retention", "tier", "label")) + " FROM (SELECT DISTINCT * FROM telco)")
