"""Dataset profiling (P01-P17): shape, duplicates, missing, uniques, typing,
ID / target detection, samples, validation checks.

All per-column numbers come from two passes over the data: one aggregate
(row count, missing and parse counts for every column at once) and one
unpivoted (column, value) count. Everything else is an expression over the
resulting per-column frame, whose size is the column count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from retainx.functions import sql as SQ
from retainx.functions.wide import chunked_agg
from retainx.functions.columns import catalog, is_missing, long_values, qcol, value_text
from retainx.functions.digests import DIGEST, MOST_SHIPPED, repeated_digests, with_digest
from retainx.functions.expr import clean_name, py_round
from retainx.params import Params

P = Params()


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row over all columns.

    Digests of rows are counted first; only rows whose digest repeats are compared
    as wholes, wherever these digests fit the bound for shipping them to the tasks.
    Both groupings combine in tasks, so one row repeated a billion times costs one
    record per task.
    """
    seen, n = repeated_digests(df)
    try:
        if n > MOST_SHIPPED:
            rows = df
        else:
            rows = with_digest(df).join(F.broadcast(seen), DIGEST, "left_semi").drop(DIGEST)      # at most 8 MB
        found = 0
        if n:
            groups = rows.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
            found = groups.agg(F.sum(F.col("_n") - 1)).first()[0]
        return df.sparkSession.createDataFrame([(found,)], "duplicate_rows bigint")
    finally:
        seen.unpersist()


def column_counts(df: DataFrame) -> DataFrame:
    """Row count plus per-column missing / numeric-parse counts in one pass,
    returned long: (ordinal, total_rows, missing_count, parse_count)."""
    aggs = ["count(1) AS total_rows"]
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = SQ.ident(f.name)
        miss = f"({c} IS NULL OR isnan({c}))" if f.dataType.typeName() in ("double", "float") else f"({c} IS NULL)"
        aggs.append(f"sum(CASE WHEN {miss} THEN 1 ELSE 0 END) AS m{i}")
        if f.dataType.typeName() == "string":
            aggs.append(f"sum(CASE WHEN {SQ.numeric_text(c)} THEN 1 ELSE 0 END) AS p{i}")
            p = f"CAST(p{i} AS BIGINT)"
        else:
            p = "CAST(NULL AS BIGINT)"
        structs.append(f"struct({i} AS ordinal, CAST(coalesce(m{i}, 0) AS BIGINT) AS missing_count, {p} AS parse_count)")
    one = chunked_agg(df, aggs)
    return one.selectExpr("total_rows", f"inline(array({', '.join(structs)}))")


def value_counts(df: DataFrame) -> DataFrame:
    """(ordinal, value, num, n): count of every distinct non-null value of
    every column. One shuffle; hot values are pre-aggregated map-side."""
    counts = long_values(df).groupBy("ordinal", "s", "i", "d").agg(F.count(F.lit(1)).alias("n"))
    return value_text(counts).select("ordinal", "value", "num", "n")


def unique_counts(df: DataFrame, params: Params = P) -> DataFrame:
    """Exact non-null distinct count per column (ordinal, unique_count)."""
    if params.approx_distinct:
        one = df.agg(*[F.approx_count_distinct(F.when(~is_missing(df, c), qcol(c))).alias(str(i))
                       for i, c in enumerate(df.columns)])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.col(str(i)).cast("bigint").alias("unique_count"))
            for i in range(len(df.columns))])))
    return value_counts(df).groupBy("ordinal").agg(F.count(F.lit(1)).cast("bigint").alias("unique_count"))


def _name_matches(name, patterns, prefix_suffix: bool, suffix: bool):
    cn = clean_name(name)
    conds = []
    for p in patterns:
        c = cn == F.lit(p)
        if prefix_suffix:
            c = c | cn.startswith(p)
            if suffix:
                c = c | cn.endswith(p)
        conds.append(c)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def column_profile(df: DataFrame, params: Params = P) -> DataFrame:
    """P13 (with P03-P07, P09-P11 as columns): one row per column."""
    spark = df.sparkSession
    cat = catalog(spark, df)
    counts = column_counts(df)
    uniq = unique_counts(df, params)
    # All three frames have one row per column: bounded, broadcast.
    prof = (cat.join(F.broadcast(counts), "ordinal")
            .join(F.broadcast(uniq), "ordinal", "left")
            .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("bigint")))
    n = F.col("total_rows")
    ratio = F.when(n > 0, F.col("parse_count") / n)
    is_num = F.col("numeric_dtype") | (F.col("is_string") & F.coalesce(ratio > params.numeric_like_ratio, F.lit(False)))
    id_by_name = _name_matches(F.col("column_name"), params.id_patterns, True, params.id_by_suffix)
    prof = (prof
            .withColumn("is_numerical", is_num)
            .withColumn("is_categorical", ~F.col("is_numerical"))
            .withColumn("name_is_target", _name_matches(F.col("column_name"), params.target_names, False, False))
            .withColumn("is_id_candidate", id_by_name | (
                (F.col("unique_count") >= n * params.id_unique_ratio) & F.col("is_categorical") & (n > params.id_min_rows)))
            .withColumn("is_target_candidate", F.col("name_is_target") | (
                (F.col("unique_count") == 2) & ~F.col("is_id_candidate")))
            .withColumn("missing_percentage",
                        F.when(n > 0, py_round(F.col("missing_count") / n * 100.0, 2)).otherwise(F.lit(0.0)))
            .withColumn("is_single_value", (F.col("unique_count") == 1) & (n > 1))
            .withColumn("is_high_cardinality", F.col("is_categorical") & (F.col("unique_count") > params.high_cardinality)
                        & ~F.col("is_id_candidate"))
            .withColumn("kind", F.when(F.col("is_id_candidate"), "id")
                        .when(F.col("is_numerical"), "numerical").otherwise("categorical")))
    return prof.select("ordinal", "column_name", "dtype", "total_rows", "missing_count", "missing_percentage",
                       "unique_count", "is_numerical", "is_categorical", "is_id_candidate", "is_target_candidate",
                       "name_is_target", "is_single_value", "is_high_cardinality", "kind")


def missing_by_column(df: DataFrame, params: Params = P) -> DataFrame:
    """Missing count and percentage per column."""
    cnt = column_counts(df)
    n = F.col("total_rows")
    return cnt.join(F.broadcast(catalog(df.sparkSession, df)), "ordinal").select(
        "column_name", "missing_count",
        F.when(n > 0, py_round(F.col("missing_count") / n * 100.0, 2)).otherwise(F.lit(0.0)).alias("missing_percentage"))


def numeric_like(df: DataFrame, params: Params = P) -> DataFrame:
    """Numeric dtype, or > 80 % of all rows parse as a number."""
    return column_profile(df, params).select("column_name", "is_numerical")


def id_columns(df: DataFrame, params: Params = P) -> DataFrame:
    """P06."""
    return column_profile(df, params).where("is_id_candidate").select("ordinal", "column_name")


def target_candidates(df: DataFrame, params: Params = P) -> DataFrame:
    """P07."""
    return column_profile(df, params).where("is_target_candidate").select("ordinal", "column_name", "name_is_target")


def zero_variance_columns(df: DataFrame, params: Params = P) -> DataFrame:
    """P09."""
    return column_profile(df, params).where("is_single_value").select("ordinal", "column_name")


def high_cardinality_columns(df: DataFrame, params: Params = P) -> DataFrame:
    """P10."""
    return column_profile(df, params).where("is_high_cardinality").select("ordinal", "column_name", "unique_count")


def feature_type_lists(df: DataFrame, params: Params = P) -> DataFrame:
    """(kind, column_name, ordinal) with kind in numerical/categorical/id."""
    return column_profile(df, params).select("kind", "column_name", "ordinal")


def _first_values(values: DataFrame, k: int) -> DataFrame:
    """The k smallest distinct (ordinal, value, num) of each column, ranked; numbers by size, text by its characters.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, so each task ships at most k values per column.
    """
    w = Window.partitionBy("ordinal").orderBy(F.col("num").asc_nulls_last(), "value")
    return values.select("ordinal", "value", "num").withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= k)


def sample_values(df: DataFrame, params: Params = P, k: int | None = None) -> DataFrame:
    """Up to ``k`` distinct non-null values per column, smallest first.

    The k-th smallest of any rows is no smaller than that of all rows. A first look
    at ``probe_rows`` rows gives such a bound for each column, and the pass over
    all rows keeps only values up to it: what is shuffled are the distinct values
    below the bounds instead of every distinct value of the table.
    """
    k = k or params.sample_values
    probe = _first_values(value_text(long_values(df.limit(params.probe_rows)).distinct()), k)
    bounds = probe.where(F.col("sample_rank") == k).select("ordinal", F.col("num").alias("_num"), F.col("value").alias("_value")).collect()   # a row a column
    long = long_values(df)
    within = F.lit(True)
    for r in bounds:
        up_to = F.coalesce(F.col("i").cast("double"), F.col("d")) <= F.lit(r["_num"]) if r["_num"] is not None else F.col("s") <= F.lit(r["_value"])
        within = F.when(F.col("ordinal") == r["ordinal"], up_to).otherwise(within)
    vals = _first_values(value_text(long.where(within).distinct()), k)
    return (vals.join(F.broadcast(catalog(df.sparkSession, df)), "ordinal")
            .select("column_name", "sample_rank", F.col("value").alias("sample_value")))


def profile_with_samples(df: DataFrame, params: Params = P) -> DataFrame:
    """P13 with the sample values (P12) of every column as an array."""
    samples = sample_values(df, params).groupBy("column_name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("sample_rank", "sample_value"))), lambda s: s["sample_value"]).alias("sample_values"))
    return column_profile(df, params).join(samples, "column_name", "left") \
        .withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def detect_target(df: DataFrame, params: Params = P) -> DataFrame:
    """First name-matched candidate, else the first candidate (one row or none)."""
    cands = column_profile(df, params).where("is_target_candidate")
    pick = cands.agg(F.min_by("column_name", F.struct(~F.col("name_is_target"), F.col("ordinal"))).alias("target_column"))
    return pick.where(F.col("target_column").isNotNull())


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Sorted distinct non-null classes of ``target`` as text (class_rank, class_value).

    Ranked by a window over the classes, after a count that refuses a column
    with more than ``max_classes`` of them.
    """
    ordinal = df.columns.index(target)
    vc = value_counts(df.select(qcol(target))).where(F.col("ordinal") == 0)
    if vc.limit(P.max_classes + 1).count() > P.max_classes:
        raise ValueError(f"Target column '{target}' has more than {P.max_classes} classes.")
    w = Window.orderBy(F.col("num").asc_nulls_last(), "value")
    return vc.select(F.lit(target).alias("target_column"), F.row_number().over(w).alias("class_rank"),
                     F.col("value").alias("class_value")).withColumn("ordinal", F.lit(ordinal))


def detected_target_classes(df: DataFrame, params: Params = P) -> DataFrame:
    """P08 with classes: (target_column, class_rank, class_value)."""
    row = detect_target(df, params).first()          # one column name
    if row is None:
        return df.sparkSession.createDataFrame([], "target_column string, class_rank int, class_value string")
    return target_classes(df, row["target_column"]).select("target_column", "class_rank", "class_value")


def _pylist(arr):
    """Python ``repr`` of a list of strings: ['a', 'b']."""
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']")))


def profile_summary(df: DataFrame, params: Params = P, target: str | None = None,
                    extra_id: str | None = None) -> DataFrame:
    """One row with the dataset-level results: counts, detected target and its
    classes, ID / zero-variance column lists (bounded by the column count)."""
    prof = column_profile(df, params)
    # one row per column: materialise once instead of recomputing it for the
    # target detection and the final summary
    prof = df.sparkSession.createDataFrame(prof.collect(), prof.schema)
    if extra_id is not None:
        if extra_id not in df.columns:
            raise ValueError(f"ID column '{extra_id}' does not exist in dataset.")
        prof = prof.withColumn("is_id_candidate", F.col("is_id_candidate") | (F.col("column_name") == extra_id))
    by_ord = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "column_name")))),
                                   lambda s: s["column_name"])
    summ = prof.agg(
        F.first("total_rows").alias("total_rows"),
        F.count(F.lit(1)).cast("bigint").alias("total_columns"),
        F.sum("missing_count").cast("bigint").alias("missing_values_total"),
        by_ord(F.col("is_id_candidate")).alias("id_columns"),
        by_ord(F.col("is_single_value")).alias("single_value_columns"),
        F.min_by(F.when(F.col("is_target_candidate"), F.col("column_name")),
                 F.when(F.col("is_target_candidate"), F.struct(~F.col("name_is_target"), F.col("ordinal"))))
        .alias("detected_target_column"))
    if target is not None:
        if target not in df.columns:
            raise ValueError(f"Target column '{target}' does not exist in dataset.")
        summ = summ.withColumn("detected_target_column", F.lit(target))
        tname = target
    else:
        r = summ.select("detected_target_column").first()
        tname = r[0] if r else None
    if tname is not None:
        classes = target_classes(df, tname).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("class_rank", "class_value"))),
                        lambda s: s["class_value"]).alias("target_classes"))
        summ = summ.crossJoin(classes)
    else:
        summ = summ.withColumn("target_classes", F.lit(None).cast("array<string>"))
    summ = summ.crossJoin(duplicate_rows(df))
    return summ.withColumn("total_rows", F.coalesce("total_rows", F.lit(0)).cast("bigint"))


def validation_checks(df: DataFrame, params: Params = P, target: str | None = None) -> DataFrame:
    """(seq, kind, name, status, message); kind is check / warning / error."""
    s = profile_summary(df, params, target)
    n, cols = F.col("total_rows"), F.col("total_columns")
    miss, dup = F.col("missing_values_total"), F.col("duplicate_rows")
    tgt, zv, ids = F.col("detected_target_column"), F.col("single_value_columns"), F.col("id_columns")
    st = lambda i, kind, name, status, msg: F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"),
                                                      F.lit(name).cast("string").alias("name"),
                                                      F.lit(status).cast("string").alias("status"),
                                                      msg.alias("message"))
    s_ = lambda x: x.cast("string")
    # names, states and messages are fixed values: they must equal the application's
    items = [
        F.when(n > 0, st(1, "check", "Dataset Loaded", "passed",
                         F.concat(F.lit("Successfully loaded "), s_(n), F.lit(" rows and "), s_(cols), F.lit(" columns."))))
        .otherwise(st(1, "check", "Dataset Loaded", "failed", F.lit("CSV file contains zero rows."))),
        F.when(tgt.isNotNull(), st(2, "check", "Target Column Detection", "passed",
                                   F.concat(F.lit("Identified '"), tgt, F.lit("' as candidate target with classes: "),
                                            _pylist(F.col("target_classes")), F.lit("."))))
        .otherwise(st(2, "check", "Target Column Detection", "warning",
                      F.lit("No obvious Churn target column found. Please select target column manually."))),
        F.when(miss == 0, st(3, "check", "Missing Values", "passed", F.lit("Zero missing values detected.")))
        .otherwise(st(3, "check", "Missing Values", "warning",
                      F.concat(F.lit("Found "), s_(miss), F.lit(" missing values across dataset. Imputation will be applied.")))),
        F.when(dup == 0, st(4, "check", "Duplicate Rows", "passed", F.lit("Zero duplicate records found.")))
        .otherwise(st(4, "check", "Duplicate Rows", "warning",
                      F.concat(F.lit("Found "), s_(dup), F.lit(" duplicate rows. They will be handled automatically.")))),
        F.when(F.size(zv) > 0, st(5, "check", "Zero Variance Columns", "warning",
                                  F.concat(F.lit("Columns with only 1 unique value: "), _pylist(zv), F.lit("."))))
        .otherwise(st(5, "check", "Feature Variance", "passed", F.lit("All columns contain variable information."))),
        F.when(F.size(ids) > 0, st(6, "check", "Identifier Columns", "passed",
                                   F.concat(F.lit("Identified ID columns to exclude from training: "), _pylist(ids), F.lit(".")))),
        F.when(n <= 0, st(7, "error", None, None, F.lit("Dataset is empty."))),
        F.when(tgt.isNull(), st(8, "warning", None, None, F.lit("Target column could not be automatically determined."))),
        F.when(miss > 0, st(9, "warning", None, None,
                            F.concat(F.lit("Found "), s_(miss), F.lit(" missing values across features.")))),
        F.when(dup > 0, st(10, "warning", None, None, F.concat(s_(dup), F.lit(" duplicate rows detected.")))),
        F.when(F.size(zv) > 0, st(11, "warning", None, None,
                                  F.concat(F.lit("Zero variance columns detected: "), F.array_join(zv, ", "), F.lit(".")))),
    ]
    return s.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def is_valid(df: DataFrame, params: Params = P) -> DataFrame:
    """Rows > 10 and columns >= 2 and no errors (the only error is emptiness)."""
    shape = table_shape(df)
    return shape.select("total_rows", "total_columns",
                        ((F.col("total_rows") > 10) & (F.col("total_columns") >= 2)).alias("is_valid"))


def configure_target(df: DataFrame, target: str, id_column: str | None = None, params: Params = P) -> DataFrame:
    """Re-profile with an explicit target and an extra ID column.

    Returns (column_name, is_id_candidate, is_target); raises if the target
    or the ID is not a column (a schema check, no data touched).
    ``configured_summary`` has the recomputed classes.
    """
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' does not exist in dataset.")
    if id_column and id_column not in df.columns:
        raise ValueError(f"ID column '{id_column}' does not exist in dataset.")
    prof = column_profile(df, params)
    extra = F.col("column_name") == id_column if id_column else F.lit(False)
    return prof.select("ordinal", "column_name", (F.col("is_id_candidate") | extra).alias("is_id_candidate"),
                       (F.col("column_name") == target).alias("is_target"))


def configured_summary(df: DataFrame, target: str, id_column: str | None = None, params: Params = P) -> DataFrame:
    """P16 for the dataset: the chosen target with its recomputed classes, and the ID columns."""
    return profile_summary(df, params, target, id_column).select(
        F.col("detected_target_column").alias("target_column"), "target_classes", "id_columns", "total_rows", "duplicate_rows")


def class_count_guard(df: DataFrame, target: str, raise_error: bool = False) -> DataFrame:
    """Training needs at least two distinct non-null classes."""
    out = df.agg(F.count_distinct(qcol(target)).alias("n_classes")).select(
        F.lit(target).alias("target_column"), F.col("n_classes").cast("bigint").alias("n_classes"),
        (F.col("n_classes") >= 2).alias("can_train"))
    if raise_error and not out.first()["can_train"]:
        raise ValueError(f"Target column '{target}' must have at least two classes to train a model.")
    return out
