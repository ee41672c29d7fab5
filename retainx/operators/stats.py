"""Descriptive statistics and chart tables.

Per-column scalars are computed in one wide aggregate; per-value work goes
through one unpivoted group-by; quantiles use the bucketed exact plan of
``retainx.plans.ranking``. Driver-side decisions (which columns qualify)
only read per-column summaries, never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from retainx.functions import sql as SQ
from retainx.functions.wide import chunked_agg
from retainx.functions.columns import catalog, is_missing, qcol
from retainx.functions.expr import display_class, guarded_double, is_numeric_type, pandas_str, py_round
from retainx.operators.gram import correlation_table
from retainx.operators.profile import column_counts, value_counts
from retainx.params import Params
from retainx.plans.ranking import exact_quantiles

P = Params()
#: Columns whose pairs fit a few aggregates.
NARROW = 16
#: With up to so many classes a crosstab with its zeros grows in proportion to its categories.
FEW_CLASSES = 100


def numeric_like_columns(df: DataFrame, exclude=(), params: Params = P) -> list[str]:
    """Names of string columns where more than 80 % of all rows parse as numbers."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not strs:
        return []
    row = df.agg(F.expr("count(1) AS _n"),
                 *[F.expr(f"sum(CASE WHEN {SQ.numeric_text(SQ.ident(c))} THEN 1 ELSE 0 END) AS `{i}`")
                   for i, c in enumerate(strs)]).first()
    n = row["_n"]
    return [c for i, c in enumerate(strs) if n and (row[str(i)] or 0) / n > params.numeric_like_ratio]


def coerce_numeric(df: DataFrame, exclude=(), params: Params = P) -> DataFrame:
    """Promote numeric-like text columns to double (unparsable -> null)."""
    promote = set(numeric_like_columns(df, exclude, params))
    return df.select(*[guarded_double(qcol(c)).alias(c) if c in promote else qcol(c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric dtypes, booleans excluded (they are categorical in statistics)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]


def _clean_num(c):
    x = qcol(c).cast("double")
    return F.when(~F.isnan(x), x)


def numeric_stats(df: DataFrame, params: Params = P) -> DataFrame:
    """D02 on an already coerced frame: one row per numeric column with data."""
    spark = df.sparkSession
    cols = numeric_columns(df)
    schema = ("column_name string, count bigint, missing bigint, mean double, std double, median double, "
              "min double, max double, q25 double, q75 double, skew double")
    if not cols:
        return spark.createDataFrame([], schema)
    aggs = ["count(1) AS _rows"]
    for i, c in enumerate(cols):
        x = SQ.clean_double(c)
        aggs += [f"count({x}) AS n{i}", f"avg({x}) AS mean{i}", f"stddev_samp({x}) AS std{i}",
                 f"min({x}) AS min{i}", f"max({x}) AS max{i}", f"skewness({x}) AS sk{i}"]
    one = chunked_agg(df, aggs)
    rows = []
    for i, c in enumerate(cols):
        n = f"n{i}"
        adj = f"sk{i} * sqrt({n} * ({n} - 1)) / ({n} - 2)"
        skew = f"CASE WHEN {n} <= 2 THEN 0D ELSE coalesce(nanvl({adj}, 0D), 0D) END"
        rows.append(f"struct({i} AS ordinal, {SQ.lit_str(c)} AS column_name, {n} AS count, _rows - {n} AS missing, "
                    f"mean{i} AS mean, CASE WHEN {n} > 1 THEN std{i} ELSE 0D END AS std, min{i} AS min, max{i} AS max, "
                    f"{skew} AS skew)")
    base = one.selectExpr(f"inline(array({', '.join(rows)}))").where(F.col("count") > 0)
    long = df.selectExpr("inline(array(" + ", ".join(f"struct({i} AS ordinal, {SQ.clean_double(c)} AS x)"
                                                     for i, c in enumerate(cols)) + "))")
    probs = [0.25, 0.5, 0.75] if params.numeric_quartiles else [0.5]
    if params.approx_quantiles:
        qs = long.groupBy("ordinal").agg(F.percentile_approx("x", probs, 10000).alias("_q"))
        qs = qs.select("ordinal", *[F.col("_q")[j].alias(f"q{int(p * 100)}") for j, p in enumerate(probs)])
    else:
        ql = exact_quantiles(long, ["ordinal"], "x", probs)
        qs = ql.groupBy("ordinal").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{int(p * 100)}")
                                         for p in probs])
    out = base.join(F.broadcast(qs), "ordinal", "left")   # one row per column
    r2 = lambda c: py_round(F.col(c), 2)
    sel = [F.col("column_name"), F.col("count").cast("bigint").alias("count"), F.col("missing").cast("bigint").alias("missing"),
           r2("mean").alias("mean"), r2("std").alias("std"), r2("q50").alias("median"),
           r2("min").alias("min"), r2("max").alias("max")]
    if params.numeric_quartiles:
        sel += [r2("q25").alias("q25"), r2("q75").alias("q75")]
    sel += [r2("skew").alias("skew")]
    return out.select(*sel)


def categorical_stats(df: DataFrame, params: Params = P) -> DataFrame:
    """D03 (scalars) on a coerced frame: one row per non-numeric column with data."""
    cols = categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count bigint, missing bigint, unique_count bigint, top_value string, "
                "top_frequency bigint, frequency_percentage double")
    sub = df.select(*[qcol(c) for c in cols])
    vc = value_counts(sub)
    agg = vc.groupBy("ordinal").agg(
        F.sum("n").cast("bigint").alias("count"), F.count(F.lit(1)).cast("bigint").alias("unique_count"),
        F.min_by("value", F.struct(-F.col("n"), F.col("num"), F.col("value"))).alias("top_value"),
        F.max("n").cast("bigint").alias("top_frequency"))
    cnt = column_counts(sub).select("ordinal", F.col("missing_count").alias("missing"))
    cat = catalog(df.sparkSession, sub)
    out = agg.join(F.broadcast(cnt), "ordinal").join(F.broadcast(cat), "ordinal")
    return out.select("column_name", "count", "missing", "unique_count", "top_value", "top_frequency",
                      py_round(F.col("top_frequency") / F.col("count") * 100.0, params.top_pct_decimals)
                      .alias("frequency_percentage"))


def categorical_values(df: DataFrame, params: Params = P) -> DataFrame:
    """D03 value list: distinct values per non-numeric column, smallest first
    (the first ``unique_values_kept`` when given), with the full count of the column."""
    cols = categorical_columns(df)
    sub = df.select(*[qcol(c) for c in cols])
    w = Window.partitionBy("ordinal").orderBy(F.col("num").asc_nulls_last(), "value")
    vals = value_counts(sub).withColumn("value_rank", F.row_number().over(w))
    if params.unique_values_kept is not None:
        vals = vals.where(F.col("value_rank") <= params.unique_values_kept)
    return vals.join(F.broadcast(catalog(df.sparkSession, sub)), "ordinal").select("column_name", "value_rank", "value")


def target_distribution(df: DataFrame, target: str, params: Params = P) -> DataFrame:
    """Class counts and share of all rows (nulls stay in the denominator)."""
    dt = df.schema[target].dataType
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    counts = (df.where(~is_missing(df, target))
              .groupBy(qcol(target).alias("_k")).agg(F.count(F.lit(1)).alias("count")))
    w = Window.orderBy(F.col("count").desc(), F.col("_k"))    # over the classes only
    return (counts.crossJoin(F.broadcast(total))
            .select(pandas_str(F.col("_k"), dt).alias("name"), F.col("count").cast("bigint").alias("count"),
                    py_round(F.col("count") / F.col("_total") * 100.0, 1).alias("percentage"),
                    F.row_number().over(w).alias("position")))


def display_classes(df: DataFrame, target: str, params: Params = P) -> DataFrame:
    """Target distribution with the dashboard's Churned / Retained wording."""
    return target_distribution(df, target, params).withColumn("display_name", display_class("name"))


def crosstab_columns(df: DataFrame, target: str, params: Params = P) -> list[str]:
    """Non-numeric columns other than the target, with at most ``crosstab_max_unique`` distinct values if given."""
    cols = [c for c in categorical_columns(df) if c != target]
    if not cols or params.crosstab_max_unique is None:
        return cols
    sub = df.select(*[qcol(c) for c in cols])
    u = value_counts(sub).groupBy("ordinal").agg(F.count(F.lit(1)).alias("u")).collect()   # one row per column
    ok = {r["ordinal"] for r in u if r["u"] <= params.crosstab_max_unique}
    ok |= set(range(len(cols))) - {r["ordinal"] for r in u}        # all-null column: 0 uniques
    return [c for i, c in enumerate(cols) if i in ok]


def _cell_counts(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(feature, category, target_class, count) of the combinations that occur; one shuffle, combined in tasks first."""
    cls = pandas_str(qcol(target), df.schema[target].dataType).alias("target_class")
    long = df.select(cls, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), pandas_str(qcol(c), df.schema[c].dataType).alias("category"))
        for c in cols])))
    return long.groupBy("feature", "category", "target_class").agg(F.count(F.lit(1)).alias("count"))


def crosstab_cells(df: DataFrame, target: str, params: Params = P) -> DataFrame:
    """D05 without its zeros: the cells that hold rows, with both marginals.

    (feature, category, target_class, count, category_total, class_total): a cell
    that is not there is zero. The size is that of what occurs, however many
    categories and classes there are; no cross join, no driver.
    """
    cols = crosstab_columns(df, target, params)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, category string, target_class string, count bigint, "
                                                   "category_total bigint, class_total bigint")
    counts = _cell_counts(df, target, cols)
    # sums of the counts, so that every branch reads the one shuffle of the scan
    by_category = counts.groupBy("feature", "category").agg(F.sum("count").alias("category_total"))
    by_class = counts.groupBy("feature", "target_class").agg(F.sum("count").alias("class_total"))
    return counts.join(by_category, ["feature", "category"]).join(by_class, ["feature", "target_class"]).select(
        "feature", "category", "target_class", "count", "category_total", "class_total")


def category_by_target(df: DataFrame, target: str, params: Params = P) -> DataFrame:
    """Crosstab of each categorical against the target, long form
    (feature, category, target_class, count) with zero cells filled.

    Of up to ``FEW_CLASSES`` classes the grid comes whole, however many categories
    there are. Of more it grows with the product of both and is refused beyond
    ``max_grid_cells``: ``crosstab_cells`` gives the same numbers without the zeros.
    """
    spark = df.sparkSession
    cols = crosstab_columns(df, target, params)
    if not cols:
        return spark.createDataFrame([], "feature string, category string, target_class string, count bigint")
    counts = _cell_counts(df, target, cols)
    # All branches keep ``count`` (every group has count >= 1), so their aggregates are identical
    # and the planner reuses one shuffle of the scan instead of pruning each branch into its own.
    present = counts.where(F.col("count") > 0)
    cats = present.select("feature", "category").distinct()
    classes = present.select("target_class").distinct()
    cells = cats.agg(F.count(F.lit(1)).alias("a")).crossJoin(classes.agg(F.count(F.lit(1)).alias("b"))).first()     # two numbers
    few = cells["b"] <= FEW_CLASSES
    if not few and cells["a"] * cells["b"] > params.max_grid_cells:
        raise ValueError(f"{cells['a']} categories by {cells['b']} classes are more than {params.max_grid_cells} cells; use crosstab_cells")
    return (cats.crossJoin(F.broadcast(classes) if few else classes).join(counts, ["feature", "category", "target_class"], "left")
            .select("feature", "category", "target_class", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def _fmt_fixed(x, decimals: int):
    """Format a double with ``decimals`` digits from its rounded integer scale;
    values beyond that scale's 64 bits have no fraction left to round."""
    t = F.bround(x * F.lit(float(10 ** decimals)), 0).try_cast("bigint")
    large = F.format_string(f"%.{decimals}f", x)
    if decimals == 0:
        return F.coalesce(t.cast("string"), large)
    a = F.abs(t)
    frac = F.lpad((a % (10 ** decimals)).cast("string"), decimals, "0")
    whole = F.floor(a / (10 ** decimals)).cast("string")
    return F.coalesce(F.concat(F.when(t < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), frac), large)


def numeric_histogram(df: DataFrame, target: str | None = None, params: Params = P) -> DataFrame:
    """NumPy-compatible equal-width histogram per numeric column (not the
    target) with at least ``hist_min_values`` values. Long form (feature, bin_index, bin, count)."""
    spark = df.sparkSession
    bins = params.hist_bins
    cols = [c for c in numeric_columns(df) if c != target]
    schema = "feature string, bin_index int, bin string, count bigint"
    if not cols:
        return spark.createDataFrame([], schema)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), _clean_num(c).alias("x")) for c in cols])))
    long = long.where(F.col("x").isNotNull())
    rng = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo0"), F.max("x").alias("_hi0"))
    rng = (rng.where(F.col("_n") >= params.hist_min_values)
           .withColumn("_lo", F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")))
           .withColumn("_hi", F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")))
           .withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))))

    def edge(i):
        return F.when(i >= bins, F.col("_hi")).otherwise(i.cast("double") * F.col("_step") + F.col("_lo"))

    x, lo = F.col("x"), F.col("_lo")
    # rng has one row per column: bounded broadcast. The bin is the number of
    # interior edges (i * step + lo, as NumPy builds them) at or below x -
    # what NumPy's division plus its two edge corrections yields.
    inner = sum(F.when(x >= F.lit(float(k)) * F.col("_step") + lo, 1).otherwise(0) for k in range(1, bins))
    binned = (long.join(F.broadcast(rng.select("feature", "_lo", "_hi", "_step")), "feature")
              .select("feature", inner.cast("long").alias("bin_index")))
    counts = binned.groupBy("feature", "bin_index").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("feature", "_lo", "_hi", "_step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index"))
    lab = F.concat(_fmt_fixed(edge(F.col("bin_index")), params.hist_label_decimals), F.lit("-"),
                   _fmt_fixed(edge(F.col("bin_index") + 1), params.hist_label_decimals))
    return (grid.join(counts, ["feature", "bin_index"], "left")
            .select("feature", F.col("bin_index").cast("int").alias("bin_index"), lab.alias("bin"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def correlation_matrix(df: DataFrame, params: Params = P) -> DataFrame:
    """Pairwise-complete Pearson of the numeric columns (the first
    ``correlation_max_columns`` when given), long (x, y, value); 0 where a
    column does not vary. Up to ``NARROW`` columns are compared by aggregates of
    each pair, more by blocked cross products in one pass (``gram``)."""
    cols = numeric_columns(df)[: params.correlation_max_columns]
    if len(cols) < 2 or not params.correlation:
        return df.sparkSession.createDataFrame([], "x string, y string, value double")
    if len(cols) > NARROW:
        return correlation_table(df, cols, lambda v: py_round(v, 2) + F.lit(0.0))
    # the parts of corr(), which itself raises on a constant column under ANSI rules
    aggs = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            x, y = SQ.clean_double(a), SQ.clean_double(cols[j])
            aggs += [f"covar_pop({x}, {y}) AS v{i}_{j}", f"stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) AS s{i}_{j}",
                     f"stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) AS t{i}_{j}"]
    one = chunked_agg(df, aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = min(i, j), max(i, j)
            v = SQ.py_round(f"coalesce(nanvl(try_divide(v{lo}_{hi}, s{lo}_{hi} * t{lo}_{hi}), 0D), 0D)", 2)
            cells.append(f"struct({SQ.lit_str(a)} AS x, {SQ.lit_str(b)} AS y, {v} AS value)")
    return one.selectExpr(f"inline(array({', '.join(cells)}))")


def dataset_analysis(df: DataFrame, target: str | None, params: Params = P) -> DataFrame:
    """D08 summary row of the analysis bundle (parts: D02-D07)."""
    cdf = coerce_numeric(df, params=params)
    return cdf.agg(F.count(F.lit(1)).alias("rows_count")).select(
        "rows_count", F.lit(len(df.columns)).cast("bigint").alias("columns_count"),
        F.lit(target).cast("string").alias("target_column"),
        F.lit(len(numeric_columns(cdf))).cast("bigint").alias("numerical_columns"),
        F.lit(len(categorical_columns(cdf))).cast("bigint").alias("categorical_columns"))


def analysis_bundle(df: DataFrame, target: str, params: Params = P) -> DataFrame:
    """D08 in full, long form (part, feature, item, number, text): the summary
    row, target distribution, numeric and categorical statistics, histograms,
    correlations and the crosstab. One frame per part, each planned by itself."""
    cdf = coerce_numeric(df, exclude=(target,), params=params)

    def long(part: str, frame: DataFrame, feature, item, number=None, text=None) -> DataFrame:
        return frame.select(F.lit(part).alias("part"), feature.alias("feature"), item.alias("item"),
                            (F.lit(None) if number is None else number).cast("double").alias("number"),
                            (F.lit(None) if text is None else text).cast("string").alias("text"))

    def melt(part: str, frame: DataFrame, names: list[str]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("number")) for n in names])).alias("x")
        flat = frame.select("column_name", rows)
        return long(part, flat, F.col("column_name"), F.col("x.item"), F.col("x.number"))

    num, cat = numeric_stats(cdf, params), categorical_stats(cdf, params)
    parts = [
        long("target_distribution", target_distribution(cdf, target, params), F.lit(target), F.col("name"), F.col("count")),
        melt("numeric", num, [c for c in num.columns if c != "column_name"]),
        melt("categorical", cat, ["count", "missing", "unique_count", "top_frequency", "frequency_percentage"]),
        long("categorical", cat, F.col("column_name"), F.lit("top_value"), None, F.col("top_value")),
        long("histogram", numeric_histogram(cdf, target, params), F.col("feature"), F.col("bin"), F.col("count")),
        long("correlation", correlation_matrix(cdf, params), F.col("x"), F.col("y"), F.col("value")),
        long("crosstab", category_by_target(cdf, target, params), F.col("feature"),
             F.concat_ws(" / ", "category", "target_class"), F.col("count")),
    ]
    one = dataset_analysis(df, target, params)
    out = long("summary", one, F.lit(None).cast("string"), F.lit("rows_count"), F.col("rows_count"))
    for p in parts:
        out = out.unionByName(p)
    return out


def churn_kpis(df: DataFrame, target: str, positive=None) -> DataFrame:
    """Total, churned, non-churned customers and churn rate.

    Churned is the count of the most frequent class that reads as positive;
    else the second most frequent class; else the only class.
    """
    from retainx.params import DASHBOARD_POSITIVE
    positive = positive or DASHBOARD_POSITIVE
    dt = df.schema[target].dataType
    # one map-side-combined pass over the rows; the total, the class counts and
    # the picks below all read this (classes x missing) aggregate's shuffle
    grouped = df.groupBy(qcol(target).alias("_k"), is_missing(df, target).alias("_miss")).agg(
        F.count(F.lit(1)).alias("_n"))
    total = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_customers"))
    counts = (grouped.where(~F.col("_miss")).select("_k", "_n")
              .withColumn("_pos", F.lower(F.regexp_replace(pandas_str(F.col("_k"), dt), r"^\s+|\s+$", "")).isin(*positive)))
    # top class, first positive class and runner-up by (count desc, value):
    # plain aggregates, no window over the classes
    order = F.struct(-F.col("_n"), F.col("_k"))
    top = counts.agg(F.min_by(F.struct("_k", "_n"), order).alias("_top"),
                     F.min_by("_n", F.when(F.col("_pos"), order)).alias("_first_pos"))
    second = (counts.crossJoin(top).where(F.col("_k") != F.col("_top._k"))
              .agg(F.min_by("_n", F.struct(-F.col("_n"), F.col("_k"))).alias("_second")))
    pick = top.crossJoin(second).select("_first_pos", "_second", F.col("_top._n").alias("_first"))
    churned = F.coalesce("_first_pos", "_second", "_first", F.lit(0)).cast("bigint")
    out = total.crossJoin(pick).withColumn("churned_customers", churned)
    n = F.col("total_customers")
    return out.select(n.cast("bigint").alias("total_customers"), "churned_customers",
                      (n - F.col("churned_customers")).cast("bigint").alias("non_churned_customers"),
                      F.when(n > 0, py_round(F.col("churned_customers") / n * 100.0, 1)).otherwise(F.lit(0.0))
                      .alias("churn_rate"))
