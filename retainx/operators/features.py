"""Feature preparation.

The fitted state (feature lists, category domains, medians, modes, the
positive class) is a small ``FeatureSchema`` read back from aggregates - the
same information a fitted scikit-learn / Spark ML transformer holds. All row
work stays in Spark expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from retainx.functions.columns import qcol
from retainx.functions.expr import as_double, guarded_double, is_numeric_type, pandas_str, py_round, strip_ws
from retainx.operators.rows import distinct_rows, drop_columns
from retainx.operators.stats import numeric_like_columns
from retainx.params import POSITIVE_PATTERNS, Params
from retainx.plans.ranking import exact_quantiles, prefix_sums
from retainx.session import shared_dir

P = Params()


# ---- F01 / F03 -------------------------------------------------------------------
#: Name of the column that identifies a prepared row after its IDs are gone.
ROW_KEY = "_row_key"


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds ``ROW_KEY``: a hash of the whole row, IDs included, so distinct rows have distinct keys.

    Every value comes with its length, so that no text can pass for a border or a null."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    text = F.concat_ws("|", *[F.coalesce(sized(qcol(c).cast("string")), F.lit("null")) for c in df.columns])
    return df.withColumn(ROW_KEY, F.md5(text))


def prepare(df: DataFrame, target: str, id_cols=(), params: Params = P, persist: bool = False,
            materialize: bool = False, row_key: bool = False) -> DataFrame:
    """drop duplicate rows, drop ID columns, coerce numeric-like text
    (the target excluded). ``persist`` keeps the deduplicated rows for the
    metadata aggregates that follow (memory, spilling to disk). ``row_key``
    adds ``ROW_KEY``, made before the IDs go.

    ``materialize`` writes the deduplicated rows once as a Parquet table in a
    fresh folder under the shared ``spark.checkpoint.dir``: every later job of
    a chain (type detection, class list, split statistics, medians, the final
    read) scans those files - with column pruning and pushed filters - instead
    of re-running the full-row dedup shuffle, and the cut lineage survives
    lost executors."""
    d = drop_columns(with_row_key(df.dropDuplicates()), id_cols) if row_key else distinct_rows(df, id_cols)
    if materialize:
        spark = d.sparkSession
        path = shared_dir(spark, "prepared")
        d.write.mode("overwrite").parquet(path)
        d = spark.read.parquet(path)
    elif persist:
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
    promote = set(numeric_like_columns(d, exclude=(target, ROW_KEY), params=params))
    return d.select(*[guarded_double(qcol(c)).alias(c) if c in promote else qcol(c) for c in d.columns])


def split_feature_types(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """numeric (booleans excluded) vs other feature columns, in column order."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        (num if is_numeric_type(f.dataType) else cat).append(f.name)
    return num, cat


def feature_types_frame(df: DataFrame, target: str) -> DataFrame:
    num, cat = split_feature_types(df, target)
    rows = [(i, c, "numerical" if c in num else "categorical") for i, c in enumerate([c for c in df.columns if c != target])]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, kind string")


# ---- F02 -----------------------------------------------------------------------------
def positive_class(df: DataFrame, target: str, params: Params = P):
    """The target value mapped to 1, chosen like the reference:

    the last class (in sorted order) whose trimmed lower-case text is a
    positive pattern; if none and there are two classes, the second (or, in
    the one-file variant, the last); else the first class.
    """
    dt = df.schema[target].dataType
    classes = (df.where(qcol(target).isNotNull()).select(qcol(target).alias("v")).distinct()
               .orderBy("v").limit(params.max_classes + 1).collect())
    if len(classes) > params.max_classes:
        raise ValueError(f"Target column '{target}' has more than {params.max_classes} classes.")
    vals = [r["v"] for r in classes]
    if isinstance(dt, T.DoubleType | T.FloatType):
        vals = [v for v in vals if not (isinstance(v, float) and math.isnan(v))]
    pos = None
    for v in vals:
        s = ("True" if v is True else "False" if v is False else str(v)).strip().lower()
        if s in POSITIVE_PATTERNS:
            pos = v
    if pos is None and vals:
        if len(vals) == 2:
            pos = vals[1]
        else:
            pos = vals[-1] if params.no_positive_fallback == "last" and len(vals) > 1 else vals[0]
    return pos, vals


def map_target(df: DataFrame, target: str, pos, label: str = "label") -> DataFrame:
    """1 for the positive class, 0 for everything else (null included)."""
    if pos is None:
        return df.withColumn(label, F.lit(0))
    return df.withColumn(label, F.coalesce((qcol(target) == F.lit(pos)).cast("int"), F.lit(0)))


# ---- F04 / F05 / F06 / F08 ---------------------------------------------------------
def normalize_category(df: DataFrame, c: str) -> Column:
    """text, stripped; null becomes the category ``nan``."""
    return strip_ws(pandas_str(qcol(c), df.schema[c].dataType))


def normalize_categories(df: DataFrame, cat_cols, params: Params = P) -> DataFrame:
    cats = set(cat_cols)
    return df.select(*[normalize_category(df, c).alias(c) if c in cats else qcol(c) for c in df.columns])


def category_counts(df: DataFrame, cat_cols) -> DataFrame:
    """(column_name, value, n) for normalised categorical values; one shuffle."""
    if not cat_cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), normalize_category(df, c).alias("value"))
                                        for c in cat_cols])))
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def category_domain(df: DataFrame, cat_cols) -> DataFrame:
    """distinct normalised values per categorical column (long form)."""
    return category_counts(df, cat_cols).select("column_name", "value")


def category_domains(df: DataFrame, cat_cols, params: Params = P) -> dict:
    """F05 for a fit: sorted categories per column, after a count that refuses
    columns with more than ``max_categories`` of them."""
    out: dict = {}
    for r in _known_categories(category_counts(df, cat_cols), params):
        out.setdefault(r["column_name"], []).append(r["value"])
    return {c: sorted(out.get(c, [])) for c in cat_cols}


def _known_categories(counts: DataFrame, params: Params) -> list:
    """Rows of ``category_counts`` (at most ``max_categories`` per column, else an error), by one pass over the table."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _refuse_wide(counts, params)
        return counts.collect()
    finally:
        counts.unpersist()


def _refuse_wide(counts: DataFrame, params: Params) -> None:
    wide = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("u")).where(F.col("u") > params.max_categories).collect()
    if wide:
        names = ", ".join(sorted(r["column_name"] for r in wide))
        raise ValueError(f"More than {params.max_categories} categories in: {names}. Leave these columns out of the features.")


def category_modes(df: DataFrame, cat_cols) -> DataFrame:
    """most frequent category per column, the smallest on ties."""
    return category_counts(df, cat_cols).groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def numeric_ranges(df: DataFrame, num_cols, params: Params = P) -> DataFrame:
    """min / max / mean / median per numeric column over all rows;
    0 / 100 / 50 / 50 when a column has no values."""
    spark = df.sparkSession
    if not num_cols:
        return spark.createDataFrame([], "column_name string, min double, max double, mean double, median double")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), qcol(c).cast("double").alias("x"))
                                        for c in num_cols])))
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    agg = long.groupBy("column_name").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    med = _medians(long, params)
    names = spark.createDataFrame([(c,) for c in num_cols], "column_name string")
    out = names.join(F.broadcast(agg), "column_name", "left").join(F.broadcast(med), "column_name", "left")
    return out.select("column_name", F.coalesce("min", F.lit(0.0)).alias("min"), F.coalesce("max", F.lit(100.0)).alias("max"),
                      F.coalesce("mean", F.lit(50.0)).alias("mean"), F.coalesce("median", F.lit(50.0)).alias("median"))


def _medians(long: DataFrame, params: Params) -> DataFrame:
    if params.approx_quantiles:
        return long.groupBy("column_name").agg(F.percentile_approx("x", 0.5, 10000).alias("median"))
    return exact_quantiles(long, ["column_name"], "x", [0.5]).select("column_name", F.col("quantile").alias("median"))


# ---- fitted schema -----------------------------------------------------------------
@dataclass
class FeatureSchema:
    target: str
    id_columns: list
    feature_columns: list
    numerical_cols: list
    categorical_cols: list
    positive: object = None
    classes: list = field(default_factory=list)
    domains: dict = field(default_factory=dict)       # column -> sorted categories (all rows)
    ranges: dict = field(default_factory=dict)        # column -> {min, max, mean, median} (all rows)
    defaults: dict = field(default_factory=dict)      # column -> default category (mode)

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    @staticmethod
    def from_dict(values: dict) -> "FeatureSchema":
        """Rebuilt from ``to_dict`` (as read back from a stored package)."""
        return FeatureSchema(**{k: values[k] for k in FeatureSchema.__dataclass_fields__ if k in values})


def fit_schema(df: DataFrame, target: str, id_cols=(), params: Params = P,
               persist: bool = False, materialize: bool = False, row_key: bool = False) -> tuple[FeatureSchema, DataFrame]:
    """Prepare ``df`` and read back the per-column metadata (bounded by the
    number of columns and their category domains). With ``persist`` the
    deduplicated frame is kept (memory, spilling to disk) for the several
    small aggregates that follow; lost blocks are recomputed from lineage.
    With ``materialize`` it is written once to the shared folder instead.
    With ``row_key`` the returned frame also carries ``ROW_KEY``."""
    whole = prepare(df, target, id_cols, params, persist=persist, materialize=materialize, row_key=row_key)
    prepared = whole.drop(ROW_KEY)
    if target not in prepared.columns:
        raise ValueError(f"Target column '{target}' not found in dataset.")
    num, cat = split_feature_types(prepared, target)
    pos, classes = positive_class(prepared, target, params)
    counts = _known_categories(category_counts(prepared, cat), params) if cat else []
    domains, best = {}, {}
    for r in counts:
        domains.setdefault(r["column_name"], []).append(r["value"])
        b = best.get(r["column_name"])
        if b is None or (-r["n"], r["value"]) < (-b[0], b[1]):
            best[r["column_name"]] = (r["n"], r["value"])
    domains = {k: sorted(v) for k, v in domains.items()}
    ranges = {r["column_name"]: {"min": r["min"], "max": r["max"], "mean": r["mean"], "median": r["median"]}
              for r in numeric_ranges(prepared, num, params).collect()} if num else {}
    schema = FeatureSchema(target=target, id_columns=list(id_cols), feature_columns=[c for c in prepared.columns if c != target],
                           numerical_cols=num, categorical_cols=cat, positive=pos, classes=classes, domains=domains,
                           ranges=ranges, defaults={k: v[1] for k, v in best.items()})
    return schema, whole


# ---- F12 -----------------------------------------------------------------------------
#: Bits of a row's hash, and how many leading ones of them a split counts rows by.
HASH_BITS = 60
SPLIT_BITS = 16


def row_hash(df: DataFrame, cols, seed: int, part: int = 0) -> Column:
    """60 bits of the md5 of the row text (``part`` 0 or 1): stable across runs and engines, no shuffle."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(qcol(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1 + 15 * part, 15), 16, 10).cast("bigint")


def _allocate(counts: dict, test_size: float) -> dict:
    """Per-class test counts: ceil(ts * n) in total, split proportionally with
    the remainder going to the largest fractional parts (ties: smaller label)."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    base = {k: math.floor(n_test * v / n) for k, v in counts.items()}
    rem = n_test - sum(base.values())
    order = sorted(counts, key=lambda k: (-(n_test * counts[k] / n - base[k]), k))
    for k in order[:rem]:
        base[k] += 1
    return base


def train_test_split(df: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     stratify: bool = True, key_cols=None) -> DataFrame:
    """adds ``is_test``. Rows are ordered by a seeded hash of ``key_cols``
    (default: all columns but the label); per label exactly the allocated
    number of rows with the lowest hashes goes to test. The threshold comes
    from counts by the leading bits of the hash, then from the few rows that
    share the threshold's bits (no global sort, no shuffle of the rows).

    ``key_cols`` should identify a row (``ROW_KEY``, or an ID): then rows with
    equal features fall on both sides like any others. Rows that share the
    threshold hash are told apart by a second hash; only if these are equal too
    is it open which of them is taken."""
    keys = [label] if stratify else []
    cols = key_cols or [c for c in df.columns if c != label]
    hd = df.withColumn("_h", row_hash(df, cols, seed))
    # rows by the leading bits of the hash; what is ranked value by value are those that share the threshold's bits only
    vc = hd.groupBy(*keys, F.shiftright("_h", HASH_BITS - SPLIT_BITS).alias("_lead")) \
        .agg(F.count(F.lit(1)).alias("_w")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = {(r[label] if stratify else 0): r["_n"] for r in vc.groupBy(*keys).agg(F.sum("_w").alias("_n")).collect()}
        if stratify and len(totals) < 2:                     # one class: plain split
            return train_test_split(df, label, test_size, seed, stratify=False, key_cols=cols)
        if not totals:
            return hd.withColumn("is_test", F.lit(False)).drop("_h")
        alloc = _allocate(totals, test_size) if stratify else {0: math.ceil(test_size * sum(totals.values()))}
        take = F.lit(0)
        for k, n in alloc.items():
            take = F.when(F.col(label) == F.lit(k), F.lit(n)).otherwise(take) if stratify else F.lit(n)

        def reached(counts: DataFrame, order_col: str, left: Column) -> DataFrame:
            """Of each group the row of ``counts`` in which its first ``left`` rows end, and how many of them it takes."""
            return prefix_sums(counts, keys, order_col, ["_w"]).withColumn("_k", left.cast("bigint")).where(
                (F.col("_w_before") < F.col("_k")) & (F.col("_k") <= F.col("_w_before") + F.col("_w"))) \
                .select(*keys, order_col, "_w", (F.col("_k") - F.col("_w_before")).alias("_need"))

        leads = {(r[label] if stratify else 0): (r["_lead"], r["_need"]) for r in reached(vc, "_lead", take).collect()}
    finally:
        vc.unpersist()
    near, need_in = F.lit(False), F.lit(0)
    for k, (lead, need) in leads.items():
        own = F.col(label).eqNullSafe(F.lit(k)) if stratify else F.lit(True)
        near = near | (own & (F.shiftright("_h", HASH_BITS - SPLIT_BITS) == F.lit(lead)))
        need_in = F.when(own, F.lit(need)).otherwise(need_in)
    around = hd.where(near).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_w")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # per label one threshold, the rows that share it and how many of them go to test
        cuts = {(r[label] if stratify else 0): (r["_h"], r["_w"], r["_need"]) for r in reached(around, "_h", need_in).collect()}
    finally:
        around.unpersist()
    # applied as literals: the returned frame is a projection of the input, so
    # later actions do not recompute the ranking
    test, tied = F.lit(False), F.lit(False)
    for k, (h, rows, need) in cuts.items():
        own = F.col(label).eqNullSafe(F.lit(k)) if stratify else F.lit(True)
        test = F.when(own, F.col("_h") <= F.lit(h)).otherwise(test)
        if need < rows:
            tied = tied | (own & (F.col("_h") == F.lit(h)))
    split = hd.withColumn("is_test", F.coalesce(test, F.lit(False)))
    if all(need == rows for _, rows, need in cuts.values()):
        return split.drop("_h")
    need_of = F.lit(0)
    for k, (_, _, need) in cuts.items():
        need_of = F.when(F.col(label).eqNullSafe(F.lit(k)), F.lit(need)).otherwise(need_of) if stratify else F.lit(need)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h2") if keys else Window.orderBy("_h2"))
    ties = hd.where(tied).withColumn("_h2", row_hash(df, cols, seed, 1)).withColumn("_r", rank) \
        .withColumn("is_test", F.col("_r") <= need_of).drop("_r", "_h2")     # only rows of the one threshold hash
    return split.where(~tied).unionByName(ties).drop("_h")


# ---- F07 / F09 / F10 -------------------------------------------------------------------
def train_medians(train: DataFrame, num_cols, params: Params = P) -> dict:
    """Exact medians of the training rows (one small collect)."""
    if not num_cols:
        return {}
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), qcol(c).cast("double").alias("x"))
                                           for c in num_cols])))
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    got = {r["column_name"]: r["median"] for r in _medians(long, params).collect()}
    return {c: got.get(c) for c in num_cols}


def impute_median(df: DataFrame, medians: dict) -> DataFrame:
    """fill missing numerics with the fitted medians."""
    return df.select(*[F.coalesce(F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double")),
                                  F.lit(medians[c])).alias(c) if c in medians else qcol(c) for c in df.columns])


def impute_mode(df: DataFrame, modes: dict) -> DataFrame:
    """F08 fill: missing categories become the fitted mode."""
    return df.select(*[F.coalesce(qcol(c), F.lit(modes[c])).alias(c) if c in modes else qcol(c) for c in df.columns])


def scaler_stats(train: DataFrame, num_cols) -> dict:
    """Mean and population std per column (one aggregate)."""
    if not num_cols:
        return {}
    row = train.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(num_cols)],
                    *[F.stddev_pop(qcol(c)).alias(f"s{i}") for i, c in enumerate(num_cols)]).first()
    out = {}
    for i, c in enumerate(num_cols):
        s = row[f"s{i}"]
        out[c] = (row[f"m{i}"] or 0.0, s if s not in (None, 0.0) and not math.isnan(s) else 1.0)
    return out


def standard_scale(df: DataFrame, stats: dict) -> DataFrame:
    """(x - mean) / population std; a zero std scales by 1."""
    return df.select(*[((qcol(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats else qcol(c)
                       for c in df.columns])


def one_hot(df: DataFrame, domains: dict, keep=()) -> DataFrame:
    """F10 (SQL form): one 0/1 column ``<col>_<category>`` per known category;
    an unseen category gives all zeros."""
    cols = [qcol(c) for c in keep]
    for c, cats in domains.items():
        for v in cats:
            cols.append(F.coalesce((qcol(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*cols)


# ---- F13 / F14 / F15 / F16 -------------------------------------------------------------
def _num_or_zero(c: Column) -> Column:
    """``float(x or 0)``."""
    return F.coalesce(guarded_double(c.cast("string")), F.lit(0.0))


def derive_total_charges(df: DataFrame, total="TotalCharges", monthly="MonthlyCharges", tenure="tenure") -> DataFrame:
    """missing / blank / zero TotalCharges = round(monthly * max(tenure, 1), 2)."""
    mc = _num_or_zero(qcol(monthly)) if monthly in df.columns else F.lit(0.0)
    ten = _num_or_zero(qcol(tenure)) if tenure in df.columns else F.lit(0.0)
    derived = py_round(mc * F.greatest(ten, F.lit(1.0)), 2)
    if total not in df.columns:
        return df.withColumn(total, derived)
    t = qcol(total)
    empty = t.isNull() | (strip_ws(t.cast("string")) == "") | (F.coalesce(guarded_double(t.cast("string")), F.lit(1.0)) == 0.0)
    return df.withColumn(total, F.when(empty, derived.cast("string")).otherwise(t.cast("string")))


#: Categories of a feature that are looked up by an expression; more of them by a join.
FEW_CATEGORIES = 64


def normalize_scoring_input(df: DataFrame, schema: FeatureSchema, derive_total: bool = True) -> DataFrame:
    """F14 for a frame of customers: match columns case-insensitively, parse
    numerics (bad or blank -> median), map categories case-insensitively onto
    the known domain (blank -> default category). A large domain is a small table
    that is joined, so that the plan does not grow with it."""
    if derive_total and "TotalCharges" in schema.feature_columns:
        df = derive_total_charges(_rename_ci(df, schema.feature_columns))
    df = _rename_ci(df, schema.feature_columns)
    out, looked = [], []
    for c in schema.feature_columns:
        if c in schema.numerical_cols:
            med = schema.ranges.get(c, {}).get("median", 0.0)
            src = qcol(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            out.append(F.coalesce(guarded_double(src), F.lit(med)).alias(c))
        else:
            dom = schema.domains.get(c, [])
            default = schema.defaults.get(c, dom[0] if dom else "Unknown")
            src = strip_ws(qcol(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
            lut = {}
            for v in dom:                      # first (smallest) value wins per lower-case key
                lut.setdefault(v.lower(), v)
            if len(lut) > FEW_CATEGORIES:
                i = len(out)
                table = df.sparkSession.createDataFrame(list(lut.items()), f"_key{i} string, _value{i} string")
                df = df.join(F.broadcast(table), F.lower(src) == F.col(f"_key{i}"), "left").drop(f"_key{i}")    # at most max_categories rows
                looked.append(f"_value{i}")
                mapped = F.coalesce(F.col(f"_value{i}"), src)
            else:
                m = F.create_map(*[x for k, v in lut.items() for x in (F.lit(k), F.lit(v))]) if lut else None
                mapped = F.coalesce(m[F.lower(src)], src) if m is not None else src
            out.append(F.when(src.isNull() | (src == ""), F.lit(default)).otherwise(mapped).alias(c))
    extra = [qcol(c) for c in df.columns if c not in schema.feature_columns and c not in looked]
    return df.select(*extra, *out)


def _rename_ci(df: DataFrame, wanted) -> DataFrame:
    """Rename columns that match a wanted name case-insensitively."""
    lower = {w.strip().lower(): w for w in wanted}
    have = set(df.columns)
    cols = []
    for c in df.columns:
        w = lower.get(c.strip().lower())
        cols.append(qcol(c).alias(w) if w and w != c and w not in have else qcol(c))
    return df.select(*cols)


def align_batch(df: DataFrame, schema: FeatureSchema) -> DataFrame:
    """the batch's feature columns in fitted order: missing numerics get
    the median, missing categoricals the default category; numerics parsed
    with the median for bad values; categoricals as stripped text. Other
    columns (IDs, target) are kept in front, untouched."""
    keep = [qcol(c) for c in df.columns if c not in schema.feature_columns]
    out = []
    for c in schema.feature_columns:
        if c in schema.numerical_cols:
            med = schema.ranges.get(c, {}).get("median", 0.0)
            x = as_double(df, c) if c in df.columns else F.lit(None).cast("double")
            out.append(F.coalesce(x, F.lit(med)).alias(c))
        else:
            dom = schema.domains.get(c, [])
            default = schema.defaults.get(c, dom[0] if dom else "Unknown")
            out.append((normalize_category(df, c) if c in df.columns else F.lit(default)).alias(c))
    return df.select(*keep, *out)


def balanced_class_weight(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """F16: n / (n_classes * n_class) per row; the label frame has one row per
    class (bounded broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    wt = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight))
    return df.join(F.broadcast(wt), label)       # one row per class of the 0/1 label
