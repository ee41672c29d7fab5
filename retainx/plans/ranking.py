"""Exact order statistics without funnelling a group through one task.

Spark's exact ``percentile`` merges the value->count map of a whole group in
a single task, and a window ordered over a whole column does the same. Here
the distinct values of each group are first range-bucketed (bucket bounds
come from ``percentile_approx`` and are frozen as a small literal table), so
every sort-based window only sees one bucket, and the bucket offsets come
from a tiny (groups x buckets) frame.

Quantiles need the values around a few ranks only. A mergeable sketch brackets
each wanted rank from both sides; one more pass keeps the values within brackets
and counts what lies between them, in tasks, so that of the other values no one
is shuffled. That the ranks fell into their brackets is checked by these counts.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F, types as T


#: Ranks that a sketch can be off, as a share of the rows.
SKETCH_ACCURACY = 10_000
#: Up to so many values around the wanted ranks are ranked by one window a group.
FEW_VALUES = 200_000
#: Up to so many brackets are compared one by one.
FEW_BRACKETS = 8


def _bucket_of(value, bounds):
    """Number of sorted ``bounds`` below ``value``: a coarse search over every
    step-th bound, then a fine one within a step."""
    step = F.greatest(F.floor(F.sqrt(F.size(bounds))).cast("int"), F.lit(1))
    below = lambda arr: F.size(F.filter(arr, lambda b: b < value))
    last = F.floor((F.size(bounds) - 1) / step).cast("int")
    coarse = below(F.transform(F.sequence(F.lit(0), last), lambda k: F.get(bounds, k * step)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.slice(bounds, (coarse - 1) * step + 1, step)))


def prefix_sums(df: DataFrame, keys: list[str], order_col: str, sum_cols: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over rows of the same group with a
    smaller ``order_col``. ``df`` must hold one row per (keys, order_col).

    Each group is cut into ``buckets`` ranges (the number of shuffle partitions
    of the session unless given), so the plan follows the cluster's setting; up to
    ``FEW_VALUES`` rows (callers keep ``df``, so that counting them is cheap) are
    ranked by one window a group."""
    spark = df.sparkSession
    if buckets is None and df.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        before = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sum_cols])
    nb = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if nb > 1:
        qs = [i / nb for i in range(1, nb)]
        bounds = df.groupBy(*keys).agg(F.array_distinct(
            F.percentile_approx(F.col(order_col).cast("double"), qs, 20 * nb)).alias("_bounds"))
        # Freeze the bounds: a recomputed sketch could differ between the two
        # branches below; one number per group and bucket.
        rows = bounds.collect()
        bounds = spark.createDataFrame(rows, bounds.schema)
        df = df.join(F.broadcast(bounds), keys) if keys else df.crossJoin(F.broadcast(bounds))       # one row per group: rows stay where they are
        df = df.withColumn("_bucket", _bucket_of(F.col(order_col).cast("double"), F.col("_bounds")).cast("int")).drop("_bounds")
    else:
        df = df.withColumn("_bucket", F.lit(0))
    btot = df.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    boff = btot.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    df = df.join(F.broadcast(boff), [*keys, "_bucket"])              # groups x buckets rows
    w = Window.partitionBy(*keys, "_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out_cols = [c for c in df.columns if not c.startswith("_off_") and c != "_bucket"]
    return df.select(*out_cols, *[
        (F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}_before")
        for c in sum_cols])


def _brackets(df: DataFrame, keys: list[str], value_col: str, probs: list[float], accuracy: int) -> DataFrame:
    """One row per group: its rows, and for each of ``probs`` values surely not above and not below the wanted ones."""
    spread = 2.0 / accuracy
    low = [max(0.0, p - spread) for p in probs]
    high = [min(1.0, p + spread) for p in probs]
    sketch = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value_col).alias("_min"), F.max(value_col).alias("_max"),
        F.percentile_approx(value_col, [*low, *high], accuracy).alias("_s"))
    at = lambda i, p, edge: F.col(edge) if p in (0.0, 1.0) else F.get("_s", F.lit(i))
    return sketch.select(*keys, "_n", "_max",
                         F.array(*[at(i, p, "_min" if p == 0.0 else "_max") for i, p in enumerate(low)]).alias("_low"),
                         F.array(*[at(len(low) + i, p, "_min" if p == 0.0 else "_max") for i, p in enumerate(high)]).alias("_high"))


def _around(df: DataFrame, keys: list[str], value_col: str, brackets: DataFrame, n: int | None = None) -> DataFrame:
    """(keys, _v, _w, _gap): how many rows have each value within the brackets. What lies before a bracket
    counts at its low end (after the last one, at the maximum), and in ``_gap``. A few brackets (their
    number ``n`` given) are plain comparisons, which are compiled; more are functions over arrays."""
    joined = df.join(F.broadcast(brackets), keys) if keys else df.crossJoin(F.broadcast(brackets))       # one row per group
    x = F.col(value_col)
    if n is not None and n <= FEW_BRACKETS:
        joined = joined.select(*keys, x, "_max", *[F.get(c, F.lit(i)).alias(f"{c}{i}") for c in ("_low", "_high") for i in range(n)])
        low, high = ([F.col(f"{c}{i}") for i in range(n)] for c in ("_low", "_high"))
        inside = reduce(or_, [(a <= x) & (x <= b) for a, b in zip(low, high)])
        later = [F.when(a > x, a) for a in low]
        ahead = F.coalesce(F.least(*later) if n > 1 else later[0], F.col("_max"))
    else:
        inside = F.exists(F.arrays_zip("_low", "_high"), lambda b: (b["_low"] <= x) & (x <= b["_high"]))
        ahead = F.coalesce(F.array_min(F.filter("_low", lambda b: b > x)), F.col("_max"))
    return joined.groupBy(*keys, F.when(inside, x).otherwise(ahead).alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_w"), F.count_if(~inside).alias("_gap"))


def exact_quantiles(df: DataFrame, keys: list[str], value_col: str, probs: list[float],
                    buckets: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (numpy / pandas default) per group.

    Returns one row per (keys, prob) with column ``quantile``; nulls and NaN
    are ignored. Runs eagerly: the values around the wanted ranks are cached, and
    the (groups x probs) result - a bounded summary - comes back as a small local
    frame. ``buckets`` sets the fineness of the sketch (two for each bucket) and
    of the ranking.
    """
    spark = df.sparkSession
    probs = [float(p) for p in probs]
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType([*key_fields, T.StructField("prob", T.DoubleType()), T.StructField("quantile", T.DoubleType())])
    # -0.0 and 0.0 are one value
    rows = df.select(*keys, (F.col(value_col).cast("double") + F.lit(0.0)).alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    bounds = _brackets(rows, keys, "_x", probs, SKETCH_ACCURACY if buckets is None else 2 * buckets)
    found = [r for r in bounds.collect() if r["_n"]]                   # one row per group
    if not found:
        return spark.createDataFrame([], out_schema)
    frozen = spark.createDataFrame(found, bounds.schema)
    picked = _picked(_around(rows, keys, "_x", frozen, len(probs)), keys, probs, found, key_fields, buckets)
    if not all(r["_certain"] for r in picked):                         # a sketch was off by more than it promises: all values
        everything = rows.groupBy(*keys, F.col("_x").alias("_v")).agg(F.count(F.lit(1)).alias("_w"), F.lit(0).alias("_gap"))
        picked = _picked(everything, keys, probs, found, key_fields, buckets)
    out = []
    for r in picked:
        a, b, t = r["_a"], r["_a"] if r["_b"] is None else r["_b"], r["_t"]
        # numpy's lerp: a + (b-a)*t below t=0.5, b - (b-a)*(1-t) from 0.5 up.
        out.append((*[r[k] for k in keys], r["prob"], b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t))
    return spark.createDataFrame(out, out_schema)


def _picked(values: DataFrame, keys: list[str], probs: list[float], groups: list, key_fields: list, buckets: int | None) -> list:
    """For each group and prob the values at the two ranks around it, and whether neither fell into a gap."""
    trows = []
    for r in groups:
        for p in probs:
            pos = p * (r["_n"] - 1)
            i = math.floor(pos)
            trows.append((*[r[k] for k in keys], p, int(i), pos - i))
    targets = values.sparkSession.createDataFrame(trows, T.StructType([
        *key_fields, T.StructField("prob", T.DoubleType()), T.StructField("_i", T.LongType()), T.StructField("_t", T.DoubleType())]))
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranked = prefix_sums(values, keys, "_v", ["_w"], buckets)
        # targets: groups x probs rows, bounded by the number of groups.
        hit = ranked.join(targets, keys) if keys else ranked.crossJoin(targets)
        first, end = F.col("_w_before") + F.col("_gap"), F.col("_w_before") + F.col("_w")
        lo_hit = (F.col("_w_before") <= F.col("_i")) & (F.col("_i") < end)
        hi_hit = (F.col("_w_before") <= F.col("_i") + 1) & (F.col("_i") + 1 < end)
        return hit.where(lo_hit | hi_hit).groupBy(*keys, "prob", "_t").agg(
            F.max(F.when(lo_hit, F.col("_v"))).alias("_a"), F.max(F.when(hi_hit, F.col("_v"))).alias("_b"),
            F.min((~lo_hit | (F.col("_i") >= first)) & (~hi_hit | (F.col("_i") + 1 >= first))).alias("_certain")).collect()
    finally:
        values.unpersist()
