"""Bounded samples of labelled ids for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_ids(ids: DataFrame, id_col: str, by: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` ids for each value of ``by``: those with the smallest hash.

    A first count tells below which hash a value certainly has enough ids, so
    that only about twice the sample, and not a share of every task, is ranked.
    """
    span = 1 << 62
    h = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 2)
    below = ids.groupBy(by).agg((F.least(F.lit(1.0), F.lit(2.0 * limit + 50) / F.count(F.lit(1))) * float(span)).alias("_below"))
    # one number for each value, looked up in place: the ids themselves are not dealt by value
    table = below.agg(F.map_from_entries(F.collect_list(F.struct(by, "_below"))).alias("_table"))
    order = Window.partitionBy(by).orderBy("_hash", id_col)
    return ids.withColumn("_hash", h).withColumn("_table", table.scalar()) \
        .where(F.col("_hash") <= F.try_element_at("_table", F.col(by))).drop("_table") \
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(id_col, by)
