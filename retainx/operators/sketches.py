"""Mergeable profiles: a dataset that grows by loads is profiled load by load, without reading old loads again.

A load's profile holds, for each column, its rows, its missing cells and a
HyperLogLog sketch of its values. Profiles of loads merge by adding the counts
and uniting the sketches, in any order, so that the distinct count of the whole
is as exact as if all rows had been sketched at once: within about
``1.04 / sqrt(2 ** precision)`` (0.8 % at 14), and exact for small columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from retainx.functions.columns import catalog, long_values
from retainx.operators.profile import column_counts

PRECISION = 14
SKETCHES = "load string, ordinal int, column_name string, total_rows long, missing_count long, sketch binary"


def load_profile(df: DataFrame, load: str, precision: int = PRECISION) -> DataFrame:
    """One row per column: (load, ordinal, column_name, total_rows, missing_count, sketch); a sketch is null where nothing is.

    Tasks sketch their own rows, so that a few KB a column and task are shuffled.
    """
    values = long_values(df).select("ordinal", F.xxhash64("s", "i", "d").alias("h"))
    sketch = values.groupBy("ordinal").agg(F.hll_sketch_agg("h", F.lit(precision)).alias("sketch"))
    return column_counts(df).join(F.broadcast(catalog(df.sparkSession, df)), "ordinal").join(sketch, "ordinal", "left") \
        .select(F.lit(load).alias("load"), "ordinal", "column_name", "total_rows", "missing_count", "sketch")


def add_load(df: DataFrame, path: str, load: str, precision: int = PRECISION) -> str:
    """Profile one load and store its row per column under ``path``; the same load again takes the place of its first profile."""
    load_profile(df, load, precision).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)
    return path


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(path)


def merged_profile(profiles: DataFrame) -> DataFrame:
    """(ordinal, column_name, total_rows, missing_count, unique_estimate) of all loads together.

    A column that some loads don't have is missing in their rows.
    """
    rows = profiles.select("load", "total_rows").distinct().agg(F.sum("total_rows").alias("_all"))
    merged = profiles.groupBy("column_name").agg(
        F.min("ordinal").alias("ordinal"), F.sum("total_rows").alias("_rows"), F.sum("missing_count").alias("_missing"),
        F.hll_union_agg("sketch", F.lit(True)).alias("_sketch"))
    return merged.crossJoin(F.broadcast(rows)).select(                                      # one row
        "ordinal", "column_name", F.col("_all").alias("total_rows"), (F.col("_missing") + F.col("_all") - F.col("_rows")).alias("missing_count"),
        F.coalesce(F.hll_sketch_estimate("_sketch"), F.lit(0)).alias("unique_estimate"))
