"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retainx.session import shared_dir


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()`` does, keeps column pruning for the
    readers, and survives the loss of any executor. ``narrow`` is for tables of
    a few numbers a row, such as links: an eighth of the partitions writes them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if narrow:
        df = df.coalesce(max(1, shuffle_partitions(spark) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
