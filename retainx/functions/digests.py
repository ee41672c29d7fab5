"""Equal rows by their digests: 8 bytes a row are shuffled instead of whole rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from retainx.functions.columns import qcol

#: Digests of repeated rows that are shipped to every task (8 MB); with more of them whole rows are grouped.
MOST_SHIPPED = 1_000_000
DIGEST = "_digest"


def with_digest(df: DataFrame) -> DataFrame:
    """Equal rows have equal digests; others may too, so that digests only say which rows to compare."""
    return df.withColumn(DIGEST, F.xxhash64(*[qcol(c) for c in df.columns]))


def repeated_digests(df: DataFrame) -> tuple[DataFrame, int]:
    """The digests that more than one row has (kept for re-use; unpersist them), and how many."""
    seen = with_digest(df).groupBy(DIGEST).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(DIGEST) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    return seen, seen.count()
