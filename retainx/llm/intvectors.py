"""Whole-number images of vectors, for operators whose inner products must be exact.

Every component x becomes floor(scale * x), with x as a double, and the vector the
packed bytes of these numbers (4 bytes each). ``Scores`` computes their exact
inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums of products beyond this could leave 64 bits.
LIMIT = 2.0 ** 62


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & (F.size(vector) > 0), F.lit(False))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, *more: Column, scale: int = 256) -> tuple[DataFrame, int]:
    """(id, packed, more...) of the usable rows, repeated rows as they come, and the length of the vectors.

    Rows with a null id, a null or empty vector or a null or non-finite component
    take no part, nor do vectors whose length is not the most frequent one (ties:
    the smaller). No usable row: length 0. Components so large that a score could
    pass 64 bits raise an error.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & whole(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more)
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0].d if dims else 0
    largest = min(2.0 ** 31 - 1, np.sqrt(LIMIT / max(dim, 1)))
    names = ["id", "packed", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * float(scale))
            if np.abs(x).max(initial=0.0) > largest:
                raise ValueError(f"a component beyond {largest / scale:.6g} could bring a score past 64 bits")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), *b.columns[2:]], names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in [("id", "long"), ("packed", "binary"), *rows.dtypes[2:]])
    return rows.where(F.size("vector") == dim).mapInArrow(run, kinds), dim


def smallest_ids(rows: DataFrame, keep: int, *by: str) -> DataFrame:
    """Of the rows that agree in ``packed`` and ``by``, those with the ``keep`` smallest ids, each once.

    An answer that takes the best few, ties to smaller ids, needs no other; so a
    vector that a third of all rows share is a few rows from here on. Both steps
    reduce within tasks before they shuffle.
    """
    same = Window.partitionBy("packed", *by).orderBy("id")
    return rows.select("id", "packed", *by).distinct().withColumn("_n", F.row_number().over(same)) \
        .where(F.col("_n") <= keep).drop("_n")


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int32).reshape(-1, dim)


class Scores:
    """Exact inner products of many integer vectors with single ones.

    They run in double precision where every partial sum is a whole number below
    2**53, else in 64-bit integers.
    """

    def __init__(self, rows: np.ndarray, others: np.ndarray) -> None:
        bound = float(np.abs(rows.astype(np.float64)).max(initial=0.0)) * float(np.abs(others.astype(np.float64)).max(initial=0.0))
        self.kind = np.float64 if bound * rows.shape[1] < 2.0 ** 53 else np.int64
        self.rows = rows.astype(self.kind)

    def of(self, other: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Scores of the rows ``at`` (by default all), as 64-bit integers."""
        other = other.astype(self.kind)
        some = at is not None and 2 * len(at) < len(self.rows)
        found = (self.rows[at] if some else self.rows) @ other
        return (found if some or at is None else found[at]).astype(np.int64)
