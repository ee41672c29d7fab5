"""Correlations of many columns in one pass: blocked cross products instead of one aggregate per pair.

A task multiplies its batches' columns with each other at once (with their masks,
since a pair counts only rows where both are present) and adds up; what leaves it
are a few numbers for each pair. Values are taken from the task's own first means,
and the tasks' sums are moved to a common point before they are added, so that
columns far from zero lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from retainx.functions.columns import qcol

#: Variance below this share of the squares that it is left over from is rounding: the column does not vary.
ROUNDING = 1e-12
PARTS = ("n", "x", "y", "xx", "yy", "xy", "wild")


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each column i of the task: its origin, and against every column j the sums over rows that have both."""
    sums = None
    for b in batches:
        raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
        if sums is None:
            p = raw.shape[1]
            origin, known = np.zeros(p), np.zeros(p, bool)
            sums = {name: np.zeros((p, p)) for name in PARTS}
        wild = np.isinf(raw)
        there = ~np.isnan(raw) & ~wild
        counts = there.sum(axis=0)
        new = ~known & (counts > 0)
        origin[new] = np.where(there, raw, 0.0).sum(axis=0)[new] / counts[new]
        known |= new
        x = np.where(there, raw - origin, 0.0)
        m, w = there.astype(np.float64), wild.astype(np.float64)
        sums["n"] += m.T @ m
        sums["x"] += x.T @ m
        sums["y"] += m.T @ x
        sums["xx"] += (x * x).T @ m
        sums["yy"] += m.T @ (x * x)
        sums["xy"] += x.T @ x
        sums["wild"] += w.T @ (m + w) + m.T @ w
    if sums is not None:
        p = len(origin)
        column = lambda a: pa.array(list(a), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(p), pa.int32()), column(np.tile(origin, (p, 1))), *[column(sums[name]) for name in PARTS]], ["i", "origin", *PARTS])


def _correlations(table: pa.Table) -> pa.Table:
    """Column i against every j, from the tasks' sums."""
    i = table.column("i")[0].as_py()
    part = {name: np.array(table.column(name).to_pylist()) for name in ("origin", *PARTS)}
    n = part["n"]
    total = n.sum(axis=0)
    weight = np.where(total > 0, total, 1.0)
    here, there = part["origin"][:, [i]], part["origin"]
    # a common origin of the pair, near where its rows are
    to_x, to_y = (n * here).sum(axis=0) / weight, (n * there).sum(axis=0) / weight
    dx, dy = here - to_x, there - to_y
    x, y = (part["x"] + n * dx).sum(axis=0), (part["y"] + n * dy).sum(axis=0)
    xx = (part["xx"] + 2 * dx * part["x"] + n * dx * dx).sum(axis=0)
    yy = (part["yy"] + 2 * dy * part["y"] + n * dy * dy).sum(axis=0)
    xy = (part["xy"] + dy * part["x"] + dx * part["y"] + n * dx * dy).sum(axis=0)
    vx, vy, cov = xx - x * x / weight, yy - y * y / weight, xy - x * y / weight
    varies = (vx > ROUNDING * xx) & (vy > ROUNDING * yy) & (part["wild"].sum(axis=0) == 0)
    value = np.where(varies, cov / np.sqrt(np.where(varies, vx * vy, 1.0)), 0.0)
    return pa.table({"i": pa.array([i] * len(value), pa.int32()), "j": pa.array(range(len(value)), pa.int32()), "value": pa.array(value)})


def pairwise_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, value) for all pairs of ``cols`` by position, pairwise complete: rows where a column is null or NaN
    don't count for its pairs. 0 where a column does not vary, has no rows or holds an infinite number."""
    numbers = df.select(*[qcol(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    lists = ", ".join(f"{name} array<double>" for name in ("origin", *PARTS))
    return numbers.mapInArrow(_task_sums, f"i int, {lists}").groupBy("i").applyInArrow(_correlations, "i int, j int, value double")


def correlation_table(df: DataFrame, cols: list[str], rounded) -> DataFrame:
    """D07 for many columns: (x, y, value) with ``rounded`` values."""
    names = F.array(*[F.lit(c) for c in cols])
    return pairwise_correlations(df, cols).select(
        F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), rounded(F.col("value")).alias("value"))
