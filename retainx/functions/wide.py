"""Wide one-row aggregates that stay inside whole-stage codegen.

Whole-stage codegen is switched off for an aggregate whose partial buffers
exceed ``spark.sql.codegen.maxFields`` (100 by default): 36 ``corr`` calls
carry 216 buffer fields and would run interpreted, several times slower.
``chunked_agg`` splits the aggregate expressions into groups under the
budget; each group is its own one-row aggregate (column pruning makes each
scan read only its columns) and the one-row results are cross-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# aggregate buffer widths (Spark's declarative aggregates)
BUFFER_FIELDS = {"count": 1, "sum": 1, "min": 1, "max": 1, "avg": 2, "stddev_samp": 3, "stddev_pop": 3,
                 "var_samp": 3, "var_pop": 3, "skewness": 4, "kurtosis": 5, "corr": 6, "covar_samp": 4, "covar_pop": 4}


def _width(sql: str) -> int:
    head = sql.strip().split("(", 1)[0].strip().lower()
    return BUFFER_FIELDS.get(head, 2)


def chunked_agg(df: DataFrame, aggs: list[str], budget: int | None = None) -> DataFrame:
    """One row holding every ``<agg SQL> AS name`` of ``aggs``."""
    if budget is None:
        try:
            budget = int(df.sparkSession.conf.get("spark.sql.codegen.maxFields", "100")) - 4
        except Exception:
            budget = 96
    chunks, cur, used = [], [], 0
    for a in aggs:
        w = _width(a)
        if cur and used + w > budget:
            chunks.append(cur)
            cur, used = [], 0
        cur.append(a)
        used += w
    if cur:
        chunks.append(cur)
    out = None
    for ch in chunks:
        part = df.agg(*[F.expr(a) for a in ch])
        out = part if out is None else out.crossJoin(part)
    return out
