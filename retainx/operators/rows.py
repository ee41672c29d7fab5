"""Row-set operators (R01-R06): preview, search, class filter, seeded sample,
dedup and column drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from retainx.functions.columns import qcol
from retainx.params import CHURN_CLASS_VALUES, LOYAL_CLASS_VALUES


def _as_text(df: DataFrame) -> list:
    """Every column as text with missing shown as '' (``fillna("")``)."""
    return [F.coalesce(qcol(c).cast("string"), F.lit("")).alias(c) for c in df.columns]


def preview(df: DataFrame, order_by: list[str], limit: int = 100) -> DataFrame:
    """First ``limit`` rows by an explicit key (Spark has no file order),
    missing as '', with the total row count on every row (TakeOrderedAndProject)."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    head = df.orderBy(*[qcol(c) for c in order_by]).limit(limit).select(*_as_text(df))
    return head.crossJoin(total)


def search_any_column(df: DataFrame, term: str) -> DataFrame:
    """Rows where any column contains ``term``, case-insensitively."""
    t = term.lower()
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | F.coalesce(F.lower(qcol(c).cast("string")).contains(t), F.lit(False))
    return df.where(cond)


def class_filter(df: DataFrame, target: str, churn_type: str) -> DataFrame:
    """Churn rows (yes/1/true/churn) or loyal rows (no/0/false/retained);
    lower-cased, not trimmed."""
    values = CHURN_CLASS_VALUES if churn_type == "churn" else LOYAL_CLASS_VALUES
    return df.where(F.lower(qcol(target).cast("string")).isin(*values))


def random_customer(df: DataFrame, target: str | None, churn_type: str | None, key: list[str],
                    seed: int = 42, n: int = 1) -> DataFrame:
    """``n`` seeded-random rows of the class, else of the whole table.

    Rank = md5(seed:key); class rows come first, so an empty class falls
    back to the table without a separate emptiness check. One global top-n.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[qcol(c).cast("string") for c in key]))
    if churn_type and target and target in df.columns:
        values = CHURN_CLASS_VALUES if churn_type == "churn" else LOYAL_CLASS_VALUES
        prio = F.when(F.lower(qcol(target).cast("string")).isin(*values), 0).otherwise(1)
    else:
        prio = F.lit(0)
    picked = df.withColumn("_prio", prio).withColumn("_h", h).orderBy("_prio", "_h").limit(n)
    out = picked.select(*_as_text(df))
    if target:
        out = out.withColumn("actual_target", qcol(target))
    return out


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """Drop the columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def distinct_rows(df: DataFrame, id_cols=()) -> DataFrame:
    """Drop exact duplicates over all columns, then the ID columns."""
    return drop_columns(df.dropDuplicates(), id_cols)
