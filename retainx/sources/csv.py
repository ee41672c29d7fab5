"""CSV source (S01): headered text, pandas-like missing tokens and typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from retainx.functions.columns import qcol
from retainx.functions.expr import strip_ws
from retainx.params import CSV_NA_TOKENS
from retainx.sources.csv_records import read_records

INT_TEXT = r"^[+-]?[0-9]+$"
NUM_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


BOOL_TEXT = r"^(?i)(true|false)$"


def _multi_line(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of headered files with line breaks within quotes: records are found split by split, then parsed one by one."""
    quotes = {"quote": '"', "escape": '"'}
    names = spark.read.options(header=True, multiLine=True, **quotes).csv(path).columns           # reads the first record only
    body = read_records(spark, path).where((F.col("start") != 0) | (F.col("n") != 0))
    parsed = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"mode": "FAILFAST", **quotes})
    return body.select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def read_customer_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read a headered CSV like ``pd.read_csv``: every column as text, the
    default missing tokens as null, then a column becomes bigint when all
    its values are integers, double when all are numbers (missing allowed;
    an integer column with missing values becomes double, as in pandas),
    boolean when all are true / false. Integers beyond 64 bits (account
    numbers) stay text, digit by digit.

    Quotes within a quoted field are doubled. ``multi_line`` also allows line
    breaks within quotes; files are read in splits all the same (``csv_records``).

    The typing decision is one aggregate over the file (two counts per
    column); rejects non-CSV paths, unparsable input (FAILFAST) and empty files.
    """
    if not str(path).lower().rstrip("/").endswith(".csv") and "*" not in str(path):
        raise ValueError("Only CSV files (.csv) are accepted.")
    raw = _multi_line(spark, path) if multi_line else (
        spark.read.option("header", True).option("mode", "FAILFAST").option("inferSchema", False)
        .option("quote", '"').option("escape", '"').csv(path))
    na = list(CSV_NA_TOKENS)
    text = raw.select(*[F.when(qcol(c).isin(na) | qcol(c).isNull(), F.lit(None)).otherwise(qcol(c)).alias(c)
                        for c in raw.columns])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(text.columns):
        v = strip_ws(qcol(c))
        whole = v.rlike(INT_TEXT)
        aggs += [F.count(qcol(c)).alias(f"n{i}"), F.count_if(whole).alias(f"i{i}"), F.count_if(v.rlike(NUM_TEXT)).alias(f"d{i}"),
                 F.count_if(whole & v.try_cast("bigint").isNull()).alias(f"w{i}"), F.count_if(v.rlike(BOOL_TEXT)).alias(f"b{i}")]
    stats = text.agg(*aggs).first()
    if not stats or stats["_rows"] == 0:
        raise ValueError("CSV file is empty.")
    cols = []
    for i, c in enumerate(text.columns):
        n, ni, nd = stats[f"n{i}"], stats[f"i{i}"] or 0, stats[f"d{i}"] or 0
        if stats[f"w{i}"]:
            cols.append(qcol(c))
        elif n > 0 and ni == n and n == stats["_rows"]:
            cols.append(strip_ws(qcol(c)).cast("bigint").alias(c))
        elif n > 0 and stats[f"b{i}"] == n == stats["_rows"]:
            cols.append(strip_ws(qcol(c)).cast("boolean").alias(c))
        elif n > 0 and nd == n:
            cols.append(strip_ws(qcol(c)).cast("double").alias(c))
        else:
            cols.append(qcol(c))
    return text.select(*cols)
