"""Schema-level helpers: quoting odd column names and the column catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from retainx.functions.expr import is_numeric_type, pandas_dtype, python_float_text


def qcol(name: str) -> Column:
    """Column reference safe for names with dots, spaces, ``%`` or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def catalog(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row per column of ``df``: ordinal, name, pandas dtype, type flags.

    Built from the schema on the driver; its size is the column count.
    """
    rows = []
    for i, f in enumerate(df.schema.fields):
        rows.append((i, f.name, pandas_dtype(f.dataType),
                     is_numeric_type(f.dataType, include_bool=True),
                     isinstance(f.dataType, T.StringType),
                     isinstance(f.dataType, (T.FloatType, T.DoubleType))))
    schema = T.StructType([
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("dtype", T.StringType(), False),
        T.StructField("numeric_dtype", T.BooleanType(), False),
        T.StructField("is_string", T.BooleanType(), False),
        T.StructField("is_float", T.BooleanType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def is_missing(df: DataFrame, name: str) -> Column:
    """pandas ``isna``: null, or NaN in a float column."""
    c = qcol(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def long_values(df: DataFrame) -> DataFrame:
    """Unpivot every column to (ordinal, s, i, d) without missing cells.

    Integral columns fill ``i``, double columns ``d``, decimals and floats
    ``s`` and ``d``, and everything else the text slot ``s`` (booleans as ``True``/``False``). Values are grouped on
    these native slots; text for numbers is produced only for the distinct
    values that survive (see ``value_text``). ``unpivot`` plans an Expand
    feeding the next partial aggregate, so rows are never materialised k times.
    """
    from retainx.functions import sql as SQ
    fields = df.schema.fields
    cols = []
    for i, f in enumerate(fields):
        c = SQ.ident(f.name)
        dt = f.dataType
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            slots = ("CAST(NULL AS STRING)", f"CAST({c} AS BIGINT)", "CAST(NULL AS DOUBLE)")
        elif isinstance(dt, T.DoubleType):
            slots = ("CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)", c)
        elif isinstance(dt, (T.FloatType, T.DecimalType)):
            slots = (f"CAST({c} AS STRING)", "CAST(NULL AS BIGINT)", f"CAST({c} AS DOUBLE)")      # text to show, number to sort by
        elif isinstance(dt, T.BooleanType):
            slots = (f"CASE WHEN {c} THEN 'True' ELSE 'False' END", "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)")
        else:
            slots = (f"CAST({c} AS STRING)", "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)")
        miss = f"({c} IS NULL OR isnan({c}))" if isinstance(dt, (T.FloatType, T.DoubleType)) else f"({c} IS NULL)"
        sv, iv, dv = slots
        cols.append(F.expr(f"CASE WHEN NOT {miss} THEN named_struct('s', {sv}, 'i', {iv}, 'd', {dv}) END AS `{i}`"))
    wide = df.select(*cols)
    long = wide.unpivot([], [str(i) for i in range(len(fields))], "ordinal", "v")
    return (long.where(F.col("v").isNotNull())
            .select(F.col("ordinal").cast("int").alias("ordinal"), F.col("v.s").alias("s"),
                    F.col("v.i").alias("i"), F.col("v.d").alias("d")))


def value_text(df: DataFrame) -> DataFrame:
    """Add ``value`` (text as Python prints it) and ``num`` (numeric sort key)
    to a frame with the (s, i, d) slots of ``long_values``."""
    floating = python_float_text(F.coalesce("s", F.col("d").cast("string")))      # floats have text and number, decimals no exponent
    return (df.withColumn("value", F.when(F.col("s").isNotNull() & F.col("d").isNull(), F.col("s")).otherwise(
                F.coalesce(F.col("i").cast("string"), floating)))
            .withColumn("num", F.coalesce(F.col("i").cast("double"), F.col("d"))))
