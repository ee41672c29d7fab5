"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# A number as pandas' ``to_numeric`` accepts it (after stripping). ``nan`` and
# ``inf`` are rejected on purpose: pandas counts NaN as missing, and Spark's
# ``cast`` would otherwise accept trailing type letters such as ``12d``.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# What ``\s`` stands for, and the line terminators that are not among it.
WHITESPACE = " \t\n\x0b\f\r"
LINE_ENDS = ("\u0085", "\u2028", "\u2029")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def py_round(c: Column | str, digits: int) -> Column:
    """Round like Python's ``round(x, digits)`` on doubles.

    Half-even on the scaled binary value: ``round(2.675, 2) == 2.67`` and
    ``round(0.125, 2) == 0.12`` as in Python, where Spark's ``round`` would
    give 2.68 and 0.13. DuckDB's ``round_even(x * 10^d, 0) / 10^d`` is the
    same arithmetic, so oracle results agree bit for bit.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.bround(c.cast("double") * F.lit(scale), 0) / F.lit(scale)


def strip_ws(c: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing whitespace, not just spaces.

    The same as replacing ``^\\s+|\\s+$``, whose ``$`` also stands before a last line
    terminator; a pattern is only searched in texts that end in one that ``\\s`` lacks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.right(c, F.lit(1)).isin(*LINE_ENDS), F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def numeric_text(c: Column | str) -> Column:
    """True when the stripped text is a plain decimal / exponent number."""
    return F.coalesce(strip_ws(c).rlike(NUMERIC_TEXT), F.lit(False))


def guarded_double(c: Column | str) -> Column:
    """``pd.to_numeric(s.str.strip(), errors='coerce')`` as a Spark column."""
    s = strip_ws(c)
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def as_double(df, name: str) -> Column:
    """``guarded_double`` of a column's text; a whole number or double is taken as it is (the same value, no text made)."""
    c, dt = F.col("`" + name.replace("`", "``") + "`"), df.schema[name].dataType
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("double")
    if isinstance(dt, T.DoubleType):
        return F.when(F.abs(c) < F.lit(float("inf")), c)           # neither NaN nor infinite, as text of these is no number
    return guarded_double(c.cast("string"))


def clean_name(c: Column | str) -> Column:
    """Column name normalised for pattern matching: strip, lower, drop ``_``/``-``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(strip_ws(c)), "[_-]", "")


def is_numeric_type(dt: T.DataType, include_bool: bool = False) -> bool:
    if include_bool and isinstance(dt, T.BooleanType):
        return True
    return isinstance(dt, NUMERIC_TYPES)


def pandas_dtype(dt: T.DataType) -> str:
    """The dtype name pandas would report for a column of this Spark type."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def python_float_text(text: Column) -> Column:
    """The text of a floating-point number as Python prints it, from the engine's own.

    Both print the shortest digits; the engine puts an exponent on numbers from
    1e7 on and below 1e-3, Python from 1e16 on and below 1e-4, as ``1e+16``, ``1.5e-05``.
    """
    part = lambda i: F.regexp_extract(text, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", i)
    sign, power = part(1), part(4).try_cast("int")
    digits = F.concat(part(2), F.when(part(3) == "0", "").otherwise(part(3)))
    whole = F.when(power >= 0, F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"))
    rest = F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise("0")
    plain = F.when(power >= 0, F.concat(sign, whole, F.lit("."), rest)) \
        .otherwise(F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))) \
        .otherwise(digits)
    power_text = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    scientific = F.concat(sign, mantissa, F.lit("e"), power_text)
    return F.when(part(2) == "", text).when((power >= -4) & (power < 16), plain).otherwise(scientific)      # no exponent: as it is


def pandas_str(c: Column | str, dt: T.DataType | None = None) -> Column:
    """``str(value)`` as Python prints it; null becomes the text ``nan``."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dt, T.BooleanType):
        s = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        s = python_float_text(c.cast("string"))
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit("nan"))


def churn_label(pct: Column | str) -> Column:
    """Label from the (already rounded) churn percentage."""
    pct = F.col(pct) if isinstance(pct, str) else pct
    return F.when(pct >= 50.0, F.lit("Churn")).otherwise(F.lit("No Churn"))


def risk_tier(pct: Column | str) -> Column:
    """< 35 Low, < 65 Medium, else High (65 itself is High)."""
    pct = F.col(pct) if isinstance(pct, str) else pct
    return (F.when(pct < 35.0, F.lit("Low Risk"))
            .when(pct < 65.0, F.lit("Medium Risk"))
            .otherwise(F.lit("High Risk")))


def display_class(name: Column | str) -> Column:
    """Dashboard wording of a target class."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.lower(name).isin("1", "yes"), F.lit("Churned")).otherwise(F.lit("Retained"))
