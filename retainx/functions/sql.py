"""SQL-text builders for wide per-column expressions.

Operators that emit a few expressions per column (dozens to hundreds in
total) build them as SQL text: one ``F.expr`` per expression instead of a
JVM round trip per operator node, which keeps plan construction cheap on
wide tables. Semantics are identical to the Column helpers in ``expr``.
"""

from __future__ import annotations

from retainx.functions.expr import LINE_ENDS, NUMERIC_TEXT, WHITESPACE


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lit_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def py_round(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(bround(CAST({x} AS DOUBLE) * {scale!r}D, 0) / {scale!r}D)"


def strip_ws(x: str) -> str:
    """``expr.strip_ws`` as text."""
    quoted = lambda t: "'" + "".join(f"\\u{ord(a):04x}" for a in t) + "'"
    ends = ", ".join(quoted(a) for a in LINE_ENDS)
    return f"(CASE WHEN right({x}, 1) IN ({ends}) THEN regexp_replace({x}, '^\\\\s+|\\\\s+$', '') ELSE btrim({x}, {quoted(WHITESPACE)}) END)"


def numeric_text(x: str) -> str:
    pat = NUMERIC_TEXT.replace("\\", "\\\\")
    return f"coalesce({strip_ws(x)} RLIKE '{pat}', false)"


def clean_double(name: str) -> str:
    """A numeric column as double with NaN turned into null."""
    x = f"CAST({ident(name)} AS DOUBLE)"
    return f"(CASE WHEN NOT isnan({x}) THEN {x} END)"
