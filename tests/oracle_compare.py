"""Run a registered Spark query and its DuckDB twin and compare the results
(row count, column names, order-insensitive values)."""

from __future__ import annotations

import math
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if not isinstance(x, (int, float)) else "n",
                  x if isinstance(x, (int, float)) else str(x)) for x in row)


def compare(spark_rows, spark_cols, duck_df: pd.DataFrame, exact: bool = False):
    """Return (ok, message)."""
    dcols = list(duck_df.columns)
    if sorted(spark_cols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(spark_cols)} duck={sorted(dcols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    srows = [tuple(_norm(r[i]) for i in si) for r in spark_rows]
    drows = [tuple(_norm(v) for v in rec) for rec in duck_df[order].itertuples(index=False, name=None)]
    if len(srows) != len(drows):
        return False, f"row count differs: spark={len(srows)} duck={len(drows)}"
    srows.sort(key=_key)
    drows.sort(key=_key)
    for a, b in zip(srows, drows):
        for c, x, y in zip(order, a, b):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if not exact and math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9):
                    continue
            return False, f"value differs in {c}: spark={x!r} duck={y!r}\n spark row={a}\n duck row={b}"
    return True, f"{len(srows)} rows match"


def run(names=None, sf_dir="/root/testdata/sf0.01", exact=False):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from retainx.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, oq = E.queries(), E.oracle_sql()
    results = {}
    for name in (names or list(qs)):
        if name not in oq:
            df = qs[name](spark, sf_dir)
            results[name] = (None, f"rows-only: {df.count()} rows")
            continue
        try:
            sdf = qs[name](spark, sf_dir)
            rows = sdf.collect()
            ddf = con.execute(oq[name]).df()
            results[name] = compare(rows, sdf.columns, ddf, exact)
        except Exception as e:  # report and continue
            results[name] = (False, f"error: {type(e).__name__}: {str(e)[:800]}")
    return results


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    res = run(args or None, exact="--exact" in sys.argv)
    bad = 0
    for k, (ok, msg) in res.items():
        flag = "OK  " if ok else ("ROWS" if ok is None else "FAIL")
        bad += ok is False
        print(f"{flag} {k}: {msg}")
    print(f"{len(res) - bad}/{len(res)} passed")
