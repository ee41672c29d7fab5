"""CSV source typing / rejection and the sinks' round trips."""

import os

import pytest

from retainx.session import shared_dir
from retainx.sources.csv import read_customer_csv


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_typing_and_missing_tokens(spark):
    base = shared_dir(spark, "csvsrc")
    p = f"{base}/customers.csv"
    _write(p, "id,tenure,charges,plan,flag\n1,5,10.5,A,NA\n2,,n/a,B,x\n3,7,3e2,N/A,y\n")
    df = read_customer_csv(spark, p)
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "tenure": "double", "charges": "double", "plan": "string", "flag": "string"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows[2]["tenure"] is None and rows[2]["charges"] is None and rows[3]["charges"] == 300.0
    assert rows[3]["plan"] is None and rows[1]["flag"] is None


def test_csv_rejections(spark):
    base = shared_dir(spark, "csvbad")
    with pytest.raises(ValueError):
        read_customer_csv(spark, f"{base}/data.txt")
    p = f"{base}/empty.csv"
    _write(p, "a,b\n")
    with pytest.raises(ValueError):
        read_customer_csv(spark, p)
