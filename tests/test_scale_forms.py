"""Forms of the operators that hold at any size: split CSV files, blocked correlations, merged sketches, sparse crosstabs, cursors."""

import csv
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainx.functions import digests as DG
from retainx.functions.expr import python_float_text
from retainx.operators import features as FE, gram, history as H, profile as P, sketches as SKE, stats as D
from retainx.params import Params
from retainx.plans import ranking, views as V
from retainx.session import shared_dir
from retainx.sources.csv import read_customer_csv
from retainx.sources.csv_records import read_records
from retainx.sources.tables import read_table

from conftest import SF_SMALL
from test_plans import final_plan


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- CSV in splits ------------------------------------------------------------------------------

@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", 1)]
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, text):
    os.makedirs(path)
    for i, part in enumerate(text if isinstance(text, list) else [text]):
        with open(f"{path}/part-{i}.csv", "w", newline="") as f:
            f.write(part)
    return path


@pytest.mark.parametrize("size,end", [(13, "\n"), (64, "\r\n"), (900, "\n")])
def test_records_across_splits_are_whole(spark, tiny_splits, size, end):
    rng = np.random.default_rng(size)
    note = lambda: "".join(rng.choice(["a", '""', "\n", ",", " x ", "\n\n", "é"], rng.integers(0, 12)))
    body = [f'{i},"{note()}",{i * 3}' if i % 3 else f"{i},plain,7" for i in range(60)]
    long = '500,"' + "line\n" * 30 + '",9'                              # one record over many splits
    head = 'id,"no\nte",v' if end == "\n" else "id,note,v"
    texts = [end.join([head, *body[:40], long, "", *body[40:]]) + end, head + end + "7,second,1"]
    path = write(shared_dir(spark, "csv") + ".csv", texts)
    want = [r for t in texts for r in list(csv.reader(io.StringIO(t.replace("\r\n", "\n"), newline="")))[1:] if r]
    tiny_splits(size)
    if size < 100:
        assert spark.read.text(path).rdd.getNumPartitions() >= 8
    got = read_customer_csv(spark, path, multi_line=True)
    assert dict(got.dtypes) == {"id": "bigint", head[3:-2].strip('"'): "string", "v": "bigint"}
    assert rows(got.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in got.columns])) == sorted(map(tuple, want), key=str)
    if end == "\n":
        tiny_splits(1 << 27)
        reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
        assert reader.columns == got.columns and reader.count() == len(want)


def test_unclosed_quotes_and_empty_files_are_refused(spark, tiny_splits):
    tiny_splits(16)
    with pytest.raises(Exception, match="a quote is not closed"):
        read_records(spark, write(shared_dir(spark, "csv") + ".csv", 'a,b\n1,"x\ny\n2,z\n')).collect()
    with pytest.raises(ValueError, match="empty"):
        read_customer_csv(spark, write(shared_dir(spark, "csv") + ".csv", "a,b\n"), multi_line=True)
    with pytest.raises(Exception):
        read_customer_csv(spark, write(shared_dir(spark, "csv") + ".csv", "a,b\n1,2,3\n"), multi_line=True).collect()


def test_very_many_splits_are_joined(spark, tiny_splits, monkeypatch):
    monkeypatch.setattr("retainx.sources.csv_records.MOST_SHIPPED", 0)
    tiny_splits(9)
    path = write(shared_dir(spark, "csv") + ".csv", "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(40)))
    assert [(r.text) for r in read_records(spark, path).orderBy("start", "n").collect()] == ["a,b", *[f'{i},"x\n{i}"' for i in range(40)]]


# ---- statistics ---------------------------------------------------------------------------------

def test_blocked_correlations_equal_pandas(spark):
    rng = np.random.default_rng(2)
    n, p = 700, 24
    x = rng.standard_normal((n, p)) @ rng.standard_normal((p, p))
    x[:, 0] += 1e9                                                      # far from zero
    x[:, 1] = 0.1                                                       # constant
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 2] = np.nan                                                    # no rows
    x[5, 3] = np.inf
    x[: n // 2, 4], x[n // 2:, 4] = x[: n // 2, 4] * 1e-3, 5.0          # the tasks' means differ
    df = spark.createDataFrame([[i, *map(float, r)] for i, r in enumerate(x)], ["id", *[f"c{k}" for k in range(p)]]).repartition(6)
    got = np.zeros((p, p))
    for r in gram.pairwise_correlations(df.drop("id"), [f"c{k}" for k in range(p)]).collect():
        got[r.i, r.j] = r.value
    import pandas as pd
    clean = pd.DataFrame(x).replace(np.inf, np.nan)
    want = clean.corr().fillna(0.0).to_numpy()
    want[1, :] = want[:, 1] = 0.0
    meets = ~np.isnan(x[5])                                             # pairs that the infinite number is part of
    want[3, meets] = want[meets, 3] = 0.0
    assert np.abs(got - want).max() < 1e-6
    assert D.correlation_matrix(df.drop("id")).count() == p * p


def test_many_columns_are_read_once(spark):
    df = spark.range(2000).select(*[(F.rand(k) * k).alias(f"c{k}") for k in range(120)])
    path = shared_dir(spark, "wide")
    df.write.parquet(path)
    out = D.correlation_matrix(spark.read.parquet(path))
    assert final_plan(out).count("FileScan parquet") == 1 and out.count() == 120 * 120


def test_sketches_merge_in_any_order(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 20_000).alias("many"), (F.col("id") % 5).cast("string").alias("few"),
                                    F.when(F.col("id") % 2 == 0, F.lit(1.5)).alias("half"), F.lit(None).cast("string").alias("none"))
    path = shared_dir(spark, "sketches")
    for k in (2, 0, 1, 0):
        SKE.add_load(df.where(F.col("many") % 3 == k), path, f"l{k}")
    got = {r["column_name"]: r for r in SKE.merged_profile(SKE.read_profiles(spark, path)).collect()}
    assert {c: (r["total_rows"], r["missing_count"]) for c, r in got.items()} == \
        {"many": (30_000, 0), "few": (30_000, 0), "half": (30_000, 15_000), "none": (30_000, 30_000)}
    assert abs(got["many"]["unique_estimate"] - 20_000) < 600
    assert [got[c]["unique_estimate"] for c in ("few", "half", "none")] == [5, 1, 0]
    assert [r["ordinal"] for r in SKE.merged_profile(SKE.read_profiles(spark, path)).orderBy("ordinal").collect()] == [0, 1, 2, 3]
    more = SKE.load_profile(spark.range(10).select(F.col("id").alias("new")), "l9")
    both = {r["column_name"]: r for r in SKE.merged_profile(SKE.read_profiles(spark, path).unionByName(more)).collect()}
    assert both["new"]["missing_count"] == 30_000 and both["few"]["missing_count"] == 10


@pytest.mark.parametrize("accuracy,few", [(10_000, 200_000), (10_000, 5), (30, 5)])
def test_quantiles_of_many_values_shuffle_few(spark, accuracy, few, monkeypatch):
    monkeypatch.setattr(ranking, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(ranking, "FEW_VALUES", few)
    df = spark.range(120_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 9 == 0, F.lit(5.0)).otherwise(F.hash("id") / 7.0).alias("x"))
    local = df.toPandas()
    probs = [0.0, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "x", probs).collect()}
    assert got == {(g, p): pytest.approx(float(np.quantile(part["x"], p)), abs=0) for g, part in local.groupby("g") for p in probs}
    frame = ranking._brackets(df, ["g"], "x", probs, accuracy)
    kept = ranking._around(df, ["g"], "x", frame).count()
    assert kept < (120_000 if accuracy == 30 else 1000)


def test_quantiles_recover_from_a_bad_sketch(spark, monkeypatch):
    real = ranking._brackets
    monkeypatch.setattr(ranking, "_brackets", lambda *a: real(*a).withColumn("_low", F.transform("_low", lambda x: x * 0 + 1e6)).withColumn(
        "_high", F.transform("_high", lambda x: x * 0 + 1e6)))
    df = spark.range(999).select(F.col("id").cast("double").alias("x"))
    assert [r["quantile"] for r in ranking.exact_quantiles(df, [], "x", [0.5]).collect()] == [499.0]


def test_duplicates_are_compared_by_digest_first(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, None, "a"), (2, 2, None), (2, 2, None), (2, 2, None), (3, 0, "")], "a int, b int, c string")
    assert P.duplicate_rows(df).first()[0] == 3
    assert P.duplicate_rows(df.where("a = 3")).first()[0] == 0 == P.duplicate_rows(df.limit(0)).first()[0]
    floats = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert P.duplicate_rows(floats).first()[0] == 2
    monkeypatch.setattr(P, "MOST_SHIPPED", 0)                          # too many to ship: whole rows
    assert P.duplicate_rows(df).first()[0] == 3
    li = read_table(spark, SF_SMALL, "lineitem")
    seen, n = DG.repeated_digests(li)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_digest" in plan and "hashpartitioning(l_orderkey" not in plan
    seen.unpersist()


def test_row_keys_are_distinct(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("~null~", "x"), (None, "x"), ("null", "x"), ("4:null", "x")], "u string, v string")
    assert FE.with_row_key(df).select(FE.ROW_KEY).distinct().count() == 6


def test_sparse_crosstab_has_what_occurs(spark):
    df = spark.range(3000).select(F.concat(F.lit("id"), "id").alias("customer"), (F.col("id") % 300).cast("string").alias("t"),
                                  F.when(F.col("id") % 2 == 0, "even").alias("half"))
    cells = D.crosstab_cells(df, "t")
    assert cells.where("feature = 'customer'").count() == 3000 and cells.where("feature = 'half'").count() == 300
    assert cells.where("feature = 'half' AND category = 'nan'").agg(F.sum("count"), F.max("category_total"), F.max("class_total")).first()[:] == (1500, 1500, 10)
    with pytest.raises(ValueError, match="crosstab_cells"):
        D.category_by_target(df, "t")
    dense = D.category_by_target(df.drop("customer"), "t")
    assert dense.count() == 2 * 300 and rows(dense.where("count > 0")) == rows(cells.where("feature = 'half'").select(dense.columns))
    assert "CartesianProduct" not in final_plan(cells) and "BroadcastNestedLoop" not in final_plan(cells)


def test_split_ranks_only_rows_near_the_threshold(spark, monkeypatch):
    seen = []
    ranked = FE.prefix_sums
    monkeypatch.setattr(FE, "prefix_sums", lambda df, *rest: (seen.append(df.count()), ranked(df, *rest))[1])
    df = spark.range(80_000).select("id", F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("label"), (F.col("id") % 3000).alias("k"))
    for cols, stratify in ((["id"], True), (["k"], True), (["id"], False)):
        seen.clear()
        got = FE.train_test_split(df, stratify=stratify, key_cols=cols)
        hashed = df.withColumn("h", FE.row_hash(df, cols, 42)).toPandas()
        second = got.select("id", "is_test").toPandas().set_index("id")["is_test"]
        for label, n in ((1, 4000), (0, 12_000)) if stratify else ((None, 16_000),):
            own = hashed if label is None else hashed[hashed.label == label]
            low = own.sort_values("h").h.to_numpy()
            assert second[own.id].sum() == n
            assert set(own.id[own.h < low[n - 1]]) <= set(second[second].index) and not second[own.id[own.h > low[n - 1]]].any()
        assert seen[-1] < 40, seen


def test_bucketed_ranking_leaves_no_group_to_one_task(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"), F.lit(1).alias("w")).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as for tables beyond it
    try:
        plan = final_plan(ranking.prefix_sums(df, ["g"], "x", ["w"], buckets=50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2, plan


def test_crosstab_of_few_classes_is_whole(spark):
    df = spark.range(60_000).select(F.concat(F.lit("id"), "id").alias("customer"), F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("t"))
    grid = D.category_by_target(df, "t")                               # 120,000 cells: more than max_grid_cells
    assert grid.agg(F.count(F.lit(1)), F.sum("count"), F.count_if(F.col("count") == 0)).first()[:] == (120_000, 60_000, 60_000)
    assert "CartesianProduct" not in final_plan(grid)
    assert D.analysis_bundle(df, "t").where("part = 'crosstab'").count() == 120_000


def test_samples_come_without_a_shuffle_of_all_values(spark):
    df = spark.range(50_000).select((F.lit(1e7) + F.col("id") * 3.5).alias("up"), (-F.col("id")).alias("down"), F.lpad(F.hex("id"), 8, "0").alias("text"),
                                    F.when(F.col("id") > 49_990, F.col("id")).alias("late"), F.lit(None).cast("int").alias("none"),
                                    (F.col("id") % 2 == 0).alias("flag"), (F.col("id") % 3).cast("decimal(9,2)").alias("dec"))
    got = {}
    for r in P.sample_values(df).collect():
        got.setdefault(r["column_name"], []).append((r["sample_rank"], r["sample_value"]))
    got = {c: [v for _, v in sorted(x)] for c, x in got.items()}
    assert got == {"up": ["10000000.0", "10000003.5", "10000007.0", "10000010.5", "10000014.0"], "down": [str(-i) for i in range(49_999, 49_994, -1)],
                   "text": ["00000000", "00000001", "00000002", "00000003", "00000004"], "late": [str(i) for i in range(49_991, 49_996)],
                   "flag": ["False", "True"], "dec": ["0.00", "1.00", "2.00"]}
    path = shared_dir(spark, "sorted")
    df.select("up", "text").coalesce(1).write.parquet(path)
    plan = P.sample_values(spark.read.parquet(path))
    plan.collect()
    assert "<= 1.0000014E7" in plan._jdf.queryExecution().executedPlan().toString()


def test_numbers_read_as_python_prints_them(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1e7, 12345678.0, 1e-3, 1e-4, 0.00012345, 1.5e-5, 1e-5, -1e-5, 1e15, 123456789012345680.0, 1e16, 1.25e16, -1e22, 1.7e308, 5e-324, 0.1]
    values += [float(v) for v in rng.standard_normal(200) * 10.0 ** rng.integers(-12, 20, 200)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", python_float_text(F.col("x").cast("string")).alias("t"))
    wrong = [(r.x, r.t, repr(r.x)) for r in df.collect() if float(r.t) != r.x or ("e" in r.t) != ("e" in repr(r.x)) or len(r.t) < len(repr(r.x))]
    assert wrong == []
    plain = spark.createDataFrame([("0E-10",), ("abcE",), ("Infinity",)], "s string").select(python_float_text(F.col("s"))).collect()
    assert [r[0] for r in plain] == ["0E-10", "abcE", "Infinity"]


def test_cursor_pages_are_the_offset_pages(spark):
    log = V.predictions(spark, SF_SMALL).select("*").withColumn("created_at", F.when(F.col("id") % 7 != 0, F.col("created_at")))
    want = [r["id"] for r in H.history_query(log, 2, limit=100_000).collect()]
    got, after = [], None
    while True:
        page = H.history_page(log, 2, after, limit=53)
        ids = [r["id"] for r in page.collect()]
        if not ids:
            break
        got += ids
        after = H.cursor_after(page)
    assert got == want and len(want) > 200 and H.cursor_after(page) is None
    with pytest.raises(ValueError):
        H.history_page(log, 2, limit=0)
    path = shared_dir(spark, "log")
    V.predictions(spark, SF_SMALL).write.parquet(path)
    page = H.history_page(spark.read.parquet(path), 2, after=(want and log.where(f"id = {want[0]}").first()["created_at"], want[0]))
    page.collect()
    assert "created_at" in page._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("ReadSchema")[0]


def test_params_bound_the_grid():
    assert Params().max_grid_cells == 100_000
