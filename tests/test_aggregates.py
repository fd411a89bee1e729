import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregates as ag


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(0)
    return pd.DataFrame({"x": rng.integers(0, 5, 200), "g": rng.integers(0, 3, 200), "y": rng.normal(size=200)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("how", ["sum", "count", "mean", "min", "max", "var", "std"])
def test_reduce(df, pdf, how):
    assert math.isclose(ag.reduce(df, "y", how).first()[0], getattr(pdf["y"], how)(), rel_tol=1e-9)


@pytest.mark.parametrize("ddof", [0, 1, 2, 5])
def test_ddof(df, pdf, ddof):
    assert math.isclose(ag.reduce(df, "y", "var", ddof=ddof).first()[0], pdf["y"].var(ddof=ddof), rel_tol=1e-9)


@pytest.mark.parametrize("n, how, want", [(0, "count", 0), (0, "sum", None), (0, "mean", None), (1, "var", None), (2, "count", 2)])
def test_few_rows(spark, n, how, want):
    assert ag.reduce(spark.range(n).select(F.col("id").cast("double").alias("y")), "y", how).first()[0] == want


def test_skipna(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "y double")
    assert ag.reduce(df, "y", "sum").first()[0] == 1.0
    assert ag.reduce(df, "y", "sum", skipna=False).first()[0] is None


def test_frame_var(df, pdf):
    got = {r["column"]: r["var"] for r in ag.frame_var(df).collect()}
    assert all(math.isclose(got[c], pdf[c].var(), rel_tol=1e-9) for c in ("x", "g", "y"))
    row = ag.frame_var(df, axis=1).orderBy("y").toPandas()
    want = pdf.sort_values("y")[["x", "g", "y"]].var(axis=1)
    assert np.allclose(row["var"], want)
    with pytest.raises(ValueError):
        ag.frame_var(df, axis=2)


def test_unique_k(df, pdf):
    got = [r[0] for r in ag.unique_k(df, "x", 3).collect()]
    assert len(set(got)) == 3 and set(got) <= set(pdf["x"])


@pytest.mark.parametrize("how", ["sum", "mean", "count", "min", "max", "std", "var"])
@pytest.mark.parametrize("keys", ["x", ["x", "g"]])
def test_groupby(df, pdf, how, keys):
    got = getattr(ag.groupby(df, keys)["y"], how)().toPandas().sort_values(keys).reset_index(drop=True)
    want = getattr(pdf.groupby(keys)["y"], how)().reset_index().sort_values(keys).reset_index(drop=True)
    assert np.allclose(got["y"].astype(float), want["y"].astype(float), equal_nan=True)


def test_groupby_agg_and_nulls(spark, df, pdf):
    got = {r["x"]: r["y"] for r in ag.groupby(df, "x").agg({"y": "max"}).collect()}
    assert got == pdf.groupby("x")["y"].max().to_dict()
    assert set(ag.groupby(df, "x")["y"].agg(["sum", "max"]).columns) == {"x", "y_sum", "y_max"}
    nulls = spark.createDataFrame([(None, 1), (1, 2), (None, 3)], "k int, v int")
    assert {r["k"]: r["v"] for r in ag.groupby(nulls, "k").sum().collect()} == {None: 4, 1: 2}
    assert {r["k"]: r["v"] for r in ag.groupby(nulls, "k", dropna=True).sum().collect()} == {1: 2}


@pytest.mark.parametrize("every", [None, 2, 3, False])
def test_tree_reduction(df, pdf, every):
    total = ag.tree_reduction(df.select("y").repartition(11), lambda p: pd.DataFrame({"s": [p["y"].sum()]}), lambda p: p.sum().to_frame().T, "s double", split_every=every)
    assert math.isclose(total.first()["s"], pdf["y"].sum(), rel_tol=1e-9)


def test_tree_reduction_errors(df):
    for bad in (1, 0, True):
        with pytest.raises(ValueError):
            ag.tree_reduction(df, len, len, "s double", split_every=bad)
    with pytest.raises(ValueError):
        ag.tree_reduction(df, len, len, "s double", combine_kwargs={"a": 1})
