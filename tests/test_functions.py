import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import arithmetic as ar
from quarry.functions.accessors import cat, dt, with_categories

PAIRS = [(7.0, 2.0), (-7.0, 2.0), (7.0, -2.0), (0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (math.nan, 1.0), (math.nan, 0.0), (math.inf, 2.0), (5.0, 5.0), (1e300, 1e-10)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PAIRS)], "k int, a double, b double")


@pytest.mark.parametrize("name, op", [("add", np.add), ("sub", np.subtract), ("mul", np.multiply), ("truediv", np.divide), ("floordiv", lambda a, b: np.floor(a / b)), ("eq", np.equal), ("ne", np.not_equal), ("lt", np.less), ("le", np.less_equal), ("gt", np.greater), ("ge", np.greater_equal)])
def test_binary(pairs, name, op):
    got = [r[0] for r in pairs.select("k", getattr(ar, name)("a", "b").alias("v")).orderBy("k").select("v").collect()]
    with np.errstate(all="ignore"):
        want = op(np.array([a for a, _ in PAIRS]), np.array([b for _, b in PAIRS]))
    assert np.array_equal(np.array(got, dtype=want.dtype), want, equal_nan=want.dtype.kind == "f")


def test_null_operands(spark):
    df = spark.createDataFrame([(None, 0.0), (1.0, None)], "a double, b double")
    for name in ("add", "truediv", "floordiv", "eq", "lt"):
        assert [r[0] for r in df.select(getattr(ar, name)("a", "b")).collect()] == [None, None]


def test_integers(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (-7, -2), (2**62 + 1, 1), (6, 3), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(ar.int_floordiv("a", "b")).collect()] == [3, -4, -4, 3, 2**62 + 1, 2, None]
    assert [r[0] for r in df.limit(4).select(ar.mod("a", "b")).collect()] == [1, 1, -1, -1]
    assert [r[0] for r in df.limit(1).select(ar.power("a", 2)).collect()] == [49.0]


def test_map_scalar_and_row_var(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "a int, b double")
    assert [tuple(r) for r in ar.map_scalar(df, ar.add, 1).collect()] == [(2, 3.0), (4, None)]
    assert [r[0] for r in df.select(ar.row_var(["a", "b"])).collect()] == [0.5, None]


@pytest.mark.parametrize("field", ["year", "month", "day", "hour", "minute", "second"])
def test_dt(spark, field):
    times = pd.date_range("2001-01-01 03:04:05", "2002-02-15", freq="400h")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in times], "value timestamp_ntz")
    assert [r[0] for r in df.select(getattr(dt(df, "value"), field)).collect()] == list(getattr(times, field))


def test_dt_errors(spark):
    df = spark.createDataFrame([(1.0, datetime(2001, 1, 1))], "value double, t timestamp_ntz")
    with pytest.raises(AttributeError, match="Can only use .dt accessor with datetimelike values"):
        dt(df, "value")
    with pytest.raises(AttributeError):
        dt(df, "t").fortnight
    assert "year" in dir(dt(df, "t"))


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame(list(zip("aabca", "abacb")) + [("z", None)], "u string, v string")


def test_categories(letters):
    df = with_categories(with_categories(letters, "u", ["c", "b", "a"], ordered=True), "v", ["c", "b", "a"], ordered=True)
    u, v = cat(df, "u"), cat(df, "v")
    assert u.ordered and u.categories == ["c", "b", "a"]
    rank = {"c": 0, "b": 1, "a": 2}
    rows = df.select("u", "v", u.codes.alias("code"), u.lt(v).alias("lt"), u.gt("b").alias("gt"), u.eq(v).alias("eq"), u.ne("a").alias("ne")).collect()
    for r in rows[:5]:
        assert (r["code"], r["lt"], r["gt"], r["eq"], r["ne"]) == (rank[r["u"]], rank[r["u"]] < rank[r["v"]], rank[r["u"]] > 1, r["u"] == r["v"], r["u"] != "a")
    assert (rows[5]["u"], rows[5]["code"], rows[5]["lt"]) == (None, -1, None)


def test_category_errors(letters):
    df = with_categories(letters, "u", ["a", "b", "c"])
    assert not cat(df, "u").ordered
    with pytest.raises(AttributeError):
        cat(df, "v")
    with pytest.raises(TypeError):
        cat(df, "u").lt("b")
    with pytest.raises(TypeError):
        cat(df, "u").eq("q")
    with pytest.raises(ValueError):
        with_categories(letters, "u", ["a", "a"])


def test_metadata_survives(letters):
    df = with_categories(letters, "u", ["a", "b", "c"]).filter(F.col("u") == "a").orderBy("v")
    assert cat(df, "u").categories == ["a", "b", "c"]
