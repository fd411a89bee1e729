import itertools

import pandas as pd
import pytest

from quarry.operators.frame import IndexedFrame
from quarry.operators.joins import broadcast_if_small, index_join, merge, size_estimate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (None, 5.0)], "x int, y double")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, 1), (3, 2), (None, 3), (2, 4)], "x int, w int")


def expected(how, null_safe):
    a = [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (None, 5.0)]
    b = [(2, 1), (3, 2), (None, 3), (2, 4)]
    same = lambda p, q: (p == q) and (null_safe or p is not None)
    out = [(p[0], p[1], q[1]) for p, q in itertools.product(a, b) if same(p[0], q[0])]
    if how in ("left", "outer"):
        out += [(p[0], p[1], None) for p in a if not any(same(p[0], q[0]) for q in b)]
    if how in ("right", "outer"):
        out += [(q[0], None, q[1]) for q in b if not any(same(p[0], q[0]) for p in a)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_merge(left, right, how, null_safe):
    assert rows(merge(left, right, on="x", how=how, null_safe=null_safe)) == expected(how, null_safe)


def test_defaults_and_errors(spark, left, right):
    assert rows(merge(left, right)) == expected("left", False)  # natural, left
    assert merge(left, right, on=("x",)).columns == ["x", "y", "w"]
    with pytest.raises(ValueError):
        merge(left.select("y"), right)
    with pytest.raises(ValueError):
        merge(left, right, how="sideways")
    with pytest.raises(KeyError):
        merge(left, right, on="y")
    with pytest.raises(ValueError):
        merge(left, left, on="x", suffixes=("", ""))
    with pytest.raises(ValueError):
        merge(left, right, left_index=True)


def test_suffixes_of_collisions_only(left, right):
    both = merge(left.withColumnRenamed("y", "v"), right.withColumnRenamed("w", "v"), on="x")
    assert both.columns == ["x", "v_x", "v_y"]
    assert merge(left, left, on="x", suffixes=("", "_r")).columns == ["x", "y", "y_r"]


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_index_join_against_pandas(spark, how):
    a = pd.DataFrame({"k": [3, 1, 1, 7], "a": [1, 2, 3, 4]})
    b = pd.DataFrame({"k": [1, 3, 5], "b": [10, 20, 30]})
    got = index_join(IndexedFrame(spark.createDataFrame(a), "k"), IndexedFrame(spark.createDataFrame(b), "k"), how=how)
    want = a.set_index("k").join(b.set_index("k"), how=how).sort_index()
    found = [tuple(None if pd.isna(v) else v for v in r) for r in got.compute().reset_index().itertuples(index=False)]
    assert sorted(found, key=repr) == sorted((tuple(None if pd.isna(v) else v for v in r) for r in want.reset_index().itertuples(index=False)), key=repr)
    assert got.df.columns == ["k", "a", "b"] and [r[0] for r in found] == sorted(r[0] for r in found)


def test_index_join_errors(spark, left, right):
    a, b = IndexedFrame(left, "x"), IndexedFrame(left, "x")
    with pytest.raises(ValueError):
        index_join(a, b)
    with pytest.raises(ValueError):
        index_join(a, IndexedFrame(right, "x"), how="cross")


def test_broadcast_is_behind_a_size_check(spark, left):
    big = spark.range(10)
    assert size_estimate(big) < 10_000 < size_estimate(left)  # of unknown size: as large as can be
    assert "ResolvedHint" in broadcast_if_small(big)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(big, most=1)._jdf.queryExecution().analyzed().toString()
