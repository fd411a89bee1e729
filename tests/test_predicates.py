import pytest
from pyspark.sql import functions as F

from quarry.operators.frame import IndexedFrame
from quarry.operators.predicates import query


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, k % 3, None if k == 4 else float(k)) for k in range(10)], "x long, y long, z double")


def xs(df):
    return sorted(r["x"] for r in df.collect())


@pytest.mark.parametrize(
    "text, keep",
    [
        ("x > 2", lambda x: x > 2),
        ("x > 2 & y == 1", lambda x: x > 2 and x % 3 == 1),
        ("x < 2 | ~(y == 1)", lambda x: x < 2 or x % 3 != 1),
        ("1 < x <= 5", lambda x: 1 < x <= 5),
        ("x % 3 == y and x ** 2 > 10", lambda x: x * x > 10),
        ("x in [1, 2, 8] or x - 1 == 4", lambda x: x in (1, 2, 8, 5)),
        ("not x in [1, 2]", lambda x: x not in (1, 2)),
        ("x // 2 == 2", lambda x: x // 2 == 2),
        ("-x < -7", lambda x: x > 7),
        ("z >= 0", lambda x: x != 4),
    ],
)
def test_query(frame, text, keep):
    assert xs(query(frame, text)) == [x for x in range(10) if keep(x)]


def test_query_values(frame):
    assert xs(query(frame, "x > @low and y in @ys", {"low": 3, "ys": [0, 1]})) == [4, 6, 7, 9]
    with pytest.raises(NameError):
        query(frame, "x > @low")
    with pytest.raises(ValueError):
        query(frame, "__import__('os').getcwd() == 'x'")


def test_values_are_bound_not_pasted(spark):
    df = spark.createDataFrame([("a' OR 1=1 --",), ("b",)], "s string")
    assert query(df, "s == @v", {"v": "a' OR 1=1 --"}).count() == 1


def test_loc_head_repr(frame):
    f = IndexedFrame(frame, "x")
    assert xs(f.loc(3, 6).df) == [3, 4, 5, 6]
    assert f.loc(3, 6, ["y"]).df.columns == ["x", "y"]
    assert [r["x"] for r in f.head(3).collect()] == [0, 1, 2]
    assert "IndexedFrame" in repr(f) and "&lt;" in f._repr_html_()
    assert len(f) == 10 and f.columns == ["y", "z"]
    with pytest.raises(KeyError):
        IndexedFrame(frame, "nothing")


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("y", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    plan = query(spark.read.parquet(str(tmp_path / "t")), "y > 10").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(y,10)" in plan
