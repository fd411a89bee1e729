import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.accessors import with_categories
from quarry.operators import extensions as ex, ordering as od
from quarry.operators.frame import IndexedFrame


@pytest.mark.parametrize("n", [0, 1, 10, 333])
@pytest.mark.parametrize("parts", [1, 5])
def test_positions(spark, n, parts):
    rng = np.random.default_rng(n)
    df = spark.createDataFrame([(int(x),) for x in rng.permutation(n)], "x long").repartition(parts)
    got = od.with_positions(df, "x").orderBy("index").collect()
    assert [(r["index"], r["x"]) for r in got] == [(k, k) for k in range(n)]


def test_positions_need_an_order(spark):
    with pytest.raises(ValueError):
        od.with_positions(spark.range(3), [])


def test_sort_and_bins(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(1, 5, 100)] + [(None,)], "a int").repartition(5)
    assert [r["a"] for r in od.sort_values(df, "a").collect()][-1] is None
    assert [r["a"] for r in od.sort_values(df, "a", ascending=False).collect()][0] == 4
    bins = od.sort_values_binned(df, "a", 3).withColumn("p", F.spark_partition_id()).groupBy("a").agg(F.countDistinct("p").alias("n")).collect()
    assert len(bins) == 5 and {r["n"] for r in bins} == {1}
    top = od.nlargest(df, 2, "a")
    assert [r["a"] for r in top.collect()] == [4, 4]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_set_and_reset_index(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    frame = od.set_index(df, "k")
    assert frame.index == ("k",) and [r["v"] for r in frame.ordered().collect()] == ["a", "b", "c"]
    assert [tuple(r) for r in od.reset_index(frame).orderBy("index").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert od.reset_index(frame, drop=False).columns == ["index", "k", "v"]
    made = od.set_index(df, F.col("k") % 2, name="odd")
    assert made.index == ("odd",) and made.columns == ["k", "v"]
    assert od.set_index(df, "k", sorted=True).df is df
    with pytest.raises(NotImplementedError):
        od.set_index(df, "k", drop=False)
    with pytest.raises(TypeError):
        od.set_index(df, 3)
    with pytest.raises(KeyError):
        od.set_index(df, "nothing")


@pytest.mark.parametrize("before, after", [(1, 3), (5, 1), (2, 7)])
def test_repartition(spark, before, after):
    assert od.repartition(spark.range(99).repartition(before), after).rdd.getNumPartitions() == after


def test_repartition_leaves_no_partition_without_rows(spark, tmp_path):
    path = str(tmp_path / "one_row_group.parquet")
    spark.range(300_000, numPartitions=1).write.parquet(path)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 7 and df.select(F.spark_partition_id()).distinct().count() == 1
        sizes = [r["n"] for r in od.partition_sizes(od.repartition(df, 7)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert sum(sizes) == 300_000 and len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_concat(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted((tuple(r) for r in od.concat([a, b, a]).collect()), key=repr) == [(1, 2), (1, 2), (3, None)]
    s = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        od.concat([with_categories(s, "s", ["a"]), with_categories(s, "s", ["a", "b"])])
    for bad in ({"axis": 1}, {"join": "inner"}):
        with pytest.raises(NotImplementedError):
            od.concat([a], **bad)


def test_apply_rows_and_map_partitions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")

    def kernel(a, b, total, flag, scale):
        for k, (x, y) in enumerate(zip(a, b)):
            total[k] = (x + y) * scale
            flag[k] = x > 2

    got = od.apply_rows(df, kernel, ["a", "b"], {"total": "f8", "flag": "bool"}, {"scale": 10}, cache_key="any")
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1.0, 2.0, 30.0, False), (3.0, 4.0, 70.0, True)]
    doubled = od.map_partitions(df, lambda p, n: pd.DataFrame({"a": p["a"] * n}), "a double", n=2)
    assert sorted(r["a"] for r in doubled.collect()) == [2.0, 6.0]


def test_extensions(spark):
    df = spark.createDataFrame([(1, "g", 1.0), (2, "g", 3.0), (3, "h", None)], "k int, g string, v double")
    assert [r["g"] for r in ex.value_counts(df, "g").filter("count = 2").collect()] == ["g"]
    assert ex.nunique(df, "g").first()[0] == 2
    assert ex.idxmax(df, "v", "k").first()[0] == 2
    assert [r[0] for r in df.select(ex.clip("v", 2.0, 9.0)).collect()] == [2.0, 3.0, None]
    assert [r[0] for r in df.orderBy("k").select(ex.running("cumsum", "v", "k", "g")).collect()] == [1.0, 4.0, None]
    assert [r["k"] for r in ex.tail(IndexedFrame(df, "k"), 2).collect()] == [3, 2]
