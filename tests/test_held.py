import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregates as ag, extensions as ex, ordering as od
from quarry.operators.frame import IndexedFrame
from quarry.operators.held import free
from quarry.operators.joins import merge
from quarry.operators.predicates import query
from quarry.sources import files, memory


def test_names_that_clash(spark):
    df = spark.createDataFrame([(7, 70, 700), (8, 80, 800)], "_part long, _row long, _shift long")
    assert [tuple(r) for r in od.with_positions(df, "_part").orderBy("index").collect()] == [(0, 7, 70, 700), (1, 8, 80, 800)]
    assert sorted(tuple(r) for p in memory.to_parts(df) for r in p.collect()) == [(7, 70, 700), (8, 80, 800)]
    assert free(df, "_part") == "_part_1" and free(df, "x") == "x"


def test_parts_run_the_plan_once(spark):
    noted = spark.sparkContext.accumulator(0)

    def note(batches):
        for pdf in batches:
            noted.add(len(pdf))
            yield pdf

    parts = memory.to_parts(spark.range(30).repartition(3).mapInPandas(note, "id long"))
    assert len(parts) == 3 and sum(p.count() for p in parts) == 30 and noted.value == 30


def test_reduction_by_partition_and_of_nothing(spark):
    count = lambda p: pd.DataFrame({"n": [len(p)], "parts": [1]})
    total = lambda p: p.sum().to_frame().T.astype("int64")
    assert tuple(ag.tree_reduction(spark.range(25_000).repartition(2), count, total, "n long, parts long").first()) == (25_000, 2)  # not by Arrow batch
    assert ag.tree_reduction(spark.range(0), count, total, "n long, parts long").first()["n"] == 0


def test_ordered_parquet_of_folders(spark, tmp_path):
    for folder in ("b", "a"):
        for k in range(12):
            spark.createDataFrame([(folder, k)], "f string, k long").coalesce(1).write.parquet(str(tmp_path / folder / f"part.{k}.parquet"))
    got = files.read_parquet(spark, [str(tmp_path / "b" / "*"), str(tmp_path / "a" / "*")], ordered=True).collect()
    assert [tuple(r) for r in got] == [(f, k) for f in "ab" for k in range(12)]


def test_json_types_of_all_files_and_sparse_columns(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"a":{"1":1},"b":{"1":2,"2":3}}')
    (tmp_path / "2.json").write_text('{"a":{"3":1.5},"c":{"4":"x"}}')
    got = files.read_json(spark, str(tmp_path / "*.json"), orient="columns", label="i")
    assert dict(got.dtypes) == {"i": "string", "a": "double", "b": "bigint", "c": "string"}
    assert sorted(map(tuple, got.collect())) == [("1", 1.0, 2, None), ("2", None, 3, None), ("3", 1.5, None, None), ("4", None, None, "x")]


def test_csv_splits_without_a_shuffle(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("x,y\n" + "".join(f"{i},{i}\n" for i in range(100)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = files.read_csv(spark, str(tmp_path / "*.csv"), chunksize="100 B")
    assert df.rdd.getNumPartitions() == 12 and df.count() == 200 and df.sparkSession is spark
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert files.read_csv(spark, str(tmp_path / "*.csv"), chunksize=None).rdd.getNumPartitions() == 2
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_local_frames(spark):
    mixed = memory.from_pandas(spark, pd.DataFrame({"a": [1, 2.5, None], "b": [None] * 2 + ["x"]}, dtype=object))
    assert dict(mixed.dtypes) == {"a": "double", "b": "string"}


def test_nan_in_predicates(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "i int, v double")
    keys = lambda text, **given: [r["i"] for r in query(df, text, given).collect()]
    assert keys("v > 2") == [2] and keys("v == v") == [2] and keys("v != v") == [1] and keys("not v > 2") == [1]
    assert keys("i in [-1, 2]") == [2] and keys("i in [@a, -3]", a=3) == [3] and keys("i not in (2,)") == [1, 3]
    df.write.parquet(str(tmp_path / "p"))
    plan = query(spark.read.parquet(str(tmp_path / "p")), "i > 1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(i,1)" in plan  # plain comparisons still reach the scan


def test_frame_operators(spark):
    a = IndexedFrame(spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, "y")], "k int, v double, s string"), "k")
    b = IndexedFrame(spark.createDataFrame([(2, 10.0), (3, 20.0)], "i int, v double"), "i")
    values = lambda f: sorted(map(tuple, f.df.collect()))
    assert values(a + 1) == [(1, 3.0), (2, 4.0)] and values(a / 0) == [(1, np.inf), (2, np.inf)] and values(a > 2) == [(1, False), (2, True)]
    assert values(a * b) == [(1, None), (2, 30.0), (3, None)]
    assert "partitions" in repr(a) and a.name() == a.with_df(a.df).name() != b.name()


def test_index_with_a_column(spark):
    names = IndexedFrame(spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string"), "id")
    rows = spark.createDataFrame([(10, 1), (11, 1), (12, 5)], "x int, k int")
    assert sorted(map(tuple, merge(rows, names, on="k", how="left", right_index=True).select("x", "k", "n").collect())) == [(10, 1, "a"), (11, 1, "a"), (12, 5, None)]
    with pytest.raises(ValueError):
        merge(rows, names, right_index=True)


def test_idxmax_of_text_labels(spark):
    df = spark.createDataFrame([("b", 3.0), ("a", 3.0), ("c", float("nan"))], "k string, v double")
    assert ex.idxmax(df, "v", "k").first()[0] == "a"
    assert [tuple(r) for r in ex.size(df.withColumn("g", F.lit(1)), "g").collect()] == [(1, 3)]
