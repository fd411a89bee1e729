import gzip
import json
import warnings
from pathlib import Path

import pandas as pd
import pytest

from quarry.functions.accessors import cat
from quarry.sources import files, memory


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def csv50(tmp_path):
    path = tmp_path / "data-0.csv"
    path.write_text("x,y\n" + "".join(f"{k},{k}\n" for k in range(20)))
    assert path.stat().st_size == 104
    return path


def test_csv(spark, csv50, tmp_path):
    (tmp_path / "data-1.csv").write_text("x,y\n100,101\n")
    want = [(k, k) for k in range(20)] + [(100, 101)]
    assert rows(files.read_csv(spark, str(tmp_path / "data-*.csv"))) == want
    assert rows(files.read_csv(spark, csv50)) == want[:-1]  # a Path
    assert rows(files.read_csv(spark, f"file://{csv50}", columns="y")) == [(k,) for k in range(20)]
    assert files.read_csv(spark, csv50, schema="x double, y long").dtypes[0] == ("x", "double")


def test_csv_chunks(spark, csv50):
    df = files.read_csv(spark, csv50, chunksize="50 B")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 20


def test_csv_gzip(spark, tmp_path):
    path = tmp_path / "a.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("x\n1\n2\n")
    with pytest.warns(UserWarning, match="gzip") as seen:
        assert rows(files.read_csv(spark, path, compression="gzip")) == [(1,), (2,)]
    assert sum("gzip" in str(w.message) for w in seen) == 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert files.read_csv_without_chunksize(spark, path, compression="gzip").rdd.getNumPartitions() == 1


def test_missing_files(spark, tmp_path):
    for read in (files.read_csv, files.read_json, files.read_orc, files.read_parquet):
        with pytest.raises(FileNotFoundError, match="nothing"):
            read(spark, str(tmp_path / "nothing-*"))


def test_bad_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nword,3\n")
    got = files.read_csv(spark, tmp_path / "a.csv", schema="x int, y int")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(1, 2), (None, 3)]
    with pytest.raises(Exception):
        files.read_csv(spark, tmp_path / "a.csv", schema="x int, y int", mode="FAILFAST").collect()


@pytest.mark.parametrize("orient", ["split", "index", "columns", "values", "records"])
def test_json_orients(spark, tmp_path, orient):
    pdf = pd.DataFrame({"x": list("abcd"), "y": [1, 2, 3, 4]})
    pdf.to_json(tmp_path / "a.json", orient=orient)
    df = files.read_json(spark, tmp_path / "a.json", orient=orient, lines=False)
    assert df.columns == (["0", "1"] if orient == "values" else ["x", "y"])
    assert rows(df) == list(zip("abcd", [1, 2, 3, 4]))


def test_json_lines_and_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "a", "y": 1}\n{"x": "b", "y": 2}\n')
    assert rows(files.read_json(spark, tmp_path / "*.json")) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        files.read_json(spark, tmp_path / "a.json", orient="diagonal")
    with pytest.raises(ValueError):
        files.read_json(spark, tmp_path / "a.json", orient="split", lines=True)
    (tmp_path / "v.json").write_text(json.dumps([[1, "a", 0.5], [2, None, 3]]))
    assert files.read_json(spark, tmp_path / "v.json", orient="values").dtypes == [("0", "bigint"), ("1", "string"), ("2", "double")]


def test_parquet(spark, tmp_path):
    for k in range(12):
        pd.DataFrame({"x": [7 * k % 5], "y": [2.5 * k]}).to_parquet(tmp_path / f"part.{k}.parquet")
    (tmp_path / "my_metadata").write_text("not data")
    want = sorted((7 * k % 5, 2.5 * k) for k in range(12))
    assert rows(files.read_parquet(spark, str(tmp_path / "*"))) == want
    assert rows(files.read_parquet(spark, [str(tmp_path / f"part.{k}.parquet") for k in range(12)])) == want
    assert files.read_parquet(spark, Path(tmp_path / "part.0.parquet"), columns="y").columns == ["y"]
    assert [r["y"] for r in files.read_parquet(spark, str(tmp_path / "part.*"), columns=["y"], ordered=True).collect()] == [2.5 * k for k in range(12)]


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n bigint, s string")
    getattr(files, f"to_{kind}")(df, tmp_path / "out")
    got = getattr(files, f"read_{kind}")(spark, str(tmp_path / "out"))
    assert rows(got.select("n", "s")) == [(1, "a"), (2, "b")]


def test_sizes():
    assert [files.parse_bytes(x) for x in (7, "50 B", "256 MiB", "1kb")] == [7, 50, 256 * 2**20, 1000]
    with pytest.raises(ValueError):
        files.parse_bytes("many")
    assert sorted(["part.10", "part.2"], key=files.natural_key) == ["part.2", "part.10"]


def test_from_pandas(spark):
    pdf = pd.DataFrame({"t": pd.to_datetime(["2001-01-01"] * 4), "c": pd.Categorical(list("abca"), ["b", "a", "c"], ordered=True), "n": range(4)}, index=[5, 6, 7, 8])
    df = memory.from_pandas(spark, pdf, npartitions=3)
    assert df.rdd.getNumPartitions() == 3
    assert dict(df.dtypes) == {"index": "bigint", "t": "timestamp_ntz", "c": "string", "n": "bigint"}
    assert cat(df, "c").ordered and cat(df, "c").categories == ["b", "a", "c"]
    assert memory.from_pandas(spark, pd.DataFrame({"x": range(10)}), chunksize=4).rdd.getNumPartitions() == 3
    assert memory.from_pandas(spark, pd.DataFrame({"x": pd.Series([], dtype="int64")})).count() == 0
    assert len(memory.compute(df)) == 4


def test_from_pandas_late_values(spark):
    """A column whose first values are null gets its type from later ones."""
    late = [None] * 1000 + list("ab") * 250
    df = memory.from_pandas(spark, pd.DataFrame({"s": pd.Series(late, dtype=object), "c": pd.Categorical(late)}))
    assert dict(df.dtypes) == {"s": "string", "c": "string"}
    assert df.filter("s = 'b' AND c = 'b'").count() == 250 and df.filter("s IS NULL AND c IS NULL").count() == 1000


def test_from_parts(spark):
    parts = [spark.createDataFrame([(k, 0)], "x long, i long") for k in range(3)]
    assert rows(memory.from_parts(spark, parts)) == [(0, 0), (1, 0), (2, 0)]
    assert [p.count() for p in memory.to_parts(spark.range(10).repartition(2))] == [5, 5]
    loaders = [lambda k=k: pd.DataFrame({"x": [k, k]}) for k in range(3)]
    assert rows(memory.from_parts(spark, loaders, "x long")) == [(0,), (0,), (1,), (1,), (2,), (2,)]
    with pytest.raises(ValueError, match="z"):
        memory.from_parts(spark, [parts[0], spark.createDataFrame([(1, 2, 3)], "x long, i long, z long")])
    with pytest.raises(ValueError, match="Metadata mismatch"):
        memory.from_parts(spark, [parts[0], loaders[0]])
