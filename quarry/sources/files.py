"""Files: CSV, JSON, ORC and Parquet, read lazily by Spark's own readers and written by its writers."""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Default byte range of a CSV partition.
CHUNK = "256 MiB"
_UNITS = {"": 1, "B": 1, "K": 10**3, "KB": 10**3, "KIB": 2**10, "M": 10**6, "MB": 10**6, "MIB": 2**20, "G": 10**9, "GB": 10**9, "GIB": 2**30, "T": 10**12, "TB": 10**12, "TIB": 2**40}
#: Types that JSON values have, by Python type.
_JSON_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType()}

PathLike = str | os.PathLike | Sequence[str | os.PathLike]


def parse_bytes(size: int | str) -> int:
    """Bytes of "50 B", "256 MiB" or a number."""
    if isinstance(size, int):
        return size
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]*)\s*", size)
    if not m or m[2].upper() not in _UNITS:
        raise ValueError(f"not a size: {size!r}")
    return int(float(m[1]) * _UNITS[m[2].upper()])


def natural_key(path: str) -> list:
    """Sorts part.2 before part.10."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]


def files(spark: SparkSession, path: PathLike) -> list[tuple[str, int]]:
    """(path, bytes) of what a path, a glob or a list of them names, in natural order.

    Goes through Hadoop's file systems, so any store works. ``s3://`` is taken as ``s3a://``.
    Raises ``FileNotFoundError`` for a name that matches nothing.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for one in [path] if isinstance(path, (str, os.PathLike)) else path:
        name = re.sub(r"^s3://", "s3a://", str(one))
        p = jvm.org.apache.hadoop.fs.Path(name)
        found = p.getFileSystem(conf).globStatus(p)
        if not found:
            raise FileNotFoundError(f"no file matches {name}")
        out += [(s.getPath().toString(), s.getLen()) for s in found]
    return sorted(out, key=lambda x: natural_key(x[0]))


def _select(df: DataFrame, columns: str | Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*([columns] if isinstance(columns, str) else columns))


def _splitting(spark: SparkSession, size: int) -> SparkSession:
    """A copy of the session, with all its settings, whose scans give a partition to each ``size`` bytes of a file. The session itself stays as it is."""
    other = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key in ("maxPartitionBytes", "openCostInBytes"):
        other.conf.set(f"spark.sql.files.{key}", str(max(1, size)))
    return other


def read_csv(spark: SparkSession, path: PathLike, chunksize: int | str | None = CHUNK, *, columns: str | Sequence[str] | None = None, schema: T.StructType | str | None = None, compression: str | None = None, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """CSV with a header. One schema holds for all files.

    One partition for each ``chunksize`` bytes of each file, or for each file where it is None.
    The scan itself is cut so; nothing is shuffled. With ``compression`` chunks are not possible, which is warned of. Malformed
    records are as ``mode`` says; they never make a partition vanish.
    """
    there = files(spark, path)
    if compression and chunksize is not None:
        warnings.warn(f"{compression} files cannot be split; chunksize is ignored", UserWarning, stacklevel=2)
        chunksize = None
    size = parse_bytes(chunksize) if chunksize is not None else max((n for _, n in there), default=0) + 1
    reader = _splitting(spark, size).read.option("header", True).option("mode", mode).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = _select(reader.csv([p for p, _ in there]), columns)
    own = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(own, spark)


def read_csv_without_chunksize(spark: SparkSession, path: PathLike, **options) -> DataFrame:
    """CSV without a chunk size: one partition for each file."""
    return read_csv(spark, path, chunksize=None, **options)


def read_parquet(spark: SparkSession, path: PathLike, *, columns: str | Sequence[str] | None = None, ordered: bool = False, **options) -> DataFrame:
    """Parquet files, directories or globs; names that end with ``_metadata`` are left out.

    ``ordered`` sorts rows by natural order of the paths, in which part.2 is before part.10, and place in the file.
    """
    there = [p for p, _ in files(spark, path) if not p.endswith("_metadata")]
    if not there:
        raise FileNotFoundError(f"no data file matches {path}")
    df = spark.read.options(**options).parquet(*there)
    if ordered:
        parts = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(r"(\d+|\D+)"))
        padded = F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 30, "0")).otherwise(x))
        df = df.orderBy(F.array_join(padded, ""), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return _select(df, columns)


def read_orc(spark: SparkSession, path: PathLike, *, columns: str | Sequence[str] | None = None, engine: str | None = None, **options) -> DataFrame:
    """ORC files; ``engine`` is accepted and has no meaning here."""
    return _select(spark.read.options(**options).orc([p for p, _ in files(spark, path)]), columns)


def _named(top, orient: str) -> dict[str, list]:
    """Values by column of one document."""
    if orient == "split":
        return {c: [r[k] for r in top["data"]] for k, c in enumerate(top["columns"])}
    if orient == "index":
        return {c: [r.get(c) for r in top.values()] for c in dict.fromkeys(k for r in top.values() for k in r)}
    if orient == "columns":
        return {c: list(v.values()) for c, v in top.items()}
    return {str(k): [r[k] if k < len(r) else None for r in top] for k in range(max(map(len, top), default=0))}


def _schema_of(text: DataFrame, orient: str) -> T.StructType:
    """Columns and types of documents, one in each row, over all of them. A column comes where it comes in some document."""

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for one in pdf["value"]:
                rows = [(k, str(c), type(v).__name__) for k, (c, values) in enumerate(_named(json.loads(one), orient).items()) for v in values or [None]]
                yield pd.DataFrame(rows, columns=["place", "name", "kind"]).drop_duplicates()

    found = text.mapInPandas(kinds, "place int, name string, kind string").groupBy("name").agg(F.min("place").alias("place"), F.collect_set("kind").alias("kinds")).orderBy("place", "name").collect()  # a row for each column
    return T.StructType([T.StructField(r["name"], _type_of(set(r["kinds"]) - {"NoneType"})) for r in found])


def _type_of(kinds: set[str]) -> T.DataType:
    if kinds == {"int", "float"}:
        return T.DoubleType()
    return _JSON_TYPES.get(next(iter(kinds)), T.StringType()) if len(kinds) == 1 else T.StringType()


def read_json(spark: SparkSession, path: PathLike, *, orient: str = "records", lines: bool | None = None, schema: T.StructType | None = None, columns: str | Sequence[str] | None = None, label: str | None = None, **options) -> DataFrame:
    """JSON in the layouts records, split, index, columns and values.

    ``lines`` defaults to true for records, one record a line. The other layouts hold a table in one document
    a file and are read file by file; their types come from all files unless a schema
    is given. ``values`` names its columns 0, 1, ... ``label`` names a column for the row
    labels of the layouts index and columns; without it they are dropped.
    """
    if orient not in ("records", "split", "index", "columns", "values"):
        raise ValueError(f"unknown orient {orient!r}")
    paths = [p for p, _ in files(spark, path)]
    if orient == "records":
        reader = spark.read.options(**options)
        reader = reader.schema(schema) if schema is not None else reader
        return _select(reader.json(paths, multiLine=not (True if lines is None else lines)), columns)
    if lines:
        raise ValueError("lines=True goes with orient='records' only")
    text = spark.read.text(paths, wholetext=True)
    if schema is None:
        schema = _schema_of(text, orient)
    named = [F.col("label").alias(label)] if label and orient in ("index", "columns") else []
    cells = T.ArrayType(T.ArrayType(T.StringType()))
    if orient in ("split", "values"):
        data = F.from_json("value", T.StructType([T.StructField("data", cells)]))["data"] if orient == "split" else F.from_json("value", cells)
        rows = text.select(F.explode(data).alias("r"))
        out = rows.select(*[F.get(F.col("r"), F.lit(k)).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)])
    elif orient == "index":
        rows = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schema))).alias("label", "r"))
        out = rows.select(*named, "r.*")
    else:
        maps = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType)) for f in schema])
        rows = text.select(F.from_json("value", maps).alias("m"))
        keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(F.col("m")[f.name]), F.array().cast("array<string>")) for f in schema])))
        rows = rows.select("m", F.explode(keys).alias("label"))
        out = rows.select(*named, *[F.col("m")[f.name][F.col("label")].alias(f.name) for f in schema])
    return _select(out, columns)


def write(df: DataFrame, path: str | Path, kind: str, *, mode: str = "errorifexists", **options) -> None:
    """Writes csv (with a header), json, orc or parquet. An extension: readers are the point here."""
    if kind == "csv":
        options = {"header": True} | options
    df.write.mode(mode).options(**options).format(kind).save(str(path))


def to_csv(df: DataFrame, path: str | Path, **options) -> None:
    write(df, path, "csv", **options)


def to_json(df: DataFrame, path: str | Path, **options) -> None:
    write(df, path, "json", **options)


def to_orc(df: DataFrame, path: str | Path, **options) -> None:
    write(df, path, "orc", **options)


def to_parquet(df: DataFrame, path: str | Path, **options) -> None:
    write(df, path, "parquet", **options)
