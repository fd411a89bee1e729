"""Frames from pandas, from parts, and back to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarry.functions.accessors import with_categories
from quarry.operators.held import free, held


def from_pandas(spark: SparkSession, pdf: pd.DataFrame | pd.Series, *, npartitions: int | None = None, chunksize: int | None = None, index: str | None = None) -> DataFrame:
    """A Spark frame of a local one. An index that is not 0..n-1 becomes a column (``index`` or its own name).

    Datetimes become timestamps without time zone; categories become strings with their
    categories and order in the column's metadata.
    """
    if isinstance(pdf, pd.Series):
        pdf = pdf.to_frame(pdf.name or "value")
    plain = isinstance(pdf.index, pd.RangeIndex) and pdf.index.start == 0 and pdf.index.step == 1
    if index or not plain:
        pdf = pdf.rename_axis(index or pdf.index.name or "index").reset_index()
    categories = {c: pdf[c].cat for c in pdf.columns if isinstance(pdf[c].dtype, pd.CategoricalDtype)}
    own = pdf.astype({c: object for c in categories})
    own = own.astype({c: float for c in own.columns if own[c].dtype == object and pd.api.types.infer_dtype(own[c], skipna=True) == "mixed-integer-float"})
    if len(own):
        inferred = spark.createDataFrame(own).schema if len(own.columns) else T.StructType()
        schema = T.StructType([T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) and own[f.name].dt.tz is None else f.dataType) for f in inferred])
    else:
        kinds = {"i": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "M": T.TimestampNTZType()}
        schema = T.StructType([T.StructField(str(c), kinds.get(own[c].dtype.kind, T.StringType())) for c in own.columns])
    df = spark.createDataFrame(own, schema)
    for c, x in categories.items():
        df = with_categories(df, c, list(x.categories), ordered=bool(x.ordered))
    if chunksize:
        npartitions = max(1, math.ceil(len(pdf) / chunksize))
    return df.repartition(npartitions) if npartitions else df


def from_pandas_api(frame) -> DataFrame:
    """A Spark frame of a pandas-on-Spark one; nothing moves."""
    return frame.to_spark()


def from_parts(spark: SparkSession, parts: Sequence[DataFrame | Callable[[], pd.DataFrame]], schema: T.StructType | str | None = None) -> DataFrame:
    """One frame of many: frames of one schema, or functions that each load a part on an executor.

    Frames must agree in columns and types; that is checked before anything runs.
    """
    if not parts:
        raise ValueError("no parts")
    if all(isinstance(p, DataFrame) for p in parts):
        first = parts[0]
        for p in parts[1:]:
            extra, missing = [c for c in p.columns if c not in first.columns], [c for c in first.columns if c not in p.columns]
            other = [c for c in p.columns if c in first.columns and p.schema[c].dataType != first.schema[c].dataType]
            if extra or missing or other:
                raise ValueError(f"Metadata mismatch found in `from_parts`: extra columns {extra}, missing {missing}, of another type {other}")
        return reduce(DataFrame.unionByName, parts)
    if any(isinstance(p, DataFrame) for p in parts):
        raise ValueError("Metadata mismatch found in `from_parts`: frames and loaders cannot be mixed")
    if schema is None:
        raise ValueError("loaders need a schema")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                yield parts[k]()

    return spark.range(len(parts)).repartition(len(parts), "id").mapInPandas(load, schema)


def to_parts(df: DataFrame) -> list[DataFrame]:
    """One frame for each partition. The rows are held in the checkpoint folder first, so that the plan runs once."""
    part = free(df, "_part")
    rows = held(df.withColumn(part, F.spark_partition_id()))
    return [rows.filter(F.col(part) == k).drop(part) for k in range(npartitions(rows))]


def npartitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def compute(df: DataFrame) -> pd.DataFrame:
    """The whole frame on the driver."""
    return df.toPandas()
