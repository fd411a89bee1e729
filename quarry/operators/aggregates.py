"""Reductions, group-by and tree reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.functions.arithmetic import numeric_columns, row_var


def variance(column: str | Column, ddof: int = 1) -> Column:
    """Variance with any degrees of freedom; null where there are no more than ``ddof`` values."""
    if ddof == 1:
        return F.var_samp(column)
    if ddof == 0:
        return F.var_pop(column)
    n = F.count(column)
    return F.when(n > ddof, F.var_pop(column) * n / F.when(n > ddof, n - ddof))


def deviation(column: str | Column, ddof: int = 1) -> Column:
    return F.sqrt(variance(column, ddof))


def sum_of_squares(column: str) -> Column:
    return F.sum(F.col(column).cast("double") * F.col(column).cast("double"))


_NAMED: dict[str, Callable] = {"sum": F.sum, "count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "var": variance, "std": deviation}


def reduce(df: DataFrame, column: str, how: str, *, ddof: int = 1, skipna: bool = True) -> DataFrame:
    """One row with the reduction of a column, under its own name. Null values are skipped; without any value: null, count 0.

    With ``skipna=False`` a null value makes the result null.
    """
    own = _NAMED[how](column, ddof) if how in ("var", "std") else _NAMED[how](column)
    if not skipna:
        own = F.when(F.count(column) == F.count(F.lit(1)), own)
    return df.agg(own.alias(column))


def frame_mean(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in numeric_columns(df)])


def frame_var(df: DataFrame, axis: int = 0, ddof: int = 1) -> DataFrame:
    """Variance of each numeric column, as rows (column, var); with axis=1 of each row, as a column ``var``."""
    names = numeric_columns(df)
    if axis == 1:
        return df.withColumn("var", row_var(names, ddof))
    if axis != 0:
        raise ValueError("axis is 0 or 1")
    wide = df.agg(*[variance(c, ddof).alias(c) for c in names])
    return wide.unpivot([], names, "column", "var")


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def unique_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """Up to ``k`` different values; which ones is not said."""
    return unique(df, column).limit(k)


class GroupBy:
    """Aggregates by key; keys come first. A null key is a group of its own unless ``dropna``."""

    def __init__(self, df: DataFrame, keys: str | Sequence[str], *, dropna: bool = False, columns: Sequence[str] | None = None):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.df = df.dropna(subset=self.keys) if dropna else df
        self.columns = list(columns) if columns is not None else None

    def __getitem__(self, columns: str | list[str]) -> GroupBy:
        return GroupBy(self.df, self.keys, columns=[columns] if isinstance(columns, str) else columns)

    def _values(self, numeric: bool) -> list[str]:
        there = self.columns or [c for c in self.df.columns if c not in self.keys]
        return [c for c in there if not numeric or c in numeric_columns(self.df)] if self.columns is None else there

    def _each(self, how: str, numeric: bool = True) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*[_NAMED[how](c).alias(c) for c in self._values(numeric)])

    def sum(self) -> DataFrame:
        return self._each("sum")

    def mean(self) -> DataFrame:
        return self._each("mean")

    def count(self) -> DataFrame:
        return self._each("count", numeric=False)

    def min(self) -> DataFrame:
        return self._each("min", numeric=False)

    def max(self) -> DataFrame:
        return self._each("max", numeric=False)

    def std(self, ddof: int = 1) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*[deviation(c, ddof).alias(c) for c in self._values(True)])

    def var(self, ddof: int = 1) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*[variance(c, ddof).alias(c) for c in self._values(True)])

    def agg(self, how: Mapping[str, str | Sequence[str]] | Sequence[str]) -> DataFrame:
        """{"y": "max"} keeps the name y; several functions give y_sum, y_max. A list goes for every value column."""
        plan = dict(how) if isinstance(how, Mapping) else {c: list(how) for c in self._values(True)}
        out = []
        for c, names in plan.items():
            out += [_NAMED[names](c).alias(c)] if isinstance(names, str) else [_NAMED[n](c).alias(f"{c}_{n}") for n in names]
        return self.df.groupBy(*self.keys).agg(*out)


def groupby(df: DataFrame, keys: str | Sequence[str], *, dropna: bool = False) -> GroupBy:
    return GroupBy(df, keys, dropna=dropna)


def tree_reduction(df: DataFrame, chunk: Callable[..., pd.DataFrame], aggregate: Callable[..., pd.DataFrame], schema: T.StructType | str, *, combine: Callable[..., pd.DataFrame] | None = None, partial_schema: T.StructType | str | None = None, split_every: int | bool | None = None, chunk_kwargs: dict | None = None, combine_kwargs: dict | None = None, aggregate_kwargs: dict | None = None) -> DataFrame:
    """``chunk`` on each partition, ``combine`` on groups of ``split_every`` partials, ``aggregate`` on what is left.

    Each function maps a local frame to a local frame; a partition must fit in a task's memory. An empty
    partition gives no partial, but for the first one: so a frame without rows is reduced too. Partials have ``partial_schema`` (default: ``schema``).
    ``split_every`` is 8 by default; False makes one step of it.
    """
    if combine is None and combine_kwargs:
        raise ValueError("combine_kwargs needs combine")
    every = 8 if split_every is None else split_every
    if every is not False and (isinstance(every, bool) or int(every) < 2):
        raise ValueError("split_every must be False or an integer of 2 or more")
    combine, combine_kwargs = combine or aggregate, combine_kwargs if combine else aggregate_kwargs
    spark = df.sparkSession
    if df.rdd.getNumPartitions() == 0:
        df = df.repartition(1)
    empty = df.limit(0).toPandas()
    partial = spark.createDataFrame([], partial_schema if partial_schema is not None else schema).schema
    numbered = T.StructType([*partial.fields, T.StructField("_part", T.LongType())])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, all_rows = TaskContext.get().partitionId(), [pdf for pdf in batches if len(pdf)]
        if all_rows or part == 0:
            whole = pd.concat(all_rows, ignore_index=True) if all_rows else empty
            yield chunk(whole, **(chunk_kwargs or {})).assign(_part=part)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["_part"].iloc[0]) // every
        return combine(pdf.drop(columns="_part"), **(combine_kwargs or {})).assign(_part=part)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return aggregate(pdf.drop(columns="_part"), **(aggregate_kwargs or {}))

    n, out = df.rdd.getNumPartitions(), df.mapInPandas(first, numbered)
    while every is not False and n > every:
        out = out.groupBy(F.floor(F.col("_part") / every)).applyInPandas(step, numbered)
        n = -(-n // every)
    return out.groupBy((F.col("_part") * 0).alias("all")).applyInPandas(last, schema)
