"""Sorts, positions, index and partition operators, unions and block functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarry.functions.accessors import KEY
from quarry.operators.frame import IndexedFrame
from quarry.operators.held import free, held


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def sort_values(df: DataFrame, by: str | Sequence[str], *, ascending: bool = True) -> DataFrame:
    """A global sort; nulls come last."""
    return df.orderBy(*[F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c in _names(by)])


def sort_values_binned(df: DataFrame, by: str, npartitions: int | None = None) -> DataFrame:
    """A global sort in which no value of ``by`` is in two partitions."""
    dealt = df.repartitionByRange(npartitions, F.asc_nulls_last(by)) if npartitions else df.repartitionByRange(F.asc_nulls_last(by))
    return dealt.sortWithinPartitions(F.asc_nulls_last(by))


def nlargest(df: DataFrame, n: int, by: str, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest values; ``ties`` decide among equal ones."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def nsmallest(df: DataFrame, n: int, by: str, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(by), *ties).limit(n)


def with_positions(df: DataFrame, order_by: str | Sequence[str], name: str = "index") -> DataFrame:
    """``df`` with the place of each row, 0..n-1, in the order of ``order_by``.

    Two passes over the sorted rows, which are held for that in the checkpoint folder:
    rows are numbered within partitions, and a row per partition says where it begins.
    ``order_by`` should tell rows apart.
    """
    by = _names(order_by)
    if not by:
        raise ValueError("positions need an order")
    part, row, shift = (free(df, x) for x in ("_part", "_row", "_shift"))
    sorted_rows = held(df.orderBy(*[F.asc_nulls_last(c) for c in by]).withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    parts = sorted_rows.groupBy(part).agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias(shift))
    place = (F.col(row) + F.col(shift)).alias(name)
    return sorted_rows.join(F.broadcast(starts), part).select(place, *[c for c in df.columns if c != name])  # a row per partition


def reset_index(frame: IndexedFrame, name: str = "index", *, drop: bool = True) -> DataFrame:
    """Positions in the frame's order instead of its index; with ``drop=False`` the old index stays as columns."""
    out = with_positions(frame.df, frame.order_by, name)
    return out.drop(*[c for c in frame.index if c != name]) if drop else out


def slice_positions(frame: IndexedFrame, start: int, stop: int, name: str = "index") -> DataFrame:
    """Rows at places ``start`` to ``stop``, end exclusive."""
    return with_positions(frame.df, frame.order_by, name).filter((F.col(name) >= start) & (F.col(name) < stop))


def set_index(df: DataFrame | IndexedFrame, index: str | Column, *, drop: bool = True, sorted: bool = False, name: str = "index") -> IndexedFrame:
    """Labels rows by a column, or by an expression that becomes a column ``name``.

    Rows are dealt by ranges of the label and sorted, unless they are said to be ``sorted``.
    """
    df = df.df if isinstance(df, IndexedFrame) else df
    if not drop:
        raise NotImplementedError("drop=False")
    if isinstance(index, Column):
        df, label = df.withColumn(name, index), name
    elif isinstance(index, str):
        if index not in df.columns:
            raise KeyError(index)
        label = index
    else:
        raise TypeError(f"an index is a name or a column, not {type(index).__name__}")
    return IndexedFrame(df if sorted else sort_values_binned(df, label), (label,))


def repartition(df: DataFrame, npartitions: int) -> DataFrame:
    """Rows are dealt anew, in turn: merged splits of files may hold none, as a row group is read by one of them."""
    return df.repartition(npartitions)


def partition_sizes(df: DataFrame, name: str = "n") -> DataFrame:
    """The number of rows of each partition, of those without rows too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({name: [sum(b.num_rows for b in batches)]})

    return df.mapInArrow(run, T.StructType([T.StructField(name, T.LongType())]))


def hash_partition(df: DataFrame, keys: str | Sequence[str], npartitions: int) -> DataFrame:
    return df.repartition(npartitions, *_names(keys))


def repartition_by_frequency(df: DataFrame, time: str, unit: str, npartitions: int | None = None) -> DataFrame:
    """Partitions that each hold whole days, months or the like of a time column."""
    period = F.date_trunc(unit, F.col(time))
    return df.repartitionByRange(npartitions, period) if npartitions else df.repartitionByRange(period)


def concat(frames: Sequence[DataFrame], *, axis: int = 0, join: str = "outer") -> DataFrame:
    """All rows of all frames, by column name; columns that a frame lacks are null there."""
    if axis != 0 or join != "outer":
        raise NotImplementedError("axis=0 and join='outer' only")
    if not frames:
        raise ValueError("nothing to concatenate")
    seen: dict[str, tuple] = {}
    for df in frames:
        for f in df.schema:
            own = f.metadata.get(KEY)
            if f.name in seen and seen[f.name] != own:
                raise ValueError(f"frames have different categories in column {f.name!r}")
            seen[f.name] = own
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def map_partitions(df: DataFrame, func: Callable[..., pd.DataFrame], schema: T.StructType | str, **kwargs) -> DataFrame:
    """``func`` on local frames: batches of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield func(pdf, **kwargs)

    return df.mapInPandas(run, schema)


def apply_rows(df: DataFrame, func: Callable[..., None], incols: Sequence[str] | Mapping[str, str], outcols: Mapping[str, object], kwargs: Mapping[str, object] | None = None, cache_key: object = None) -> DataFrame:
    """``func`` reads arrays of ``incols`` and fills arrays of ``outcols`` {name: numpy type}; they follow the other columns.

    ``incols`` may rename: {column: argument}. ``cache_key`` is accepted and has no meaning here.
    """
    taken = dict(incols) if isinstance(incols, Mapping) else {c: c for c in incols}
    kinds = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType(), "b1": T.BooleanType()}
    types = {c: np.dtype(t) for c, t in outcols.items()}
    rest = [f for f in df.schema if f.name not in types]
    schema = T.StructType([*rest, *[T.StructField(c, kinds[t.str[1:]]) for c, t in types.items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {c: np.zeros(len(pdf), t) for c, t in types.items()}
            func(**{arg: pdf[c].to_numpy() for c, arg in taken.items()}, **out, **(kwargs or {}))
            yield pdf[[f.name for f in rest]].assign(**out)

    return df.mapInPandas(run, schema)
