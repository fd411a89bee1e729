"""A Spark frame with named index columns and an order of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.functions import arithmetic


@dataclass(frozen=True)
class IndexedFrame:
    """``df`` whose rows are labelled by ``index``; the order of rows is that of ``order_by``, ascending."""

    df: DataFrame
    index: tuple[str, ...]
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "index", (self.index,) if isinstance(self.index, str) else tuple(self.index))
        object.__setattr__(self, "order_by", tuple(self.order_by) or self.index)
        if missing := [c for c in (*self.index, *self.order_by) if c not in self.df.columns]:
            raise KeyError(f"no such column: {missing}")

    @property
    def columns(self) -> list[str]:
        """Columns that are not index."""
        return [c for c in self.df.columns if c not in self.index]

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.select(*self.columns).dtypes)

    @property
    def npartitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def divisions(self) -> list:
        """Least label of each partition that has rows, and the greatest label of all; runs a job."""
        (name,) = self.index
        own = self.df.groupBy(F.spark_partition_id().alias("p")).agg(F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy("p").collect()
        return [*[r["lo"] for r in own], max((r["hi"] for r in own), default=None)]

    def index_values(self) -> DataFrame:
        return self.df.select(*self.index)

    def ordered(self) -> DataFrame:
        """The frame in its order; nulls last."""
        return self.df.orderBy(*[F.asc_nulls_last(c) for c in self.order_by])

    def with_df(self, df: DataFrame) -> IndexedFrame:
        return IndexedFrame(df, self.index, self.order_by)

    def select(self, *columns: str) -> IndexedFrame:
        return self.with_df(self.df.select(*dict.fromkeys((*self.index, *self.order_by, *columns))))

    def loc(self, start=None, stop=None, columns: list[str] | None = None) -> IndexedFrame:
        """Rows with labels from ``start`` to ``stop``, both inclusive."""
        (name,) = self.index
        df = self.df
        if start is not None:
            df = df.filter(F.col(name) >= F.lit(start))
        if stop is not None:
            df = df.filter(F.col(name) <= F.lit(stop))
        out = self.with_df(df)
        return out.select(*columns) if columns is not None else out

    def head(self, n: int = 5) -> DataFrame:
        """The first ``n`` rows in the order of the frame."""
        return self.ordered().limit(n)

    def compute(self) -> pd.DataFrame:
        """All rows on the driver, with the index."""
        return self.ordered().toPandas().set_index(list(self.index))

    def persist(self, eager: bool = False) -> IndexedFrame:
        df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        if eager:
            df.count()
        return self.with_df(df)

    def aligned(self, other: IndexedFrame, how: str = "inner", suffix: str = "_other") -> DataFrame:
        """Rows of two frames that have one label, for arithmetic between them; equal names of ``other`` get ``suffix``."""
        right = other.df.withColumnsRenamed({c: c + suffix for c in other.columns if c in self.columns} | dict(zip(other.index, self.index, strict=True)))
        return self.df.join(right, list(self.index), how)

    def assign(self, **columns: Column) -> IndexedFrame:
        return self.with_df(self.df.withColumns(columns))

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"<quarry.IndexedFrame | {self.npartitions} partitions | index {', '.join(self.index)} | {self.df.select(*self.columns).schema.simpleString()}>"

    def name(self) -> str:
        """A name of what the frame computes: the same for the same plan."""
        return f"frame-{self.df.semanticHash() & 0xFFFFFFFF:08x}"

    def _binary(self, op: Callable, other) -> IndexedFrame:
        """``op`` with a value, for every numeric column; or with the columns of equal name of another frame, by index: labels of both, null where one lacks them."""
        numeric = [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType) and f.name in self.columns]
        if not isinstance(other, IndexedFrame):
            return IndexedFrame(self.df.select(*self.index, *[op(F.col(c), other).alias(c) for c in numeric]), self.index)
        both = [c for c in numeric if c in other.columns]
        left, right = self.df.select(*self.index, *both), other.df.select(*other.index, *both).withColumnsRenamed({c: f"{c}__other" for c in both} | dict(zip(other.index, self.index, strict=True)))
        return IndexedFrame(left.join(right, list(self.index), "full").select(*self.index, *[op(F.col(c), F.col(f"{c}__other")).alias(c) for c in both]), self.index)

    def __add__(self, other):
        return self._binary(arithmetic.add, other)

    def __sub__(self, other):
        return self._binary(arithmetic.sub, other)

    def __mul__(self, other):
        return self._binary(arithmetic.mul, other)

    def __truediv__(self, other):
        return self._binary(arithmetic.truediv, other)

    def __floordiv__(self, other):
        return self._binary(arithmetic.floordiv, other)

    def __mod__(self, other):
        return self._binary(arithmetic.mod, other)

    def __pow__(self, other):
        return self._binary(arithmetic.power, other)

    def __lt__(self, other):
        return self._binary(arithmetic.lt, other)

    def __gt__(self, other):
        return self._binary(arithmetic.gt, other)

    def __le__(self, other):
        return self._binary(arithmetic.le, other)

    def __ge__(self, other):
        return self._binary(arithmetic.ge, other)

    def _repr_html_(self) -> str:
        import html

        return f"<p>{html.escape(repr(self))}</p>"
