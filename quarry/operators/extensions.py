"""Further usual dataframe operators, with Spark's own semantics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarry.operators.frame import IndexedFrame

_KINDS = {"number": T.NumericType, "string": T.StringType, "bool": T.BooleanType, "datetime": T.DatetimeType}


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(columns))


def select_dtypes(df: DataFrame, kind: str) -> DataFrame:
    """Columns of a kind: number, string, bool or datetime."""
    wanted = (T.TimestampType, T.TimestampNTZType, T.DateType) if kind == "datetime" else _KINDS[kind]
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, wanted)])


def fillna(df: DataFrame, values: object) -> DataFrame:
    return df.na.fill(values)


def dropna(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how, subset=subset)


def where(column: str, condition: Column, other: object = None) -> Column:
    """The column where the condition holds, else ``other``."""
    return F.when(condition, F.col(column)).otherwise(F.lit(other))


def mask(column: str, condition: Column, other: object = None) -> Column:
    return F.when(condition, F.lit(other)).otherwise(F.col(column))


def clip(column: str, lower: object, upper: object) -> Column:
    """Null stays null."""
    return F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.lit(lower)), F.lit(upper)))


def sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    return df.sample(fraction, seed)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset) if subset else None)


def nunique(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias(column))


def nunique_approx(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.approx_count_distinct(column).alias(column))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).filter(F.col(column).isNotNull())


def any_(condition: Column) -> Column:
    return F.bool_or(condition)


def all_(condition: Column) -> Column:
    return F.bool_and(condition)


def prod(column: str) -> Column:
    return F.product(F.col(column))


def quantile(df: DataFrame, column: str, q: float, *, approximate: bool = False) -> DataFrame:
    """Exact quantiles need all values of the column sorted; the approximate one merges sketches."""
    own = F.percentile_approx(column, q) if approximate else F.percentile(column, q)
    return df.agg(own.alias(column))


def describe(df: DataFrame, *statistics: str) -> DataFrame:
    return df.summary(*statistics)


def idxmax(df: DataFrame, column: str, label: str) -> DataFrame:
    """The label of the largest value; the smallest label among equals. NaN counts as no value."""
    value = F.nanvl(F.col(column), F.lit(None)) if dict(df.dtypes)[column] in ("float", "double") else F.col(column)
    top = df.agg(F.max(value).alias("top"))  # one row
    return df.join(F.broadcast(top), value == F.col("top")).agg(F.min(label).alias(label))


def idxmin(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.agg(F.min_by(F.col(label), F.struct(F.col(column), F.col(label))).alias(label))


def running(how: str, column: str, order_by: str, partition_by: str | None = None, n: int = 3) -> Column:
    """cumsum, cummin, cummax, cumcount, shift, diff or rolling_sum along an order.

    Without ``partition_by`` all rows go through one task.
    """
    w = Window.partitionBy(*([partition_by] if partition_by else [])).orderBy(order_by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    made = {
        "cumsum": lambda: F.sum(column).over(upto),
        "cummin": lambda: F.min(column).over(upto),
        "cummax": lambda: F.max(column).over(upto),
        "cumcount": lambda: F.count(F.lit(1)).over(upto) - 1,
        "shift": lambda: F.lag(column).over(w),
        "diff": lambda: F.col(column) - F.lag(column).over(w),
        "rolling_sum": lambda: F.sum(column).over(w.rowsBetween(1 - n, 0)),
        "rolling_mean": lambda: F.avg(column).over(w.rowsBetween(1 - n, 0)),
    }
    return made[how]()


def size(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of each group, as ``size``; a null key is a group."""
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(F.count(F.lit(1)).alias("size"))


def first_last(df: DataFrame, keys: str | Sequence[str], column: str, order_by: str) -> DataFrame:
    """The column's first and last value of each group, in the order of ``order_by``, as <column>_first and <column>_last."""
    own = [F.min_by(column, order_by).alias(f"{column}_first"), F.max_by(column, order_by).alias(f"{column}_last")]
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(*own)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left frame less those of the right one, each as often as it is there."""
    return left.exceptAll(right.select(*left.columns))


def tail(frame: IndexedFrame, n: int = 5) -> DataFrame:
    """The last ``n`` rows in the order of the frame, last first."""
    return frame.df.orderBy(*[F.desc_nulls_first(c) for c in frame.order_by]).limit(n)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, known: Sequence[object] | None = None) -> DataFrame:
    """Sums by index and column value; with ``known`` values no extra job looks for them."""
    return df.groupBy(index).pivot(columns, list(known) if known else None).agg(F.sum(values))
