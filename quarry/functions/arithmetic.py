"""Binary operators with the semantics of dataframes: IEEE division, floor that rounds down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def add(a, b) -> Column:
    return _col(a) + _col(b)


def sub(a, b) -> Column:
    return _col(a) - _col(b)


def mul(a, b) -> Column:
    return _col(a) * _col(b)


def truediv(a, b) -> Column:
    """a / b as doubles; by zero: inf, -inf or NaN. Null where either is null."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNull(), F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(by_zero)).otherwise(a / b)


def floordiv(a, b) -> Column:
    """floor(a / b), a double."""
    whole = truediv(a, b)
    near = F.rint(whole)  # a double, so inf, NaN and -0.0 stay
    return near - F.when(near > whole, 1.0).otherwise(0.0)


def int_floordiv(a, b) -> Column:
    """floor(a / b) of integers, a bigint, exact beyond 2**53; null by zero."""
    a, b = _col(a).cast("long"), _col(b).cast("long")
    safe = F.when(b != 0, b)
    return F.call_function("div", a, safe) - F.when((a % safe != 0) & ((a < 0) != (safe < 0)), 1).otherwise(0)


def mod(a, b) -> Column:
    """a - b * floor(a / b): the sign is the divisor's. Null by zero."""
    a, b = _col(a), _col(b)
    safe = F.when(b != 0, b)
    return ((a % safe) + safe) % safe


def power(a, b) -> Column:
    return F.pow(_col(a), _col(b))


def eq(a, b) -> Column:
    return _compare(a, b, lambda x, y: x == y, False)


def ne(a, b) -> Column:
    return _compare(a, b, lambda x, y: x != y, True)


def lt(a, b) -> Column:
    return _compare(a, b, lambda x, y: x < y, False)


def le(a, b) -> Column:
    return _compare(a, b, lambda x, y: x <= y, False)


def gt(a, b) -> Column:
    return _compare(a, b, lambda x, y: x > y, False)


def ge(a, b) -> Column:
    return _compare(a, b, lambda x, y: x >= y, False)


def _compare(a, b, op, nan: bool) -> Column:
    """IEEE: a comparison with NaN is false, but for ``ne``. Null where either is null."""
    a, b = _col(a), _col(b)
    either = F.isnan(a.try_cast("double")) | F.isnan(b.try_cast("double"))
    return F.when(F.coalesce(either, F.lit(False)), F.lit(nan)).otherwise(op(a, b))


def map_scalar(df: DataFrame, op, value) -> DataFrame:
    """``op(column, value)`` for every column of a frame."""
    return df.select(*[op(F.col(c), value).alias(c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def row_var(columns: list, ddof: int = 1) -> Column:
    """Variance over the columns of each row; null values are skipped, too few give null."""
    own = F.filter(F.array(*[_col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(own)
    mean = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n)
    squares = F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(n > ddof, squares / F.when(n > ddof, n - ddof))
