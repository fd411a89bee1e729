"""Date parts and categories of a column.

Spark has no categorical type: a categorical column is a string column whose metadata
hold the categories, in order, and whether that order has a meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

KEY = "quarry.categories"
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: Date parts, and the functions that give them.
FIELDS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


class dt:
    """``dt(df, name).year`` and so on, as integer columns."""

    def __init__(self, df: DataFrame, name: str):
        if not isinstance(df.schema[name].dataType, _DATES):
            raise AttributeError("Can only use .dt accessor with datetimelike values")
        self._column = df[name]

    def __getattr__(self, field: str) -> Column:
        if field not in FIELDS:
            raise AttributeError(f"no date part {field!r}")
        return FIELDS[field](self._column)

    def __dir__(self):
        return [*FIELDS]


def with_categories(df: DataFrame, name: str, categories: list, *, ordered: bool = False) -> DataFrame:
    """``df`` with ``name`` as a categorical column; values outside the categories become null."""
    if len(set(categories)) != len(categories):
        raise ValueError("categories must be different")
    own = F.when(F.col(name).isin(*categories), F.col(name)) if categories else F.lit(None).cast("string")
    return df.withColumn(name, own.alias(name, metadata={KEY: {"categories": list(categories), "ordered": ordered}}))


class cat:
    """Categories, codes and comparisons of a categorical column."""

    def __init__(self, df: DataFrame, name: str):
        own = df.schema[name].metadata.get(KEY)
        if own is None:
            raise AttributeError("Can only use .cat accessor with a 'category' dtype")
        self._column, self.categories, self.ordered = df[name], list(own["categories"]), bool(own["ordered"])

    @property
    def codes(self) -> Column:
        """Place in the list of categories, -1 for null."""
        return F.coalesce(self._code(self._column), F.lit(-1))

    def _code(self, column: Column) -> Column:
        if not self.categories:
            return F.lit(None).cast("int")
        return F.create_map(*[F.lit(x) for k, c in enumerate(self.categories) for x in (c, k)])[column]

    def _other(self, other, need_order: bool) -> Column:
        if need_order and not self.ordered:
            raise TypeError("unordered categories can only be compared for equality")
        if isinstance(other, cat):
            if other.categories != self.categories or other.ordered != self.ordered:
                raise TypeError("categories differ")
            return other._code(other._column)
        if other not in self.categories:
            raise TypeError(f"{other!r} is not a category")
        return F.lit(self.categories.index(other))

    def eq(self, other) -> Column:
        return self._code(self._column) == self._other(other, False)

    def ne(self, other) -> Column:
        return self._code(self._column) != self._other(other, False)

    def lt(self, other) -> Column:
        return self._code(self._column) < self._other(other, True)

    def gt(self, other) -> Column:
        return self._code(self._column) > self._other(other, True)
