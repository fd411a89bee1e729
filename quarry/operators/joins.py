"""Equi-joins with dataframe conventions: natural keys, suffixes, index joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quarry.operators.frame import IndexedFrame

#: A side is broadcast if the optimizer's estimate of its size is no more than this; else Spark chooses.
BROADCAST_BYTES = 32 * 2**20
_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def size_estimate(df: DataFrame) -> int:
    """Bytes, as the optimizer sees them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, behind a check of the size; larger sides are left to a shuffle join."""
    return F.broadcast(df) if size_estimate(df) <= most else df


def _suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    both = [c for c in left.columns if c in right.columns and c not in on]
    if both and not any(suffixes):
        raise ValueError(f"columns overlap but no suffix is given: {both}")
    return left.withColumnsRenamed({c: c + suffixes[0] for c in both}), right.withColumnsRenamed({c: c + suffixes[1] for c in both})


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    """Keys first and once, then the left and the right columns."""
    if how not in _HOW:
        raise ValueError(f"how must be one of {list(_HOW)}, not {how!r}")
    rest = [c for c in left.columns if c not in on], [c for c in right.columns if c not in on]
    if not null_safe:
        return left.join(right, on, _HOW[how]).select(*on, *rest[0], *rest[1])
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = [left[c].eqNullSafe(other[f"_right_{c}"]) for c in on]
    joined = left.join(other, same, _HOW[how])
    keys = [F.coalesce(F.col(c), F.col(f"_right_{c}")).alias(c) for c in on]
    return joined.select(*keys, *rest[0], *rest[1])


def merge(left: DataFrame | IndexedFrame, right: DataFrame | IndexedFrame, on: str | Sequence[str] | None = None, how: str = "left", left_index: bool = False, right_index: bool = False, suffixes: tuple[str, str] = ("_x", "_y"), *, null_safe: bool = False) -> DataFrame | IndexedFrame:
    """Joins on equal keys: ``on``, else all common columns in the left one's order.

    With both ``left_index`` and ``right_index`` the indexes are the keys; with one of them, that frame's index
    and the other frame's columns ``on``, whose names the keys then have.
    Only equal names of columns that are not keys get suffixes. Null keys match nothing unless
    ``null_safe``. A small side is broadcast where the kind of join allows that.
    """
    if left_index != right_index:
        frame, keys = (left if left_index else right), [on] if isinstance(on, str) else list(on or ())
        if not isinstance(frame, IndexedFrame) or len(keys) != len(frame.index):
            raise ValueError("an index is merged with as many columns of the other frame, given by `on`")
        named = frame.df.withColumnsRenamed(dict(zip(frame.index, keys, strict=True)))
        left, right = (named, right) if left_index else (left, named)
    elif left_index:
        if not (isinstance(left, IndexedFrame) and isinstance(right, IndexedFrame)):
            raise ValueError("left_index and right_index are for frames with an index")
        return index_join(left, right, how=how, lsuffix=suffixes[0], rsuffix=suffixes[1])
    left, right = (x.df if isinstance(x, IndexedFrame) else x for x in (left, right))
    keys = [on] if isinstance(on, str) else list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no common columns to join on")
    if missing := [c for c in keys if c not in left.columns or c not in right.columns]:
        raise KeyError(f"not in both frames: {missing}")
    left, right = _suffixed(left, right, keys, suffixes)
    if how in ("inner", "left"):
        right = broadcast_if_small(right)
    elif how == "right":
        left = broadcast_if_small(left)
    return _join(left, right, keys, how, null_safe)


def index_join(left: IndexedFrame, right: IndexedFrame, how: str = "left", lsuffix: str = "", rsuffix: str = "") -> IndexedFrame:
    """Joins on the index; the result is ordered by it, with the left one's columns first."""
    if how not in _HOW:
        raise ValueError(f"how must be one of {list(_HOW)}, not {how!r}")
    if len(left.index) != len(right.index):
        raise ValueError("the indexes have different numbers of columns")
    on = list(left.index)
    clash = [c for c in right.columns if c in on]
    if clash:
        raise ValueError(f"columns of the right frame are named like the left index: {clash}")
    a, b = _suffixed(left.df, right.df.withColumnsRenamed(dict(zip(right.index, on, strict=True))), on, (lsuffix, rsuffix))
    return IndexedFrame(_join(a, b, on, how, False), left.index)


def semi(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of the left frame that have a partner (extension)."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of the left frame without a partner (extension)."""
    return left.join(right, on, "left_anti")
