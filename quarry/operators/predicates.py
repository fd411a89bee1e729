"""Python-like filter expressions, as Spark columns.

The text is parsed, never evaluated, and values are bound as literals.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.functions import arithmetic

_LOCAL = "__local_"
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
#: The same with NaN as dataframes have it: unequal to all, and not in any order.
_FLOAT = {ast.Eq: arithmetic.eq, ast.NotEq: arithmetic.ne, ast.Lt: arithmetic.lt, ast.LtE: arithmetic.le, ast.Gt: arithmetic.gt, ast.GtE: arithmetic.ge}
_ARITHMETIC = {ast.Add: arithmetic.add, ast.Sub: arithmetic.sub, ast.Mult: arithmetic.mul, ast.Div: arithmetic.truediv, ast.FloorDiv: arithmetic.floordiv, ast.Mod: arithmetic.mod, ast.Pow: arithmetic.power}


def _python(text: str) -> str:
    """The expression with ``@name`` as a plain name, and ``& | ~`` with the precedence of and, or, not."""
    out, at = [], False
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.string == "@":
            at = True
            continue
        word = {"&": "and", "|": "or", "~": "not"}.get(t.string, t.string) if t.type == tokenize.OP else t.string
        out.append(_LOCAL + word if at else word)
        at = False
    return " ".join(x for x in out if x.strip())


def parse(text: str, local_dict: Mapping[str, object] | None = None, floats: Collection[str] | None = None) -> Column:
    """The condition ``text`` as a Column; ``@name`` is a value of ``local_dict``.

    ``floats`` names the columns that may hold NaN (default: all). Comparisons without any
    of them are plain ones, which scans can take over.
    """
    given = dict(local_dict or {})

    def may_be_nan(node: ast.AST) -> bool:
        for x in ast.walk(node):
            if isinstance(x, ast.BinOp) and isinstance(x.op, (ast.Div, ast.FloorDiv, ast.Pow)):
                return True
            if isinstance(x, ast.Name):
                own = given.get(x.id[len(_LOCAL) :]) if x.id.startswith(_LOCAL) else None
                if isinstance(own, float) and own != own or not x.id.startswith(_LOCAL) and (floats is None or x.id in floats):
                    return True
        return False

    def value(node: ast.AST):
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id.startswith(_LOCAL):
                name = node.id[len(_LOCAL) :]
                if name not in given:
                    raise NameError(f"local variable {name!r} is not given")
                return F.lit(given[name])
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.BoolOp):
            parts = [value(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp):
            own = value(node.operand)
            return ~own if isinstance(node.op, ast.Not) else -own if isinstance(node.op, ast.USub) else own
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, (ast.In, ast.NotIn)):
                    own = value(left).isin(items(right))
                    own = ~own if isinstance(op, ast.NotIn) else own
                else:
                    own = (_FLOAT if may_be_nan(left) or may_be_nan(right) else _COMPARE)[type(op)](value(left), value(right))
                out = own if out is None else out & own
                left = right
            return out
        raise ValueError(f"not understood in a condition: {ast.dump(node)[:80]}")

    def item(node: ast.AST):
        if isinstance(node, ast.Name) and node.id.startswith(_LOCAL):
            return given[node.id[len(_LOCAL) :]]
        try:
            return ast.literal_eval(node)
        except ValueError:
            raise ValueError("`in` needs a list of values") from None

    def items(node: ast.AST) -> list:
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [item(x) for x in node.elts]
        if isinstance(node, ast.Name) and node.id.startswith(_LOCAL):
            return list(given[node.id[len(_LOCAL) :]])
        raise ValueError("`in` needs a list")

    return value(ast.parse(_python(text), mode="eval").body)


def query(df: DataFrame, text: str, local_dict: Mapping[str, object] | None = None) -> DataFrame:
    """Rows for which the condition is true; null counts as false, as does a comparison with NaN other than ``!=``."""
    return df.filter(parse(text, local_dict, [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]))
