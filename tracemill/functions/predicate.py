"""Compound predicates as text, turned into a Column with missing-value rules of their own.

The language is a small part of Python's expressions: comparisons (chained ones
too), `and or not`, `& | ~` between conditions, `in` and `not in` lists,
arithmetic with + - * / // % **, a few functions, names and constants. A
comparison with a missing value is false, so its negation is true, and `!=`
keeps rows without a value.
"""

from __future__ import annotations

import ast
import io
import operator
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PredicateError(ValueError):
    """A predicate that can't be read, or that names an unknown column."""


_ARITHMETIC = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Pow: lambda a, b: F.pow(a, b),
}
_COMPARE = {ast.Eq: operator.eq, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "exp": F.exp, "floor": F.floor, "ceil": F.ceil, "lower": F.lower, "upper": F.upper, "length": F.length}


def predicate(text: str, columns: list[str]) -> Column:
    """The condition that `text` states over `columns`."""
    try:
        tree = ast.parse(_spelled(text.strip()), mode="eval").body
    except (SyntaxError, tokenize.TokenError) as error:
        raise PredicateError(f"can't read {text!r}: {error}") from error
    return _condition(tree, columns)


def _spelled(text: str) -> str:
    """& | ~ as `and or not`, whose precedence they have here."""
    spelled = {"&": "and", "|": "or", "~": "not"}
    found = tokenize.generate_tokens(io.StringIO(text).readline)
    return tokenize.untokenize((tokenize.NAME, spelled[t.string]) if t.string in spelled else t[:2] for t in found)


def where(df: DataFrame, text: str) -> DataFrame:
    """Rows that meet the predicate."""
    return df.filter(predicate(text, df.columns))


def _is_condition(node: ast.AST) -> bool:
    return isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not)


def _condition(node: ast.AST, columns: list[str]) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_condition(v, columns) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_condition(node.operand, columns)
    if isinstance(node, ast.Compare):
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators):
            one = _compare(op, left, right, columns)
            out, left = one if out is None else out & one, right
        return out
    return F.coalesce(_value(node, columns).cast("boolean"), F.lit(False))


def _compare(op: ast.cmpop, left: ast.AST, right: ast.AST, columns: list[str]) -> Column:
    if isinstance(op, (ast.In, ast.NotIn)):
        if not isinstance(right, (ast.List, ast.Tuple)):
            raise PredicateError("`in` needs a list")
        found = F.coalesce(_value(left, columns).isin([ast.literal_eval(v) for v in right.elts]), F.lit(False))
        return ~found if isinstance(op, ast.NotIn) else found
    a, b = _value(left, columns), _value(right, columns)
    if isinstance(op, ast.NotEq):
        return ~F.coalesce(a == b, F.lit(False))
    if type(op) not in _COMPARE:
        raise PredicateError(f"unknown comparison in {ast.unparse(left)}")
    return F.coalesce(_COMPARE[type(op)](a, b), F.lit(False))


def _value(node: ast.AST, columns: list[str]) -> Column:
    if _is_condition(node):
        return _condition(node, columns)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        if node.id not in columns:
            raise PredicateError(f"unknown column {node.id!r}. Available columns: {', '.join(columns)}")
        return F.col(f"`{node.id}`")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _value(node.operand, columns)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
        return _ARITHMETIC[type(node.op)](_value(node.left, columns), _value(node.right, columns))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1:
        return _FUNCTIONS[node.func.id](_value(node.args[0], columns))
    raise PredicateError(f"can't use {ast.unparse(node)!r}")
