"""Derived columns from a small arithmetic grammar."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each sign and operator of the grammar makes of its operands' columns.
OPERATORS: dict[type, Callable[..., Column]] = {
    ast.UAdd: lambda v: v, ast.USub: F.negate,
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide,
}
#: The operands of each node that applies an operator.
OPERANDS: dict[type, Callable[[ast.AST], list[ast.AST]]] = {ast.UnaryOp: lambda n: [n.operand], ast.BinOp: lambda n: [n.left, n.right]}


def compile_expression(text: str, known: set[str]) -> Column:
    """Numbers, names, signs and ``+ - * /``; null and unknown names make null, and so does division by 0."""
    leaves = {
        ast.Constant: lambda n: F.lit(float(n.value)) if type(n.value) in (int, float) else None,
        ast.Name: lambda n: (F.col(f"`{n.id}`") if n.id in known else F.lit(None)).cast("double"),
    }

    def column(node: ast.AST) -> Column:
        kind = type(node)
        apply = OPERATORS.get(type(getattr(node, "op", None)))
        made = leaves[kind](node) if kind in leaves else apply(*map(column, OPERANDS[kind](node))) if apply and kind in OPERANDS else None
        if made is None:
            raise ValueError(f"not allowed in an expression: {kind.__name__}")
        return made

    return column(ast.parse(text, mode="eval").body)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns in order, so that later ones may use earlier ones. What the grammar doesn't allow gives null."""
    for name, text in columns.items():
        if not text:
            continue
        try:
            value = compile_expression(text, set(df.columns))
        except (ValueError, SyntaxError):
            value = F.lit(None).cast("double")
        df = df.withColumn(name, value)
    return df
