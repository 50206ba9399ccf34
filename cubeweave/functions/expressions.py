"""Text expressions over columns, for ``eval`` and ``query``: a whitelist of Python's syntax."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeweave.functions import math as M

_BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: M.divide, ast.FloorDiv: M.floordiv, ast.Mod: M.mod, ast.Pow: F.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
_COMPARE: dict[type, Callable] = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def translate(text: str, names: Collection[str]) -> Column:
    """The column that an expression stands for; anything off the whitelist raises."""

    def go(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str, bool)):
            return F.lit(n.value)
        if isinstance(n, ast.Name) and n.id in names:
            return F.col(n.id)
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp):
            x = go(n.operand)
            return -x if isinstance(n.op, ast.USub) else x if isinstance(n.op, ast.UAdd) else ~x
        if isinstance(n, ast.BoolOp):
            parts = [go(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.Compare):
            items = [n.left, *n.comparators]
            out = None
            for a, op, b in zip(items, n.ops, items[1:]):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
                    one = go(a).isin([c.value for c in b.elts if isinstance(c, ast.Constant)])
                    one = ~one if isinstance(op, ast.NotIn) else one
                elif type(op) in _COMPARE:
                    one = _COMPARE[type(op)](go(a), go(b))
                else:
                    raise ValueError("this comparison isn't supported")
                out = one if out is None else out & one
            return out
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            args = [go(a) for a in n.args]
            if n.func.id in M.UNARY and len(args) == 1:
                return M.UNARY[n.func.id](*args)
            if n.func.id in M.BINARY and len(args) == 2:
                return M.BINARY[n.func.id](*args)
        raise ValueError(f"{ast.dump(n)[:60]} isn't allowed in an expression")

    return go(ast.parse(text.strip(), mode="eval").body)
