"""User-written criteria such as ``1 < Y <= 8.009`` or ``M > 7 and M not in [1, 2, 6]`` as Column expressions.

The text is parsed, never evaluated. Allowed are one variable, numbers, comparisons (chained too), ``in`` and
``not in`` with a list of numbers, ``and``, ``or``, ``not``, the arithmetic signs and ``abs``.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne,
}
_ARITHMETIC = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Mod: F.pmod, ast.Pow: F.pow,
}


def criterion(text: str, value: Column, variable: str = "Y") -> Column:
    """The criterion over ``value``; a NULL value never meets it. Anything not allowed is a ValueError."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"not a criterion: {text!r}") from error

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Name(id=name) if name == variable:
                return value
            case ast.Constant(value=bool(x)):
                return F.lit(x)
            case ast.Constant(value=int() | float() as x):
                return F.lit(float(x))
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~walk(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](walk(a), walk(b))
            case ast.BoolOp(op=op, values=parts):
                out = walk(parts[0])
                for part in parts[1:]:
                    out = out & walk(part) if isinstance(op, ast.And) else out | walk(part)
                return out
            case ast.Compare(left=left, ops=ops, comparators=rest):
                out, before = None, left
                for op, after in zip(ops, rest, strict=True):
                    if isinstance(op, ast.In | ast.NotIn):
                        if not isinstance(after, ast.List | ast.Tuple):
                            raise ValueError(f"a list is needed after 'in': {text!r}")
                        within = F.lit(False)
                        for item in after.elts:
                            within = within | (walk(before) == walk(item))
                        one = ~within if isinstance(op, ast.NotIn) else within
                    elif type(op) in _COMPARE:
                        one = _COMPARE[type(op)](walk(before), walk(after))
                    else:
                        raise ValueError(f"not allowed in a criterion: {text!r}")
                    out, before = one if out is None else out & one, after
                return out
            case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
                return F.abs(walk(x))
        raise ValueError(f"not allowed in a criterion: {text!r}")

    return F.coalesce(walk(tree), F.lit(False))
