"""Python's operators on cubes: element by element on common labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeweave.functions import math as M
from cubeweave.options import OPTIONS


def _apply(a: Any, b: Any, op: Callable[[Column, Column], Column], join: str) -> Any:
    """``op`` between a cube and a cube, a column or a plain value."""
    from cubeweave.cube import Cube
    from cubeweave.operators import align

    if isinstance(b, Cube):
        if join == "exact":
            align.align(a, b, join="exact")
        out = align.binary(a, b, op, "inner" if join == "exact" else join)
    else:
        out = a.map(lambda c: op(c, b if isinstance(b, Column) else F.lit(b)))
    return out if OPTIONS["keep_attrs"] else replace(out, attrs={}, var_attrs={})


def _three(name: str, flags: Callable[[Column, Column], Column] | None = None) -> tuple[Callable, Callable, Callable]:
    """An operator as it stands, with its sides swapped, and in place; ``flags`` is what it does to booleans."""

    def op(cube: Any) -> Callable[[Column, Column], Column]:
        return flags if flags and set(cube.dtypes.values()) == {"boolean"} else M.BINARY[name]

    def plain(self: Any, other: Any) -> Any:
        return _apply(self, other, op(self), OPTIONS["arithmetic_join"])

    def swapped(self: Any, other: Any) -> Any:
        return _apply(self, other, lambda x, y: op(self)(y, x), OPTIONS["arithmetic_join"])

    def in_place(self: Any, other: Any) -> Any:
        return _apply(self, other, op(self), "exact")

    return plain, swapped, in_place


class Arithmetic:
    """Operators of a cube.

    Labels meet by the option ``arithmetic_join``.  In place (``a += b``) a name is
    bound to the new cube, whose labels have to be those of the old one; otherwise
    :class:`cubeweave.cube.AlignmentError` is raised (a job for each shared dimension).
    """

    __add__, __radd__, __iadd__ = _three("add")
    __sub__, __rsub__, __isub__ = _three("subtract")
    __mul__, __rmul__, __imul__ = _three("multiply")
    __truediv__, __rtruediv__, __itruediv__ = _three("divide")
    __floordiv__, __rfloordiv__, __ifloordiv__ = _three("floor_divide")
    __mod__, __rmod__, __imod__ = _three("mod")
    __pow__, __rpow__, __ipow__ = _three("power")
    __and__, __rand__, __iand__ = _three("bitwise_and", lambda x, y: x & y)
    __or__, __ror__, __ior__ = _three("bitwise_or", lambda x, y: x | y)
    __xor__, __rxor__, __ixor__ = _three("bitwise_xor", lambda x, y: x != y)
    __lshift__, _, __ilshift__ = _three("left_shift")
    __rshift__, _, __irshift__ = _three("right_shift")
    __lt__, __gt__ = _three("less")[0], _three("greater")[0]
    __le__, __ge__ = _three("less_equal")[0], _three("greater_equal")[0]
    del _

    def __neg__(self) -> Any:
        return self.map(M.UNARY["negative"])

    def __pos__(self) -> Any:
        return self.map(lambda c: c)

    def __abs__(self) -> Any:
        return self.map(M.UNARY["abs"])

    def __invert__(self) -> Any:
        """Not, of booleans; all bits turned, of integers."""
        flags = {n for n, t in self.dtypes.items() if t == "boolean"}
        return self.with_frame(self.frame.withColumns({n: ~F.col(n) if n in flags else M.UNARY["invert"](F.col(n)) for n in self.names}))
