"""Two ways to compute the same formula: numpy arrays of a block, or columns of a DataFrame.

A kernel takes a lane and its operands and uses ordinary arithmetic; what differs (choices, bit
operations, roots) it asks of the lane. `let` names an intermediate result: in a DataFrame it
becomes a column of its own, so that a value used twice is computed once and plans stay linear.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


class Blocks:
    """numpy, in the precision of its operands. Hashes are int64 arrays of 32-bit values."""

    @staticmethod
    def let(x):
        return x

    lets = staticmethod(lambda *xs: xs)
    where, least, greatest = staticmethod(np.where), staticmethod(np.minimum), staticmethod(np.maximum)
    sqrt, floor, exp, abs, sin, cos = (staticmethod(f) for f in (np.sqrt, np.floor, np.exp, np.abs, np.sin, np.cos))

    @staticmethod
    def atan2(y, x):
        return np.arctan2(y, x) + 0.0

    @staticmethod
    def power(x, e):
        return np.power(x, e)

    @staticmethod
    def divide(a, b):
        """a / b, and 0 where b is 0."""
        zero = b == 0
        return np.where(zero, 0, a / np.where(zero, 1, b))

    @staticmethod
    def cell(x):
        """A whole-number coordinate as a 32-bit value."""
        return x.astype(np.int64) & MASK32

    @staticmethod
    def real(x, like):
        return x.astype(like.dtype) if hasattr(like, "dtype") else x

    xor = staticmethod(lambda a, b: a ^ b)
    land = staticmethod(lambda a, b: a & b)
    shr = staticmethod(lambda a, n: a >> n)
    both = staticmethod(np.logical_and)


class Rows:
    """Columns over a DataFrame that grows by the intermediate results; `df` is the current one."""

    _names = itertools.count()

    def __init__(self, df: DataFrame):
        self.df = df

    def lets(self, *xs):
        named = {f"_t{next(self._names)}": x for x in xs if isinstance(x, Column)}
        self.df = self.df.withColumns(named)
        names = iter(named)
        return tuple(F.col(next(names)) if isinstance(x, Column) else x for x in xs)

    def let(self, x):
        return self.lets(x)[0]

    @staticmethod
    def where(c, a, b):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(c, lit(a)).otherwise(lit(b))

    @staticmethod
    def _lit(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    def least(self, a, b):
        return F.least(self._lit(a), self._lit(b))

    def greatest(self, a, b):
        return F.greatest(self._lit(a), self._lit(b))

    sqrt, exp, abs, sin, cos = (staticmethod(f) for f in (F.sqrt, F.exp, F.abs, F.sin, F.cos))

    @staticmethod
    def floor(x):
        return F.floor(x).cast("double")

    def atan2(self, y, x):
        return F.atan2(self._lit(y), self._lit(x))

    def power(self, x, e):
        return F.pow(x, self._lit(e))

    def divide(self, a, b):
        b = self._lit(b)
        return F.when(b == 0, F.lit(0.0)).otherwise(self._lit(a) / F.when(b == 0, F.lit(1.0)).otherwise(b))

    @staticmethod
    def cell(x):
        return x.cast("long").bitwiseAND(F.lit(MASK32))

    @staticmethod
    def real(x, like):
        return x.cast("double") if isinstance(x, Column) else x

    @staticmethod
    def xor(a, b):
        return (a if isinstance(a, Column) else F.lit(a)).bitwiseXOR(b if isinstance(b, Column) else F.lit(b))

    @staticmethod
    def land(a, b):
        return a.bitwiseAND(F.lit(b))

    @staticmethod
    def shr(a, n):
        return F.shiftright(a, n)

    @staticmethod
    def both(a, b):
        return a & b


def u32_mul(lane, x, c: int):
    """x * c modulo 2**32 for 32-bit x, within 64-bit signed arithmetic: by halves of c."""
    lo, hi = c & 0xFFFF, c >> 16
    return lane.land(x * lo + lane.land(x * hi, 0xFFFF) * 65536, MASK32)
