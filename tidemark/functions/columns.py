"""Building blocks of column expressions: values bound once, and folds over arrays in few passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Every prefix of an array combined, in log2(size) passes over it.

    ``combine(earlier, later)`` must be associative.  Each pass combines an
    entry with the one twice as far back as in the pass before.
    """
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))

    def step(so_far: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(so_far, lambda x, i: F.when(i >= back, combine(F.get(so_far, i - back), x)).otherwise(x))

    return F.aggregate(passes, items, step)
