"""Column helpers for arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() or a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Running sums (or maxima) of an int array: log2(size) passes, each adding what lies 1, 2, 4, ... places before."""
    shifts = F.array(*[F.lit(1 << k) for k in range(31)])

    def passes(v: Column) -> Column:
        def one(acc: Column, shift: Column) -> Column:
            return F.zip_with(acc, F.slice(F.concat(F.array_repeat(F.lit(zero), shift), acc), 1, F.size(acc)), add)

        return F.aggregate(F.filter(shifts, lambda x: x < F.size(v)), v, one)

    return let(values, passes)
