"""Array helpers that stay inside the JVM. A null element makes sums, and what follows from them, null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row; inside a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    """Null for the empty array."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


def central(values: Column, power: int) -> Column:
    """Population central moment of the given power."""
    return let(mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + F.pow(x - m, F.lit(power))) / F.nullif(F.size(values), F.lit(0)))


def var_pop(values: Column) -> Column:
    return let(mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.nullif(F.size(values), F.lit(0)))


def std_pop(values: Column) -> Column:
    return F.sqrt(var_pop(values))


def quantile_sorted(ordered: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array; null for the empty one."""
    place = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (place - low)


def median(values: Column) -> Column:
    return let(F.sort_array(values), lambda s: quantile_sorted(s, 0.5))


def differences(values: Column) -> Column:
    """x[i+1] - x[i]; empty for fewer than two elements."""
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def complete(values: Column) -> Column:
    """Whether the array holds no null."""
    return ~F.exists(values, lambda x: x.isNull())


def slope(xs: Column, ys: Column) -> Column:
    """Least-squares slope of ys on xs; null for fewer than two points or a constant xs."""
    def fitted(mx: Column, my: Column) -> Column:
        cross = total(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my)))
        return cross / F.nullif(total(F.transform(xs, lambda x: (x - mx) * (x - mx))), F.lit(0.0))

    return F.when(F.size(xs) > 1, let(mean(xs), lambda mx: let(mean(ys), lambda my: fitted(mx, my))))
