"""Time-domain features of a window (an array of doubles). Empty windows and windows with nulls give nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vibrata.functions.arrays import let, mean, median, quantile_sorted, std_pop, total

FLAT = 1e-12  # a variance up to here counts as constant: skewness and kurtosis are 0
#: The quartiles by default; a feature is named quantile_ and the percentage.
QUANTILES = (0.25, 0.5, 0.75)


def _moments(w: Column) -> Column:
    """struct(m, v, m3, m4, ms): mean, central moments 2 to 4 and mean square."""
    n = F.size(w)

    def about(m: Column) -> Column:
        start = F.struct(*(F.lit(0.0).alias(k) for k in ("v", "m3", "m4", "ms")))
        step = lambda s, x: F.struct(
            (s["v"] + (x - m) * (x - m)).alias("v"), (s["m3"] + (x - m) * (x - m) * (x - m)).alias("m3"),
            (s["m4"] + (x - m) * (x - m) * (x - m) * (x - m)).alias("m4"), (s["ms"] + x * x).alias("ms"),
        )
        return F.aggregate(w, start, step, lambda s: F.struct(m.alias("m"), (s["v"] / n).alias("v"), (s["m3"] / n).alias("m3"), (s["m4"] / n).alias("m4"), (s["ms"] / n).alias("ms")))

    return F.when(n > 0, let(mean(w), about))


def zero_crossing_rate(w: Column) -> Column:
    """Changes of sign (zero is a sign of its own) per step."""
    n = F.size(w)
    changes = F.zip_with(F.slice(w, 2, F.greatest(n - 1, F.lit(0))), F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: (F.signum(b) != F.signum(a)).cast("double"))
    return F.when(n > 1, total(changes) / (n - 1)).when(n == 1, 0.0)


def moments(w: Column, quantiles: tuple[float, ...] = QUANTILES) -> Column:
    """struct(mean, variance, rms, skewness, kurtosis, zcr, quantile_...): population variance, bias-corrected shape.

    Skewness needs three and excess kurtosis four samples for the correction; with fewer they stay uncorrected.
    """
    n = F.size(w).cast("double")

    def shaped(s: Column) -> Column:
        g1, g2 = s["m3"] / F.pow(s["v"], F.lit(1.5)), s["m4"] / (s["v"] * s["v"]) - 3
        flat = s["v"] <= FLAT
        skew = F.when(flat, 0.0).when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(g1)
        kurt = F.when(flat, 0.0).when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)).otherwise(g2)
        return let(F.sort_array(w), lambda o: F.struct(
            s["m"].alias("mean"), s["v"].alias("variance"), F.sqrt(s["ms"]).alias("rms"), F.when(s["v"].isNotNull(), skew).alias("skewness"), F.when(s["v"].isNotNull(), kurt).alias("kurtosis"),
            zero_crossing_rate(w).alias("zcr"), *(F.when(s["v"].isNotNull(), quantile_sorted(o, q)).alias(f"quantile_{int(q * 100)}") for q in quantiles),
        ))

    return let(_moments(w), shaped)


#: Names of ``five_statistics``, in order.
FIVE = ("min", "max", "mean", "median", "std")


def five_statistics(w: Column) -> Column:
    """struct(min, max, mean, median, std), with the population deviation."""
    return F.struct(F.array_min(w).alias("min"), F.array_max(w).alias("max"), mean(w).alias("mean"), median(w).alias("median"), std_pop(w).alias("std"))
