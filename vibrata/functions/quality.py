"""Signal-quality features of a window; windows under eight samples, and windows with nulls, have none (nulls)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vibrata.functions.arrays import complete, differences, let, mean, median, std_pop, total, var_pop

LEAST = 8
REPEATS = 3  # equal samples in a row that count as a dropout
NAMES = ("sq_noise_floor", "sq_baseline_stability", "sq_dropout_rate", "sq_peak_consistency", "sq_snr", "sq_response_linearity")


def noise_floor(w: Column) -> Column:
    """Median absolute deviation of the first difference, scaled to a normal deviation of one sample."""
    spread = lambda d: let(median(d), lambda m: median(F.transform(d, lambda x: F.abs(x - m))))
    return let(differences(w), spread) * (1.4826 / 2**0.5)


def baseline_stability(w: Column, segments: int = 4) -> Column:
    """Population deviation of the means of equal segments, without the rest; 0 for segments under two samples."""
    size = F.floor(F.size(w) / segments).cast("int")
    means = F.array(*(mean(F.slice(w, size * i + 1, size)) for i in range(segments)))
    return F.when(size < 2, 0.0).otherwise(let(means, std_pop))


def dropout_rate(w: Column, repeats: int = REPEATS) -> Column:
    """Share of samples in runs of at least ``repeats`` equal values."""
    counted = lambda s: s["gone"] + F.when(s["run"] >= repeats, s["run"]).otherwise(0)
    state = lambda run, last, gone: F.struct(run.cast("int").alias("run"), last.cast("double").alias("last"), gone.cast("int").alias("gone"))
    step = lambda s, x: F.when((s["run"] > 0) & (s["last"] == x), state(s["run"] + 1, x, s["gone"])).otherwise(state(F.lit(1), x, counted(s)))
    return F.aggregate(w, state(F.lit(0), F.lit(None), F.lit(0)), step, counted) / F.nullif(F.size(w), F.lit(0))


def peak_consistency(w: Column) -> Column:
    """Coefficient of variation of the ranges of half-overlapping eighths."""
    n = F.size(w)
    size = F.greatest(F.floor(n / 8).cast("int"), F.lit(4))
    step = F.greatest(F.floor(size / 2).cast("int"), F.lit(1))
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, step))
    ranges = F.transform(starts, lambda s: let(F.slice(w, s + 1, size), lambda part: F.array_max(part) - F.array_min(part)))
    varied = lambda r: let(mean(r), lambda m: F.when((F.size(r) < 2) | (m < 1e-12), 0.0).otherwise(std_pop(r) / m))
    return let(ranges, varied)


def snr(w: Column) -> Column:
    """Decibels of the variance over half the variance of the first difference, between -60 and 60 where one vanishes."""
    noise = var_pop(differences(w)) / 2
    told = lambda signal, noise: F.when(noise < 1e-20, 60.0).when(signal < 1e-20, -60.0).otherwise(10 * F.log10(signal / noise))
    return let(var_pop(w), lambda s: let(noise, lambda n: told(s, n)))


def response_linearity(w: Column) -> Column:
    """R squared of the samples on their index; 1 for constant windows."""
    n = F.size(w)
    middle = (n - 1) / 2.0
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def fitted(m: Column) -> Column:
        cross = total(F.zip_with(w, at, lambda x, i: (x - m) * (i - middle)))
        tt = n.cast("double") * (n * n - 1.0) / 12
        told = lambda ss, c: F.when((ss < 1e-12) | (n < 3), 1.0).otherwise(c * c / (F.nullif(tt, F.lit(0.0)) * ss))
        return let(total(F.transform(w, lambda x: (x - m) * (x - m))), lambda ss: let(cross, lambda c: told(ss, c)))

    return let(mean(w), fitted)


def signal_quality(w: Column) -> Column:
    """struct of the six features in the order of ``NAMES``."""

    def features(v: Column) -> Column:
        values = (noise_floor(v), baseline_stability(v), dropout_rate(v), peak_consistency(v), snr(v), response_linearity(v))
        return F.when((F.size(v) >= LEAST) & complete(v), F.struct(*(x.alias(n) for x, n in zip(values, NAMES, strict=True))))

    return let(w, features)
