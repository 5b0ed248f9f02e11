"""Distributions over bins, and divergences between them, as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vibrata.functions.arrays import let, total
from vibrata.functions.batches import by_length

BINS = 50
CLIP, SMOOTHING = 1e-12, 1e-10


def bin_masses(rows: np.ndarray, bins: int = BINS) -> list:
    """(centers, probs) of each row: equal bins over its range, one added to each count; None for constant rows."""
    centers, probs, varied = bin_matrices(rows, bins)
    return [(c, p) if v else None for c, p, v in zip(centers, probs, varied, strict=True)]


def bin_matrices(rows: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and probs of ``bin_masses`` as matrices, and which rows aren't constant."""
    low, high = rows.min(1, keepdims=True), rows.max(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.minimum(np.nan_to_num((rows - low) / (high - low) * bins), bins - 1).astype(int)
    own = place + np.arange(len(rows))[:, None] * bins
    counts = np.bincount(own.ravel(), minlength=len(rows) * bins).reshape(len(rows), bins)
    centers = low + (np.arange(bins) + 0.5) * (high - low) / bins
    return centers, (counts + 1) / (rows.shape[1] + bins), (high > low)[:, 0]


def _structs(found: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"centers": [f and f[0] for f in found], "probs": [f and f[1] for f in found]})


def histogram(values: Column, bins: int = BINS) -> Column:
    """struct(centers, probs) of an array; its fields are null for empty and constant arrays, and for those with nulls."""

    @pandas_udf("struct<centers: array<double>, probs: array<double>>")
    def counted(windows: pd.Series) -> pd.DataFrame:
        return _structs(by_length(windows, lambda m: bin_masses(m, bins)))

    return counted(values)


def kde(values: Column, bins: int = BINS) -> Column:
    """struct(centers, probs): Gaussian kernels of Silverman's width on a grid a tenth beyond the range; nulls if constant."""

    @pandas_udf("struct<centers: array<double>, probs: array<double>>")
    def estimated(windows: pd.Series) -> pd.DataFrame:
        def work(m: np.ndarray) -> list:
            out = []
            for x in m:
                deviation, n = x.std(ddof=1), len(x)
                if not deviation > 0:
                    out.append(None)
                    continue
                width = deviation * (3 * n / 4) ** -0.2
                margin = 0.1 * (x.max() - x.min() + 1e-12)
                grid = np.linspace(x.min() - margin, x.max() + margin, bins)
                mass = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(1) / (n * width * np.sqrt(2 * np.pi))
                out.append((grid, mass / (mass.sum() + 1e-12)))
            return out

        return _structs(by_length(windows, work, 2))

    return estimated(values)


def interpolated(grid: Column, centers: Column, probs: Column) -> Column:
    """Linear interpolation at ascending grid points between evenly spaced centres; 0 outside them.

    A point that rounding alone puts outside (by a billionth of the range) counts as the end itself, so distributions
    over one range stay comparable at its ends.
    """
    n = F.size(centers)

    def at(first: Column, last: Column) -> Column:
        def one(x: Column) -> Column:
            place = (x - first) / (last - first) * (n - 1)
            low = F.least(F.greatest(F.floor(place).cast("int"), F.lit(0)), n - 2)
            value = F.get(probs, low) + (F.get(probs, low + 1) - F.get(probs, low)) * (place - low)
            slack = (last - first) * 1e-9
            return F.when((x < first - slack) | (x > last + slack), 0.0).otherwise(value)

        return F.transform(grid, one)

    return let(F.get(centers, F.lit(0)), lambda a: let(F.get(centers, n - 1), lambda b: at(a, b)))


def aligned(p: Column, q: Column, bins: int = BINS) -> Column:
    """struct(p, q): the masses of two structs (centers, probs) on a common grid over both ranges, smoothed and normalised.

    Masses are interpolated, not densities, so the result depends on how the two ranges compare.
    """
    smoothed = lambda m: let(F.transform(m, lambda x: x + SMOOTHING), lambda s: let(total(s), lambda t: F.transform(s, lambda x: x / t)))

    def on_grid(low: Column, high: Column) -> Column:
        grid = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(i == bins - 1, high).otherwise(low + i * ((high - low) / (bins - 1))))
        return let(grid, lambda g: F.struct(smoothed(interpolated(g, p["centers"], p["probs"])).alias("p"), smoothed(interpolated(g, q["centers"], q["probs"])).alias("q")))

    low = F.least(F.get(p["centers"], F.lit(0)), F.get(q["centers"], F.lit(0)))
    high = F.greatest(F.element_at(p["centers"], -1), F.element_at(q["centers"], -1))
    return F.when(p["centers"].isNotNull() & q["centers"].isNotNull(), let(low, lambda a: let(high, lambda b: on_grid(a, b))))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in nats; masses are clipped from below."""
    clip = lambda x: F.greatest(x, F.lit(CLIP))
    return total(F.zip_with(p, q, lambda a, b: clip(a) * F.ln(clip(a) / clip(b))))


def symmetric_kl(p: Column, q: Column) -> Column:
    return (kl(p, q) + kl(q, p)) / 2


def jensen_shannon(p: Column, q: Column) -> Column:
    """At most ln 2."""
    return let(F.zip_with(p, q, lambda a, b: (a + b) / 2), lambda m: (kl(p, m) + kl(q, m)) / 2)


def _on_grid(grid: np.ndarray, first: np.ndarray, last: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """``interpolated`` in numpy, rows of grids and distributions, smoothed and normalised."""
    n = probs.shape[1]
    place = (grid - first) / (last - first) * (n - 1)
    low = np.clip(np.floor(place), 0, n - 2).astype(np.intp)
    below = np.take_along_axis(probs, low, 1)
    value = below + (np.take_along_axis(probs, low + 1, 1) - below) * (place - low)
    slack = (last - first) * 1e-9
    value[(grid < first - slack) | (grid > last + slack)] = 0.0
    value += SMOOTHING
    return value / value.sum(1, keepdims=True)


def apart(pc: np.ndarray, pp: np.ndarray, qc: np.ndarray, qp: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(symmetric_kl, jensen_shannon) of rows of centres and masses, as of ``aligned`` structs."""
    (p0, p1), (q0, q1) = ((c[:, :1], c[:, -1:]) for c in (pc, qc))
    low, high = np.minimum(p0, q0), np.maximum(p1, q1)
    grid = low + np.arange(bins) * ((high - low) / (bins - 1))
    grid[:, -1:] = high
    p, q = np.maximum(_on_grid(grid, p0, p1, pp), CLIP), np.maximum(_on_grid(grid, q0, q1, qp), CLIP)
    m = (p + q) / 2
    return ((p - q) * np.log(p / q)).sum(1) / 2, (p * np.log(p / m) + q * np.log(q / m)).sum(1) / 2
