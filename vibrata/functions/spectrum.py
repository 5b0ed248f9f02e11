"""Welch spectra of windows and features of spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vibrata.functions.arrays import let, mean, slope, total
from vibrata.functions.batches import by_length

SEGMENT = 256
FLOOR = 1e-12


def power_density(windows: np.ndarray, fs: float, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided densities (rows, frequencies), by Welch's method.

    Segments overlap by half, lose their mean, and are weighted by a periodic Hann window; samples after the last whole
    segment take no part.
    """
    size = min(segment, windows.shape[1])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    starts = range(0, windows.shape[1] - size + 1, size - size // 2)
    power = 0.0
    for s in starts:
        part = windows[:, s : s + size]
        power = power + np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * hann, axis=1)) ** 2
    power = power / (len(starts) * fs * (hann**2).sum())
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power


def welch(w: Column, fs: float, segment: int = SEGMENT) -> Column:
    """array<double>: densities at 0, fs/n, 2 fs/n, ..., n being the segment's length; null under two samples."""

    @pandas_udf("array<double>")
    def estimated(windows: pd.Series) -> pd.Series:
        return by_length(windows, lambda m: list(power_density(m, fs, segment)[1]), 2)

    return estimated(w)


def frequencies(w: Column, fs: float, segment: int = SEGMENT) -> Column:
    """The frequencies of ``welch``'s densities."""
    size = F.least(F.size(w), F.lit(segment))
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.floor(size / 2).cast("int")), lambda k: k * F.lit(float(fs)) / size))


def psd_slope(f: Column, p: Column) -> Column:
    """Slope of log10 density on log10 frequency, over positive ones; null under two."""
    pairs = F.filter(F.arrays_zip(f.alias("f"), p.alias("p")), lambda x: (x["f"] > 0) & (x["p"] > 0))
    return let(F.transform(pairs, lambda x: F.struct(F.log10(x["f"]).alias("x"), F.log10(x["p"]).alias("y"))), lambda q: slope(F.transform(q, lambda x: x["x"]), F.transform(q, lambda x: x["y"])))


def spectral_entropy(p: Column) -> Column:
    """Shannon entropy of the normalised spectrum, in nats."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(FLOOR)))
    return let(clipped, lambda c: let(total(c), lambda s: -total(F.transform(c, lambda x: x / s * F.ln(x / s)))))


def spectral_flatness(p: Column) -> Column:
    """Geometric over arithmetic mean."""
    return let(F.transform(p, lambda x: F.greatest(x, F.lit(FLOOR))), lambda c: F.exp(mean(F.transform(c, lambda x: F.ln(x)))) / mean(c))


def spectral_centroid(f: Column, p: Column) -> Column:
    return total(F.zip_with(f, p, lambda x, y: x * y)) / (total(p) + FLOOR)


def band_energy(f: Column, p: Column, low: float, high: float) -> Column:
    """Sum of the densities at frequencies from low to under high."""
    return total(F.zip_with(f, p, lambda x, y: F.when((x >= low) & (x < high), y).otherwise(0.0)))


def band_name(low: float, high: float) -> str:
    return f"band_energy_{low:.1f}_{high:.1f}"


NAMES = ("psd_slope", "spectral_entropy", "spectral_flatness", "spectral_centroid")


def spectral_features(f: Column, p: Column, bands: tuple[tuple[float, float], ...] = ()) -> list[Column]:
    columns = (psd_slope(f, p), spectral_entropy(p), spectral_flatness(p), spectral_centroid(f, p))
    return [*(c.alias(n) for c, n in zip(columns, NAMES, strict=True)), *(band_energy(f, p, a, b).alias(band_name(a, b)) for a, b in bands)]
