"""The maximal-overlap discrete wavelet transform with the sym4 filter, and features of its bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vibrata.functions.batches import by_length

# The scaling coefficients of the least asymmetric Daubechies wavelet with four vanishing moments.
SCALING = (
    -0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.80373875180591614,
    0.29785779560527736, -0.09921954357684722, -0.01260396726203783, 0.03222310060404270,
)
TAPS = len(SCALING)
#: Taps of the smooth and of the detail filter as the transform uses them, divided by the square root of 2.
SMOOTH = tuple(g / math.sqrt(2) for g in SCALING)
DETAIL = tuple((-1) ** n * g / math.sqrt(2) for n, g in enumerate(reversed(SCALING)))
LEAST = 8  # samples of a window with features
STATISTICS = ("energy", "variance", "entropy", "rms", "kurtosis")


def levels(n: int, wanted: int = 5) -> int:
    """Levels that ``n`` samples allow, at most ``wanted``; 0 for fewer than two samples."""
    return 0 if n < 2 else min(wanted, max(1, math.floor(math.log2(n / (TAPS - 1)))))


def modwt(windows: np.ndarray, level: int = 5) -> np.ndarray:
    """(bands, rows, n) of a matrix of windows: details from the finest on, then the last smooth. Windows are circular."""
    smooth, bands = windows, []
    for j in range(levels(windows.shape[1], level)):
        shifted = [np.roll(smooth, (k << j), axis=1) for k in range(TAPS)]
        bands.append(sum(h * x for h, x in zip(DETAIL, shifted, strict=True)))
        smooth = sum(g * x for g, x in zip(SMOOTH, shifted, strict=True))
    return np.stack([*bands, smooth])


def band_names(level: int) -> list[str]:
    return [*(f"d{j}" for j in range(1, level + 1)), "a"]


def band_statistics(bands: np.ndarray) -> np.ndarray:
    """(..., 5) in the order of ``STATISTICS`` of bands along the last axis: kurtosis is in excess and not corrected."""
    n = bands.shape[-1]
    squares = bands * bands
    energy = squares.sum(-1)
    centred = bands - bands.mean(-1, keepdims=True)
    variance = (centred**2).mean(-1)
    share = np.maximum(squares / (energy[..., None] + 1e-12), 1e-12)
    entropy = -(share * np.log2(share)).sum(-1)
    deviation = np.sqrt(variance)
    with np.errstate(divide="ignore", invalid="ignore"):
        kurtosis = np.where((n < 4) | (deviation < 1e-12), 0.0, (centred**4).mean(-1) / variance**2 - 3)
    return np.stack([energy, variance, entropy, np.sqrt(squares.mean(-1)), kurtosis], -1)


def bands(w: Column, level: int = 5) -> Column:
    """array<array<double>>: a window's bands, details first; null for windows under eight samples or with nulls."""

    @pandas_udf("array<array<double>>")
    def transformed(windows: pd.Series) -> pd.Series:
        return by_length(windows, lambda m: [[b for b in row] for row in modwt(m, level).transpose(1, 0, 2)], LEAST)

    return transformed(w)


def wavelet_statistics(w: Column, level: int = 5) -> Column:
    """array<array<double>>: the five statistics of every band, in the order of ``bands``."""

    @pandas_udf("array<array<double>>")
    def measured(windows: pd.Series) -> pd.Series:
        return by_length(windows, lambda m: [[b for b in row] for row in band_statistics(modwt(m, level)).transpose(1, 0, 2)], LEAST)

    return measured(w)


def feature_names(level: int = 5) -> list[str]:
    """Columns of ``wavelet_features`` for windows that allow ``level`` levels, in order."""
    own = [f"modwt_{b}_{s}" for b in band_names(level) for s in STATISTICS]
    return [*own, "modwt_levels", "modwt_total_energy", *(f"modwt_{b}_rel_energy" for b in band_names(level)), "modwt_energy_ratio_hf_lf", "modwt_max_energy_level"]


def wavelet_features(statistics: Column, level: int = 5) -> list[Column]:
    """The columns of ``feature_names`` from ``wavelet_statistics``; bands that the window is too short for are null.

    The ratio sets the two finest bands against the smooth; the level of most energy is that of a detail, from 1, and
    the first of equals wins.
    """
    have = F.size(statistics) - 1  # levels of this window
    energies = F.transform(statistics, lambda s: s[0])
    total = F.aggregate(energies, F.lit(0.0), lambda s, x: s + x)
    place = lambda b: F.lit(b) if b < level else F.size(statistics) - 1
    at = lambda b: F.when((F.lit(b) < have) | F.lit(b == level), F.get(statistics, place(b)))
    own = [F.get(at(b), k) for b in range(level + 1) for k in range(len(STATISTICS))]
    relative = [F.get(at(b), 0) / (total + 1e-12) for b in range(level + 1)]
    fine = F.get(energies, 0) + F.when(have > 1, F.get(energies, 1)).otherwise(0.0)
    ratio = fine / (F.get(energies, have) + 1e-12)
    details = F.when(have > 0, F.slice(energies, 1, F.greatest(have, F.lit(1))))
    top = F.array_position(details, F.array_max(details))
    columns = [*own, F.when(have >= 0, have).cast("double"), total, *relative, ratio, top.cast("double")]
    return [c.alias(n) for c, n in zip(columns, feature_names(level), strict=True)]
