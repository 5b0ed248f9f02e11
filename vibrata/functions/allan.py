"""Overlapping Allan deviation of windows of rates (frequency data).

With phases x, the running sums of the samples over the rate, starting at 0, and m samples in tau, the variance is the
mean of (x[i+2m] - 2 x[i+m] + x[i])^2 over all i, divided by 2 tau^2 (Riley, NIST SP 1065). Taus are whole numbers of
samples, m = floor(tau * rate); m of 0 and repeated m are left out, and so are taus with one term or none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vibrata.functions.arrays import slope
from vibrata.functions.batches import by_length

LEAST = 50  # samples of a window with Allan features


def default_taus(n: int, fs: float, count: int = 10) -> list[float]:
    """Logarithmically spaced from one sample to half the window, without the end."""
    longest = n / fs / 2
    return [float(t) for t in np.logspace(math.log10(1 / fs), math.log10(longest), count) if t < longest] if n > 1 else []


def strides(taus: list[float], n: int, fs: float) -> list[int]:
    """Distinct numbers of samples in ascending order that leave two terms at least."""
    # The small addition keeps 3 samples from becoming 2 where tau * fs falls just short of a whole number.
    return [m for m in sorted({int(math.floor(t * fs + 1e-9)) for t in taus}) if m > 0 and n - 2 * m + 1 > 1]


def deviations(windows: np.ndarray, fs: float, ms: list[int]) -> np.ndarray:
    """(rows, len(ms)) of a matrix of windows."""
    phase = np.concatenate([np.zeros((len(windows), 1)), np.cumsum(windows, 1) / fs], 1)
    found = []
    for m in ms:
        second = phase[:, 2 * m :] - 2 * phase[:, m:-m] + phase[:, : -2 * m]
        found.append(np.sqrt((second**2).mean(1) / 2) * fs / m)
    return np.stack(found, 1)


def allan_deviation(w: Column, fs: float, taus: list[float] | None = None) -> Column:
    """array<struct<tau, adev>> in ascending order; null with fewer than two taus asked, or none that can be had."""

    @pandas_udf("array<struct<tau: double, adev: double>>")
    def measured(windows: pd.Series) -> pd.Series:
        def work(m: np.ndarray) -> list:
            asked = taus if taus is not None else default_taus(m.shape[1], fs)
            ms = strides(asked, m.shape[1], fs)
            if len(asked) < 2 or not ms:
                return [None] * len(m)
            return [[{"tau": k / fs, "adev": float(x)} for k, x in zip(ms, row, strict=True)] for row in deviations(m, fs, ms)]

        return by_length(windows, work, 2)

    return measured(w)


def feature_names(n: int, fs: float, taus: list[float] | None = None) -> list[str]:
    """Columns for windows of n samples: taus to two decimals (the last of equal names counts), then the slope."""
    ms = strides(taus if taus is not None else default_taus(n, fs), n, fs)
    return [*dict.fromkeys(f"adev_{m / fs:.2f}s" for m in ms), "adev_slope"]


def allan_features(adev: Column, n: int, fs: float, taus: list[float] | None = None) -> list[Column]:
    """The columns of ``feature_names``; the slope is of log10 deviation on log10 tau, and needs three taus."""
    ms = strides(taus if taus is not None else default_taus(n, fs), n, fs)
    last = {f"adev_{m / fs:.2f}s": i for i, m in enumerate(ms)}
    log = lambda field: F.transform(adev, lambda x: F.log10(x[field]))
    steep = F.when(F.size(adev) > 2, slope(log("tau"), log("adev")))
    return [*(F.get(adev, i)["adev"].alias(name) for name, i in last.items()), steep.alias("adev_slope")]
