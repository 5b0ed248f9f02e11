"""Feature families of windows, picked by flags; families that are not asked for are not computed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.functions import allan, quality, spectrum, time, wavelet
from vibrata.operators import divergences, signals, windows


@dataclass(frozen=True)
class Families:
    """Which features a window gets. The defaults are those of the extractor."""

    quantiles: tuple[float, ...] = time.QUANTILES
    bands: tuple[tuple[float, float], ...] = ()
    spectrum: bool = True
    allan: bool = True
    taus: tuple[float, ...] | None = None
    wavelet_level: int | None = 5
    signal_quality: bool = True
    divergence: bool = False

    def names(self, size: int, fs: float) -> list[str]:
        """The feature columns of windows of ``size`` samples, in order."""
        own = ["mean", "variance", "rms", "skewness", "kurtosis", "zcr", *(f"quantile_{int(q * 100)}" for q in self.quantiles)]
        if self.spectrum:
            own += [*spectrum.NAMES, *(spectrum.band_name(a, b) for a, b in self.bands)]
        if self.allan and size >= allan.LEAST:
            own += allan.feature_names(size, fs, list(self.taus) if self.taus else None)
        if self.wavelet_level and size >= wavelet.LEAST:
            own += wavelet.feature_names(wavelet.levels(size, self.wavelet_level))
        if self.signal_quality and size >= quality.LEAST:
            own += list(quality.NAMES)
        return own


def window_features(table: DataFrame, size: int, fs: float, families: Families = Families(), w: str = "value", reference: DataFrame | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``table`` with the features of its array ``w`` of ``size`` samples; ``keep`` are the columns kept.

    Windows with nulls have null features. Each family is one column that Catalyst computes once and takes apart; only
    spectra, Allan deviations and wavelets go to Python, a batch of windows at a time. With ``families.divergence``,
    ``reference`` holds the reference distributions (band, centers, probs).
    """
    keep = [c for c in table.columns if c != w] if keep is None else list(keep)
    level = wavelet.levels(size, families.wavelet_level or 0) if size >= wavelet.LEAST and families.wavelet_level else 0
    with_allan = families.allan and size >= allan.LEAST
    taus = list(families.taus) if families.taus else None
    out = table.withColumn("__time", time.moments(F.col(w), families.quantiles))
    columns: list[Column] = [F.col("__time")[n].alias(n) for n in ("mean", "variance", "rms", "skewness", "kurtosis", "zcr", *(f"quantile_{int(q * 100)}" for q in families.quantiles))]
    if families.spectrum:
        out = out.withColumn("__psd", spectrum.welch(F.col(w), fs))
        out = out.withColumn("__freq", spectrum.frequencies(F.col(w), fs))
        columns += spectrum.spectral_features(F.col("__freq"), F.col("__psd"), families.bands)
    if with_allan:
        out = out.withColumn("__adev", allan.allan_deviation(F.col(w), fs, taus))
        columns += allan.allan_features(F.col("__adev"), size, fs, taus)
    if level:
        out = out.withColumn("__bands", wavelet.wavelet_statistics(F.col(w), level))
        columns += wavelet.wavelet_features(F.col("__bands"), level)
    if families.signal_quality and size >= quality.LEAST:
        out = out.withColumn("__sq", quality.signal_quality(F.col(w)))
        columns += [F.col("__sq")[n].alias(n) for n in quality.NAMES]
    if families.divergence and reference is not None:
        out = divergences.with_window_divergence(out, reference, families.wavelet_level or 5, w)
        columns += [F.col(n) for n in divergences.WINDOW_SUMMARY]
    return out.select(*keep, *columns)


@dataclass(frozen=True)
class FeatureExtractor:
    """Windows and features of all signals of a table at one sample rate."""

    fs: float
    families: Families = field(default_factory=Families)

    def process(self, samples: DataFrame, keys: Sequence[str], window_sec: float, step_sec: float, normalize: bool = False, reference: DataFrame | None = None, value: str = "value", idx: str = "idx") -> DataFrame:
        """keys, window_start_sample, window_start_sec and features, a row for each whole window.

        ``normalize`` turns each signal into deviations from its mean first. An empty table, or signals shorter than a
        window, give no rows.
        """
        size, step = windows.samples_of(window_sec, self.fs), windows.samples_of(step_sec, self.fs)
        source = signals.normalised(samples, keys, value) if normalize else samples
        cut = windows.sliding(source.withColumn(value, signals.nan_to_null(value)), keys, size, step, idx, (value,))
        cut = cut.withColumn("window_start_sec", F.col("window_start_sample") / F.lit(float(self.fs)))
        return window_features(cut, size, self.fs, self.families, value, reference, [*keys, "window_start_sample", "window_start_sec"])

    def process_whole(self, arrays: DataFrame, size: int, value: str = "value") -> DataFrame:
        """Features of signals that are given as arrays of one length, without windowing."""
        return window_features(arrays, size, self.fs, self.families, value)
