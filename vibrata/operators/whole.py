"""Features of whole signals that are never one array: stretches are worked on apart and what they give is merged.

Moments and extremes merge as aggregates, quantiles come from counts in order, spectra are averages of segments, wavelet
statistics sums over coefficients, and Allan deviations sums over blocks of phases that meet at an offset.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from vibrata.functions import allan, quality, spectrum, time, wavelet
from vibrata.functions.arrays import slope, std_pop
from vibrata.operators import divergences, windows
from vibrata.operators.extract import Families
from vibrata.operators.joins import looked_up
from vibrata.operators.running import quantiles
from vibrata.operators.signals import with_length
from vibrata.sources.scratch import written

ROWS = 1 << 16  # samples of a stretch
PHASES = 1 << 14  # phases of a block
LAGS = quality.REPEATS  # earlier samples that a sample comes with


def sound_signals(samples: DataFrame, keys: Sequence[str], value: str = "value", idx: str = "idx") -> DataFrame:
    """(keys, idx, value) of the signals without a null, NaN or infinite value; only finite signals have features."""
    x = F.col(value).cast("double")
    odd = F.coalesce((F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    bad = samples.groupBy(*keys).agg(F.max(odd).alias("__odd"))
    return looked_up(samples.select(*keys, F.col(idx).cast("long").alias("idx"), x.alias("value")), bad, keys).where("NOT __odd").drop("__odd")


def with_earlier(samples: DataFrame, keys: Sequence[str], lags: int = LAGS, rows: int = ROWS) -> DataFrame:
    """Samples with x1, x2, ...: the values one, two and so on before; null before the signal's first.

    Each stretch gets the last ``lags`` samples of the one before besides, so stretches need nothing else.
    """
    own = F.floor(F.col("idx") / rows)
    both = F.array_compact(F.array(own, F.when(F.col("idx") >= (own + 1) * rows - lags, own + 1)))
    copies = samples.select(*keys, "idx", "value", F.explode(both).alias("__stretch"))
    inside = Window.partitionBy(*keys, "__stretch").orderBy("idx")
    found = copies.select("*", *(F.lag("value", k).over(inside).alias(f"x{k}") for k in range(1, lags + 1)))
    return found.where(F.col("idx") >= F.col("__stretch") * rows).drop("__stretch")


def time_features(stepped: DataFrame, keys: Sequence[str], wanted: tuple[float, ...] = time.QUANTILES) -> DataFrame:
    """keys and the features of ``time.moments``, from samples with the one before."""
    x = F.col("value")
    changes = F.sum(F.when(F.col("x1").isNotNull(), (F.signum(x) != F.signum("x1")).cast("double")))
    found = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.sqrt(F.avg(x * x)).alias("rms"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), changes.alias("changes")
    )
    n, flat, g1, g2 = F.col("n"), F.col("variance") <= time.FLAT, F.col("g1"), F.col("g2")
    skew = F.when(flat, 0.0).when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(g1)
    kurt = F.when(flat, 0.0).when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)).otherwise(g2)
    zcr = F.when(n > 1, F.col("changes") / (n - 1)).otherwise(0.0)
    plain = found.select(*keys, "mean", "variance", "rms", skew.alias("skewness"), kurt.alias("kurtosis"), zcr.alias("zcr"))
    return looked_up(plain, quantiles(stepped.select(*keys, "value"), keys, "value", {f"quantile_{int(q * 100)}": q for q in wanted}), keys)


def densities(samples: DataFrame, keys: Sequence[str], fs: float, segment: int = spectrum.SEGMENT) -> DataFrame:
    """keys, freqs, densities: Welch's estimate over a whole signal, the mean of the spectra of its segments.

    Segments are windows; signals shorter than one are a segment as they are. Signals under two samples have none.
    """
    long = windows.sliding(samples, keys, segment, segment - segment // 2).select(*keys, "value")
    few = with_length(samples, keys).where((F.col("__n") < segment) & (F.col("__n") > 1))
    short = few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda r: r["value"]).alias("value"))
    one = long.unionByName(short).select(*keys, F.posexplode(spectrum.welch(F.col("value"), fs, segment)).alias("bin", "p"), F.least(F.size("value"), F.lit(segment)).alias("size"))
    averaged = one.groupBy(*keys, "bin").agg(F.avg("p").alias("p"), F.max("size").alias("size"))
    rows = averaged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "p"))).alias("rows"), F.max("size").alias("size"))  # segment / 2 + 1 at most
    return rows.select(*keys, F.transform("rows", lambda r: r["bin"] * F.lit(float(fs)) / F.col("size")).alias("freqs"), F.transform("rows", lambda r: r["p"]).alias("densities"))


def quality_features(stepped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the features of ``quality.signal_quality``, from samples with the three before; null under eight samples."""
    x, d = F.col("value"), F.col("value") - F.col("x1")
    same = [F.coalesce(a == b, F.lit(False)) for a, b in ((x, F.col("x1")), (F.col("x1"), F.col("x2")), (F.col("x2"), F.col("x3")))]
    third, first_third = same[0] & same[1], same[0] & same[1] & ~same[2]  # of equal samples in a row
    plain = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("v"), F.var_pop(d).alias("vd"), F.covar_pop(x, F.col("idx").cast("double")).alias("cov"), F.var_pop("idx").alias("vi"),
        F.sum(third.cast("long") + F.when(first_third, 2).otherwise(0)).alias("gone"),
    )
    n, noise = F.col("n"), F.col("vd") / 2
    snr = F.when(noise < 1e-20, 60.0).when(F.col("v") < 1e-20, -60.0).otherwise(10 * F.log10(F.col("v") / noise))
    straight = F.when((F.col("v") * n < 1e-12) | (n < 3), 1.0).otherwise(F.col("cov") * F.col("cov") / F.nullif(F.col("v") * F.col("vi"), F.lit(0.0)))
    told = plain.select(*keys, n.alias("n"), (F.col("gone") / n).alias("sq_dropout_rate"), snr.alias("sq_snr"), straight.alias("sq_response_linearity"))
    steps = stepped.where("x1 IS NOT NULL").select(*keys, d.alias("d"))
    middle = quantiles(steps, keys, "d", {"m": 0.5})
    spread = quantiles(looked_up(steps, middle, keys).select(*keys, F.abs(F.col("d") - F.col("m")).alias("d")), keys, "d", {"mad": 0.5})
    noise_floor = spread.select(*keys, (F.col("mad") * (1.4826 / 2**0.5)).alias("sq_noise_floor"))
    sized = looked_up(stepped.select(*keys, "idx", "value"), plain.select(*keys, "n"), keys)
    quarter = F.floor(n / 4)
    means = [F.avg(F.when(F.floor(F.col("idx") / F.greatest(quarter, F.lit(1))) == i, x)) for i in range(4)]
    stable = F.when(quarter < 2, 0.0).otherwise(std_pop(F.array(*(f"a{i}" for i in range(4)))))
    base = sized.groupBy(*keys, "n").agg(*(m.alias(f"a{i}") for i, m in enumerate(means))).select(*keys, stable.alias("sq_baseline_stability"))
    # Half-overlapping eighths: window k begins at k * step.
    size = F.greatest(F.floor(n / 8), F.lit(4))
    step = F.greatest(F.floor(size / 2), F.lit(1))
    low, high = F.greatest(F.ceil((F.col("idx") - size + 1) / step), F.lit(0)), F.least(F.floor(F.col("idx") / step), F.floor((n - size) / step))
    parts = sized.where(n >= size).select(*keys, x, F.explode(F.when(low <= high, F.sequence(low, high))).alias("window"))
    ranges = parts.groupBy(*keys, "window").agg((F.max("value") - F.min("value")).alias("range"))
    varied = ranges.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.avg("range").alias("m"), F.stddev_pop("range").alias("s"))
    peaks = varied.select(*keys, F.when((F.col("c") < 2) | (F.col("m") < 1e-12), 0.0).otherwise(F.col("s") / F.col("m")).alias("sq_peak_consistency"))
    out = told
    for more in (noise_floor, base, peaks):
        out = looked_up(out, more, keys, "left")
    return out.select(*keys, *(F.when(n >= quality.LEAST, F.col(c)).alias(c) for c in quality.NAMES))


def wavelet_features(samples: DataFrame, keys: Sequence[str], level: int = 5) -> DataFrame:
    """keys and the features of ``wavelet.wavelet_features``; signals under eight samples have no row."""
    long = with_length(samples, keys).where(F.col("__n") >= wavelet.LEAST).drop("__n")
    coefs = written(divergences.long_modwt(long, keys, level).select(*keys, "band", "coef"))
    own, c = [*keys, "band"], F.col("coef")
    sums = coefs.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.sum(c * c).alias("energy"), F.var_pop(c).alias("variance"), F.sqrt(F.avg(c * c)).alias("rms"), F.kurtosis(c).alias("peaked"))
    share = F.greatest(c * c / (F.col("energy") + 1e-12), F.lit(1e-12))
    entropy = looked_up(coefs, sums.select(*own, "energy"), own).groupBy(*own).agg((-F.sum(share * F.log2(share))).alias("entropy"))
    kurtosis = F.when((F.col("n") < 4) | (F.sqrt("variance") < 1e-12), 0.0).otherwise(F.col("peaked"))
    told = looked_up(sums.withColumn("kurtosis", kurtosis), entropy, own)
    last = F.col("band").startswith("A")
    rows = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(last.alias("last"), "band", F.array(*wavelet.STATISTICS).alias("s")))).alias("rows"))  # a row for each band
    return rows.withColumn("s", F.transform("rows", lambda r: r["s"])).select(*keys, *wavelet.wavelet_features(F.col("s"), level))


def phase_blocks(samples: DataFrame, keys: Sequence[str], fs: float, block: int = PHASES) -> DataFrame:
    """keys, n, block, base, values: a block's samples over the rate, and their sum before the block."""
    rows = with_length(samples, keys).groupBy(*keys, F.col("__n").alias("n"), F.floor(F.col("idx") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    filled = rows.select(*keys, "n", "block", F.transform("rows", lambda r: r["value"] / F.lit(float(fs))).alias("values"))
    once = written(filled.withColumn("sum", F.aggregate("values", F.lit(0.0), lambda s, v: s + v)))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = once.select(*keys, "block", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("base"))  # a row for each block
    return looked_up(once.drop("sum"), base, [*keys, "block"])


def allan_deviations(samples: DataFrame, keys: Sequence[str], fs: float, taus: Sequence[float] | None = None, count: int = 10, block: int = PHASES) -> DataFrame:
    """keys, m, tau, adev: overlapping Allan deviations of whole signals, as ``allan.deviations`` gives them for windows.

    Without ``taus`` each signal has ``count`` of them, spaced by its own length. Phases lie in blocks; for strides of up to
    half a block a task takes a block and the one behind it, for longer ones, stride by stride, a block with the parts of
    the up to four blocks that begin one and two strides later. Signals that allow no stride have no rows.
    """
    given = list(taus) if taus is not None else None

    @pandas_udf("array<long>")
    def strides(n: pd.Series) -> pd.Series:
        asked = {int(k): given if given is not None else allan.default_taus(int(k), fs, count) for k in set(n)}
        return pd.Series([allan.strides(asked[int(k)], int(k), fs) if len(asked[int(k)]) > 1 else [] for k in n])

    blocks = phase_blocks(samples, keys, fs, block).withColumn("ms", strides("n"))
    near = F.filter("ms", lambda m: 2 * m <= block)
    far = F.filter("ms", lambda m: 2 * m > block)
    place = lambda at, m, ms: F.struct(at.cast("long").alias("target"), m.cast("long").alias("m"), ms.alias("near"))
    none = F.array().cast("array<long>")
    here = F.when(F.size(near) > 0, F.filter(F.array(place(F.col("block"), F.lit(0), near), place(F.col("block") - 1, F.lit(0), near)), lambda p: p["target"] >= 0)).otherwise(F.array().cast("array<struct<target:bigint,m:bigint,near:array<bigint>>>"))

    def shifted(m: Column) -> Column:
        """The targets whose phases, or those one or two strides behind them, lie in this block."""
        ends = [(F.floor((F.col("block") * block - r * m) / block), F.floor(((F.col("block") + 1) * block - r * m) / block)) for r in range(3)]
        return F.transform(F.array_distinct(F.array(*(e for pair in ends for e in pair))), lambda t: place(t, m, none))

    there = F.filter(F.flatten(F.transform(far, shifted)), lambda p: (p["target"] >= 0) & (p["target"] * block + 2 * p["m"] <= F.col("n")))
    dealt = blocks.select(*keys, "n", "block", "base", "values", F.explode(F.concat(here, there)).alias("p")).select(*keys, "n", "block", "base", "values", "p.target", F.col("p.m").alias("m"), "p.near")

    def summed(own: pd.DataFrame) -> pd.DataFrame:
        n, target, m = int(own["n"].iloc[0]), int(own["target"].iloc[0]), int(own["m"].iloc[0])
        pieces = {int(b): np.concatenate([[base], base + np.cumsum(v)]) for b, base, v in zip(own["block"], own["base"], own["values"], strict=True)}

        def phases(start: int, stop: int) -> np.ndarray:
            """Phases start to stop; a block's last is the next one's first, and only the signal's last lies nowhere else."""
            parts, at = [], start
            while at < stop:
                b = at // block if at // block in pieces else at // block - 1
                end = min(stop, (b + 1) * block if at // block == b else at + 1)
                parts.append(pieces[b][at - b * block : end - b * block])
                if not len(parts[-1]):  # the signal's last phase, behind its last sample
                    parts[-1] = pieces[b][-1:]
                at += len(parts[-1])
            return np.concatenate(parts)

        out = []
        for stride in [m] if m else [int(x) for x in own["near"].iloc[0]]:
            first, last = target * block, min((target + 1) * block, n - 2 * stride + 1)
            if last > first:
                second = phases(first + 2 * stride, last + 2 * stride) - 2 * phases(first + stride, last + stride) + phases(first, last)
                out.append((*(own[k].iloc[0] for k in keys), stride, float((second**2).sum()), len(second)))
        return pd.DataFrame(out, columns=[*keys, "m", "squares", "terms"])

    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    sums = dealt.groupBy(*keys, "m", "target").applyInPandas(summed, f"{kinds}, m long, squares double, terms long")
    total = sums.groupBy(*keys, "m").agg(F.sum("squares").alias("squares"), F.sum("terms").alias("terms"))
    tau = F.col("m") / F.lit(float(fs))
    return total.select(*keys, "m", tau.alias("tau"), (F.sqrt(F.col("squares") / F.col("terms") / 2) / tau).alias("adev"))


def allan_features(deviations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, adev (tau and deviation, ascending) and adev_slope, null under three taus."""
    rows = deviations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tau", "adev"))).alias("adev"))  # a row for each tau
    log = lambda field: F.transform("adev", lambda x: F.log10(x[field]))
    return rows.withColumn("adev_slope", F.when(F.size("adev") > 2, slope(log("tau"), log("adev"))))


def whole_features(samples: DataFrame, keys: Sequence[str], fs: float, families: Families = Families(), idx: str = "idx", value: str = "value", rows: int = ROWS) -> DataFrame:
    """keys, n_samples and features, a row for each signal: the families that ``extract.window_features`` has for arrays.

    Signals may be of any length each. Allan deviations, whose taus differ by signal, are one array ``adev``, with
    ``adev_slope``. Signals with a null, NaN or infinite value have null features, and so have those that are too short for
    a family. Samples are numbered from 0 without gaps; an empty table gives no rows.
    """
    own = [f"__key{i}" for i in range(len(keys))]  # a key may have any name
    named = samples.select(*(F.col(k).alias(c) for k, c in zip(keys, own, strict=True)), F.col(idx).alias("idx"), F.col(value).alias("value"))
    sound = written(sound_signals(named, own))
    stepped = written(with_earlier(sound, own, LAGS, rows))
    out = named.groupBy(*own).agg(F.count(F.lit(1)).alias("n_samples"))
    parts = [time_features(stepped, own, families.quantiles)]
    if families.spectrum:
        f, p = F.col("freqs"), F.col("densities")
        parts.append(densities(sound, own, fs).select(*own, *spectrum.spectral_features(f, p, families.bands)))
    if families.allan:
        parts.append(allan_features(allan_deviations(sound, own, fs, families.taus), own))
    if families.wavelet_level:
        parts.append(wavelet_features(sound, own, families.wavelet_level))
    if families.signal_quality:
        parts.append(quality_features(stepped, own))
    for part in parts:
        out = looked_up(out, part, own, "left")
    return out.select(*(F.col(c).alias(k) for c, k in zip(own, keys, strict=True)), *(f"`{c}`" for c in out.columns if c not in own))
