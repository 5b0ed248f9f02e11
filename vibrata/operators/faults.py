"""Synthetic sensor faults on long-form signals, as column expressions.

Random draws are hashes of the seed, the signal's key and the sample's number, so any partitioning gives the same fault.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from vibrata.functions.draws import head, normal, normals, uniform, uniform_of, uniforms
from vibrata.operators.joins import looked_up
from vibrata.operators.signals import with_length

# The fault types.
FAULT_TYPES = ("noise_increase", "bias_drift", "spike_injection", "bandwidth_loss", "saturation", "gain_change")
#: Those that change each sample by itself.
POINTWISE = tuple(f for f in FAULT_TYPES if f != "bandwidth_loss")
LEAST = 4  # samples of a signal that can have a fault
STRETCH = 1 << 14
BLOCK = 1 << 12  # samples whose windows a row gives in ``injected_windows``
MOST_WIDTHS = 64  # severities of bandwidth loss that ``injected`` takes at once


def _mirrored(samples: DataFrame, reach: int, n: str, idx: str) -> DataFrame:
    """Copies of samples at the places before 0 and from n on that a box reaches, mirrored at the edges (``__at``)."""
    turns = F.floor(F.lit(reach) / F.col(n)) + 1
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(2 * F.col(n) * k + F.col(idx), 2 * F.col(n) * k - 1 - F.col(idx))))
    return samples.withColumn("__at", F.explode(F.filter(places, lambda p: (p >= -reach) & (p < F.col(n) + reach))))


def box_filtered(samples: DataFrame, keys: Sequence[str], widths: Sequence[int], n: str, idx: str = "idx", value: str = "value") -> DataFrame:
    """``samples`` with smooth_<w> for each width: the mean of w samples from idx - w // 2 on, mirrored at the edges.

    Moving frames run inside stretches of the signal, each with the few samples around it, so no task holds a whole
    signal and all widths share one shuffle. Null samples don't count.
    """
    reach = max(widths) // 2 + 1
    spread = _mirrored(samples, reach, n, idx)
    own = F.floor(F.col("__at") / STRETCH)
    edge = F.col("__at") - own * STRETCH
    stretches = F.array_compact(F.array(own, F.when(edge < reach, own - 1), F.when(edge >= STRETCH - reach, own + 1)))
    dealt = spread.withColumn("__stretch", F.explode(stretches))
    around = Window.partitionBy(*keys, "__stretch").orderBy("__at")
    means = [F.avg(value).over(around.rowsBetween(-(w // 2), w - 1 - w // 2)).alias(f"smooth_{w}") for w in sorted(set(widths))]
    inside = dealt.select("*", *means).where((F.col("__at") == F.col(idx)) & (F.col("__stretch") == own))
    return inside.drop("__at", "__stretch")


def box_width(severity: float) -> int:
    return int(3 + 20 * max(severity, 0.0))


def _stats(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Length, mean, deviation and largest size, a row a signal."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__mean"), (F.stddev_pop(value) + 1e-8).alias("__std"), F.max(F.abs(F.col(value))).alias("__peak"),
    )


def _measured(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``samples`` with their signal's length, mean, deviation and largest size."""
    return looked_up(samples, _stats(samples, keys, value), keys)


def _damped(measured: DataFrame, keys: Sequence[str], severities: Sequence[float], idx: str, value: str) -> DataFrame:
    """``measured`` with slow_<w> for the width of each severity: filtered, and set back to a part of its deviation."""
    widths = sorted({box_width(s) for s in severities})
    smooth = box_filtered(measured, keys, widths, "__n", idx, value)
    levels = smooth.groupBy(*keys).agg(*(f(f"smooth_{w}").alias(f"{name}_{w}") for w in widths for name, f in (("level", F.avg), ("spread", F.stddev_pop))))
    slow = lambda w: (F.col(f"smooth_{w}") - F.col(f"level_{w}")) * (F.col("__std") / (F.col(f"spread_{w}") + 1e-8)) * 0.6 + F.col("__mean")
    return looked_up(smooth, levels, keys).select(*measured.columns, *(slow(w).alias(f"slow_{w}") for w in widths))


def _hurt(fault: Column, severity: Column, severities: Sequence[float], signal: Sequence[Column], seed: int, idx: str, value: str, signs: Column | None, branches: Column | None, older: bool) -> Column:
    """A sample's value under a fault. Only the branch of the fault is computed, and only its draws are made."""
    x, s, d = F.col(value), F.greatest(severity.cast("double"), F.lit(0.0)), F.col("__std")
    u = F.col(idx) / F.greatest(F.col("__n") - 1, F.lit(1))
    sample = [*signal, F.col(idx)]
    sign = signs if signs is not None else F.when(uniform(seed, signal, "sign") < 0.5, -1.0).otherwise(1.0)
    falls = branches if branches is not None else uniform(seed, signal, "gain") < 0.5
    grown = F.pow(u, F.lit(1.5))
    noise = x + normal(seed, sample, "noise") * (0.5 + 2.5 * grown) * d * s
    drift = x + sign * 3.0 * d * s * grown
    size = 3 + 3 * uniform(seed, sample, "size")
    spike = F.when(uniform(seed, sample, "spike") < 0.02 * s + 0.08 * s * u, x + F.when(uniform(seed, sample, "side") < 0.5, -1.0).otherwise(1.0) * size * d * s).otherwise(x)
    scale = F.greatest(F.col("__peak"), d, F.lit(1e-8))
    limit = F.least(F.greatest(0.95 - 0.30 * s, F.lit(0.12)), F.lit(0.95)) * scale
    step = F.greatest(scale * (0.01 + 0.02 * s), F.lit(1e-8))
    clipped = F.least(F.greatest(x, -limit), limit)
    if older:
        middle, bound = F.col("__mean"), F.greatest(2.0 - 1.2 * s, F.lit(0.3)) * d
        saturated = F.least(F.greatest(x, middle - bound), middle + bound)
        gained = (x - middle) * F.when(falls, F.greatest(F.lit(0.2), 1 - 0.6 * s)).otherwise(1 + 0.8 * s) + middle
    else:
        saturated = F.when(s > 0, F.rint(clipped / step) * step).otherwise(clipped)
        gained = x * F.when(falls, F.greatest(F.lit(0.1), 1 - 0.45 * s)).otherwise(1 + 1.2 * s)
    slow = F.lit(None).cast("double")
    for w in sorted({box_width(v) for v in severities}):
        slow = F.when(F.floor(3 + 20 * s) == w, F.col(f"slow_{w}")).otherwise(slow)
    told = (
        F.when(fault == "noise_increase", noise).when(fault == "bias_drift", drift).when(fault == "spike_injection", spike)
        .when(fault == "saturation", saturated).when(fault == "gain_change", gained).when(fault == "bandwidth_loss", slow).otherwise(x)
    )
    return F.when(x.isNotNull(), told)


def injected(samples: DataFrame, keys: Sequence[str], fault: Column, severity: Column, seed: int = 42, idx: str = "idx", value: str = "value", signs: Column | None = None, branches: Column | None = None, older: bool = False) -> DataFrame:
    """``samples`` with faults in their values; ``fault`` and ``severity`` may differ between keys, not inside one.

    Severities below 0 count as 0; signals under four samples stay as they are; an unknown type is an error. At
    severity 0 noise, drift, spikes and gain change nothing, while saturation clips at 0.95 of the largest size and
    bandwidth loss filters by three samples. ``signs`` (of a drift) and ``branches`` (whether the gain falls) are drawn
    for each key unless given. Null samples stay null. The severities of bandwidth losses must be few, as each has a
    column of its own. ``older`` takes the older rules of saturation and gain, which work about the signal's mean.
    """
    known = F.when(fault.isin(*FAULT_TYPES), fault).otherwise(F.raise_error(F.concat(F.lit("unknown fault type "), F.coalesce(fault, F.lit("null")))))
    rows = _measured(samples, keys, value).withColumn("__sev", severity.cast("double")).withColumn("__fault", F.when(F.col("__n") < LEAST, F.lit("none")).otherwise(known))
    slow = samples.where(fault == "bandwidth_loss").select(severity.cast("double")).distinct().limit(MOST_WIDTHS + 1).collect()
    severities = sorted({r[0] or 0.0 for r in slow})
    if len(severities) > MOST_WIDTHS:
        raise ValueError(f"over {MOST_WIDTHS} severities of bandwidth loss at once")
    if severities:
        rows = _damped(rows, keys, severities, idx, value)
    told = _hurt(F.col("__fault"), F.col("__sev"), severities, [F.col(k) for k in keys], seed, idx, value, signs, branches, older)
    return rows.withColumn(value, told).select(*samples.columns)


def injected_cells(
    samples: DataFrame, keys: Sequence[str], faults: Sequence[str] = FAULT_TYPES, severities: Sequence[float] = (2.0,), trials: int | None = None,
    seed: int = 42, idx: str = "idx", value: str = "value", older: bool = False,
) -> DataFrame:
    """A copy of ``samples`` under each fault and severity (and trial), with columns fault_type, severity (and trial).

    Lengths, deviations and filtered values are those of the signal, so they are taken before the samples are copied. The
    draws of a cell are hashes of the keys and the cell, as if ``injected`` had them all as keys.
    """
    unknown = sorted(set(faults) - set(FAULT_TYPES))
    if unknown:
        raise ValueError(f"unknown fault types {unknown}")
    rows = _measured(samples, keys, value)
    slow = severities if "bandwidth_loss" in faults else ()
    if slow:
        rows = _damped(rows, keys, slow, idx, value)
    cell = ["fault_type", "severity", *(["trial"] if trials is not None else [])]
    every = [(f, float(s), t) for f in faults for s in severities for t in range(trials if trials is not None else 1)]
    cells = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(c, cell, strict=False))) for c in every))
    copies = rows.withColumn("__cell", F.explode(cells)).select(*rows.columns, "__cell.*")
    fault = F.when(F.col("__n") < LEAST, F.lit("none")).otherwise(F.col("fault_type"))
    told = _hurt(fault, F.col("severity"), slow, [F.col(c) for c in (*keys, *cell)], seed, idx, value, None, None, older)
    return copies.withColumn(value, told).select(*samples.columns, *cell)


def _hurt_values(fault: str, s: float, start: str, x: np.ndarray, idx: np.ndarray, n: int, d: float, peak: float) -> np.ndarray:
    """``_hurt`` in numpy, for the pointwise faults by their present rules: samples ``x`` with numbers ``idx`` of a signal."""
    s = max(s, 0.0)
    u = idx / max(n - 1, 1)
    if fault == "noise_increase":
        return x + normals(start, idx, "noise") * (0.5 + 2.5 * u**1.5) * d * s if s > 0 or not np.isfinite(d) else x
    if fault == "bias_drift":
        return x + (-1.0 if uniform_of(start, "sign") < 0.5 else 1.0) * 3.0 * d * s * u**1.5
    if fault == "spike_injection":
        hit = np.flatnonzero(uniforms(start, idx, "spike") < 0.02 * s + 0.08 * s * u) if s > 0 else np.array([], int)
        told = x.copy()
        if len(hit):
            told[hit] += np.where(uniforms(start, idx[hit], "side") < 0.5, -1.0, 1.0) * (3 + 3 * uniforms(start, idx[hit], "size")) * d * s
        return told
    if fault == "saturation":
        scale = np.maximum(np.maximum(peak, d), 1e-8)
        limit, step = min(max(0.95 - 0.30 * s, 0.12), 0.95) * scale, np.maximum(scale * (0.01 + 0.02 * s), 1e-8)
        clipped = np.minimum(np.maximum(x, -limit), limit)
        return np.rint(clipped / step) * step if s > 0 else clipped
    return x * (max(0.1, 1 - 0.45 * s) if uniform_of(start, "gain") < 0.5 else 1 + 1.2 * s)


def injected_windows(
    samples: DataFrame, keys: Sequence[str], faults: Sequence[str], severities: Sequence[float], size: int, step: int,
    seed: int = 42, idx: str = "idx", value: str = "value", block: int = BLOCK,
) -> DataFrame:
    """keys, fault_type, severity, window_start_sample and the array ``value``: the windows of ``injected_cells``.

    They are those that ``windows.sliding`` cuts from the copies of the signal under each fault and severity, with NaN as
    null. A pointwise fault needs nothing but the sample and its signal's statistics, so the samples are not copied before
    they are shuffled: they are gathered once, in blocks that carry the samples that their last windows reach, and each
    block gives the windows of all cells. Draws are hashes as in ``injected_cells``, made in numpy.
    """
    unknown = sorted(set(faults) - set(POINTWISE))
    if unknown:
        raise ValueError(f"not pointwise fault types {unknown}")
    if size <= 0 or step <= 0:
        raise ValueError("windows and steps need at least one sample")
    long = step * -(-max(block, size) // step)
    own = F.floor(F.col(idx) / long)
    before = F.when((own > 0) & (F.col(idx) - own * long < size - step), own - 1)
    copies = samples.select(*keys, F.col(idx).cast("long").alias("__idx"), F.col(value).cast("double").alias("__x"), F.explode(F.array_compact(F.array(own, before))).alias("__block"))
    blocks = copies.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(F.struct("__idx", "__x"))).alias("__rows"))
    every = [(f, float(s)) for f in faults for s in severities]
    starts = F.array(*(head(seed, [*(F.col(f"`{k}`") for k in keys), F.lit(f), F.lit(s)]) for f, s in every))
    sized = looked_up(blocks, _stats(samples, keys, value), keys)
    rows = sized.select(*keys, (F.col("__block") * long).alias("__first"), "__n", "__std", "__peak", F.col("__rows.__idx").alias("__idx"), F.col("__rows.__x").alias("__x"), starts.alias("__starts"))
    kinds = StructType([*(samples.schema[k] for k in keys), StructField("fault_type", StringType()), StructField("severity", DoubleType()), StructField("window_start_sample", LongType()), StructField(value, ArrayType(DoubleType()))])
    named = list(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = {c: batch.column(c).to_pylist() for c in ("__first", "__n", "__std", "__peak", "__starts")}
            for i in range(batch.num_rows):
                numbers, x = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("__idx", "__x"))
                first, n, d, peak, starts = (told[c][i] for c in ("__first", "__n", "__std", "__peak", "__starts"))
                d, peak = (np.nan if v is None else v for v in (d, peak))  # of a signal that is all null
                # Windows that start in the block and have all their samples, by the place of their first in the arrays.
                whole = np.flatnonzero(numbers[size - 1 :] - numbers[: len(numbers) - size + 1] == size - 1) if len(numbers) >= size else np.array([], int)
                at = whole[(numbers[whole] % step == 0) & (numbers[whole] < first + long)]
                if not len(at):
                    continue
                takes = at[:, None] + np.arange(size)
                for (fault, severity), start in zip(every, starts, strict=True):
                    hurt = _hurt_values(fault, severity, start, x, numbers, n, d, peak) if n >= LEAST else x
                    flat = pa.array(hurt[takes].ravel(), pa.float64(), from_pandas=True)
                    same = pa.array(np.full(len(at), i))
                    arrays = [*(batch.column(k).take(same) for k in named), pa.array([fault] * len(at)), pa.array(np.full(len(at), severity)), pa.array(numbers[at]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * size + 1, size), pa.int32()), flat)]
                    yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return rows.mapInArrow(cut, kinds)


DEGRADATIONS = ("noise_increase", "bias_drift", "bandwidth_loss", "spike_injection")


def degraded(samples: DataFrame, keys: Sequence[str], mode: str, severity: float = 1.0, seed: int = 42, idx: str = "idx", value: str = "value") -> DataFrame:
    """The plainer degradations, which grow over the signal: noise, squared drift, a widening local mean, spikes of 5.

    The local mean reaches half of 1 + 20 * severity * idx / n samples to each side, cut off at the signal's ends.
    """
    if mode not in DEGRADATIONS:
        raise ValueError(f"unknown degradation {mode}")
    rows = with_length(samples.withColumn(value, F.col(value).cast("double")), keys)
    t = F.col(idx) / F.greatest(F.col("__n") - 1, F.lit(1))
    sample = [*(F.col(k) for k in keys), F.col(idx)]
    if mode == "bandwidth_loss":
        widest = int(1 + severity * 20) // 2
        half = F.floor(F.greatest(F.floor(1 + severity * 20 * (F.col(idx) / F.col("__n"))), F.lit(1)) / 2)
        return _local_means(rows, keys, half, widest, idx, value).select(*samples.columns)
    x = F.col(value)
    told = {
        "noise_increase": x + normal(seed, sample, "noise") * (3.0 * severity) * t,
        "bias_drift": x + 2.0 * severity * t * t,
        "spike_injection": F.when(uniform(seed, sample, "spike") < 0.02 * severity * t, x + F.when(uniform(seed, sample, "side") < 0.5, -5.0).otherwise(5.0)).otherwise(x),
    }[mode]
    return rows.withColumn(value, told).select(*samples.columns)


def _local_means(rows: DataFrame, keys: Sequence[str], half: Column, widest: int, idx: str, value: str) -> DataFrame:
    """``rows`` with ``value`` as the mean of the samples up to ``half`` (at most ``widest``) places to either side.

    A moving frame for each half width runs inside stretches with margins; each sample takes the one of its own.
    """
    own = F.floor(F.col(idx) / STRETCH)
    edge = F.col(idx) - own * STRETCH
    stretches = F.array_compact(F.array(own, F.when(edge < widest, own - 1), F.when(edge >= STRETCH - widest, own + 1)))
    around = Window.partitionBy(*keys, "__stretch").orderBy(idx)
    dealt = rows.withColumn("__stretch", F.explode(stretches))
    told = F.lit(None).cast("double")
    for h in range(widest + 1):
        told = F.when(half == h, F.avg(value).over(around.rowsBetween(-h, h))).otherwise(told)
    return dealt.withColumn("__local", told).where(F.col("__stretch") == own).withColumn(value, F.col("__local"))


def linear_drift(samples: DataFrame, keys: Sequence[str], severity: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """A straight drift up to ``severity`` times the signal's range."""
    stats = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), (F.max(value) - F.min(value)).alias("__range"))
    t = F.col(idx) / F.greatest(F.col("__n") - 1, F.lit(1))
    return looked_up(samples, stats, keys).withColumn(value, F.col(value) + severity * F.col("__range") * t).select(*samples.columns)


def added_noise(samples: DataFrame, keys: Sequence[str], severity: float, seed: int = 42, idx: str = "idx", value: str = "value") -> DataFrame:
    """White noise of ``severity`` population deviations of the signal, the same all along it."""
    stats = samples.groupBy(*keys).agg(F.stddev_pop(value).alias("__std"))
    draw = normal(seed, [*(F.col(k) for k in keys), F.col(idx)], "noise")
    return looked_up(samples, stats, keys).withColumn(value, F.col(value) + draw * severity * F.col("__std")).select(*samples.columns)


#: What a sweep may raise by steps: noise in deviations and a straight drift in ranges of the signal.
SWEEPS = {"noise": added_noise, "drift": linear_drift}


def swept(samples: DataFrame, keys: Sequence[str], severities: dict[str, Sequence[float]], idx: str = "idx", value: str = "value") -> DataFrame:
    """``samples`` once for each severity of each sweep of SWEEPS that is named, with ``sweep`` and ``severity``.

    The same draws are used at every severity of noise, so a sweep changes nothing but the amount.
    """
    steps = [(name, float(severity)) for name, some in severities.items() for severity in some]
    if not steps:
        raise ValueError("a sweep needs a severity")
    every = None
    for name, severity in steps:
        one = SWEEPS[name](samples, keys, severity, idx=idx, value=value).withColumn("sweep", F.lit(name)).withColumn("severity", F.lit(severity))
        every = one if every is None else every.unionByName(one)
    return every
