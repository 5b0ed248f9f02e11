"""Windows over long-form signals. A window is bounded, so its samples can be one array; a signal never is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.functions.draws import uniform
from vibrata.operators.signals import lengths, with_length


def samples_of(seconds: float, fs: float) -> int:
    n = int(seconds * fs)
    if n <= 0:
        raise ValueError("windows and steps need at least one sample")
    return n


def _gathered(placed: DataFrame, keys: Sequence[str], size: int, idx: str, values: Sequence[str], start: Column) -> DataFrame:
    """Arrays of the windows that have all ``size`` samples."""
    group = placed.groupBy(*keys, "__k").agg(F.sort_array(F.collect_list(F.struct(idx, *values))).alias("__rows"))
    whole = group.where(F.size("__rows") == size)
    return whole.select(*keys, start.alias("window_start_sample"), *(F.col(f"__rows.{v}").alias(v) for v in values))


def sliding(samples: DataFrame, keys: Sequence[str], size: int, step: int, idx: str = "idx", values: Sequence[str] = ("value",)) -> DataFrame:
    """keys, window_start_sample and the arrays ``values``: windows of ``size`` samples at 0, step, 2 step, ...

    The incomplete tail gives no window, nor does a shorter signal. Each sample goes to the few windows that it lies
    in, so only samples and their copies are shuffled and no task holds more than single windows. Null samples stay in
    place as nulls.
    """
    if size <= 0 or step <= 0:
        raise ValueError("windows and steps need at least one sample")
    first = F.greatest(F.ceil((F.col(idx) - (size - 1)) / step), F.lit(0))
    last = F.floor(F.col(idx) / step)
    k = F.explode(F.when(first <= last, F.sequence(first, last)))
    return _gathered(samples.select(*keys, idx, *values, k.alias("__k")), keys, size, idx, values, (F.col("__k") * step).cast("long"))


def tumbling(samples: DataFrame, keys: Sequence[str], size: int, idx: str = "idx", values: Sequence[str] = ("value",)) -> DataFrame:
    """Windows one after another; the tail is dropped."""
    return sliding(samples, keys, size, size, idx, values)


def at_starts(samples: DataFrame, starts: DataFrame, keys: Sequence[str], size: int, idx: str = "idx", values: Sequence[str] = ("value",)) -> DataFrame:
    """Windows at given starts: a table of keys, ``window`` (a number) and ``start``.

    Samples and starts meet in stretches of ``size`` samples: a window lies in two at most. Windows that reach beyond
    the signal are left out.
    """
    own = starts.select(*keys, "window", "start", F.explode(F.array(F.floor(F.col("start") / size), F.floor(F.col("start") / size) + 1)).alias("__stretch"))
    placed = samples.select(*keys, idx, *values).withColumn("__stretch", F.floor(F.col(idx) / size)).join(own, [*keys, "__stretch"])
    inside = placed.where((F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("start") + size)).withColumn("__k", F.struct("window", "start"))
    found = _gathered(inside, keys, size, idx, values, F.col("__k"))
    return found.select(*keys, "window_start_sample.window", F.col("window_start_sample.start").alias("window_start_sample"), *values)


def random_starts(samples: DataFrame, keys: Sequence[str], size: int, count: int, seed: int = 42) -> DataFrame:
    """keys, window, start: ``count`` starts in every signal that fits a window, with replacement, from seeded hashes (MD5)."""
    room = lengths(samples, keys, "__n").where(F.col("__n") >= size)
    drawn = room.select(*keys, "__n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("window"))
    share = uniform(seed, [F.col(k) for k in (*keys, "window")], "start")
    return drawn.select(*keys, "window", F.floor(share * (F.col("__n") - size + 1)).alias("start"))


def segments(samples: DataFrame, keys: Sequence[str], count: int, keep_rest: bool = True, idx: str = "idx", segment: str = "segment") -> DataFrame:
    """``samples`` with the number of their segment of n // count samples; the rest joins the last or is dropped.

    Signals with fewer than ``count`` samples have no segments.
    """
    sized = with_length(samples, keys).withColumn("__size", F.floor(F.col("__n") / count)).where(F.col("__size") > 0)
    number = F.floor(F.col(idx) / F.col("__size"))
    if keep_rest:
        sized = sized.withColumn(segment, F.least(number, F.lit(count - 1)).cast("int"))
    else:
        sized = sized.where(number < count).withColumn(segment, number.cast("int"))
    return sized.select(*samples.columns, segment)
