"""Long-form signals: numbering, filtering, cropping and normalising samples.

A signal is the rows of one key (one or more columns); ``idx`` numbers its samples from 0 without gaps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.operators.joins import looked_up
from vibrata.operators.running import quantiles

STRETCH = 1 << 16  # rows of a stretch, on average, where nothing else is asked for
MOST_STRETCHES = 1 << 12  # whose cuts are sought at once


def nan_to_null(value: str | Column) -> Column:
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(column), column)


def _place(samples: DataFrame, order: str) -> Column:
    """``order`` as a double: seconds, where it is a timestamp."""
    is_time = samples.schema[order].dataType.typeName().startswith("timestamp")
    return F.unix_micros(F.col(order).cast("timestamp")) / 1e6 if is_time else F.col(order).cast("double")


def stretched(samples: DataFrame, order: str, spread: float | None = None, stretch: str = "__stretch", rows: int = STRETCH) -> DataFrame:
    """``samples`` with the number of the stretch of ``order`` that they lie in, each ``spread`` long.

    Without ``spread`` two passes over ``order`` find approximate quantiles that cut all samples into stretches of ``rows``
    each, about, however unevenly they are spread; beyond MOST_STRETCHES stretches they grow. Equal values of ``order`` are
    in one stretch, and later values in no earlier one. Rows without ``order`` have the last number.
    """
    place = _place(samples, order)
    if spread is not None:
        return samples.withColumn(stretch, F.floor(place / F.lit(float(spread))).cast("long"))
    placed = samples.withColumn("__place", place)
    parts = min(-(-placed.where("__place IS NOT NULL").count() // rows), MOST_STRETCHES)
    cuts = sorted(set(placed.approxQuantile("__place", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if not cuts:
        return placed.withColumn(stretch, F.lit(0).cast("long")).drop("__place")
    numbers = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__place", outputCol="__number", handleInvalid="keep").transform(placed)
    return numbers.withColumn(stretch, F.col("__number").cast("long")).drop("__place", "__number")


def indexed(samples: DataFrame, keys: Sequence[str], order: str, spread: float | None = None, idx: str = "idx") -> DataFrame:
    """``samples`` with ``idx`` in ascending ``order``, a number or timestamp that is unique within a key.

    ``spread`` is the length of order values (seconds for timestamps) that one task numbers at a time: a signal of any
    length is cut into such stretches, which are numbered apart and moved by the count of what lies before. Rows whose
    key or order is null belong to no signal and are left out.
    """
    rows = stretched(samples.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, order))), order, spread)
    counts = rows.groupBy(*keys, "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "__stretch", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(order))
    numbered = rows.withColumn("__inside", inside).join(starts, [*keys, "__stretch"])
    return numbered.select(*samples.columns, (F.col("__before") + F.col("__inside") - 1).alias(idx))


def renumbered(samples: DataFrame, keys: Sequence[str], idx: str = "idx", spread: int = 1 << 20) -> DataFrame:
    """Numbers samples anew, in the order of ``idx``, after some were dropped."""
    return indexed(samples.withColumnRenamed(idx, "__old"), keys, "__old", spread, idx).drop("__old")


def lengths(samples: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def only_labels(samples: DataFrame, label: str, wanted: Sequence) -> DataFrame:
    """Rows whose label is one of ``wanted``; null labels go."""
    return samples.where(F.col(label).isin(*wanted))


def finite(samples: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is neither null, NaN nor infinite."""
    return samples.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))


def with_length(samples: DataFrame, keys: Sequence[str], n: str = "__n") -> DataFrame:
    return looked_up(samples, lengths(samples, keys, n), keys)


def trimmed(samples: DataFrame, keys: Sequence[str], fs: float, start_sec: float = 60, end_sec: float = 30, idx: str = "idx") -> DataFrame:
    """Without the first and last seconds, numbered from 0; a signal no longer than both together stays whole."""
    head, tail = int(start_sec * fs), int(end_sec * fs)
    short = head + tail >= F.col("__n")
    kept = with_length(samples, keys).where(short | ((F.col(idx) >= head) & (F.col(idx) < F.col("__n") - tail)))
    return kept.withColumn(idx, F.when(short, F.col(idx)).otherwise(F.col(idx) - head)).select(*samples.columns)


def head(samples: DataFrame, seconds: float, fs: float, idx: str = "idx") -> DataFrame:
    return samples.where(F.col(idx) < int(seconds * fs))


def middle(samples: DataFrame, keys: Sequence[str], size: int, idx: str = "idx") -> DataFrame:
    """The ``size`` samples in the middle of each signal, numbered from 0; a shorter signal stays whole."""
    start = F.greatest(F.floor((F.col("__n") - size) / 2), F.lit(0))
    kept = with_length(samples, keys).where((F.col(idx) >= start) & (F.col(idx) < start + size))
    return kept.withColumn(idx, F.col(idx) - start).select(*samples.columns)


def long_channels(samples: DataFrame, keys: Sequence[str], channels: dict[str, str], channel: str = "channel", value: str = "value") -> DataFrame:
    """keys, channel, value: a row for each of the columns ``channels`` (name -> column), NaN as null."""
    pairs = F.array(*(F.struct(F.lit(name).alias(channel), nan_to_null(column).alias(value)) for name, column in channels.items()))
    return samples.select(*keys, F.explode(pairs).alias("__c")).select(*keys, f"__c.{channel}", f"__c.{value}")


def normalised(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values as deviations from the signal's mean in population standard deviations; a deviation of 0 counts as 1."""
    stats = samples.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    scale = F.when(F.col("__std") == 0, 1.0).otherwise(F.col("__std"))
    return looked_up(samples, stats, keys).withColumn(value, (F.col(value) - F.col("__mean")) / scale).select(*samples.columns)


def centred(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    means = samples.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    return looked_up(samples, means, keys).withColumn(value, F.col(value) - F.col("__mean")).select(*samples.columns)


def scaled(samples: DataFrame, factors: dict[str, float], channel: str = "channel", value: str = "value") -> DataFrame:
    """Values times their channel's factor (raw units to physical ones); channels without one keep theirs."""
    factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in factors.items() for x in pair)), F.col(channel)), F.lit(1.0))
    return samples.withColumn(value, F.col(value) * factor)


def sample_rates(samples: DataFrame, keys: Sequence[str], order: str, rate: str = "sample_rate", spread: float | None = None) -> DataFrame:
    """One over the exact median of the positive steps of ``order`` (seconds or a timestamp); no row where there is none.

    Steps are taken inside stretches (see ``stretched``) and, from each stretch's last value to the next one's first,
    between them, so no task walks a whole signal. Rows without ``order`` don't count.
    """
    sound = samples.where(F.col(order).isNotNull())
    rows = stretched(sound.select(*keys, _place(sound, order).alias("__at")), "__at", spread)
    inside = F.col("__at") - F.lag("__at").over(Window.partitionBy(*keys, "__stretch").orderBy("__at"))
    ends = rows.groupBy(*keys, "__stretch").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    between = F.col("__first") - F.lag("__last").over(Window.partitionBy(*keys, F.lit(0)).orderBy("__stretch"))
    steps = rows.select(*keys, inside.alias("__step")).unionByName(ends.select(*keys, between.alias("__step"))).where("__step > 0")
    return quantiles(steps, keys, "__step", {"__median": 0.5}).select(*keys, (1 / F.col("__median")).alias(rate))


def collected_channels(samples: DataFrame, keys: Sequence[str], least: int = 100, channel: str = "channel", value: str = "value") -> DataFrame:
    """Non-null samples of the signals that have at least ``least`` of them."""
    sound = samples.where(F.col(value).isNotNull())
    own = [*keys, channel]
    return with_length(sound, own).where(F.col("__n") >= least).drop("__n")
