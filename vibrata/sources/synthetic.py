"""Seeded noise signals, white, brown and pink, alone or in the shape of given signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.functions.draws import normal
from vibrata.operators.joins import looked_up
from vibrata.operators.running import totals_before

KINDS = ("white", "brown", "pink")
OCTAVES = 16  # of pink noise: its power falls with frequency down to one in 2**OCTAVES samples


def noise_like(samples: DataFrame, keys: Sequence[str], mean: float = 0.0, std: float = 1.0, kind: str = "white", seed: int = 42, idx: str = "idx") -> DataFrame:
    """(keys, idx, value): for each sample of ``samples`` one of noise, with exactly this mean and population deviation in
    each signal (a deviation of 0 counts as 1).

    Each value is made of seeded draws by key and sample number, so any partitioning gives the same: white noise is one
    draw, brown noise the running sum of draws, and pink noise the sum of draws that are each held for twice as many
    samples as the one before. An empty table gives an empty result.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    own = [F.col(k) for k in keys]
    if kind == "pink":
        value = sum((normal(seed, [*own, F.lit(k), F.shiftright(F.col(idx), k)], "pink") for k in range(OCTAVES)), F.lit(0.0))
    else:
        value = normal(seed, [*own, F.col(idx)], kind)
    raw = samples.select(*keys, F.col(idx).cast("long").alias(idx)).select(*keys, idx, value.alias("value"))
    if kind == "brown":
        raw = totals_before(raw, keys, idx, ["value"]).select(*keys, idx, (F.col("before_value") + F.col("value")).alias("value"))
    stats = raw.groupBy(*keys).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    scale = F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return looked_up(raw, stats, keys).select(*keys, idx, ((F.col("value") - F.col("__m")) / scale * std + mean).alias("value"))


def noise(spark: SparkSession, samples: int, channels: int = 1, mean: float = 0.0, std: float = 1.0, kind: str = "white", seed: int = 42, partitions: int | None = None) -> DataFrame:
    """(channel, idx, value): ``noise_like`` for channels of as many samples each. One sample, or none, is allowed."""
    grid = spark.range(samples * channels, numPartitions=partitions)
    rows = grid.select((F.col("id") % channels).cast("int").alias("channel"), F.floor(F.col("id") / channels).alias("idx"))
    return noise_like(rows, ["channel"], mean, std, kind, seed)
