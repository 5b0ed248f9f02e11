"""The test tables as signals: a sensor is an event type, its samples are ordered by time, and users stand for conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.operators.extract import Families, FeatureExtractor
from vibrata.operators.signals import indexed
from vibrata.sources.scratch import written

FS = 100.0
CELLS_KEYS = ["signal_id", "condition"]
WEEK = 7 * 86400.0
#: Plain features of short windows, for what is done with feature tables.
PLAIN = Families(spectrum=False, allan=False, wavelet_level=None, signal_quality=False)
PLAIN_NAMES = PLAIN.names(64, FS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, condition, ts, value, k)."""
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("signal_id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("condition"), "ts", "value", k.alias("k"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, idx, value)."""
    return indexed(events(spark, sf_dir).select("signal_id", "ts", "value"), ["signal_id"], "ts", WEEK).select("signal_id", "idx", "value")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, condition, idx, value, k), numbered inside each cell."""
    return indexed(events(spark, sf_dir), ["signal_id", "condition"], "ts", WEEK).drop("ts")


def plain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, condition, window_start_sample, window_start_sec, plain features) of windows of 64 samples every 32.

    Written once, as what is done with feature tables reads them several times.
    """
    return written(FeatureExtractor(FS, PLAIN).process(cells(spark, sf_dir), ["signal_id", "condition"], 0.64, 0.32))


def rounded(table: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, without negative zeros, so that engines that add in another order agree."""
    tidy = lambda c: (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)
    return table.select(*(tidy(c) if kind == "double" else F.col(c) for c, kind in table.dtypes))


def unit(value: Column) -> Column:
    return F.round(value, 6)
