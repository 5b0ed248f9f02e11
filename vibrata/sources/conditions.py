"""Recordings of several sensors under several conditions, a CSV for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The conditions in order, with revolutions a minute, and the columns that a file must have.
CONDITIONS = {"stationary": 0, "40_rpm": 40, "80_rpm": 80, "120_rpm": 120, "160_rpm": 160, "200_rpm": 200}
REQUIRED = ("Time_ms", "CalAX", "CalAY", "CalAZ", "CalGX", "CalGY", "CalGZ", "RawAX", "RawAY", "RawAZ", "RawGX", "RawGY", "RawGZ")
AXES = {"AccX": "CalAX", "AccY": "CalAY", "AccZ": "CalAZ", "GyroX": "CalGX"}
TRIADS = {
    "cal_acc_norm_mean": ("CalAX", "CalAY", "CalAZ"), "raw_acc_norm_mean": ("RawAX", "RawAY", "RawAZ"),
    "cal_gyro_norm_mean": ("CalGX", "CalGY", "CalGZ"), "raw_gyro_norm_mean": ("RawGX", "RawGY", "RawGZ"),
}


def default_patterns(sensors: Sequence[str]) -> dict[tuple[str, str], str]:
    """(sensor, condition) -> glob of its file's name."""
    return {(s, c): f"{s.lower()}_{c}_*.csv" for s in sensors for c in CONDITIONS}


def discovered(spark: SparkSession, root: str, patterns: dict[tuple[str, str], str]) -> dict[tuple[str, str], str]:
    """The file of each pattern, by the file system of ``root``; anything but one match is an error."""
    jvm = spark.sparkContext._jvm
    found = {}
    for cell, pattern in patterns.items():
        glob = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
        matches = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
        if len(matches) != 1:
            raise FileNotFoundError(f"{pattern} has {len(matches)} matches under {root}, and needs one")
        found[cell] = matches[0].getPath().toString()
    return found


def recordings(spark: SparkSession, root: str, patterns: dict[tuple[str, str], str], required: Sequence[str] = REQUIRED) -> DataFrame:
    """sensor, condition and the required columns (Time_ms as long, the rest as doubles) of all files.

    Each file's header is checked for the columns; their order may differ from file to file.
    """
    every = None
    for (sensor, condition), path in discovered(spark, root, patterns).items():
        raw = spark.read.option("header", True).csv(path)
        missing = sorted(set(required) - set(raw.columns))
        if missing:
            raise ValueError(f"{path} lacks {missing}")
        cast = lambda c: F.col(c).cast(T.LongType() if c == "Time_ms" else T.DoubleType()).alias(c)
        one = raw.select(F.lit(sensor).alias("sensor"), F.lit(condition).alias("condition"), *(cast(c) for c in required))
        every = one if every is None else every.unionByName(one)
    return every


def condition_table(spark: SparkSession, conditions: dict[str, int] = CONDITIONS) -> DataFrame:
    """condition, condition_label, rpm, ord."""
    rows = [(c, c.replace("_", " ").title() if not rpm else f"{rpm} RPM", rpm, i) for i, (c, rpm) in enumerate(conditions.items())]
    return spark.createDataFrame(rows, "condition string, condition_label string, rpm int, ord int")
