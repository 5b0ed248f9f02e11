"""Sensor recordings in text files as DataFrames: whitespace columns by position, CSV and Parquet by name.

Lines are split by Spark's text reader and stay JVM expressions. Row numbers, where a
format needs them, come with the file's name, as a file is one recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vibrata.operators.joins import looked_up
from vibrata.operators.signals import nan_to_null
from vibrata.sources.scratch import written


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value) of the lines that hold something; ``line_no`` rises within a file, with gaps."""
    read = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return read.where(F.trim("value") != "")


def parts(value: str | Column = "value") -> Column:
    """The whitespace-separated parts of a line."""
    return F.split(F.trim(F.col(value) if isinstance(value, str) else value), r"\s+")


def number(at: int, value: str = "__parts") -> Column:
    """A part as a double; missing parts and NaN are null, other words are an error."""
    return nan_to_null(F.get(value, at).cast("double"))


def whitespace_columns(table: DataFrame, columns: dict[str, int], value: str = "value") -> DataFrame:
    """``table`` without ``value``, with a double column for each name -> position."""
    split = table.withColumn("__parts", parts(value))
    return split.select(*(c for c in table.columns if c != value), *(number(i).alias(n) for n, i in columns.items()))


def cmapss(table: DataFrame, positions: Sequence[int] = tuple(range(5, 26))) -> DataFrame:
    """Engine degradation lines: sensors s<position>, as floats."""
    wide = whitespace_columns(table, {f"s{i}": i for i in positions})
    return wide.select(*(F.col(c).cast("float").alias(c) if c.startswith("s") and c[1:].isdigit() else F.col(c) for c in wide.columns))


# First positions of the three units of a PAMAP2 line, of which each has temperature and four triads.
PAMAP2_UNITS = {"hand": 3, "chest": 20, "ankle": 37}
PAMAP2_TRIADS = {"accel_16g": 1, "accel_6g": 4, "gyro": 7, "mag": 10}


def pamap2(table: DataFrame) -> DataFrame:
    """timestamp, activity (int), heart_rate, and for each unit its temperature and arrays of three for each triad."""
    split = table.withColumn("__parts", parts())
    units = [number(first).alias(f"{unit}_temp") for unit, first in PAMAP2_UNITS.items()]
    units += [F.array(*(number(first + at + i) for i in range(3))).alias(f"{unit}_{triad}") for unit, first in PAMAP2_UNITS.items() for triad, at in PAMAP2_TRIADS.items()]
    own = [c for c in table.columns if c != "value"]
    return split.select(*own, number(0).alias("timestamp"), number(1).cast("int").alias("activity"), number(2).alias("heart_rate"), *units)


# Columns of an SHL motion line.
SHL_COLUMNS = ("timestamp", "accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z")


def shl_motion(table: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The ten columns of lines without a NaN in any column; ``max_rows`` counts lines before that."""
    first = table.orderBy("line_no").limit(max_rows) if max_rows is not None else table
    split = first.withColumn("__parts", parts())
    sound = ~F.exists("__parts", lambda p: F.lower(p) == "nan")
    return split.where(sound).select(*(c for c in table.columns if c != "value"), *(number(i).alias(n) for i, n in enumerate(SHL_COLUMNS)))


# First positions of the body-worn units of an OPPORTUNITY line, and the place of its activity label.
OPPORTUNITY_UNITS = {"back": 37, "rua": 50, "rla": 63, "lua": 76, "lla": 89}
OPPORTUNITY_ACTIVITY = 243


def opportunity(table: DataFrame) -> DataFrame:
    """timestamp, nine columns for each unit, and activity_ml, null for lines that are too short to have one."""
    axes = [f"{kind}_{axis}" for kind in ("accel", "gyro", "mag") for axis in "xyz"]
    columns = {f"{unit}_{axis}": first + i for unit, first in OPPORTUNITY_UNITS.items() for i, axis in enumerate(axes)}
    wide = whitespace_columns(table, {"timestamp": 0, **columns, "activity_ml": OPPORTUNITY_ACTIVITY})
    return wide.withColumn("activity_ml", F.col("activity_ml").cast("int"))


# Signals of the HAR data set, which begin their files' names.
HAR_SIGNALS = ("total_acc_x", "total_acc_y", "total_acc_z", "body_gyro_x", "body_gyro_y", "body_gyro_z")
HAR_ROW = 128


def flattened_rows(rows: DataFrame, keys: Sequence[str], row: str, values: str, size: int, value: str = "value") -> DataFrame:
    """(keys, row, idx, value): arrays of ``size`` samples laid end to end, ``row`` being their number from 0."""
    flat = rows.select(*keys, row, F.posexplode(values).alias("__i", value))
    return flat.select(*keys, row, (F.col(row) * size + F.col("__i")).alias("idx"), F.col(value).cast("double").alias(value))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value) with rows numbered from 0 within one file, in its order.

    ``line_no`` rises with the place in the file. The lines are written once with it, as they are read both for the counts
    and for the rows, and then numbered in stretches.
    """
    read = written(lines(spark, path).select("line_no", "value"))
    # The upper part of a line's number is the split that it was read from, the lower one its place there.
    split = F.shiftright("line_no", 33).alias("__split")
    counts = read.groupBy(split).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__split").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split of a file
    starts = counts.select("__split", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__split").orderBy("line_no"))
    placed = looked_up(read.withColumn("__split", split).withColumn("__i", inside), starts, ["__split"])
    return placed.select((F.col("__before") + F.col("__i") - 1).alias("row"), "value")


def uci_har(spark: SparkSession, directory: str, split: str = "train", signals: Sequence[str] = HAR_SIGNALS) -> DataFrame:
    """(signal, row, idx, value, subject, activity): every row of 128 samples with its subject and activity."""
    parts_of = []
    for name in signals:
        rows = numbered_lines(spark, f"{directory}/{split}/Inertial Signals/{name}_{split}.txt")
        values = F.transform(parts(), lambda p: p.cast("double"))
        parts_of.append(flattened_rows(rows.select(F.lit(name).alias("signal"), "row", values.alias("__values")), ["signal"], "row", "__values", HAR_ROW))
    every = parts_of[0]
    for more in parts_of[1:]:
        every = every.unionByName(more)
    for name, file in (("subject", "subject"), ("activity", "y")):
        labels = numbered_lines(spark, f"{directory}/{split}/{file}_{split}.txt").select("row", F.trim("value").cast("int").alias(name))
        every = every.join(labels, "row")
    return every.select("signal", "row", "idx", "value", "subject", "activity")


def tabular(spark: SparkSession, path: str, time_column: str | None = None, channel_columns: Sequence[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV, TXT (with a header) or Parquet: the time column, if named, and the channels as floats.

    Channels are all other columns by default. Without ``schema`` a CSV's columns are read as strings and cast. The
    sample rate is ``signals.sample_rates`` of the time column.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        reader = spark.read.option("header", True)
        table = (reader.schema(schema) if schema else reader).csv(path)
    elif kind in ("parquet", "pq"):
        table = spark.read.parquet(path)
    else:
        raise ValueError(f"{path} is neither CSV, TXT nor Parquet")
    channels = list(channel_columns) if channel_columns is not None else [c for c in table.columns if c != time_column]
    time = [F.col(time_column)] if time_column else []
    return table.select(*time, *(F.col(c).cast("float").alias(c) for c in channels))
