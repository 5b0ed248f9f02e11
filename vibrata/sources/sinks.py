"""Results as files: small tables as one CSV each, and a JSON of what was selected and calibrated."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_table(table: DataFrame, path: str, files: int = 1) -> None:
    """A CSV with a header. Summaries are small; give more ``files`` for tables that are not."""
    table.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_summary(spark: SparkSession, root: str, results: dict[str, DataFrame], record: dict) -> None:
    """summary.json and a folder for each of the tables under ``root``."""
    for name, table in results.items():
        write_table(table, f"{root.rstrip('/')}/{name}")
    write_json(spark, record, f"{root.rstrip('/')}/summary.json")
