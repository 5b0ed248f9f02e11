"""Recordings inside binary files: a file is opened in the task that reads it, and given back as rows."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def realworld_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, body_part, idx, x, y, z) of the CSVs in zip files, with columns attr_x, attr_y and attr_z.

    The body part is what follows the last underscore of a CSV's name with two underscores or more, else the name.
    """

    def unpacked(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.endswith(".csv"):
                            stem = member.rsplit("/", 1)[-1][:-4]
                            body = stem.rsplit("_", 1)[-1] if stem.count("_") >= 2 else stem
                            with archive.open(member) as f:
                                for part in pd.read_csv(f, chunksize=100_000):
                                    yield pd.DataFrame({"file": name, "body_part": body, "idx": part.index.astype("int64"), **{a: part[f"attr_{a}"].astype(float) for a in "xyz"}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpacked, "file string, body_part string, idx long, x double, y double, z double")


def npz(spark: SparkSession, path: str, key: str = "signal") -> DataFrame:
    """(file, channel, idx, value) of one array of each NPZ file; a file without it is an error that lists what it has."""

    def unpacked(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    if key not in data:
                        raise KeyError(f"{name} has no {key}, but {sorted(data.keys())}")
                    values = np.asarray(data[key], float)
                values = values.reshape(len(values), -1)
                for channel in range(values.shape[1]):
                    yield pd.DataFrame({"file": name, "channel": channel, "idx": np.arange(len(values)), "value": values[:, channel]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpacked, "file string, channel int, idx long, value double")
