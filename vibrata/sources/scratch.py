"""Tables that are written once and read again, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``, removed when the driver ends.

    A local session that names no such folder, as in tests, gets a temporary one; on a cluster that is an error, as its
    executors and its driver share no machine's folders.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    folder = context._jsc.sc().getCheckpointDir().get()
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(table: DataFrame) -> DataFrame:
    """``table``, written as Parquet and read again: computed once, whatever reads it and however often.

    Row numbers and other values that depend on the order of rows are settled by it, and a lost executor costs a read.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def removed(spark: SparkSession, table: DataFrame) -> None:
    """Remove a table that ``written`` gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
