"""Sharding by fixed virtual slots, in DataFrame functions only.

Records are hashed into thousands of virtual slots for good. A small, versioned table maps slots to shards; placing and
rebalancing edit that table, by the bytes in each slot, and never the hash. Version 1 deals slots round; each
rebalancing adds a version in which overloaded shards have given slots away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.sources.scratch import shared_folder, written

SLOTS, SHARDS, OVERHEAD = 8192, 40, 16
RUN = 1 << 16  # rows that are wholly alike and numbered by one task


def record_size(text: str | Column, overhead: int = OVERHEAD) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead."""
    column = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(column.cast("string")), F.lit(0)) + overhead).cast("long")


def virtual_slot(id_col: str, text_crc: Column, copy: Column, slots: int = SLOTS) -> Column:
    """Slot of a record, by its id, its text's checksum and its number among rows that are wholly alike.

    So neither a frequent text nor a null id nor a row that is repeated often fills a slot.
    """
    key = F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_crc.cast("string"), F.when(copy > 0, copy.cast("string")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: (version, v_slot, shard), slots dealt round."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("v_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map's next version under ``loads`` (v_slot, bytes), for ``shards`` shards; slots without load count 0.

    A shard keeps its slots, the largest first, as long as they fit into the mean load; what does not fit, and all
    slots of shards numbered ``shards`` or higher, goes to whichever shard is least loaded, the largest first. Loads
    then differ by no more than the slots moved last. The table has a row for each slot, whatever the corpus, so one
    row may gather it.
    """
    filled = slot_map.join(loads.select("v_slot", "bytes"), "v_slot", "left").select(F.col("version").cast("int").alias("version"), F.col("v_slot").cast("int").alias("v_slot"), F.col("shard").cast("int").alias("shard"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    mean = filled.agg((F.sum("bytes") / shards).alias("mean"))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "v_slot").rowsBetween(Window.unboundedPreceding, 0))
    judged = filled.withColumn("running", running).crossJoin(F.broadcast(mean)).withColumn("stays", (F.col("shard") < shards) & (F.col("running") <= F.col("mean")))
    kept = judged.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("load"))
    move = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "v_slot"))))
    moving = judged.agg(move.alias("moving"))
    # Every shard has a load, also one that no slot maps to yet.
    every = judged.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left")
    start = every.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("load", F.lit(0)).cast("long").alias("load"), "shard"))).alias("loads"))
    # One step: the least loaded shard, which is the first, takes the slot; the loads are sorted again.
    step = lambda s, x: F.struct(
        F.array_sort(F.transform(s["loads"], lambda y, i: F.when(i == 0, F.struct((y["load"] - x["less"]).alias("load"), y["shard"].alias("shard"))).otherwise(y))).alias("loads"),
        F.concat(s["taken"], F.array(F.struct(x["v_slot"].alias("v_slot"), s["loads"][0]["shard"].alias("to")))).alias("taken"),
    )
    none = F.expr("cast(array() as array<struct<v_slot:int,to:int>>)")
    placed = moving.crossJoin(start).select(F.explode(F.aggregate("moving", F.struct("loads", none.alias("taken")), step)["taken"]).alias("m")).select("m.v_slot", "m.to")
    return judged.join(placed, "v_slot", "left").select((F.col("version") + 1).alias("version"), "v_slot", F.coalesce("to", "shard").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; a version that is there already is written again, which makes retries safe."""
    slot_map.write.partitionBy("version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def has_map(spark: SparkSession, path: str) -> bool:
    """Whether a map is stored there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the newest."""
    stored = spark.read.parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).head()[0]
    return stored.where(F.col("version") == version).select("version", "v_slot", "shard")


def numbered_copies(records: DataFrame, columns: list[str], copy: str) -> DataFrame:
    """``columns`` of every record and its number, from 0, among those that are wholly alike.

    Alike records are counted, not gathered; the counts are laid out again in runs of RUN rows, so the rows of a count of
    any size are made by many tasks.
    """
    runs = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__n") - 1).cast("long"), F.lit(RUN).cast("long")))
    laid = runs.select(*columns, "__n", first.alias("__first"))
    many = laid.where(f"__n > {RUN}").repartition(*columns, "__first")
    every = F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + RUN, F.col("__n")) - 1))
    return laid.where(f"__n <= {RUN}").unionAll(many).select(*columns, every.alias(copy))


def sharded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, v_slot, shard, slot, and the map's version.

    The map is read from ``map_path``, in its newest version, and stored there in the next one, rebalanced for these
    documents; where nothing is stored yet, version 1 is stored first. Without a path it lies in the session's shared folder.

    Sizes of shards come near equal (law ``bytes``): they differ by about the smallest slots, as long as no single
    record exceeds a shard's mean. ``slot`` numbers a shard's rows from 0 without gaps, by virtual slot, then id,
    checksum, size and copy. Equal texts (groups) have equal checksums and sizes, and are spread by their ids, as a group
    may be larger than a shard; rows that are wholly alike are spread too. Null texts have size ``OVERHEAD`` and the
    checksum of the empty text. An empty table gives an empty result; columns other than the two named are ignored. The
    texts are read once, for a narrow table of records that is written to the shared folder.
    """
    spark, path = documents.sparkSession, map_path or f"{shared_folder(documents.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    crc = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    records = documents.select(F.col(id_col).alias("__id"), record_size(text_col).alias("size"), crc.alias("text_crc32"))
    copies = numbered_copies(records, ["__id", "size", "text_crc32"], "__copy")
    rows = written(copies.withColumn("v_slot", virtual_slot("__id", F.col("text_crc32"), F.col("__copy"), slots)))
    loads = written(rows.groupBy("v_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    if not has_map(spark, path):
        store_map(first_map(spark, slots, shards), path)
    store_map(rebalanced(read_map(spark, path), loads, shards), path)
    mapped = read_map(spark, path)
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("v_slot").rowsBetween(Window.unboundedPreceding, -1))
    places = mapped.join(loads.select("v_slot", "n"), "v_slot").withColumn("__ahead", F.coalesce(ahead, F.lit(0)))
    # ``places`` has ``slots`` rows at most; rows are numbered within virtual slots, which are many and small.
    inside = F.row_number().over(Window.partitionBy("v_slot").orderBy("__id", "text_crc32", "size", "__copy"))
    return rows.withColumn("__inside", inside).join(F.broadcast(places), "v_slot").select(
        F.col("__id").alias(id_col), "size", "text_crc32", "v_slot", "shard", (F.col("__ahead") + F.col("__inside") - 1).alias("slot"), "version",
    )


def sharding(documents: DataFrame) -> DataFrame:
    """The production query."""
    return sharded(documents).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "v_slot", "version",
    )
