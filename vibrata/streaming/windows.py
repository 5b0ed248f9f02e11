"""Windows over streams: tumbling and sliding windows of time, and windows of a count of samples kept in state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from vibrata.operators.joins import looked_up
from vibrata.operators.windows import sliding


def timed(samples: DataFrame, key: str, time: str, value: str, length: str = "3 seconds", step: str | None = "1500 milliseconds", late: str = "10 seconds", whole: int | None = None) -> DataFrame:
    """(key, window_start, array) of event-time windows; ``whole`` keeps those with that many samples only.

    Samples that come later than ``late`` behind the newest are dropped; a window is given out once, when it is past
    that. At a fixed rate a window of ``length`` has a fixed number of samples.
    """
    span = F.window(time, length, step) if step else F.window(time, length)
    rows = samples.withWatermark(time, late).groupBy(key, span.alias("__w")).agg(F.sort_array(F.collect_list(F.struct(time, value))).alias("__rows"))
    cut = rows.select(key, F.col("__w.start").alias("window_start"), F.transform("__rows", lambda r: r[value]).alias(value))
    return cut.where(F.size(value) == whole) if whole is not None else cut


def timed_totals(samples: DataFrame, key: str, time: str, value: str, length: str, step: str | None = None, late: str = "10 seconds") -> DataFrame:
    """(key, window_start, n, total) of the windows of ``timed``, for windows whose number of samples has no bound.

    Counts and sums are combined before the shuffle and no samples are gathered. A null value makes its window's total null.
    """
    span = F.window(time, length, step) if step else F.window(time, length)
    total = F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))
    rows = samples.withWatermark(time, late).groupBy(key, span.alias("__w")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
    return rows.select(key, F.col("__w.start").alias("window_start"), "n", "total")


def counted(samples: DataFrame, key: str, time: str, value: str, size: int, step: int) -> DataFrame:
    """(key, window_start_sample, array): windows of ``size`` samples every ``step``, across micro-batches.

    The state of a key is the tail that coming windows need, under size + step samples. Samples are taken in the order
    of time within a micro-batch; what comes later for an earlier time counts as newer.
    """

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)  # ``seen`` numbers the first held sample
        rows = pd.concat(list(batches)).sort_values([time, value])
        held += [float(x) for x in rows[value]]
        out = []
        while True:
            start = -(-seen // step) * step
            if start + size > seen + len(held):
                break
            at = start - seen
            out.append((name[0], start, held[at : at + size]))
            drop = min(start + step - seen, len(held))
            held, seen = held[drop:], seen + drop
        state.update((held, seen))
        yield pd.DataFrame(out, columns=[key, "window_start_sample", value])

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, time, value).groupBy(key).applyInPandasWithState(
        advance, f"`{key}` {kind}, window_start_sample long, `{value}` array<double>", "held array<double>, seen long", "append", GroupStateTimeout.NoTimeout,
    )


def counted_in_order(samples: DataFrame, key: str, time: str, value: str, size: int, step: int, late: str = "10 seconds") -> DataFrame:
    """(key, window_start_sample, array): as ``counted``, in the order of event time whatever the order of arrival.

    Samples wait in state until the watermark, ``late`` behind the newest time of all keys, has passed them: then nothing
    earlier can come any more, and they go into windows by time, equal times by value. A key without new samples is
    woken by a timer when the watermark passes its next waiting one. What comes later than ``late`` is dropped and
    counted (``late_rows``). The state of a key is the samples of ``late`` and the tail of ``counted``, in one task's memory;
    ``replayed_in_order`` is for more. ``time`` is a timestamp; null keys, times and values are left out.
    """

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen, times, values = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in state.get) if state.exists else ([], 0, [], [])
        waiting = list(zip(times, values, strict=True))
        for rows in batches if not state.hasTimedOut else ():
            waiting += zip(rows["__micros"].tolist(), rows[value].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = sum(1 for t, _ in waiting if t < passed * 1000)
        held += [float(x) for _, x in waiting[:ready]]
        waiting = waiting[ready:]
        out = []
        while (start := -(-seen // step) * step) + size <= seen + len(held):
            at = start - seen
            out.append((name[0], start, held[at : at + size]))
            drop = min(start + step - seen, len(held))
            held, seen = held[drop:], seen + drop
        state.update((held, seen, [t for t, _ in waiting], [float(x) for _, x in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed) + 1)
        yield pd.DataFrame(out, columns=[key, "window_start_sample", value])

    kind = samples.schema[key].dataType.simpleString()
    sound = samples.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull()).withWatermark(time, late)
    return sound.select(key, time, F.unix_micros(F.col(time)).alias("__micros"), F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(
        advance, f"`{key}` {kind}, window_start_sample long, `{value}` array<double>", "held array<double>, seen long, times array<long>, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def session_totals(samples: DataFrame, key: str, time: str, value: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """(key, session_start, session_end, n, total) of sessions that a pause of ``gap`` or more ends, across micro-batches.

    The counterpart over streams of ``temporal.sessions``; ends are the first and last sample's time. Spark's session
    windows go on over a pause of exactly their gap, so theirs is a microsecond shorter. State is a row for
    each open session: samples of a batch are merged into it and into each other before they are stored. A session is
    given out, in append mode, once the watermark has passed its end; samples later than ``late`` are dropped and counted
    (``late_rows``). Null keys and times belong to no session; null values count as 0.
    """
    sound = samples.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    last = F.max(time)
    rows = sound.withWatermark(time, late).groupBy(key, F.session_window(time, f"{gap} -1 microseconds").alias("__s")).agg(F.min(time).alias("session_start"), last.alias("session_end"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"))
    return rows.select(key, "session_start", "session_end", "n", "total")


def lateness(table: DataFrame, time: str) -> str:
    """How late rows of a finite ``table`` can come at most, in whatever order its parts are streamed."""
    first, last = table.agg(F.min(F.unix_micros(F.col(time))), F.max(F.unix_micros(F.col(time)))).head()
    return f"{(last - first) // 1000 + 1 if first is not None else 0} milliseconds"


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators have dropped as too late, over the progress that is kept."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def replayed(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """The last result of a finite stream, run to its end: each batch's result is written to ``folder``, for ``complete``
    the last one counts and else all together."""

    def stored(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'last' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).foreachBatch(stored).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/*")


def replayed_in_order(samples: DataFrame, key: str, time: str, value: str, size: int, step: int, folder: str, late: str = "10 seconds", span: str = "1 minute") -> DataFrame:
    """(key, window_start_sample, array) of ``counted_in_order`` of a finite stream, run to its end, for any number of samples.

    Samples wait in a row of state for each key and ``span`` of time, 16 bytes each, so a key's waiting samples are dealt to
    all tasks. A span is given out, in order, once the watermark has passed its end; what comes for it later is dropped.
    Each batch writes its spans to ``folder`` and numbers their samples by the counts of the spans before; windows are cut as
    those of a table. From one batch to the next goes a row for each key: the count of its samples, and the samples (under
    size + step) that coming windows need.
    """
    spark = samples.sparkSession
    sound = samples.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull()).withWatermark(time, late)
    # Two lists of the same rows in the same order: a list of structs would take twice the bytes.
    lists = F.collect_list(F.unix_micros(F.col(time))).alias("__times"), F.collect_list(F.col(value).cast("double")).alias("__values")
    spans = sound.groupBy(key, F.window(time, span).alias("__w")).agg(*lists)
    ordered = F.transform(F.sort_array(F.arrays_zip("__times", "__values")), lambda r: r["__values"])
    spans = spans.select(key, F.unix_micros("__w.start").alias("__span"), ordered.alias("__values"))
    kept = StructType([spans.schema[key], *StructType.fromDDL("__n long, __rest array<struct<idx: long, v: double>>").fields])

    def stored(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/spans/{number}")
        own = spark.read.schema(spans.schema).parquet(f"{folder}/spans/{number}")
        before = spark.read.schema(kept).parquet(f"{folder}/kept/{number - 1}") if number else spark.createDataFrame([], kept)
        if own.isEmpty():
            before.write.mode("overwrite").parquet(f"{folder}/kept/{number}")
            return
        counts = own.select(key, "__span", F.size("__values").cast("long").alias("__n"))
        earlier = before.select(key, F.col("__n").alias("__seen"))
        running = F.sum("__n").over(Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.withColumn("__offset", F.coalesce(running, F.lit(0))).join(earlier, key, "left")
        offsets = offsets.select(key, "__span", (F.col("__offset") + F.coalesce("__seen", F.lit(0))).alias("__offset"))
        placed = looked_up(own, offsets, [key, "__span"])
        rows = lambda table: table.select(key, "__offset", F.posexplode("__values").alias("i", value)).select(key, (F.col("__offset") + F.col("i")).alias("idx"), value)
        rest = before.select(key, F.explode("__rest").alias("__r")).select(key, F.col("__r.idx").alias("idx"), F.col("__r.v").alias(value))
        sliding(rows(placed).unionByName(rest), [key], size, step, values=(value,)).write.mode("overwrite").parquet(f"{folder}/found/{number}")
        every = before.select(key, "__n").unionByName(counts.select(key, "__n")).groupBy(key).agg(F.sum("__n").alias("__n"))
        coming = every.withColumn("__next", F.greatest(F.ceil((F.col("__n") - size + 1) / step) * step, F.lit(0)).cast("long"))
        last = looked_up(placed, coming.drop("__n"), [key]).where(F.col("__offset") + F.size("__values") > F.col("__next")).drop("__next")
        ends = looked_up(rows(last).unionByName(rest), coming.drop("__n"), [key]).where("idx >= __next")
        ends = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("__rest"))
        every.join(ends, key, "left").select(key, "__n", "__rest").write.mode("overwrite").parquet(f"{folder}/kept/{number}")

    query = spans.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(stored).start()
    query.awaitTermination()
    found = StructType([spans.schema[key], *StructType.fromDDL(f"window_start_sample long, `{value}` array<double>").fields])
    spark.createDataFrame([], found).write.parquet(f"{folder}/found/none")  # so that there is a folder
    return spark.read.schema(found).parquet(f"{folder}/found/*")


def scored(windows: DataFrame, features, calibration: DataFrame, selection: Sequence[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Health of streamed windows: ``features`` gives their feature columns, and the fitted model is small and stated.

    Stateless, so it runs on any stream of windows; ``calibration`` is the one row of ``fit_calibration``.
    """
    table = features(windows)
    z = F.array(*(F.abs((F.col(n) - F.lit(stats[n][0])) / F.lit(stats[n][1])) for n in selection))
    sound = F.filter(z, lambda x: x.isNotNull() & ~F.isnan(x))
    raw = F.aggregate(sound, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(sound), F.lit(0))
    fitted = calibration.head()
    excess = F.greatest(F.col("qv_health_score_raw") - F.lit(fitted["healthy_threshold"]), F.lit(0.0))
    return table.withColumn("qv_health_score_raw", raw).withColumn("qv_health_score", 1 / (1 + excess / F.lit(max(fitted["healthy_scale"], 1e-12))))
