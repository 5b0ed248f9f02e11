"""Sessions and ordered windows over replayed streams against finished tables."""

import random

import pytest
from pyspark.sql import functions as F

from vibrata.operators import temporal
from vibrata.operators.signals import indexed
from vibrata.operators.windows import sliding
from vibrata.streaming.windows import counted_in_order, late_rows, lateness, replayed, replayed_in_order, session_totals

START = 1_700_000_000


def replay(spark, tmp_path, batches, name, make):
    """Rows that a query over files, one a batch, gives in append mode, and the query."""
    schema = "k string, ts timestamp, value double"
    rows = lambda b: spark.createDataFrame(b, "k string, s double, value double").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long") + START * 10**6).alias("ts"), "value")
    for b in batches:
        rows(b).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect(), query, rows([r for b in batches for r in b])


def test_shuffled_batches_give_the_windows_of_sorted_ones(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), float(i), float(rng.randrange(100))) for i in range(90)]
    rng.shuffle(rows)
    # Nothing is late within 100 seconds; the last batches only let the watermark pass everything else.
    batches = [rows[:25], rows[25:60], rows[60:], [("z", 1000.0, 0.0)], [("z", 2000.0, 0.0)]]
    got, _, _ = replay(spark, tmp_path, batches, "ordered", lambda s: counted_in_order(s, "k", "ts", "value", 8, 5, "100 seconds"))
    table = spark.createDataFrame(rows, "k string, s double, value double")
    want = sliding(indexed(table, ["k"], "s"), ["k"], 8, 5).collect()
    assert sorted((r.k, r.window_start_sample, r.value) for r in got) == sorted((r.k, r.window_start_sample, r.value) for r in want)


def test_streamed_sessions_equal_those_of_the_table_and_late_rows_are_counted(spark, tmp_path):
    rng, at, rows = random.Random(3), 0.0, []
    for _ in range(80):
        at += rng.choice([0.5, 1.25, 7.5])
        rows.append((rng.choice("aab"), at, float(rng.randrange(9))))
    local = [rows[i : i + 8] for i in range(0, 80, 8)]
    for b in local:
        rng.shuffle(b)  # sessions begin, grow and meet out of order, within what may be late
    flush = [[("z", at + 1000, 0.0)], [("a", 1.0, 5.0), ("z", at + 1001, 0.0)]]  # the first row of the last batch is late
    got, query, _ = replay(spark, tmp_path, [*local, *flush], "sessions", lambda s: session_totals(s, "k", "ts", "value", "5 seconds", "100 seconds"))
    table = spark.createDataFrame(rows, "k string, s double, value double")
    want = temporal.sessions(table, ["k"], "s", 5.0, 9, {"total": "value"}).collect()
    told = lambda t: round(t.timestamp() - START, 3)
    assert sorted((r.k, told(r.session_start), told(r.session_end), r.n, r.total) for r in got) == sorted((r.k, r.session_start, r.session_end, r.n, r.total) for r in want)
    assert late_rows(query) == 1


def test_files_of_a_table_give_its_sessions_whatever_their_order(spark, tmp_path):
    rows = [(k, float(i * step), 1.0) for k, step in (("a", 5), ("b", 4), ("c", 7)) for i in range(40)]  # pauses of the gap itself, less and more
    rows.sort(key=lambda r: -r[1])
    frame = lambda b: spark.createDataFrame(b, "k string, s double, value double").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long") + START * 10**6).alias("ts"), "value")
    for i in range(0, 120, 30):  # the newest file first
        frame(rows[i : i + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "reversed"))
    stream = spark.readStream.schema("k string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reversed"))
    got = replayed(session_totals(stream, "k", "ts", "value", "5 seconds", lateness(frame(rows), "ts")), str(tmp_path / "found")).collect()
    want = temporal.sessions(spark.createDataFrame(rows, "k string, s double, value double"), ["k"], "s", 5.0, 9, {"total": "value"}).collect()
    told = lambda t: round(t.timestamp() - START, 3)
    assert sorted((r.k, told(r.session_start), told(r.session_end), r.n, r.total) for r in got) == sorted((r.k, r.session_start, r.session_end, r.n, r.total) for r in want)
    assert lateness(frame(rows).where("false"), "ts") == "0 milliseconds"


@pytest.mark.parametrize(("late", "size", "step"), [("100 seconds", 8, 5), ("12 seconds", 8, 5), ("12 seconds", 3, 7), ("12 seconds", 4, 4)])
def test_spans_of_a_key_are_dealt_and_give_the_windows_of_sorted_samples(spark, tmp_path, late, size, step):
    """All at once at the end, and span by span with what windows need kept from batch to batch; equal times go by value."""
    rng = random.Random(4)
    rows = [(rng.choice("aab") if i < 60 else "a", float(i // 2), float(rng.randrange(100))) for i in range(120)] + [("c", 3.5, 1.0), (None, 4.0, 1.0), ("a", None, 1.0), ("b", 4.0, None)]
    rows.sort(key=lambda r: (r[1] or 0.0) // 10 + rng.random() / 2)  # out of order by 10 seconds at most
    frame = lambda b: spark.createDataFrame(b, "k string, s double, value double").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long") + START * 10**6).alias("ts"), "value")
    for b in [*(rows[i : i + 20] for i in range(0, len(rows), 20)), [("z", 1000.0, 0.0)], [("z", 2000.0, 0.0)]]:
        frame(b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = replayed_in_order(stream, "k", "ts", "value", size, step, str(tmp_path / "out"), late, "4 seconds")
    table = spark.createDataFrame([r for r in rows if None not in r], "k string, s double, value double")
    own = table.select("k", F.struct("s", "value").alias("o"), "value").groupBy("k").agg(F.sort_array(F.collect_list("o")).alias("o")).select("k", F.posexplode("o.value").alias("idx", "value"))
    want = sliding(own.withColumn("idx", F.col("idx").cast("long")), ["k"], size, step).collect()
    assert sorted((r.k, r.window_start_sample, r.value) for r in got.collect()) == sorted((r.k, r.window_start_sample, r.value) for r in want)
    spans = spark.read.parquet(str(tmp_path / "out/spans/*"))
    assert spans.where("k = 'a'").count() >= 15 and spans.agg(F.max(F.size("__values"))).head()[0] <= 8  # no row holds a key's samples
    told = spark.read.parquet(str(tmp_path / "out/found/[0-9]*")).select(F.regexp_extract(F.input_file_name(), r"found/(\d+)/", 1).alias("b")).distinct().count()
    assert told == 1 if late == "100 seconds" else told > 2
