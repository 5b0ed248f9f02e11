"""Files of each format to rows, and streams against batches."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrata.operators.windows import sliding
from vibrata.plans import health
from vibrata.sources import archives, conditions, sinks, synthetic, text_tables
from vibrata.streaming.windows import counted, timed


def write(path, rows):
    path.write_text("\n".join(" ".join(map(str, r)) for r in rows) + "\n")
    return str(path)


def test_pamap2(spark, tmp_path):
    path = write(tmp_path / "s.dat", [[0.01, 2, "NaN", *range(51)], [0.02, 3, 80, *range(100, 151)]])
    a, b = text_tables.pamap2(text_tables.lines(spark, path)).orderBy("timestamp").collect()
    assert a.activity == 2 and a.heart_rate is None and b.heart_rate == 80 and a.hand_temp == 0 and a.hand_accel_16g == [1, 2, 3] and a.chest_temp == 17 and a.ankle_mag == [44, 45, 46]


def test_cmapss_shl_and_opportunity(spark, tmp_path):
    path = write(tmp_path / "t.txt", [range(26), range(26, 52)])
    row = text_tables.cmapss(text_tables.lines(spark, path)).orderBy("s5").first()
    assert row.s5 == 5 and row.s25 == 25 and "s26" not in row.asDict()
    path = write(tmp_path / "m.txt", [[*range(22), "nan"], list(range(23)), [1] * 23])
    assert text_tables.shl_motion(text_tables.lines(spark, path)).count() == 2
    assert text_tables.shl_motion(text_tables.lines(spark, path), max_rows=2).count() == 1
    path = write(tmp_path / "o.dat", [range(250)])
    row = text_tables.opportunity(text_tables.lines(spark, path)).first()
    assert row.back_accel_x == 37 and row.lla_mag_z == 97 and row.activity_ml == 243


def test_uci_har(spark, tmp_path):
    base = tmp_path / "train" / "Inertial Signals"
    base.mkdir(parents=True)
    for i, name in enumerate(text_tables.HAR_SIGNALS):
        write(base / f"{name}_train.txt", [[i + k + j / 1000 for j in range(128)] for k in range(3)])
    write(tmp_path / "train" / "subject_train.txt", [[1], [1], [2]])
    write(tmp_path / "train" / "y_train.txt", [[5], [6], [5]])
    rows = text_tables.uci_har(spark, str(tmp_path)).where("signal = 'total_acc_x'").orderBy("idx").collect()
    assert len(rows) == 384 and [r.idx for r in rows] == list(range(384)) and rows[130].subject == 1 and rows[130].activity == 6 and rows[300].subject == 2
    assert abs(rows[130].value - 1.002) < 1e-9


def test_tabular_archives_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,y\n0,1,2\n1,3,4\n")
    rows = text_tables.tabular(spark, str(tmp_path / "a.csv"), "t").orderBy("t").collect()
    assert [(r.x, r.y) for r in rows] == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        text_tables.tabular(spark, "a.xyz")
    with zipfile.ZipFile(tmp_path / "acc.zip", "w") as z:
        z.writestr("acc_walking_chest.csv", "id,attr_time,attr_x,attr_y,attr_z\n1,0,1,2,3\n2,1,4,5,6\n")
        z.writestr("plain.csv", "id,attr_time,attr_x,attr_y,attr_z\n1,0,7,8,9\n")
        z.writestr("note.txt", "nothing")
    found = archives.realworld_zip(spark, str(tmp_path / "acc.zip")).orderBy("body_part", "idx").collect()
    assert [(r.body_part, r.idx, r.z) for r in found] == [("chest", 0, 3), ("chest", 1, 6), ("plain", 0, 9)]
    np.savez(tmp_path / "s.npz", signal=np.arange(4.0))
    assert [r.value for r in archives.npz(spark, str(tmp_path / "s.npz")).orderBy("idx").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="has no other"):
        archives.npz(spark, str(tmp_path / "s.npz"), "other").collect()
    sinks.write_summary(spark, str(tmp_path / "out"), {"one": spark.range(3)}, {"b": 1, "a": [2]})
    assert spark.read.option("header", True).csv(str(tmp_path / "out/one")).count() == 3
    assert spark.read.text(str(tmp_path / "out/summary.json")).first()[0] == '{"a": [2], "b": 1}'


def test_noise(spark):
    for kind in synthetic.KINDS:
        x = synthetic.noise(spark, 2000, 1, 3.0, 0.5, kind).orderBy("idx")
        r = x.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
        assert abs(r.m - 3) < 1e-9 and abs(r.s - 0.5) < 1e-9
        again = synthetic.noise(spark, 2000, 1, 3.0, 0.5, kind, partitions=7).orderBy("idx")
        assert np.allclose([r.value for r in x.collect()], [r.value for r in again.collect()])
    with pytest.raises(ValueError):
        synthetic.noise(spark, 10, kind="green")


def test_recordings(spark, tmp_path):
    patterns = {("acme", c): f"acme_{c}_*.csv" for c in conditions.CONDITIONS}
    for c in conditions.CONDITIONS:
        (tmp_path / f"acme_{c}_1.csv").write_text(",".join(reversed(conditions.REQUIRED)) + "\n" + "\n".join(",".join(["1.5"] * 12 + [str(t)]) for t in (20, 0, 10)) + "\n")
    table = conditions.recordings(spark, str(tmp_path), patterns)
    assert table.count() == 18 and table.where("Time_ms = 10 AND CalAX = 1.5").count() == 6
    samples = health.samples_of_recordings(table, health.Settings(trim_start_sec=0.01, trim_end_sec=0.01))
    assert samples.count() == 6 * 4 and {r.idx for r in samples.collect()} == {0}
    (tmp_path / "acme_40_rpm_2.csv").write_text("x\n1\n")
    with pytest.raises(FileNotFoundError):
        conditions.discovered(spark, str(tmp_path), patterns)


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i)) for i in range(90)]
    table = spark.createDataFrame(rows, "k string, s long, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    for i in range(3):  # three micro-batches in order
        table.where(f"value >= {30 * i} AND value < {30 * (i + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = run(counted(stream(), "k", "ts", "value", 8, 5), "append", "counted_windows")
    from vibrata.operators.signals import indexed

    want = sliding(indexed(table, ["k"], "ts"), ["k"], 8, 5).collect()
    assert sorted((r.k, r.window_start_sample, r.value) for r in got) == sorted((r.k, r.window_start_sample, r.value) for r in want)
    timed_rows = run(timed(stream(), "k", "ts", "value", "10 seconds", None, "1 second"), "append", "timed_windows")
    batch = {(r.k, r.window_start, tuple(r.value)) for r in timed(table, "k", "ts", "value", "10 seconds", None, "1 second").collect()}
    assert timed_rows and {(r.k, r.window_start, tuple(r.value)) for r in timed_rows} <= batch
