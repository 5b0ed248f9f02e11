"""The health plan end to end over made recordings, and what it shares with the plain operators."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrata.operators import evaluation, faults, joins, learning, scoring, stability, windows
from vibrata.operators.extract import Families, FeatureExtractor
from vibrata.plans import health
from vibrata.sources.conditions import AXES, CONDITIONS, REQUIRED, default_patterns, recordings
from vibrata.sources.scratch import removed, written

PLAIN = Families(spectrum=False, allan=False, wavelet_level=None, signal_quality=False)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two sensors under two conditions, twelve seconds each."""
    root, rng = tmp_path_factory.mktemp("recordings"), np.random.default_rng(1)
    for sensor in ("alpha", "beta"):
        for condition, rpm in list(CONDITIONS.items())[:2]:
            t = np.arange(1200) / 100
            rows = np.stack([np.sin(2 * np.pi * (1 + rpm / 40) * t + k) * (1 + k) + rng.normal(0, 0.1 + 0.05 * (sensor == "beta"), 1200) for k in range(len(REQUIRED) - 1)], 1)
            with open(root / f"{sensor}_{condition}_1.csv", "w", newline="") as f:
                out = csv.writer(f)
                out.writerow(REQUIRED)
                out.writerows([int(1000 * a), *(f"{x:.6f}" for x in row)] for a, row in zip(t, rows))
    return str(root)


def test_analysis_of_recordings(spark, folder):
    patterns = {k: v for k, v in default_patterns(["alpha", "beta"]).items() if k[1] in list(CONDITIONS)[:2]}
    s = health.Settings(
        window_sec=0.64, step_sec=0.64, level=3, trim_start_sec=1, trim_end_sec=1, base_sec=5, channels=("AccX", "AccY"), conditions=tuple(list(CONDITIONS)[:2]),
        base_conditions=("40_rpm",), mandatory=("kurtosis",), pool=8, n_stable=3, n_sensitive=2, chosen_families=PLAIN,
    )
    found = health.analysis(recordings(spark, folder, patterns), s, (0.0, 2.0), 1)
    assert found["trimmed_signals"].count() == 2 * 2 * 1000 * len(AXES)
    chosen = {(r.sensor, r.role): r.n for r in found["selection"].groupBy("sensor", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(chosen[x, "mandatory"] == 2 and chosen[x, "stable"] <= 3 and chosen[x, "sensitive"] <= 2 for x in ("alpha", "beta"))
    summary = found["condition_summary"].collect()
    assert len(summary) == 4 and all(0.5 < r.mean_health_score <= 1 and r.mean_div_mean_kl > 0 for r in summary)
    results = {(r.sensor, r.fault_type, r.severity): r for r in found["fault_results"].collect()}
    assert len(results) == 2 * 6 * 2
    for sensor in ("alpha", "beta"):  # noise makes health fall and distributions move
        calm, loud = results[sensor, "noise_increase", 0.0], results[sensor, "noise_increase", 2.0]
        assert loud.mean_health_score < calm.mean_health_score and loud.mean_div_mean_kl > calm.mean_div_mean_kl
    assert found["cross_sensor_matrix"].count() == 4 and found["sanity_summary"].count() == 2
    assert found["modwt_segments"].count() == 2 * 500


def test_channel_vectors_are_those_of_wide_features(spark):
    rng = np.random.default_rng(5)
    rows = [("s", "c", ch, i, float(rng.normal())) for ch in ("AccX", "AccY") for i in range(640)]
    samples = spark.createDataFrame(rows, "sensor string, condition string, channel string, idx long, value double")
    s = health.Settings(window_sec=0.64, step_sec=0.32, channels=("AccX", "AccY"), chosen_families=PLAIN)
    features = written(health.channel_features(samples, ["sensor", "condition"], s))
    wide = health.wide_features(features, ["sensor", "condition"], s)
    selection = spark.createDataFrame([("s", "stable", 0, "AccX_mean"), ("s", "stable", 1, "AccY_rms"), ("s", "sensitive", 0, "AccY_rms"), ("s", "stable", 2, "AccX_nothing")], "sensor string, role string, place int, feature string")
    stats = health.long_stats(features, ["sensor"], s)
    keep = ["sensor", "condition", "window_start_sample"]
    a = scoring.quality_vectors(wide, s.wide_names, selection, stats, ["sensor"], keep).orderBy("window_start_sample").collect()
    b = scoring.channel_vectors(features, s.names, s.channels, selection, stats, ["sensor"], keep).orderBy("window_start_sample").collect()
    assert len(a) == len(b) == 19
    for x, y in zip(a, b):
        assert x.window_start_sample == y.window_start_sample and set(x.qv) == set(y.qv) == {"AccX_mean", "AccY_rms"}
        assert np.isclose(x.qv_health_score_raw, y.qv_health_score_raw) and np.isclose(x.qv_degradation_score_raw, y.qv_degradation_score_raw)
    means = health.long_means(features, ["sensor", "condition"], s)
    assert {r.feature for r in stability.across_means(means, ["sensor"]).collect()} == set(s.wide_names)


def test_cells_are_those_of_injected(spark):
    rng = np.random.default_rng(2)
    samples = spark.createDataFrame([(k, i, float(rng.normal())) for k in ("a", "b") for i in range(300)], "k string, idx long, value double")
    cells = faults.injected_cells(samples, ["k"], severities=(0.0, 1.0), trials=2).collect()
    assert len(cells) == 600 * 6 * 2 * 2
    copies = samples.withColumn("fault_type", F.explode(F.array(*(F.lit(f) for f in faults.FAULT_TYPES)))).withColumn("severity", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("trial", F.explode(F.array(F.lit(0), F.lit(1))))
    plain = faults.injected(copies, ["k", "fault_type", "severity", "trial"], F.col("fault_type"), F.col("severity")).collect()
    key = lambda r: (r.k, r.fault_type, r.severity, r.trial, r.idx)
    want = {key(r): r.value for r in plain}
    assert all(abs(want[key(r)] - r.value) < 1e-9 for r in cells)
    with pytest.raises(ValueError):
        faults.injected_cells(samples, ["k"], ["anything"])


def test_large_lookups_are_salted(spark):
    table = spark.createDataFrame([(i % 7, i) for i in range(700)], "k int, v int")
    small = spark.createDataFrame([(k, k * 10) for k in range(5)], "k int, w int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, joins.looked_up(table, small, ["k"], how).collect()), key=str)
        assert sorted(map(tuple, joins.looked_up(table, small, ["k"], how, most=2).collect()), key=str) == want
        assert len(want) == (700 if how == "left" else 500)


def test_written_tables_can_be_removed(spark):
    table = written(spark.range(10).withColumn("x", F.col("id") * 2))
    assert table.count() == 10 and written(table.limit(0)).count() == 0
    removed(spark, table)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_predictor_refuses_short_signals_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"{kind}{j}", kind, i, float(rng.normal(0 if kind == "low" else 5))) for kind in ("low", "high") for j in range(3) for i in range(600)]
    rows += [("short", "low", i, 0.0) for i in range(150)]
    samples = spark.createDataFrame(rows, "signal string, kind string, idx long, value double")
    names = PLAIN.names(200, 100.0)
    features = FeatureExtractor(100.0, PLAIN).process(samples, ["signal", "kind"], 2.0, 1.0)
    predictor = learning.ModalityPredictor(learning.fit_modality(features, names, "kind", trees=5, depth=3), tuple(names), PLAIN)
    predictor.save(str(tmp_path / "model"))
    predictor.save(str(tmp_path / "model"))
    told = {r.signal: r for r in learning.ModalityPredictor.load(str(tmp_path / "model"), PLAIN).predict(samples, ["signal"]).collect()}
    assert len(told) == 7 and told["short"].modality is None and "200" in told["short"].error
    assert all(r.modality == name[:-1] and r.confidence == 1 and r.n_windows == 5 for name, r in told.items() if name != "short")
    assert learning.cross_validated(features, names, "kind", folds=2, trees=5, depth=3) > 0.9


def test_window_dataset(spark):
    rows = [(s, i, float(i % 17)) for s in range(20) for i in range(640)]
    cut = windows.sliding(spark.createDataFrame(rows, "subject int, idx long, value double"), ["subject"], 64, 64)
    split = learning.subject_splits(cut, "subject")
    subjects = {r.split: r.n for r in split.groupBy("split").agg(F.countDistinct("subject").alias("n")).collect()}
    assert subjects == {"train": 14, "val": 3, "test": 3}
    mixed = written(learning.degraded_share(split, ["subject", "window_start_sample"]))
    got = mixed.collect()
    assert len(got) == 200 and 60 < sum(r.label for r in got) < 140 and all(len(r.value) == 64 for r in got)
    before = {(r.subject, r.window_start_sample): r.value for r in split.collect()}
    assert all((before[r.subject, r.window_start_sample] == r.value) for r in got if not r.label)
    assert sum(before[r.subject, r.window_start_sample] != r.value for r in got if r.label) > 50
    scaled = learning.scaled_windows(mixed, mixed.where("label = 0")).where("label = 0").select(F.explode("value").alias("x")).agg(F.avg("x"), F.stddev_pop("x")).head()
    assert abs(scaled[0]) < 1e-9 and abs(scaled[1] - 1) < 1e-9


def test_per_class_accuracy(spark):
    table = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, guess string")
    assert {r.truth: r.accuracy for r in evaluation.class_accuracy(table, "truth", "guess").collect()} == {"a": 0.5, "b": 1.0}
