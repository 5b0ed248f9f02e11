"""Windows of faulty signals without copies of the samples, and their divergences in numpy, against the operators row by row."""

import math

import pytest
from pyspark.sql import functions as F

from vibrata.operators import divergences, faults, windows


def plain(rows):
    tidy = lambda x: math.nan if x is None else x
    return {tuple(r[:4]): [tidy(x) for x in r[4]] for r in (tuple(r) for r in rows)}


@pytest.mark.parametrize(("size", "step", "block"), [(16, 8, 64), (16, 8, 1 << 12), (16, 5, 1), (7, 10, 20)])
def test_windows_are_those_of_the_copied_samples(spark, size, step, block):
    """Signals with a null, without deviation, with one sample too few, too short for a fault, and with a gap, in small blocks."""
    own = [("a", i, None if i == 70 else math.sin(i) * 5 + i % 7) for i in range(150)] + [("flat", i, 2.0) for i in range(40)] + [("short", i, 1.0) for i in range(15)]
    own += [("tiny", i, float(i)) for i in range(3)] + [("gap", i, float(i * i % 11)) for i in range(90) if i not in (41, 42)] + [("none", i, None) for i in range(20)]
    table = spark.createDataFrame(own, "k string, idx long, value double").repartition(5)
    severities = (-1.0, 0.0, 0.5, 2.0)
    got = faults.injected_windows(table, ["k"], faults.POINTWISE, severities, size, step, block=block)
    want = windows.sliding(faults.injected_cells(table, ["k"], faults.POINTWISE, severities), ["k", "fault_type", "severity"], size, step)
    assert got.columns == want.columns
    got, want = plain(got.collect()), plain(want.collect())
    assert got.keys() == want.keys() and len(want) > 100
    for cell, x in want.items():
        assert got[cell] == pytest.approx(x, rel=1e-9, abs=1e-9, nan_ok=True), cell


def test_tiny_signals_stay_as_they_are_and_other_faults_are_errors(spark):
    table = spark.createDataFrame([("tiny", i, float(i)) for i in range(3)], "k string, idx long, value double")
    got = faults.injected_windows(table, ["k"], faults.POINTWISE, (2.0,), 2, 1).collect()
    assert len(got) == 10 and all(r.value == [r.window_start_sample, r.window_start_sample + 1.0] for r in got)
    assert faults.injected_windows(table.limit(0), ["k"], faults.POINTWISE, (2.0,), 2, 1).isEmpty()
    for unknown in ("bandwidth_loss", "rust"):
        with pytest.raises(ValueError, match="not pointwise"):
            faults.injected_windows(table, ["k"], [unknown], (2.0,), 2, 1)


@pytest.mark.parametrize("keys", [["k"], []])
def test_divergences_in_numpy_equal_those_in_columns(spark, monkeypatch, keys):
    """Windows of two lengths, constant, with nulls and too short; a reference that lacks a band and a key."""
    signal = [("ab"[i % 2], i // 2, math.sin(i / 3) * 3 + i % 5) for i in range(600)]
    samples = spark.createDataFrame(signal, "k string, idx long, value double")
    reference = divergences.reference_distributions(samples, keys, 3) if keys else divergences.reference_distributions(samples.where("k = 'a'"), ["k"], 3).drop("k")
    reference = reference.where("band <> 'D2'")
    rows = [(k, i, [math.cos(i + j * j) * (1 + i) for j in range(n)]) for i, (k, n) in enumerate([("a", 64), ("b", 64), ("a", 16), ("c", 64), ("b", 20), ("a", 5)])]
    rows += [("a", 6, [1.0] * 64), ("b", 7, [None, *range(63)]), ("a", 8, None), ("b", 9, [float("nan")] * 64), (None, 10, [float(j) for j in range(64)])]
    table = spark.createDataFrame([(k, i, w and [None if x is None else float(x) for x in w]) for k, i, w in rows], "k string, i long, value array<double>")
    told = lambda: sorted(map(tuple, divergences.with_window_divergence(table, reference, 3, keys=keys).drop("value").select("i", F.expr("divergences.band"), F.expr("divergences.kl"), F.expr("divergences.jsd"), "div_mean_kl", "div_max_kl", "div_mean_jsd").collect()))
    got = told()
    monkeypatch.setattr(divergences, "MOST_BOOKS", 0)
    want = told()
    assert len(got) == len(rows) and sum(r[4] is not None for r in want) >= 4
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and all(x == (y if y is None else pytest.approx(y, rel=1e-9)) for x, y in zip(a[2:], b[2:], strict=True)), (a, b)
