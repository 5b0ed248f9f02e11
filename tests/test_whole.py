"""Features of whole signals against those of arrays, with stretches and blocks far shorter than the signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrata.functions import allan
from vibrata.operators import whole
from vibrata.operators.extract import Families, window_features

FS = 50.0
KEY = ["k"]


def signals_of(seed=3):
    rng = np.random.default_rng(seed)
    steps = np.round(np.cumsum(rng.normal(size=1500)) * 2) / 2
    steps[200:260] = 4.0
    return {"walk": steps, "noise": rng.normal(size=700) + 3, "short": rng.normal(size=100), "tiny": rng.normal(size=5), "one": np.array([2.0]), "flat": np.full(300, 1.5)}


def frame(spark, signals):
    return spark.createDataFrame([(k, i, float(x)) for k, v in signals.items() for i, x in enumerate(v)], "k string, idx long, value double")


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-8))


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_features_equal_those_of_arrays(spark, rows):
    found = signals_of()
    families = Families(bands=((0.5, 5.0),))
    got = {r.k: r for r in whole.whole_features(frame(spark, found), KEY, FS, families, rows=rows).collect()}
    assert set(got) == set(found)
    for k, v in found.items():
        own = spark.createDataFrame([(k, [float(x) for x in v])], "k string, value array<double>")
        (want,) = window_features(own, len(v), FS, families).collect()
        row = got[k]
        assert row.n_samples == len(v)
        for name in want.asDict():
            if name.startswith("modwt_a_") and len(v) < 8 or name == "adev_slope" and k == "flat":  # the slope of rounding
                continue
            if name.startswith("adev_") and name.endswith("s"):
                measured = {f"adev_{x.tau:.2f}s": x.adev for x in row.adev}
                assert close(measured[name], want[name]), (k, name)
            elif name != "k" and name in row.asDict():
                assert close(row[name], want[name]), (k, name, row[name], want[name])


def test_odd_signals_have_null_features(spark):
    table = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, float("nan")), ("c", 0, float("inf")), ("d", 0, 1.0), ("d", 1, 2.0)], "k string, idx long, value double").withColumn("x1", F.lit("clash"))
    got = {r.k: r for r in whole.whole_features(table, KEY, FS).collect()}
    assert [got[k].mean for k in "abcd"] == [None, None, None, 1.5] and [got[k].n_samples for k in "abcd"] == [2, 1, 1, 2]
    assert whole.whole_features(table.limit(0), KEY, FS).count() == 0


@pytest.mark.parametrize("block", [16, 100, 1 << 14])
def test_allan_deviations_of_blocks_equal_those_of_arrays(spark, block):
    found = signals_of(5)
    got = {}
    for r in whole.allan_deviations(frame(spark, found), KEY, FS, count=20, block=block).collect():
        got.setdefault(r.k, {})[r.m] = r.adev
    for k, v in found.items():
        ms = allan.strides(allan.default_taus(len(v), FS, 20), len(v), FS) if len(v) > 1 else []
        want = dict(zip(ms, allan.deviations(np.asarray(v)[None], FS, ms)[0], strict=True)) if ms else {}
        assert set(got.get(k, {})) == set(want), k
        assert all(close(got[k][m], float(x)) or abs(got[k][m] - x) < 1e-7 for m, x in want.items()), k


def test_earlier_values_cross_stretches(spark):
    table = frame(spark, {"a": range(50)})
    for r in whole.with_earlier(table, KEY, 3, 7).collect():
        assert (r.x1, r.x2, r.x3) == tuple(float(r.idx - j) if r.idx >= j else None for j in (1, 2, 3))
