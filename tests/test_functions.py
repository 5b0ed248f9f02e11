"""Window features against numpy, and their invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vibrata.functions import allan, divergence, quality, spectrum, time, wavelet
from vibrata.operators import divergences, faults, running, signals, windows
from vibrata.operators.extract import Families, FeatureExtractor

RNG = np.random.default_rng(42)
WHITE = RNG.normal(size=300)
CASES = {
    "white": WHITE, "brown": np.cumsum(RNG.normal(size=300)), "constant": np.full(300, 42.0), "zeros": np.zeros(300), "ramp": np.linspace(0, 100, 300),
    "stuck": np.r_[WHITE[:100], np.zeros(50), WHITE[150:]], "short": np.array([1.0, 2.0, 3.0]), "one": np.array([5.0]), "empty": np.array([]),
}


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(k, [float(x) for x in v]) for k, v in CASES.items()] + [("null", None), ("hole", [1.0, None] * 20)]
    return spark.createDataFrame(rows, "name string, value array<double>").cache()


def told(table, column):
    return {r["name"]: r["x"] for r in table.select("name", column.alias("x")).collect()}


def test_moments(arrays):
    got = told(arrays, time.moments(F.col("value")))
    for name in ("white", "brown", "ramp", "stuck"):
        x, n = CASES[name], len(CASES[name])
        d = x - x.mean()
        g1, g2 = (d**3).mean() / x.std() ** 3, (d**4).mean() / x.var() ** 2 - 3
        want = [x.mean(), x.var(), math.sqrt((x * x).mean()), g1 * math.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), (np.diff(np.sign(x)) != 0).sum() / (n - 1), *np.quantile(x, [0.25, 0.5, 0.75])]
        assert np.allclose([*got[name]], want, rtol=1e-9, atol=1e-9)
    assert got["constant"].skewness == got["constant"].kurtosis == 0 and got["one"].zcr == 0
    assert got["empty"]["mean"] is None and got["hole"]["mean"] is None and got["null"]["mean"] is None


def test_signal_quality(arrays):
    got = told(arrays, quality.signal_quality(F.col("value")))
    assert got["constant"].sq_snr == 60 and got["constant"].sq_dropout_rate == 1 and got["constant"].sq_response_linearity == 1 and got["constant"].sq_noise_floor == 0
    assert math.isclose(got["stuck"].sq_dropout_rate, 50 / 300) and got["ramp"].sq_response_linearity > 0.999 and got["ramp"].sq_baseline_stability > 1
    assert abs(got["white"].sq_noise_floor - 1) < 0.3 and 0 < got["white"].sq_peak_consistency < 1
    assert all(got[k] is None for k in ("short", "one", "empty", "null", "hole"))


def test_wavelets_keep_energy_and_match_the_circular_sum():
    x = RNG.normal(size=(4, 64))
    bands = wavelet.modwt(x, 5)
    assert bands.shape == (4, 4, 64) and np.allclose((bands**2).sum((0, 2)), (x**2).sum(1))
    direct = np.array([[sum(wavelet.DETAIL[k] * row[(t - k) % 64] for k in range(8)) for t in range(64)] for row in x])
    assert np.allclose(bands[0], direct)
    assert [wavelet.levels(n) for n in (1, 2, 8, 100, 128, 200, 300)] == [0, 1, 1, 3, 4, 4, 5]
    assert math.isclose(sum(wavelet.SCALING), math.sqrt(2)) and math.isclose(sum(g * g for g in wavelet.SCALING), 1)


def test_spectra_of_odd_and_long_windows(arrays):
    f, p = spectrum.power_density(np.array([np.sin(2 * np.pi * 10 * np.arange(1000) / 100)]), 100)
    assert abs(f[p[0].argmax()] - 10) < 0.5 and len(f) == 129
    x = RNG.normal(size=(1, 101))
    f, p = spectrum.power_density(x, 100)
    assert len(f) == 51 and np.isclose(p.sum() * f[1], x.var(), rtol=0.7)
    got = told(arrays, spectrum.welch(F.col("value"), 100.0))
    assert len(got["white"]) == 129 and len(got["short"]) == 2 and got["one"] is None and got["hole"] is None


def test_allan_slopes():
    n = 4096
    ms = allan.strides(allan.default_taus(n, 100.0), n, 100.0)
    fit = lambda x: np.polyfit(np.log10(ms[:6]), np.log10(allan.deviations(x[None], 100.0, ms)[0][:6]), 1)[0]
    assert abs(fit(RNG.normal(size=n)) + 0.5) < 0.1 and abs(fit(np.cumsum(RNG.normal(size=n))) - 0.5) < 0.15
    assert allan.strides(allan.default_taus(300, 100.0), 300, 100.0) == [1, 3, 5, 9, 16, 28, 49, 85]


def test_divergences(spark):
    p, q = [0.9, 0.05, 0.025, 0.015, 0.01], [0.01, 0.015, 0.025, 0.05, 0.9]
    table = spark.createDataFrame([(p, p), (p, q)], "p array<double>, q array<double>")
    same, apart = table.select(divergence.kl(F.col("p"), F.col("q")).alias("kl"), divergence.symmetric_kl(F.col("p"), F.col("q")).alias("s"), divergence.jensen_shannon(F.col("p"), F.col("q")).alias("j")).collect()
    assert abs(same.kl) < 1e-12 and apart.kl > 1 and math.isclose(apart.s, sum(a * math.log(a / b) for a, b in zip(p, q)), rel_tol=1e-9) and 0 < apart.j <= math.log(2)


def test_kernel_densities_agree(spark, arrays):
    long = arrays.where("name IN ('white', 'brown')").select("name", F.explode("value").alias("v"))
    wide = told(arrays.where("name IN ('white', 'brown')"), divergence.kde(F.col("value")))
    for r in divergences.densities(long, ["name"], "v").collect():
        assert np.allclose(r.probs, wide[r["name"]].probs) and np.allclose(r.centers, wide[r["name"]].centers)


def samples(spark, x, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(x)], "signal_id string, idx long, value double")


def test_long_transform_in_blocks(spark):
    x = RNG.normal(size=1000)
    got = divergences.long_modwt(samples(spark, x), ["signal_id"], 5, block=256).collect()
    want = wavelet.modwt(x[None], 5)[:, 0]
    bands = {r.band for r in got}
    assert bands == {"D1", "D2", "D3", "D4", "D5", "A5"} and len(got) == 6000
    for r in got:
        assert abs(r.coef - want[5 if r.band[0] == "A" else int(r.band[1]) - 1][r.idx]) < 1e-9


def test_windows_of_short_empty_and_gapped_signals(spark):
    table = samples(spark, range(10)).unionByName(samples(spark, range(3), "short"))
    rows = windows.sliding(table, ["signal_id"], 4, 3).collect()
    assert sorted((r.window_start_sample, r.value) for r in rows) == [(0, [0, 1, 2, 3]), (3, [3, 4, 5, 6]), (6, [6, 7, 8, 9])]
    assert [r.window_start_sample for r in windows.sliding(table, ["signal_id"], 2, 4).orderBy("window_start_sample").collect() if r.signal_id == "s"] == [0, 4, 8]
    assert windows.sliding(table.limit(0), ["signal_id"], 4, 3).count() == 0
    with pytest.raises(ValueError):
        windows.sliding(table, ["signal_id"], 0, 1)


def test_numbering_does_not_depend_on_stretches(spark):
    table = spark.createDataFrame([("a", float(x)) for x in RNG.permutation(500)] + [(None, 1.0), ("a", None)], "k string, t double")
    one = {(r.t, r.idx) for r in signals.indexed(table, ["k"], "t").collect()}
    assert one == {(r.t, r.idx) for r in signals.indexed(table, ["k"], "t", 17.0).collect()} and len(one) == 500


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(spark, keys):
    x = np.round(RNG.normal(size=2000), 2)
    table = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("a", float("nan"))], "k string, v double")
    (r,) = running.quantiles(table, keys, "v", {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}, "n").collect()
    assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(x, [0, 0.37, 0.95, 1])) and r.n == 2000
    assert running.quantiles(table.where("v IS NULL"), keys, "v", {"a": 0.5}).count() == 0


def test_faults(spark):
    x = 10 * np.sin(np.arange(400) / 9)
    table = samples(spark, x)
    at = lambda f, s: np.array([r.value for r in faults.injected(table, ["signal_id"], F.lit(f), F.lit(float(s))).orderBy("idx").collect()])
    for f in ("noise_increase", "bias_drift", "spike_injection", "gain_change"):
        assert np.allclose(at(f, 0), x) and np.allclose(at(f, -1), x) and not np.allclose(at(f, 2), x)
        assert np.array_equal(at(f, 1), at(f, 1))
    assert np.abs(at("saturation", 2)).max() < np.abs(x).max() * 0.5
    slow = at("bandwidth_loss", 1)
    padded = np.pad(x, 11, mode="symmetric")
    smooth = np.array([padded[i : i + 23].mean() for i in range(400)])
    assert np.allclose(slow, (smooth - smooth.mean()) * ((x.std() + 1e-8) / (smooth.std() + 1e-8)) * 0.6 + x.mean())
    short = samples(spark, [1, 2, 3])
    assert [r.value for r in faults.injected(short, ["signal_id"], F.lit("anything"), F.lit(1.0)).orderBy("idx").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="unknown fault"):
        faults.injected(table, ["signal_id"], F.lit("anything"), F.lit(1.0)).collect()


def test_extractor_at_other_rates(spark):
    for fs in (48.0, 83.0):
        x = RNG.normal(size=int(fs * 6))
        out = FeatureExtractor(fs, Families(allan=False)).process(samples(spark, x), ["signal_id"], 2.0, 1.0)
        size, step = int(2 * fs), int(fs)
        assert out.count() == (len(x) - size) // step + 1
        assert set(Families(allan=False).names(size, fs)) <= set(out.columns)
