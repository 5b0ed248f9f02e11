"""The recurrent autoencoder: gradients, a plain recurrence, training in tasks, and its anomaly scores."""

import math

import numpy as np
import pytest

from vibrata.operators import autoencoder, learning


def test_gradients_are_those_of_small_differences():
    rng = np.random.default_rng(1)
    windows = rng.normal(size=(3, 5, 2))
    w = autoencoder.started(2, 4, 3, 7)
    w = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in w.items()}
    _, found = autoencoder.gradients(w, windows)
    for name, g in found.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)]:
            two = []
            for d in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += d
                two.append(((autoencoder.forward(moved, windows)[0] - windows) ** 2).mean())
            assert math.isclose((two[0] - two[1]) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-8), name


def plain_error(w, window):
    """One window, number by number."""
    n = len(w["encoder_back"])

    def unit(drive, held, back):
        out = []
        g = [sum(held[i] * back[i][j] for i in range(n)) for j in range(3 * n)]
        for j in range(n):
            keep, reset = (1 / (1 + math.exp(-(drive[j + o] + g[j + o]))) for o in (0, n))
            out.append(keep * held[j] + (1 - keep) * math.tanh(drive[j + 2 * n] + reset * g[j + 2 * n]))
        return out

    line = lambda x, m, b: [sum(x[i] * m[i][j] for i in range(len(x))) + b[j] for j in range(len(b))]
    held = [0.0] * n
    for x in window:
        held = unit(line(x, w["encoder_in"], w["encoder_bias"]), held, w["encoder_back"])
    first = line(line(held, w["narrow"], w["narrow_bias"]), w["widen"], w["widen_bias"])
    held, drive, total = first, line(first, w["decoder_in"], w["decoder_bias"]), 0.0
    for x in window:
        held = unit(drive, held, w["decoder_back"])
        total += sum((a - b) ** 2 for a, b in zip(line(held, w["out"], w["out_bias"]), x, strict=True))
    return total / window.size


def test_scores_are_those_of_a_plain_recurrence(spark):
    rng = np.random.default_rng(2)
    w = autoencoder.started(2, 5, 3, 4)
    windows = rng.normal(size=(6, 7, 2))
    assert np.allclose(autoencoder.flat(autoencoder.unflat(autoencoder.flat(w), 2, 5, 3)), autoencoder.flat(w))
    model = autoencoder.SequenceAutoencoder(autoencoder.flat(w), ("a", "b"), 5, 3)
    rows = [(i, x[:, 0].tolist(), x[:, 1].tolist()) for i, x in enumerate(windows)] + [(8, None, [1.0]), (9, [1.0, None], [1.0, 2.0]), (10, [float("nan")] * 2, [1.0, 2.0])]
    got = {r.id: r.error for r in model.score(spark.createDataFrame(rows, "id int, a array<double>, b array<double>")).collect()}
    assert all(math.isclose(got[i], plain_error(w, x), rel_tol=1e-9) for i, x in enumerate(windows))
    assert [got[i] for i in (8, 9, 10)] == [None] * 3 and len(got) == 9


@pytest.fixture(scope="module")
def waves():
    """Healthy windows are slow waves of any phase; degraded ones have noise or a second, faster wave."""
    rng = np.random.default_rng(3)
    t = np.arange(24)
    wave = lambda f: np.sin(2 * np.pi * (f * t / 24 + rng.random()))
    healthy = [wave(rng.choice([1, 2])) + rng.normal(size=24) * 0.05 for _ in range(240)]
    bad = [wave(1) + (rng.normal(size=24) * 0.6 if k % 2 else wave(9) * 0.8) for k in range(80)]
    return healthy, bad


def test_tasks_train_one_network_that_tells_degraded_windows(spark, waves, tmp_path):
    healthy, bad = waves
    frame = lambda rows, label: spark.createDataFrame([(x.tolist(), label) for x in rows], "value array<double>, label int")
    checked, tested = frame(healthy[160:200], 0).union(frame(bad[:40], 1)), frame(healthy[200:], 0).union(frame(bad[40:], 1))
    model = autoencoder.fit(frame(healthy[:160], 0).repartition(3), validation=checked, hidden=16, latent=6, rounds=5, epochs=20, batch=16, tasks=3)
    assert 1 <= model.round <= 5 and model.separation > 0
    again = autoencoder.fit(frame(healthy[:160], 0).repartition(7), validation=checked, hidden=16, latent=6, rounds=5, epochs=20, batch=16, tasks=3)
    assert np.allclose(again.weights, model.weights)  # however the rows come
    model.save(spark, str(tmp_path / "model"))
    loaded = autoencoder.SequenceAutoencoder.load(spark, str(tmp_path / "model"))
    rows = loaded.score(tested).collect()
    good, worse = (np.array([r.error for r in rows if r.label == k]) for k in (0, 1))
    area = (worse[:, None] > good[None, :]).mean()
    pca = learning.reconstruction_error(learning.fit_window_pca(frame(healthy[:160], 0), k=3), tested).collect()
    other = (np.array([r.error for r in pca if r.label == 1])[:, None] > np.array([r.error for r in pca if r.label == 0])[None, :]).mean()
    print("areas under the curve: recurrent", area, "components", other)
    assert area > 0.9
    untrained = autoencoder.errors(autoencoder.started(1, 16, 6, 42), np.array(healthy[200:])[:, :, None]).mean()
    assert good.mean() < 0.5 * untrained


def test_nothing_to_learn_from(spark):
    with pytest.raises(ValueError, match="no healthy window"):
        autoencoder.fit(spark.createDataFrame([([None],), (None,)], "value array<double>"))
