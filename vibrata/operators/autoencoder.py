"""A recurrent autoencoder of windows: what it cannot rebuild of a window is the window's anomaly score.

An encoder of gated units reads a window, a few numbers are kept of it, and a decoder rebuilds the whole window from these.
It learns from healthy windows alone. Tasks train copies of the network on their own windows; a round averages the copies,
weighted by windows, and the network of the round that tells degraded validation windows best from healthy ones is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.sources.scratch import written

CLIP = 1.0  # norm that gradients are cut to
TASKS = 64  # copies of the network in a round, at most

Weights = dict[str, np.ndarray]


def shapes(channels: int, hidden: int, latent: int) -> dict[str, tuple[int, ...]]:
    return {
        "encoder_in": (channels, 3 * hidden), "encoder_back": (hidden, 3 * hidden), "encoder_bias": (3 * hidden,), "narrow": (hidden, latent), "narrow_bias": (latent,),
        "widen": (latent, hidden), "widen_bias": (hidden,), "decoder_in": (hidden, 3 * hidden), "decoder_back": (hidden, 3 * hidden), "decoder_bias": (3 * hidden,),
        "out": (hidden, channels), "out_bias": (channels,),
    }


def started(channels: int, hidden: int, latent: int, seed: int) -> Weights:
    """Small random weights; update gates lean towards keeping what is held."""
    rng = np.random.default_rng(seed)
    made = {name: rng.normal(size=s) * (2 / sum(s)) ** 0.5 if len(s) > 1 else np.zeros(s) for name, s in shapes(channels, hidden, latent).items()}
    for side in ("encoder", "decoder"):
        made[f"{side}_bias"][:hidden] = 1.0
    return made


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gated(drive: np.ndarray, held: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, list]:
    """States (time, rows, hidden) of gated units, and what the way back needs; ``drive`` is (time, rows, 3 hidden)."""
    n, states, kept = held.shape[1], [], []
    for a in drive:
        g = held @ back
        keep, reset = sigmoid(a[:, :n] + g[:, :n]), sigmoid(a[:, n : 2 * n] + g[:, n : 2 * n])
        fresh = np.tanh(a[:, 2 * n :] + reset * g[:, 2 * n :])
        kept.append((held, keep, reset, fresh, g[:, 2 * n :]))
        held = keep * held + (1 - keep) * fresh
        states.append(held)
    return np.stack(states), kept


def gated_back(kept: list, back: np.ndarray, d_states: np.ndarray, d_held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of drive, of ``back`` and of the first state, from those of all states and of the last."""
    d_drive, d_back = [], np.zeros_like(back)
    for (held, keep, reset, fresh, inner), d_state in zip(reversed(kept), d_states[::-1], strict=True):
        d = d_held + d_state
        d_fresh = d * (1 - keep) * (1 - fresh**2)
        gates = [d * (held - fresh) * keep * (1 - keep), d_fresh * inner * reset * (1 - reset)]
        d_g = np.concatenate([*gates, d_fresh * reset], 1)
        d_drive.append(np.concatenate([*gates, d_fresh], 1))
        d_back += held.T @ d_g
        d_held = d * keep + d_g @ back.T
    return np.stack(d_drive[::-1]), d_back, d_held


def forward(w: Weights, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Rebuilt windows, and what the way back needs; windows are (rows, time, channels)."""
    x = windows.transpose(1, 0, 2)
    seen, kept = gated(x @ w["encoder_in"] + w["encoder_bias"], np.zeros((len(windows), len(w["encoder_back"]))), w["encoder_back"])
    code = seen[-1] @ w["narrow"] + w["narrow_bias"]
    first = code @ w["widen"] + w["widen_bias"]
    drive = np.broadcast_to(first @ w["decoder_in"] + w["decoder_bias"], (len(x), len(windows), 3 * first.shape[1]))
    told, again = gated(drive, first, w["decoder_back"])
    return (told @ w["out"] + w["out_bias"]).transpose(1, 0, 2), (x, seen, kept, code, first, told, again)


def errors(w: Weights, windows: np.ndarray) -> np.ndarray:
    """Mean squared error of each window."""
    return ((forward(w, windows)[0] - windows) ** 2).mean((1, 2))


def gradients(w: Weights, windows: np.ndarray) -> tuple[float, Weights]:
    """Mean squared error over some windows and its gradients."""
    rebuilt, (x, seen, kept, code, first, told, again) = forward(w, windows)
    difference = (rebuilt - windows).transpose(1, 0, 2)
    d_out = 2 * difference / difference.size
    out: Weights = {"out": np.einsum("tbh,tbc->hc", told, d_out), "out_bias": d_out.sum((0, 1))}
    d_drive, out["decoder_back"], d_first = gated_back(again, w["decoder_back"], d_out @ w["out"].T, np.zeros_like(first))
    d_all = d_drive.sum(0)
    out["decoder_in"], out["decoder_bias"] = first.T @ d_all, d_all.sum(0)
    d_first = d_first + d_all @ w["decoder_in"].T
    out["widen"], out["widen_bias"] = code.T @ d_first, d_first.sum(0)
    d_code = d_first @ w["widen"].T
    out["narrow"], out["narrow_bias"] = seen[-1].T @ d_code, d_code.sum(0)
    d_drive, out["encoder_back"], _ = gated_back(kept, w["encoder_back"], np.zeros_like(seen), d_code @ w["narrow"].T)
    out["encoder_in"], out["encoder_bias"] = np.einsum("tbc,tbh->ch", x, d_drive), d_drive.sum((0, 1))
    return float((difference**2).mean()), out


def trained(w: Weights, windows: np.ndarray, epochs: int, rate: float, batch: int, seed: int) -> Weights:
    """A copy of the network after some passes over the windows, by Adam steps with cut gradients."""
    w = {k: v.copy() for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(windows), batch):
            _, found = gradients(w, windows[order[lo : lo + batch]])
            size = sum(float((g**2).sum()) for g in found.values()) ** 0.5
            step += 1
            for k, g in found.items():
                g = g * min(1.0, CLIP / (size + 1e-12))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(values: np.ndarray, channels: int, hidden: int, latent: int) -> Weights:
    out, at = {}, 0
    for name, shape in sorted(shapes(channels, hidden, latent).items()):
        n = int(np.prod(shape))
        out[name], at = values[at : at + n].reshape(shape), at + n
    return out


def matrices(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """(rows, time, channels) of windows whose channels are columns of arrays of one length."""
    columns = [np.stack([np.asarray(x, float) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()]) for c in names]
    return np.stack(columns, 2)


def is_sound(names: list[str]) -> Column:
    """Whether all channels are arrays without a null or a value that isn't finite."""
    good = F.lit(True)
    for c in names:
        good = good & F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return good


@dataclass(frozen=True)
class SequenceAutoencoder:
    """A fitted network of fixed size, and the round that it comes from."""

    weights: np.ndarray
    channels: tuple[str, ...]
    hidden: int
    latent: int
    round: int = 0
    separation: float = 0.0

    def score(self, windows: DataFrame, error: str = "error") -> DataFrame:
        """``windows`` with the mean squared error of rebuilding each; null for windows with a null or no finite value."""
        names, me = list(self.channels), self
        columns = windows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = unflat(me.weights, len(names), me.hidden, me.latent)
            for batch in batches:
                if len(batch):
                    found = errors(w, matrices(batch, names))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*columns, error])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
        fine = windows.where(is_sound(names)).mapInArrow(run, f"{kinds}, `{error}` double")
        return fine.unionByName(windows.where(~is_sound(names)).withColumn(error, F.lit(None).cast("double")))

    def save(self, spark: SparkSession, path: str) -> None:
        row = ([float(x) for x in self.weights], list(self.channels), self.hidden, self.latent, self.round, float(self.separation))
        spark.createDataFrame([row], "weights array<double>, channels array<string>, hidden int, latent int, round int, separation double").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SequenceAutoencoder:
        r = spark.read.parquet(path).head()
        return SequenceAutoencoder(np.array(r.weights), tuple(r.channels), r.hidden, r.latent, r["round"], r.separation)


def fit(
    healthy: DataFrame, channels: tuple[str, ...] = ("value",), validation: DataFrame | None = None, label: str = "label", hidden: int = 24, latent: int = 8,
    rounds: int = 6, epochs: int = 4, rate: float = 0.01, batch: int = 32, tasks: int = 8, seed: int = 42,
) -> SequenceAutoencoder:
    """A network fitted to all healthy windows, whose channels are arrays of one length.

    Windows are dealt by the hash of their values to ``tasks`` tasks, TASKS at most; each trains a copy for ``epochs`` passes
    a round, and copies are averaged by Spark, weight by weight, so the driver gets one network a round. With
    ``validation``, windows with a label of 0 or 1, the round counts in which the mean error of those labelled 1 exceeds
    that of the others most; else the last. Windows with a null or no finite value are left out; without any other
    there is nothing to learn from, which is an error.
    """
    names, tasks = list(channels), min(tasks, TASKS)
    spark, width = healthy.sparkSession, len(flat(started(len(channels), hidden, latent, seed)))
    part = F.pmod(F.xxhash64(*names), F.lit(tasks)).cast("int")
    dealt = written(healthy.where(is_sound(names)).select(part.alias("part"), *names))
    if dealt.isEmpty():
        raise ValueError("no healthy window to learn from")
    checked = None if validation is None else written(validation.select(*names, label))

    def learner(number: int, shared):
        def learn(key: tuple, table: pa.Table) -> pa.Table:
            rows = table.combine_chunks().sort_by([("__order", "ascending")]).to_batches()
            windows = np.concatenate([matrices(b, names) for b in rows])
            copy = trained(unflat(shared.value, len(names), hidden, latent), windows, epochs, rate / number**0.5, batch, seed + 1000 * number + key[0].as_py())
            return pa.table({"n": pa.array([len(windows)], pa.int64()), "weights": pa.array([flat(copy)], pa.list_(pa.float64()))})

        return learn

    now, best = flat(started(len(channels), hidden, latent, seed)), None
    for number in range(1, rounds + 1):
        copies = dealt.withColumn("__order", F.xxhash64(*names)).groupBy("part").applyInArrow(learner(number, spark.sparkContext.broadcast(now)), "n long, weights array<double>")
        mean = copies.select("n", F.posexplode("weights").alias("at", "x")).groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        now = np.zeros(width)
        for r in mean.collect():  # a row for each weight
            now[r["at"]] = r.x
        model = SequenceAutoencoder(now, tuple(channels), hidden, latent, number)
        if checked is not None:
            means = model.score(checked).groupBy().agg(F.avg(F.when(F.col(label) == 1, F.col("error"))).alias("bad"), F.avg(F.when(F.col(label) == 0, F.col("error"))).alias("good")).head()
            model = SequenceAutoencoder(now, tuple(channels), hidden, latent, number, (means.bad or 0.0) - (means.good or 0.0))
        if best is None or checked is None or model.separation > best.separation:
            best = model
    return best
