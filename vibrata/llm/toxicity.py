"""Toxicity by a convolutional text classifier that is trained in numpy.

Words are hashed to embeddings; filters of several widths run over the word sequence of the whole text, each keeps its
largest response, and a logistic layer reads those maxima. The driver fits the weights on a bounded sample of labelled
rows; scoring is one narrow pass in which each task folds embeddings and filters into lookup tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import PUNCTUATION, WordBuckets, binaries, carried, id_remainder, labelled_sample, platt, sigmoid, within
from vibrata.sources.scratch import written

CHUNK = 1 << 17  # positions convolved at once


@dataclass
class ToxicityModel:
    """Weights, the calibration of the margin, and a threshold for each language."""

    embedding: np.ndarray  # (buckets + 1, dim); the last row is padding, all zeros
    filters: dict[int, np.ndarray]  # width -> (width, dim, n_filters)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] | None = None

    @property
    def pad(self) -> int:
        return len(self.embedding) - 1

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Each filter tap applied to each bucket's embedding: convolving is then adding looked-up rows."""
        return {w: [(self.embedding @ tap).astype(np.float32) for tap in taps] for w, taps in self.filters.items()}

    def pooled(self, ids: np.ndarray, starts: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Largest response of every filter in every document, over positions in blocks of bounded size."""
        gap = max(tables) - 1
        n, parts = len(starts), []
        for width in sorted(tables):
            best = np.full((n, tables[width][0].shape[1]), -np.inf, np.float32)
            for lo in range(0, len(ids) - gap, CHUNK):
                hi = min(lo + CHUNK, len(ids) - gap)
                response = tables[width][0][ids[lo:hi]]
                for k in range(1, width):
                    response += tables[width][k][ids[lo + k : hi + k]]
                first = np.searchsorted(starts, lo, "right") - 1
                last = np.searchsorted(starts, hi - 1, "right")
                cuts = np.maximum(starts[first:last], lo) - lo
                best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(response, cuts, axis=0))
            parts.append(np.maximum(best + self.biases[width], 0))
        return np.concatenate(parts, 1)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return sigmoid((pooled @ self.out + self.offset) * self.slope + self.shift).astype(float)


def stream(docs: list[np.ndarray], pad: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another with ``gap`` pads before each and at the end, so no window spans two."""
    filler = np.full(gap, pad, np.int32)
    lengths = np.array([len(d) + gap for d in docs], np.int64)
    ids = np.concatenate([x for d in docs for x in (filler, d)] + [filler])
    return ids, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def fit(
    docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], buckets: int, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3),
    n_filters: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.05, seed: int = 7,
) -> ToxicityModel:
    """Adagrad on the log loss. A fifth of the rows is kept back to calibrate scores and thresholds.

    With no rows or one class only, the model gives the base rate (0 without rows) for every text.
    """
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (buckets + 1, dim))
    filters = {w: rng.normal(0, 0.4, (w, dim, n_filters)) for w in widths}
    biases = {w: np.zeros(n_filters) for w in widths}
    model = ToxicityModel(embedding, filters, biases, rng.normal(0, 0.2, n_filters * len(widths)), 0.0, thresholds={})
    embedding[-1] = 0
    if not len(y) or y.min() == y.max():
        model.out[:], model.offset = 0, 30.0 if len(y) and y.max() else -30.0
        return model
    kept_back = rng.random(len(y)) < 0.2
    train = np.flatnonzero(~kept_back)
    if kept_back.sum() < 20 or y[kept_back].min() == y[kept_back].max() or y[train].min() == y[train].max():
        train, kept_back = np.arange(len(y)), np.ones(len(y), bool)
    # The first embedding axis starts at the shrunken log-odds of a bucket's presence in the two classes.
    seen = np.zeros((2, buckets))
    for i in train:
        seen[int(y[i]), np.unique(docs[i])] += 1
    rates = (seen + 0.5) / (np.array([[(y[train] == 0).sum()], [(y[train] == 1).sum()]]) + 1)
    odds = np.log(rates[1] / rates[0])
    embedding[:-1, 0] += np.clip(odds, -3, 3) * (seen.sum(0) / (seen.sum(0) + 8)) * 0.3
    # Buckets of a few documents stay at zero: their words would be learned by heart and add noise elsewhere.
    known = np.append(seen.sum(0) >= np.clip(len(train) // 800, 2, 5), False)
    embedding[~known] = 0
    weight = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-3), 0.5 / max(1 - y[train].mean(), 1e-3))
    history = {w: np.full_like(filters[w], 1e-2) for w in widths}
    past_e, past_b, past_o, past_0 = np.full_like(embedding, 1e-2), {w: np.full_like(b, 1e-2) for w, b in biases.items()}, np.full_like(model.out, 1e-2), 1e-2
    gap = max(widths) - 1
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), batch):
            part = train[lo : lo + batch]
            ids, starts = stream([docs[i] for i in part], model.pad, gap)
            ends = np.append(starts[1:], len(ids) - gap)
            x = embedding[ids]
            tops, places = [], []
            for w in widths:
                z = sum(x[k : len(ids) - gap + k] @ filters[w][k] for k in range(w))
                at = np.stack([s + z[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
                places.append(at)
                tops.append(np.take_along_axis(z, at, 0) + biases[w])
            raw = np.concatenate(tops, 1)
            pooled = np.maximum(raw, 0)
            error = (sigmoid(pooled @ model.out + model.offset) - y[part]) * weight[part] / len(part)
            back = error[:, None] * model.out * (raw > 0)
            grad = pooled.T @ error + 1e-4 * model.out
            past_o += grad**2
            model.out -= rate * grad / np.sqrt(past_o)
            past_0 += error.sum() ** 2
            model.offset -= rate * error.sum() / np.sqrt(past_0)
            touched, pushes = [], []
            for j, w in enumerate(widths):
                own, at = back[:, j * n_filters : (j + 1) * n_filters], places[j]
                past_b[w] += own.sum(0) ** 2
                biases[w] -= rate * own.sum(0) / np.sqrt(past_b[w])
                grads = np.stack([np.einsum("bfd,bf->df", x[at + k], own) for k in range(w)])
                for k in range(w):
                    touched.append(ids[at + k].ravel())
                    pushes.append((own[:, :, None] * filters[w][k].T[None]).reshape(-1, dim))
                history[w] += grads**2
                filters[w] -= rate * grads / np.sqrt(history[w])
            where, back_to = np.unique(np.concatenate(touched), return_inverse=True)
            push = np.zeros((len(where), dim))
            np.add.at(push, back_to, np.concatenate(pushes))
            past_e[where] += push**2
            embedding[where] -= rate * push / np.sqrt(past_e[where])
            embedding[~known] = 0
    model.embedding = embedding.astype(np.float32)
    keep = np.flatnonzero(kept_back)
    tables = model.tables()
    ids, starts = stream([docs[i] for i in keep], model.pad, gap)
    pooled = model.pooled(ids, starts, tables)
    model.slope, model.shift = platt(pooled @ model.out + model.offset, y[keep].astype(float))
    scores = model.score(pooled)
    model.thresholds = {None: best_threshold(scores, y[keep])}
    for lang in sorted({x for x in (langs[i] for i in keep) if x is not None}):
        own = np.array([langs[i] == lang for i in keep])
        if own.sum() >= 30 and 0 < y[keep][own].sum() < own.sum():
            model.thresholds[lang] = best_threshold(scores[own], y[keep][own])
    return model


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Midway between the scores around the cut with the best F1; ties go to the cut nearest 0.5."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    s = scores[order]
    ok = np.append(s[:-1] > s[1:], True)
    cuts = (s + np.append(s[1:], 0)) / 2
    best = np.flatnonzero(ok & (f1 >= f1[ok].max() - 1e-12))
    return float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])


def hashed(words: WordBuckets, text: bytes) -> np.ndarray:
    return words.ids(text.lower().split())


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", buckets: int = 1 << 18, most_labelled: int = 10000, epochs: int = 8, most_words: int = 1 << 23) -> ToxicityModel:
    """Fit on at most ``most_labelled`` labelled rows that aren't held out, of at most ``most_words`` words together.

    Tasks send hashed words, not texts, so 32 MB reach the driver at most. Texts are learned from whole; one that the
    rest of the words' budget can't hold is left out. Null texts have no words. Without labels, or with one class only,
    see ``fit``.
    """

    def encode(batches):
        words = WordBuckets(buckets, PUNCTUATION)
        for b in batches:
            ids = [hashed(words, t).tobytes() for t in binaries(b, "text")]
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), sizes, *carried(b, ["lang", "y", "__at"])], ["ids", "n", "lang", "y", "__at"])

    sample = labelled_sample(documents, labels, label, most_labelled, {"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})
    encoded = written(sample.mapInArrow(encode, "ids binary, n bigint, lang string, y int, __at bigint"))
    rows = within(encoded, "n", most_words).toArrow().sort_by([("ids", "ascending"), ("y", "ascending")])
    docs = [np.frombuffer(x, np.int32) for x in rows["ids"].to_pylist()]
    return fit(docs, np.array(rows["y"].to_pylist(), float), rows["lang"].to_pylist(), buckets, epochs=epochs)


def score(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, score in [0, 1], the language's threshold, and ``flagged`` by that threshold.

    Null and empty texts are scored as texts without words. Repeated rows get a row each, other columns are ignored,
    an empty table gives an empty result, and texts of any length are read whole, in blocks of positions. The language
    only picks the threshold; unknown and null languages use the one of all languages.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # size fixed by buckets, dim and filters

    def run(batches):
        own: ToxicityModel = shared.value
        tables = own.tables()
        words, gap = WordBuckets(own.pad, PUNCTUATION), max(tables) - 1
        for b in batches:
            texts = binaries(b, "text")
            if not texts:
                continue
            ids, starts = stream([hashed(words, t) for t in texts], own.pad, gap)
            scores = own.score(own.pooled(ids, starts, tables))
            default = own.thresholds.get(None, 0.5)
            cut = [own.thresholds.get(x, default) for x in carried(b, ["lang"])[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([*carried(b, ["id"]), pa.array(scores), pa.array(cut, pa.float64()), pa.array(scores >= np.array(cut))], ["id", "score", "threshold", "flagged"])

    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return source.mapInArrow(run, f"id {kind}, score double, threshold double, flagged boolean")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The production query: every document scored, with its fold and the decision at 0.5."""
    scored = score(documents, train(documents, labels))
    return scored.select(
        F.col("id").alias("doc_id"), (id_remainder("id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "threshold", "flagged",
    )
