"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank, so a document is scored in time linear in its features:
sum over pairs of <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import WordBuckets, binaries, carried, fields, id_remainder, labelled_sample, platt, quoted, sigmoid, unused, within
from vibrata.sources.scratch import written

#: The structure statistics, in order; n_chars is the table's own column.
STATISTICS = [
    "log_words", "log_bytes", "distinct_words", "same_as_previous", "word_length", "upper", "digit", "symbol", "stop",
    "other_bytes", "words_per_line", "distinct_lines", "log_n_chars",
]
BINS = 12
_CLASS = np.zeros(256, np.uint8)  # 0 letters and spaces, 1 upper case, 2 digits, 3 symbols, 4 stops and commas, 5 beyond ASCII
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_CLASS[[ord(c) for c in ".,"]] = 4
_CLASS[128:] = 5


@dataclass
class QualityModel:
    weights: np.ndarray  # (buckets + BINS * statistics,)
    factors: np.ndarray  # (same, rank)
    edges: np.ndarray  # (statistics, BINS - 1)
    buckets: int
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        return self.bias + float(self.weights[index] @ value) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())

    def features(self, words: tuple[np.ndarray, np.ndarray], statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words weigh together as much as one statistic's bin does; each statistic sets one of its bins."""
        index, count = words
        value = count / (np.sqrt((count * count).sum()) or 1.0)
        bins = (statistics[:, None] >= self.edges).sum(1) + self.buckets + BINS * np.arange(len(self.edges))
        return np.concatenate([index, bins]), np.concatenate([value, np.ones(len(bins))])

    def score(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(margins * self.slope + self.shift)


def describe(text: bytes, n_chars: float | None, buckets: WordBuckets) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct word buckets with counts, and the statistics, of a whole text."""
    words = text.lower().split()
    n, size = len(words), max(len(text), 1)
    ids = buckets.ids(words)
    index, count = np.unique(ids, return_counts=True)
    kinds = np.zeros(6)
    for lo in range(0, len(text), 1 << 22):
        kinds += np.bincount(_CLASS[np.frombuffer(text[lo : lo + (1 << 22)], np.uint8)], minlength=6)
    lines = text.split(b"\n")
    repeats = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    stats = [np.log1p(n), np.log1p(len(text)), len(index) / max(n, 1), repeats, size / max(n, 1), *(kinds[1:] / size), n / len(lines), len(set(lines)) / len(lines)]
    return (index.astype(np.int32), count.astype(np.float64)), np.array([*stats, np.log1p(max(n_chars or 0.0, 0.0))])


def fit(words: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray, y: np.ndarray, buckets: int, rank: int = 8, epochs: int = 10, batch: int = 64, rate: float = 0.08, seed: int = 11) -> QualityModel:
    """Adagrad on the log loss; a fifth of the rows only calibrates the score.

    With no rows the score is 1 for every text, with one class only that class, so that nothing is rejected unlearned.
    """
    rng = np.random.default_rng(seed)
    k = len(STATISTICS)
    size = buckets + BINS * k
    edges = np.quantile(statistics, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(y) else np.zeros((k, BINS - 1))
    model = QualityModel(np.zeros(size), rng.normal(0, 0.05, (size, rank)), edges, buckets)
    if not len(y) or y.min() == y.max():
        model.factors[:], model.bias = 0, 30.0 if not len(y) or y.max() else -30.0
        return model
    rows = [model.features(w, s) for w, s in zip(words, statistics, strict=True)]
    kept_back = rng.random(len(y)) < 0.2
    train = np.flatnonzero(~kept_back)
    if kept_back.sum() < 20 or y[kept_back].min() == y[kept_back].max() or y[train].min() == y[train].max():
        train, kept_back = np.arange(len(y)), np.ones(len(y), bool)
    past_w, past_v, past_b = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), batch):
            part = train[lo : lo + batch]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            lengths = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            v = model.factors[index] * value[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            squares = np.add.reduceat((v * v).sum(1), starts)
            margin = model.bias + np.add.reduceat(model.weights[index] * value, starts) + 0.5 * ((total**2).sum(1) - squares)
            error = np.repeat((sigmoid(margin) - y[part]) / len(part), lengths)
            grad_w = error * value
            grad_v = (error * value)[:, None] * (np.repeat(total, lengths, axis=0) - v)
            where, back_to = np.unique(index, return_inverse=True)
            sum_w = np.bincount(back_to, grad_w, len(where)) + 1e-5 * model.weights[where]
            sum_v = np.stack([np.bincount(back_to, grad_v[:, j], len(where)) for j in range(rank)], 1) + 1e-5 * model.factors[where]
            past_w[where] += sum_w**2
            past_v[where] += sum_v**2
            model.weights[where] -= rate * sum_w / np.sqrt(past_w[where])
            model.factors[where] -= rate * sum_v / np.sqrt(past_v[where])
            push = error.sum() / max(len(index), 1) * len(part)
            past_b += push**2
            model.bias -= rate * push / np.sqrt(past_b)
    keep = np.flatnonzero(kept_back)
    model.slope, model.shift = platt(np.array([model.margin(*rows[i]) for i in keep]), y[keep].astype(float))
    return model


def n_chars(documents: DataFrame) -> Column:
    """The table's own column of lengths, or none where it has no such column."""
    return F.col("n_chars").cast("double") if "n_chars" in documents.columns else F.lit(None).cast("double")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 1 << 16, most_labelled: int = 6000, epochs: int = 10, most_features: int = 1 << 22) -> QualityModel:
    """Fit on at most ``most_labelled`` labelled rows that aren't held out, of at most ``most_features`` features together.

    Tasks send features, not texts, so 34 MB reach the driver at most; a text whose features the rest of that budget
    can't hold is left out. Null texts have no words. Without labels, or with one class only, see ``fit``.
    """

    def encode(batches):
        hashes = WordBuckets(buckets)
        for b in batches:
            found = [describe(t, n, hashes) for t, n in zip(binaries(b, "text"), carried(b, ["n_chars"])[0].to_pylist(), strict=True)]
            columns = [pa.array([f(x) for x in found], pa.binary()) for f in (lambda x: x[0][0].tobytes(), lambda x: x[0][1].astype(np.float32).tobytes(), lambda x: x[1].tobytes())]
            sizes = pa.array([len(x[0][0]) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, sizes, *carried(b, ["y", "__at"])], ["index", "count", "stats", "n", "y", "__at"])

    sample = labelled_sample(documents, labels, label, most_labelled, {"text": F.col("text").cast("string"), "n_chars": n_chars(documents)})
    encoded = written(sample.mapInArrow(encode, "index binary, count binary, stats binary, n bigint, y int, __at bigint"))
    rows = within(encoded, "n", most_features).toArrow().sort_by([("stats", "ascending"), ("index", "ascending"), ("y", "ascending")])
    words = [(np.frombuffer(i, np.int32), np.frombuffer(c, np.float32).astype(float)) for i, c in zip(rows["index"].to_pylist(), rows["count"].to_pylist(), strict=True)]
    stats = np.array([np.frombuffer(s) for s in rows["stats"].to_pylist()]).reshape(-1, len(STATISTICS))
    return fit(words, stats, np.array(rows["y"].to_pylist(), float), buckets, epochs=epochs)


def score(documents: DataFrame, model: QualityModel, keep: list[str], score_col: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score, in one narrow pass.

    Null and empty texts are scored as texts without words; a null n_chars, or none, counts as 0. Repeated rows get a row
    each and an empty table gives an empty result. Texts of any length are read whole. Columns not named in ``keep`` are
    ignored; ``score_col`` must not be one of them.
    """
    if score_col in keep:
        raise ValueError(f"there is a column {score_col} already")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # size fixed by buckets and rank
    text, chars = unused([*keep, score_col], "text_read", "chars_read")

    def run(batches):
        own: QualityModel = shared.value
        hashes = WordBuckets(own.buckets)
        for b in batches:
            lengths = carried(b, [chars])[0].to_pylist()
            margins = np.array([own.margin(*own.features(*describe(t, n, hashes))) for t, n in zip(binaries(b, text), lengths, strict=True)])
            yield pa.RecordBatch.from_arrays([*carried(b, keep), pa.array(own.score(margins), pa.float64())], [*keep, score_col])

    source = documents.select(*quoted(keep), F.col("text").cast("string").alias(text), n_chars(documents).alias(chars))
    return source.mapInArrow(run, f"{fields(documents, keep)}, `{score_col}` double")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The production query: every document scored, with its fold and the decision at 0.3."""
    scored = score(documents, train(documents, labels), ["doc_id"])
    return scored.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score ``threshold`` or more.

    Each row is judged by itself: null and empty texts as texts without words, repeated rows alike. The empty table gives
    an empty result; without labels all rows stay.
    """
    columns = documents.columns
    (own,) = unused(columns, "score")
    return score(documents, train(documents, labels), columns, own).where(F.col(own) >= threshold).select(*quoted(columns))
