"""Small helpers that the operators share."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.sources.scratch import shared_folder

#: Words are maximal runs of other characters than these; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words, in texts with or without A-Z.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = b".,;:!?\"'()"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the quicker function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The text's words: what a split leaves, as an extraction of all matches copies the text for each of them."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP), "")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's folder; partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(taken: list[str], *names: str) -> list[str]:
    """``names`` with so many underscores before them that no column of ``taken`` has them, in any case."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{n}`") for n in names]


def fields(documents: DataFrame, names: list[str]) -> str:
    """DDL of some of a table's columns."""
    return ", ".join(f"`{n}` {documents.schema[n].dataType.simpleString()}" for n in names)


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text modulo divisor; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; nulls become empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def carried(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


class WordBuckets(dict):
    """Remembers the hash bucket of words; forgets all at a bound, so that memory stays flat."""

    def __init__(self, buckets: int, strip: bytes = b"", most: int = 300_000):
        super().__init__()
        self.buckets, self.strip, self.most = buckets, strip, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        bucket = self[word] = zlib.crc32(word.strip(self.strip) if self.strip else word) % self.buckets
        return bucket

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to labels, by damped Newton steps."""
    spread = float(margin.std()) or 1.0
    x = np.stack([margin / spread, np.ones_like(margin)], 1).astype(float)
    target = (label * label.sum() + 1) / (label.sum() + 2) * label + (1 - label) / ((1 - label).sum() + 2)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (beta - [1, 0]))
        beta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
    return max(float(beta[0]) / spread, 1e-6), float(beta[1])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, columns: dict[str, Column]) -> DataFrame:
    """At most ``most`` labelled rows whose crc32(doc_id) mod 5 is not 0, with ``columns``, ``y`` and ``__at``, their place.

    The rows with the smallest hashes of their ids are taken, so every size of table is sampled alike. A document
    with several labels gets the largest; of repeated ids one row counts, whichever is largest. Labels other than 0 and
    1, and null ids, are left out.
    """
    held = id_remainder("doc_id", 5) == 0
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # ``chosen`` holds ``most`` pairs of two numbers at most.
    met = documents.select("doc_id", F.struct(*(c.alias(n) for n, c in columns.items())).alias("__row")).join(F.broadcast(chosen), "doc_id")
    once = met.groupBy("doc_id", "__y").agg(F.max("__row").alias("__row"))
    return once.select("__row.*", F.col("__y").alias("y"), F.xxhash64("doc_id").alias("__at"))


def within(rows: DataFrame, size: str, most: int) -> DataFrame:
    """The rows, by rising ``__at``, whose sizes add up to ``most`` at most; a row that is too large alone is passed over.

    ``rows`` are a bounded sample that is written already; only its places and sizes come to the driver.
    """
    kept, total = [], 0
    for at, n in sorted((tuple(r) for r in rows.select("__at", size).collect())):
        if total + n <= most:
            kept.append((at,))
            total += n
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "__at long")), "__at", "left_semi")
