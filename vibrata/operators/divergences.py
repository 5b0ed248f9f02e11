"""Distributions of wavelet coefficients of whole signals and of windows, and how far they lie apart."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StructField, StructType

from vibrata.functions import divergence, wavelet
from vibrata.functions.arrays import let, mean
from vibrata.functions.batches import by_length, matrices
from vibrata.operators.joins import looked_up
from vibrata.operators.signals import finite, renumbered, with_length
from vibrata.sources.scratch import written

BLOCK = 1 << 14  # samples of a long signal that one row transforms
MOST_BOOKS = 1 << 12  # keys whose reference distributions, about 5 KB each, are fetched
CHUNK = 1 << 11  # windows that are worked on at once
WINDOW_SUMMARY = ("div_mean_kl", "div_max_kl", "div_mean_jsd")


def long_modwt(samples: DataFrame, keys: Sequence[str], level: int = 5, idx: str = "idx", value: str = "value", block: int = BLOCK) -> DataFrame:
    """keys, n_levels, band (D1, D2, ..., A and the number of levels), idx, coef: the circular transform of whole signals.

    A long signal is cut into blocks, each with the samples before it that its coefficients reach back to; the first
    block has those of the end. So blocks are transformed apart, in one shuffle, and give what the whole signal would.
    Signals need finite values and are numbered from 0 without gaps.
    """
    reach = (wavelet.TAPS - 1) * (2**level - 1)
    if block < reach:
        raise ValueError(f"a block of {block} samples is shorter than the {reach} that coefficients reach back")
    sized = with_length(samples, keys)
    own = F.floor(F.col(idx) / block)
    at = lambda b, p: F.struct(b.cast("long").alias("block"), p.cast("long").alias("place"))
    here = at(own, F.col(idx))
    ahead = F.when((F.col(idx) >= (own + 1) * block - reach) & ((own + 1) * block < F.col("__n")), at(own + 1, F.col(idx)))
    around = F.when((F.col("__n") > block) & (F.col(idx) >= F.col("__n") - reach), at(F.lit(0), F.col(idx) - F.col("__n")))
    copies = sized.select(*keys, "__n", value, F.explode(F.array_compact(F.array(here, ahead, around))).alias("__at"))
    rows = copies.groupBy(*keys, "__n", "__at.block").agg(F.sort_array(F.collect_list(F.struct("__at.place", value))).alias("__rows"))
    rows = rows.select(*keys, F.col("__n").alias("n"), "block", F.transform("__rows", lambda r: r[value].cast("double")).alias("w"), F.when(F.col("__n") > block, reach).otherwise(0).alias("skip"))

    @pandas_udf("array<array<double>>")
    def transformed(w: pd.Series, skip: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([list(wavelet.modwt(np.asarray(x, float)[None], wavelet.levels(k, level))[:, 0, s:]) if k > 1 else [] for x, s, k in zip(w, skip, n, strict=True)])

    bands = rows.select(*keys, "n", "block", F.posexplode(transformed("w", "skip", "n")).alias("b", "coefs"), F.lit(level).alias("level"))
    allowed = F.greatest(F.floor(F.log2(F.col("n") / float(wavelet.TAPS - 1))), F.lit(1))
    named = bands.withColumn("n_levels", F.least(allowed, F.col("level")).cast("int"))
    band = F.when(F.col("b") < F.col("n_levels"), F.concat(F.lit("D"), (F.col("b") + 1).cast("string"))).otherwise(F.concat(F.lit("A"), F.col("n_levels").cast("string")))
    out = named.select(*keys, "n_levels", band.alias("band"), "block", F.posexplode("coefs").alias("i", "coef"))
    return out.select(*keys, "n_levels", "band", (F.col("block") * block + F.col("i")).alias("idx"), "coef")


def histograms(values: DataFrame, keys: Sequence[str], value: str, bins: int = divergence.BINS) -> DataFrame:
    """keys, centers, probs: equal bins over each key's range, one added to each count. Constant keys have no row."""
    ranges = values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).where("high > low")
    place = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int"), F.lit(bins - 1))
    counts = looked_up(values.where(F.col(value).isNotNull()), ranges, keys).groupBy(*keys, "low", "high", "n", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    # A key has as many rows here as it has bins at most.
    gathered = counts.groupBy(*keys, "low", "high", "n").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("counts"))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    width = (F.col("high") - F.col("low")) / bins
    probs = F.transform(every, lambda i: (F.coalesce(F.try_element_at("counts", i), F.lit(0)) + 1.0) / (F.col("n") + bins))
    return gathered.select(*keys, F.transform(every, lambda i: F.col("low") + (i + 0.5) * width).alias("centers"), probs.alias("probs"))


def densities(values: DataFrame, keys: Sequence[str], value: str, bins: int = divergence.BINS) -> DataFrame:
    """keys, centers, probs by Gaussian kernels of Silverman's width, on a grid a tenth beyond the range.

    A value adds to ``bins`` sums of its key, a column each, so tasks pass on a row for each key and no value is copied.
    Keys with one value or equal ones have no row.
    """
    stats = values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).where("n > 1 AND sd > 0")
    margin = 0.1 * (F.col("high") - F.col("low") + 1e-12)
    stats = stats.withColumn("start", F.col("low") - margin).withColumn("step", (F.col("high") - F.col("low") + 2 * margin) / (bins - 1))
    stats = stats.withColumn("width", F.col("sd") * F.pow(3.0 * F.col("n") / 4, F.lit(-0.2))).drop("low", "high", "sd")
    near = looked_up(values.where(F.col(value).isNotNull()), stats, keys)
    place = lambda i: F.col("start") + i * F.col("step")
    z = lambda i: (place(i) - F.col(value)) / F.col("width")
    rows = near.groupBy(*keys, "start", "step", "n", "width").agg(*(F.sum(F.exp(-0.5 * z(i) * z(i))).alias(f"__s{i}") for i in range(bins)))
    mass = F.transform(F.array(*(F.col(f"__s{i}") for i in range(bins))), lambda s: s / (F.col("n") * F.col("width") * float(np.sqrt(2 * np.pi))))
    told = rows.select(*keys, F.array(*(place(i) for i in range(bins))).alias("centers"), mass.alias("mass"))
    total = F.aggregate("mass", F.lit(0.0), lambda s, m: s + m) + 1e-12
    return told.withColumn("total", total).select(*keys, "centers", F.transform("mass", lambda m: m / F.col("total")).alias("probs"))


def reference_distributions(samples: DataFrame, keys: Sequence[str], level: int = 5, bins: int = divergence.BINS, method: str = "histogram", idx: str = "idx", value: str = "value") -> DataFrame:
    """keys, band, centers, probs of every band of whole signals; signals under eight finite samples have none.

    Samples that aren't finite are dropped and the rest numbered anew before the transform. Both the samples and the
    coefficients are read more than once, for lengths, ranges and counts, and so written.
    """
    if method not in ("histogram", "kde"):
        raise ValueError(f"unknown method {method}")
    sound = with_length(written(renumbered(finite(samples.select(*keys, idx, value), value), keys, idx)), keys)
    coefs = written(long_modwt(sound.where(F.col("__n") >= wavelet.LEAST).drop("__n"), keys, level, idx, value))
    return (histograms if method == "histogram" else densities)(coefs, [*keys, "band"], "coef", bins)


def band_distributions(w, level: int = 5, bins: int = divergence.BINS):
    """array<struct<centers, probs>> of a window's bands, details first; null fields for constant bands."""

    @pandas_udf("array<struct<centers: array<double>, probs: array<double>>>")
    def counted(windows: pd.Series) -> pd.Series:
        def work(m: np.ndarray) -> list:
            per_band = [divergence.bin_masses(b, bins) for b in wavelet.modwt(m, level)]
            return [[{"centers": d[i] and d[i][0], "probs": d[i] and d[i][1]} for d in per_band] for i in range(len(m))]

        return by_length(windows, work, wavelet.LEAST)

    return counted(w)


def _band(i, have):
    """The name of a window's band by its place, of ``have`` details and a smooth."""
    return F.when(i < have, F.concat(F.lit("D"), (i + 1).cast("string"))).otherwise(F.concat(F.lit("A"), have.cast("string")))


def book_divergences(books: Sequence[dict], w, number, level: int = 5):
    """struct<kl, jsd> of arrays with a value for each band of a window, details first: how far it lies from books[number].

    Null stands for bands that are constant or that the book lacks, or that there is no book for; windows that have no
    bands are null. The books go to Python with the function and windows are worked on as matrices, so that neither the
    books nor the windows' distributions are copied for each row.
    """
    names = sorted({band for book in books for band in book})
    centers, probs = (np.full((len(names), len(books) + 1, divergence.BINS), np.nan) for _ in range(2))  # the last for no book
    for n, book in enumerate(books):
        for band, d in book.items():
            if d["centers"][-1] > d["centers"][0]:
                centers[names.index(band), n], probs[names.index(band), n] = d["centers"], d["probs"]

    @pandas_udf("struct<kl: array<double>, jsd: array<double>>")
    def told(windows: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        own = numbers.fillna(len(books)).to_numpy(int)
        kls, jsds = np.full(len(windows), None, object), np.full(len(windows), None, object)

        def work(m: np.ndarray, places: np.ndarray) -> None:
            bands = wavelet.modwt(m, level)
            kl, jsd = (np.full((len(m), len(bands)), np.nan) for _ in range(2))  # NaN is null in what Python returns
            for i, band in enumerate(bands):
                name = f"D{i + 1}" if i + 1 < len(bands) else f"A{len(bands) - 1}"
                if name not in names:
                    continue
                qc, qp, varied = divergence.bin_matrices(band)
                k, book = names.index(name), own[places]
                rows = np.flatnonzero(varied & (qc[:, -1] > qc[:, 0]) & ~np.isnan(centers[k, book, 0]))
                kl[rows, i], jsd[rows, i] = divergence.apart(centers[k, book[rows]], probs[k, book[rows]], qc[rows], qp[rows])
            for j, place in enumerate(places):
                kls[place], jsds[place] = kl[j], jsd[j]

        for places, m in matrices(windows, wavelet.LEAST):
            for at in range(0, len(m), CHUNK):
                work(m[at : at + CHUNK], places[at : at + CHUNK])
        return pd.DataFrame({"kl": kls, "jsd": jsds})

    return told(w, number)


def with_window_divergence(table: DataFrame, reference: DataFrame, level: int = 5, w: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``divergences`` (band, kl, jsd of each band) and their mean and largest values.

    ``reference`` is (keys, band, centers, probs), a handful of rows a key. Bands it lacks are skipped, and so is the
    smooth of a window that allows fewer levels than the reference; windows without any band have nulls. Constant bands
    have no distribution and are skipped. Windows of a key without a reference stay, with nulls.
    """
    books = reference.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("centers", "probs")))).alias("__book"))
    found = books.limit(MOST_BOOKS + 1).collect()
    shapes = {len(x) for row in found for d in row["__book"].values() for x in (d["centers"], d["probs"])}
    if len(found) <= MOST_BOOKS and shapes <= {divergence.BINS}:
        numbered = [(*(row[k] for k in keys), i) for i, row in enumerate(found)]
        kinds = StructType([*(reference.schema[k] for k in keys), StructField("__number", IntegerType())])
        numbers = F.broadcast(table.sparkSession.createDataFrame(numbered, kinds, verifySchema=False))
        joined = table.join(numbers, list(keys), "left") if keys else table.join(numbers, F.lit(True), "left")
        told = joined.withColumn("__apart", book_divergences([row["__book"].asDict() if hasattr(row["__book"], "asDict") else row["__book"] for row in found], F.col(w), F.col("__number"), level))
        have = F.size("__apart.kl") - 1
        one = lambda i: F.when(F.get("__apart.kl", i).isNotNull(), F.struct(_band(i, have).alias("band"), F.get("__apart.kl", i).alias("kl"), F.get("__apart.jsd", i).alias("jsd")))
        told = told.withColumn("divergences", F.when(F.col("__apart.kl").isNotNull(), F.array_compact(F.transform(F.sequence(F.lit(0), have), one))))
    else:
        joined = looked_up(table, books, keys, "left", most=MOST_BOOKS)
        joined = joined.withColumn("__dists", band_distributions(F.col(w), level))
        have = F.size("__dists") - 1

        def apart(d, i):
            return let(F.try_element_at("__book", _band(i, have)), lambda ref: let(divergence.aligned(ref, d), lambda pq: F.when(
                pq.isNotNull(), F.struct(_band(i, have).alias("band"), divergence.symmetric_kl(pq["p"], pq["q"]).alias("kl"), divergence.jensen_shannon(pq["p"], pq["q"]).alias("jsd")),
            )))

        told = joined.withColumn("divergences", F.array_compact(F.transform("__dists", apart)))
    kls, jsds = F.transform("divergences", lambda d: d["kl"]), F.transform("divergences", lambda d: d["jsd"])
    return told.select(*table.columns, "divergences", mean(kls).alias("div_mean_kl"), F.array_max(kls).alias("div_max_kl"), mean(jsds).alias("div_mean_jsd"))


def band_columns(table: DataFrame, level: int = 5) -> DataFrame:
    """``divergences`` as columns div_d1_kl, div_d1_jsd, ..., div_a_kl, div_a_jsd."""
    pick = lambda band, field: F.get(F.transform(F.filter("divergences", lambda d: d["band"] == band), lambda d: d[field]), F.lit(0))
    names = [(f"D{j}", f"d{j}") for j in range(1, level + 1)] + [(f"A{level}", "a")]
    return table.select("*", *(pick(band, f).alias(f"div_{n}_{f}") for band, n in names for f in ("kl", "jsd"))).drop("divergences")


def cross_divergence(reference: DataFrame, key: str) -> DataFrame:
    """sensor_a, sensor_b, band, kl of all ordered pairs of keys and the bands they share.

    Keys are sensors, of which there are few; the table has a handful of rows for each.
    """
    a = reference.select(F.col(key).alias("sensor_a"), "band", F.struct("centers", "probs").alias("pa"))
    b = reference.select(F.col(key).alias("sensor_b"), "band", F.struct("centers", "probs").alias("pb"))
    met = a.join(b, "band").where("sensor_a <> sensor_b").withColumn("pq", divergence.aligned(F.col("pa"), F.col("pb")))
    return met.select("sensor_a", "sensor_b", "band", divergence.symmetric_kl(F.col("pq.p"), F.col("pq.q")).alias("kl"))


def cross_matrix(reference: DataFrame, key: str) -> DataFrame:
    """sensor_a, sensor_b, mean_kl over shared bands; 0 for a sensor and itself."""
    apart = cross_divergence(reference, key).groupBy("sensor_a", "sensor_b").agg(F.avg("kl").alias("mean_kl"))
    same = reference.select(F.col(key).alias("sensor_a")).distinct().select("sensor_a", F.col("sensor_a").alias("sensor_b"), F.lit(0.0).alias("mean_kl"))
    return same.unionByName(apart)
