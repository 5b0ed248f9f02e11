"""How well classifiers and detectors do: accuracies, confusion, ROC curves, detection at a threshold, effect sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.operators.joins import looked_up
from vibrata.operators.running import quantiles, totals_before


def top_k_accuracy(scored: DataFrame, truth: str, probabilities: Column, k: int, name: str = "top_k_accuracy") -> DataFrame:
    """Share of rows whose true class is among the k most probable. ``probabilities`` maps classes to numbers.

    Of equal probabilities the class that sorts last comes first. A class that the map lacks is a miss.
    """
    rows = scored.select(F.col(truth).alias("t"), probabilities.alias("p")).withColumn("own", F.try_element_at("p", F.col("t")))
    better = F.size(F.filter(F.map_entries("p"), lambda e: (e["value"] > F.col("own")) | ((e["value"] == F.col("own")) & (e["key"] > F.col("t")))))
    return rows.agg(F.avg(F.when(F.col("own").isNotNull() & (better < k), 1.0).otherwise(0.0)).alias(name))


def confusion(predicted: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n), long; pivot ``guess`` for the matrix."""
    return predicted.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def class_accuracy(predicted: DataFrame, truth: str, guess: str) -> DataFrame:
    return predicted.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def roc_curve(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, fpr, tpr, area): a row for each distinct score, from ``score >= threshold``.

    ``label`` is 1 or true for what should score high. ``area`` is the trapezoid from the threshold above. Scores are
    counted first; the running counts come from buckets of scores, so no task holds all of a key.
    """
    positive = F.col(label).cast("int")
    counted = scored.where(F.col(score).isNotNull()).groupBy(*keys, (-F.col(score).cast("double")).alias("__down")).agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))
    placed = totals_before(counted, keys, "__down", ["p", "q"])
    share = lambda part, whole: F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(0.0)
    tpr, before_tpr = share(F.col("before_p") + F.col("p"), "all_p"), share(F.col("before_p"), "all_p")
    fpr, before_fpr = share(F.col("before_q") + F.col("q"), "all_q"), share(F.col("before_q"), "all_q")
    return placed.select(*keys, (-F.col("__down")).alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"), ((fpr - before_fpr) * (tpr + before_tpr) / 2).alias("area"))


def auc(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return roc_curve(scored, score, label, keys).groupBy(*keys).agg(F.sum("area").alias("auc"))


def detection(scored: DataFrame, score: str, label: str, keys: Sequence[str] = (), healthy_quantile: float = 0.95) -> DataFrame:
    """Precision, recall, f1, accuracy and counts for ``score`` above the healthy scores' quantile."""
    cuts = quantiles(scored.where(F.col(label).cast("int") == 0), keys, score, {"threshold": healthy_quantile})
    judged = looked_up(scored, cuts, keys)
    flagged, real = F.col(score) > F.col("threshold"), F.col(label).cast("int") == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    cells = judged.groupBy(*keys, "threshold").agg(count(flagged & real).alias("tp"), count(flagged & ~real).alias("fp"), count(~flagged & ~real).alias("tn"), count(~flagged & real).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    told = cells.withColumn("precision", precision).withColumn("recall", recall)
    return told.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn(
        "accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    )


def effect_size(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's d with population deviations, and the ratio of the two means."""
    bad = F.col(label).cast("int") == 1
    of = lambda f, c: f(F.when(c, F.col(score)))
    parts = scored.groupBy(*keys).agg(of(F.avg, ~bad).alias("healthy_mean"), of(F.avg, bad).alias("degraded_mean"), of(F.stddev_pop, ~bad).alias("s0"), of(F.stddev_pop, bad).alias("s1"))
    pooled = F.sqrt((F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / 2)
    return parts.select(*keys, "healthy_mean", "degraded_mean", ((F.col("degraded_mean") - F.col("healthy_mean")) / (pooled + 1e-8)).alias("cohens_d"), (F.col("degraded_mean") / (F.col("healthy_mean") + 1e-8)).alias("separation"))


def seeded_order(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))


def balanced_split(rows: DataFrame, label: str, ids: Sequence[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``is_test``: as many of every class, ``share`` of the smallest, in an order of seeded hashes.

    Hashes are cut into buckets that are ranked apart, so one class may hold most rows.
    """
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.floor(F.min("n") * share).alias("__take"))
    placed = _ranked_by_hash(rows, label, ids, seed)
    return placed.join(F.broadcast(least), F.lit(True)).withColumn("is_test", F.col("__place") < F.col("__take")).select(*rows.columns, "is_test")  # one row


def stratified_sample(rows: DataFrame, label: str, ids: Sequence[str], most: int = 500, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of every class, the first in an order of seeded hashes."""
    return _ranked_by_hash(rows, label, ids, seed).where(F.col("__place") < most).select(*rows.columns)


def _ranked_by_hash(rows: DataFrame, label: str, ids: Sequence[str], seed: int) -> DataFrame:
    hashed = rows.withColumn("__h", seeded_order(ids, seed)).withColumn("__b", F.substring("__h", 1, 2))
    sizes = hashed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(label, "__b", before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", *ids)) - 1
    return hashed.withColumn("__i", inside).join(starts, [label, "__b"]).withColumn("__place", F.col("__start") + F.col("__i"))
