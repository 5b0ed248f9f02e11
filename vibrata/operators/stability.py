"""How stable features are over time and over conditions, and which of them make a quality vector.

Stability tables are long, a row for each feature: few rows, whatever the number of windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.operators.signals import indexed
from vibrata.operators.windows import segments

TINY = 1e-12


def feature_means(features: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, feature, mean), averages first and turned into rows after, so that windows are shuffled as sums only."""
    means = features.groupBy(*by).agg(*(F.avg(_null(n)).alias(n) for n in names))
    return _rows(means, by, names, {"mean": "{}"})


def _rows(table: DataFrame, by: Sequence[str], names: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """A row for each feature; ``columns`` are names of values with the pattern of their wide columns."""
    parts = F.array(*(F.struct(F.lit(n).alias("feature"), *(F.col(f"`{pattern.format(n)}`").alias(c) for c, pattern in columns.items())) for n in names))
    return table.select(*by, F.explode(parts).alias("__f")).select(*by, "__f.*")


def _null(name: str):
    return F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double"))


def _ranked(table: DataFrame, keys: Sequence[str], cv: str) -> DataFrame:
    """Ranks from the smallest variation on; nulls come last, ties in the order of names."""
    order = Window.partitionBy(*keys, F.lit(0)).orderBy(F.col(cv).asc_nulls_last(), "feature")
    return table.withColumn("stability_rank", F.row_number().over(order).cast("int"))


def over_time(features: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], n_segments: int = 4, spread: float | None = None) -> DataFrame:
    """(keys, feature, mean, std, cv, stability_rank) over the means of equal stretches of windows in ``order``.

    The last stretch takes the rest; std is the sample deviation. Keys with fewer windows than stretches have no rows.
    ``spread`` is as for ``indexed``.
    """
    one = [*keys] or ["__one"]
    rows = features if keys else features.withColumn("__one", F.lit(0))
    cut = segments(indexed(rows, one, order, spread, "__idx"), one, n_segments, True, "__idx", "__segment")
    means = feature_means(cut, [*one, "__segment"], names)
    table = means.groupBy(*one, "feature").agg(F.avg("mean").alias("m"), F.stddev_samp("mean").alias("std"))
    table = table.select(*keys, "feature", F.col("m").alias("mean"), "std", (F.col("std") / (F.abs("m") + TINY)).alias("cv"))
    return _ranked(table, keys, "cv")


def across_conditions(features: DataFrame, condition: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, mean_, std_ and cv_across_conditions, n_conditions, stability_rank) over condition means.

    A feature that a condition has no value of has a null variation, and comes last. With one condition std is 0.
    """
    return across_means(feature_means(features, [*keys, condition], names), keys)


def across_means(means: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``across_conditions`` from means that are there already: a row for each key, condition and feature."""
    whole = F.count("mean") == F.count(F.lit(1))
    table = means.groupBy(*keys, "feature").agg(
        F.when(whole, F.avg("mean")).alias("mean_across_conditions"),
        F.when(whole, F.coalesce(F.stddev_samp("mean"), F.lit(0.0))).alias("std_across_conditions"), F.count(F.lit(1)).cast("int").alias("n_conditions"),
    )
    table = table.withColumn("cv_across_conditions", F.col("std_across_conditions") / (F.abs("mean_across_conditions") + TINY))
    return _ranked(table, keys, "cv_across_conditions")


def calm(stability: DataFrame, keys: Sequence[str] = (), most: float = 0.35, least: int = 8, fallback: int = 48, cv: str = "cv_across_conditions") -> DataFrame:
    """``stability`` with ``fits``: whether a feature's variation is at most ``most``.

    Where fewer than ``least`` features of a key are so calm, the ``fallback`` first in rank fit instead. A feature
    without a variation doesn't fit the first way.
    """
    enough = F.sum(F.when(F.col(cv) <= most, 1).otherwise(0)).over(Window.partitionBy(*keys, F.lit(0))) >= least
    return stability.withColumn("fits", F.when(enough, F.coalesce(F.col(cv) <= most, F.lit(False))).otherwise(F.col("stability_rank") <= fallback))


def log_variation(features: DataFrame, condition: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, cv_log, cv_raw): variation over condition means of a feature's logarithm, and of the feature.

    The first takes population deviations and the second sample ones; only positive features have a logarithm of use.
    """
    logs = features.select(*keys, condition, *(F.ln(_null(n) + TINY).alias(n) for n in names))
    cv = lambda table, std: feature_means(table, [*keys, condition], names).groupBy(*keys, "feature").agg((std("mean") / (F.abs(F.avg("mean")) + TINY)).alias("cv"))
    return cv(logs, F.stddev_pop).withColumnRenamed("cv", "cv_log").join(cv(features, F.stddev_samp).withColumnRenamed("cv", "cv_raw"), [*keys, "feature"])


def selected(stability: DataFrame, n_stable: int = 8, n_sensitive: int = 4, cv: str = "cv", mandatory: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, role, place, feature): mandatory features as given, the most stable, and the least stable ones.

    Places count from 0 in the order mandatory, stable, sensitive (both by rising variation). A feature can have several
    roles; the first of them is where it stands in the vector.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, F.lit(0)))
    ranked = _ranked(stability.select(*keys, "feature", cv), keys, cv).withColumn("n", n)
    stable = ranked.where(F.col("stability_rank") <= n_stable).select(*keys, F.lit("stable").alias("role"), (F.col("stability_rank") - 1).alias("place"), "feature")
    start = F.greatest(F.col("n") - n_sensitive, F.lit(0))
    sensitive = ranked.where(F.col("stability_rank") > start).select(*keys, F.lit("sensitive").alias("role"), (F.col("stability_rank") - start - 1).alias("place"), "feature")
    chosen = stable.unionByName(sensitive)
    if mandatory:
        listed = F.posexplode(F.array(*(F.lit(m) for m in mandatory)))
        own = stability.select(*keys, F.lit(0).alias("__one")).distinct().select(*keys, F.lit("mandatory").alias("role"), listed.alias("place", "feature"))
        chosen = own.unionByName(chosen)
    return chosen.withColumn("place", F.col("place").cast("int"))


def vector_order(selection: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, roles, ord): each feature once, in the vector's order, with all its roles."""
    role = F.when(F.col("role") == "mandatory", 0).when(F.col("role") == "stable", 1).otherwise(2)
    once = selection.groupBy(*keys, "feature").agg(F.min(F.struct(role.alias("r"), "place")).alias("first"), F.sort_array(F.collect_set("role")).alias("roles"))
    order = F.row_number().over(Window.partitionBy(*keys, F.lit(0)).orderBy("first", "feature"))
    return once.select(*keys, "feature", "roles", (order - 1).cast("int").alias("ord"))


def reference_stats(features: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, mean, std): std is the sample deviation and a tiny addition."""
    measured = [f for n in names for f in (F.avg(_null(n)).alias(f"m_{n}"), (F.stddev_samp(_null(n)) + TINY).alias(f"s_{n}"))]
    return _rows(features.groupBy(*keys).agg(*measured), keys, names, {"mean": "m_{}", "std": "s_{}"})


def response_ranks(baseline: DataFrame, degraded: DataFrame, names: Sequence[str], stats: DataFrame, fault: str = "fault_type", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, fault_response, response_rank): mean over faults of how far a feature's mean moves, in ``stats``' std."""
    before = feature_means(baseline, keys, names).withColumnRenamed("mean", "base")
    after = feature_means(degraded, [*keys, fault], names)
    own = [*keys, "feature"]
    moved = after.join(before, own).join(stats.select(*own, "std"), own)
    shift = F.abs(F.col("mean") - F.col("base")) / F.greatest("std", F.lit(TINY))
    table = moved.groupBy(*own).agg(F.coalesce(F.avg(shift), F.lit(0.0)).alias("fault_response"))
    order = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("fault_response"), "feature")
    return table.withColumn("response_rank", F.row_number().over(order).cast("int"))


def relative_shifts(features: DataFrame, condition: str, baseline: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, condition, feature, shift): a condition's mean against the baseline's, relative where that isn't 0."""
    means = feature_means(features, [*keys, condition], names)
    base = means.where(F.col(condition) == baseline).select(*keys, "feature", F.col("mean").alias("base"))
    moved = means.where(F.col(condition) != baseline).join(base, [*keys, "feature"])
    size = F.abs("base")
    return moved.select(*keys, condition, "feature", (F.abs(F.col("mean") - F.col("base")) / F.when(size > TINY, size).otherwise(1.0)).alias("shift"))


def agreeing(stability: DataFrame, key: str, least: float | None = None, most: float | None = None, cv: str = "cv_across_conditions") -> DataFrame:
    """(feature, max_cv): features whose variation lies under ``most`` (or over ``least``) for every key."""
    fits = F.lit(True)
    if most is not None:
        fits = fits & (F.col(cv) < most)
    if least is not None:
        fits = fits & (F.col(cv) > least)
    every = stability.groupBy("feature").agg(F.min(F.coalesce(fits, F.lit(False))).alias("fits"), F.max(cv).alias("max_cv"))
    return every.where("fits").select("feature", "max_cv")


def condition_scores(features: DataFrame, condition: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, condition, feature, mean, z): condition means as deviations from their mean over conditions (sample std)."""
    over = Window.partitionBy(*keys, "feature")
    means = feature_means(features, [*keys, condition], names)
    return means.withColumn("z", (F.col("mean") - F.avg("mean").over(over)) / (F.stddev_samp("mean").over(over) + TINY))


def agreement(features: DataFrame, key: str, first: str, second: str, condition: str, names: Sequence[str], outliers: int = 3) -> DataFrame:
    """(condition, correlation, feature, apart, outlier_rank): how two keys' feature means agree under each condition.

    Means are deviations from the mean over all features of the key and condition; the features that lie furthest apart
    are listed.
    """
    over = Window.partitionBy(key, condition)
    means = feature_means(features.where(F.col(key).isin(first, second)), [key, condition], names)
    scored = means.withColumn("z", (F.col("mean") - F.avg("mean").over(over)) / (F.stddev_samp("mean").over(over) + TINY))
    a = scored.where(F.col(key) == first).select(condition, "feature", F.col("z").alias("za"))
    b = scored.where(F.col(key) == second).select(condition, "feature", F.col("z").alias("zb"))
    met = a.join(b, [condition, "feature"]).withColumn("apart", F.abs(F.col("za") - F.col("zb")))
    own = Window.partitionBy(condition)
    ranked = met.withColumn("correlation", F.corr("za", "zb").over(own)).withColumn("outlier_rank", F.row_number().over(own.orderBy(F.desc("apart"), "feature")))
    return ranked.where(F.col("outlier_rank") <= outliers).select(condition, "correlation", "feature", "apart", "outlier_rank")
