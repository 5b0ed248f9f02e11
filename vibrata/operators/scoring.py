"""Quality vectors, the calibrated health score, and summaries of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibrata.functions.arrays import let
from vibrata.operators.joins import looked_up
from vibrata.operators.running import quantiles
from vibrata.operators.stability import reference_stats, vector_order


def quality_vectors(features: DataFrame, names: Sequence[str], selection: DataFrame, stats: DataFrame | None = None, keys: Sequence[str] = (), keep: Sequence[str] = (), normalize: bool = True) -> DataFrame:
    """keep, ``qv`` (feature -> value), qv_health_score_raw and qv_degradation_score_raw, and the scores as copies.

    Values are deviations from the ``stats`` (keys, feature, mean, std), by default those of ``features``, or plain
    without ``normalize``. The health score is the mean size over the selection, skipping nulls; the degradation score
    is that over sensitive features. Before calibration more means worse. Selected features that the table lacks are
    skipped. The selection of a key is a short array that is joined to its windows, so windows are not shuffled where
    the selection is small enough to broadcast.
    """
    have = selection.where(F.col("feature").isin(*names)) if names else selection.where(F.lit(False))
    picked = vector_order(have, keys)
    own = [*keys, "feature"]
    if normalize:
        picked = picked.join(stats if stats is not None else reference_stats(features, names, keys), own)
    else:
        picked = picked.withColumn("mean", F.lit(0.0)).withColumn("std", F.lit(1.0))
    lists = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "feature", "roles", "mean", "std"))).alias("__picked"))
    joined = looked_up(features, lists, keys, most=1 << 14)
    sound = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    values = F.create_map(*(x for n in names for x in (F.lit(n), sound(n))))
    z = let(values, lambda m: F.transform("__picked", lambda p: F.struct(p["feature"].alias("feature"), p["roles"].alias("roles"), ((F.element_at(m, p["feature"]) - p["mean"]) / p["std"]).alias("z"))))
    size = lambda zs: let(F.array_compact(F.transform(zs, lambda x: F.abs(x["z"]))), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0)))
    scored = joined.withColumn("__z", z).where(F.size("__z") > 0)
    raw = scored.select(
        *keep, F.map_from_entries(F.transform("__z", lambda x: F.struct(x["feature"], x["z"]))).alias("qv"),
        size(F.col("__z")).alias("qv_health_score_raw"), size(F.filter("__z", lambda x: F.array_contains(x["roles"], "sensitive"))).alias("qv_degradation_score_raw"),
    )
    return raw.withColumn("qv_health_score", F.col("qv_health_score_raw")).withColumn("qv_degradation_score", F.col("qv_degradation_score_raw"))


def channel_vectors(features: DataFrame, names: Sequence[str], channels: Sequence[str], selection: DataFrame, stats: DataFrame, keys: Sequence[str], keep: Sequence[str], channel: str = "channel") -> DataFrame:
    """Raw scores like those of ``quality_vectors``, of features that lie a channel a row and are selected as <channel>_<name>.

    A channel's row gives sums over its own selected features, and the channels' sums meet by ``keep``; features are
    neither turned into columns nor into rows. ``qv`` is the map of the vector's deviations.
    """
    order = vector_order(selection, keys).join(stats, [*keys, "feature"])
    own = F.coalesce(*(F.when(F.col("feature").startswith(f"{c}_"), F.lit(c)) for c in sorted(channels, key=len, reverse=True)))
    told = order.withColumn(channel, own).withColumn("name", F.expr(f"substring(feature, length({channel}) + 2)")).where(F.col("name").isin(*names))
    lists = told.groupBy(*keys, channel).agg(F.sort_array(F.collect_list(F.struct("ord", "feature", "name", "roles", "mean", "std"))).alias("__picked"))
    joined = looked_up(features, lists, [*keys, channel], most=1 << 14)
    sound = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    values = F.create_map(*(x for n in names for x in (F.lit(n), sound(n))))
    z = let(values, lambda m: F.transform("__picked", lambda p: F.struct(p["feature"].alias("feature"), F.array_contains(p["roles"], "sensitive").alias("sensitive"), ((F.element_at(m, p["name"]) - p["mean"]) / p["std"]).alias("z"))))
    total = lambda zs: F.aggregate(zs, F.lit(0.0), lambda s, x: s + F.coalesce(F.abs(x["z"]), F.lit(0.0)))
    count = lambda zs: F.size(F.filter(zs, lambda x: x["z"].isNotNull()))
    sensitive = F.filter("__z", lambda x: x["sensitive"])
    parts = joined.withColumn("__z", z).select(*keep, "__z", total(F.col("__z")).alias("__s"), count(F.col("__z")).alias("__c"), total(sensitive).alias("__ss"), count(sensitive).alias("__sc"))
    summed = parts.groupBy(*keep).agg(F.flatten(F.collect_list("__z")).alias("__z"), *(F.sum(c).alias(c) for c in ("__s", "__c", "__ss", "__sc")))  # a list of the vector's length
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    raw = summed.select(*keep, F.map_from_entries(F.transform("__z", lambda x: F.struct(x["feature"], x["z"]))).alias("qv"), share("__s", "__c").alias("qv_health_score_raw"), share("__ss", "__sc").alias("qv_degradation_score_raw"))
    return raw.withColumn("qv_health_score", F.col("qv_health_score_raw")).withColumn("qv_degradation_score", F.col("qv_degradation_score_raw"))


def composition(features: DataFrame, names: Sequence[str], vectors: dict[str, Sequence[str]], reference: DataFrame, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(vector, by, mean_health_score): mean raw scores of windows under vectors of stated features, to compare them.

    Each of ``vectors`` (name -> features) is scored against the means and deviations of ``reference``, the healthy
    windows; ``by`` are the columns of the experiment, such as the severity of a fault or the condition.
    """
    stats = reference_stats(reference, names, keys)
    every = None
    for name, chosen in sorted(vectors.items()):
        picked = stats.select(*keys, "feature").where(F.col("feature").isin(*chosen))
        place = F.array_position(F.array(*(F.lit(c) for c in chosen)), F.col("feature"))
        selection = picked.select(*keys, F.lit("stable").alias("role"), (place - 1).cast("int").alias("place"), "feature")
        scored = quality_vectors(features, names, selection, stats, keys, [*dict.fromkeys((*keys, *by))])
        one = scored.groupBy(*dict.fromkeys((*keys, *by))).agg(F.avg("qv_health_score_raw").alias("mean_health_score")).select(F.lit(name).alias("vector"), "*")
        every = one if every is None else every.unionByName(one)
    return every


def fit_calibration(scores: DataFrame, keys: Sequence[str] = (), healthy_quantile: float = 0.95, min_scale: float = 1e-6, score: str = "qv_health_score_raw") -> DataFrame:
    """(keys, healthy_quantile, healthy_threshold, healthy_scale) of healthy scores; keys without finite scores have no row."""
    q = min(max(healthy_quantile, 0.5), 0.999)
    found = quantiles(scores, keys, score, {"__q": q, "__half": 0.5, "__low": 0.25, "__high": 0.75})
    scale = F.greatest(F.col("__q") - F.col("__half"), F.col("__high") - F.col("__low"), F.lit(min_scale))
    return found.select(*keys, F.lit(q).alias("healthy_quantile"), F.col("__q").alias("healthy_threshold"), scale.alias("healthy_scale"))


def calibrated(scores: DataFrame, calibration: DataFrame, keys: Sequence[str] = (), source: str = "qv_health_score_raw", target: str = "qv_health_score") -> DataFrame:
    """``scores`` with qv_health_excess and ``target`` in [0, 1], 1 inside the healthy envelope. Without ``source``, unchanged."""
    if source not in scores.columns:
        return scores
    envelope = calibration.select(*keys, F.col("healthy_threshold").alias("__threshold"), F.greatest("healthy_scale", F.lit(1e-12)).alias("__scale"))
    joined = looked_up(scores, envelope, keys)
    told = joined.withColumn("qv_health_excess", F.when(F.col(source).isNotNull(), F.greatest(F.col(source) - F.col("__threshold"), F.lit(0.0))))
    health = F.least(F.greatest(1 / (1 + F.col("qv_health_excess") / F.col("__scale")), F.lit(0.0)), F.lit(1.0))
    return told.withColumn(target, health).drop("__threshold", "__scale")


def timeline(windows: DataFrame, conditions: DataFrame, keys: Sequence[str] = ("sensor",), condition: str = "condition", start: str = "window_start_sec") -> DataFrame:
    """``windows`` with the conditions' columns and window_start_sec_global: conditions follow one another.

    ``conditions`` has a row for each key and condition, with ``ord`` and ``seconds`` (its length).
    """
    from pyspark.sql.window import Window

    before = Window.partitionBy(*keys, F.lit(0)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    offsets = conditions.withColumn("__offset", F.coalesce(F.sum("seconds").over(before), F.lit(0.0))).drop("seconds", "ord")
    return looked_up(windows, offsets, [*keys, condition]).withColumn("window_start_sec_global", F.col("__offset") + F.col(start)).drop("__offset")


def condition_summary(vectors: DataFrame, divergence: DataFrame, keys: Sequence[str] = ("sensor", "condition")) -> DataFrame:
    """Mean and sample deviation of the health score, mean raw score and mean divergences, by sensor and condition."""
    health = vectors.groupBy(*keys).agg(F.avg("qv_health_score").alias("mean_health_score"), F.stddev_samp("qv_health_score").alias("std_health_score"), F.avg("qv_health_score_raw").alias("mean_health_score_raw"))
    apart = divergence.groupBy(*keys).agg(F.avg("div_mean_kl").alias("mean_div_mean_kl"), F.avg("div_mean_jsd").alias("mean_div_mean_jsd"))
    return health.join(apart, list(keys), "left")


def divergence_summary(divergence: DataFrame, keys: Sequence[str] = ("sensor", "condition")) -> DataFrame:
    """(keys, n_windows, mean_kl, max_kl, mean_jsd) of the windows that have divergences."""
    sound = divergence.where(F.col("div_mean_kl").isNotNull())
    return sound.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.avg("div_mean_kl").alias("mean_kl"), F.max("div_max_kl").alias("max_kl"), F.avg("div_mean_jsd").alias("mean_jsd"))


def severity_summary(results: DataFrame, keys: Sequence[str] = ("sensor", "fault_type", "severity")) -> DataFrame:
    """Mean and sample deviation of health and divergence at each severity."""
    parts = [f(c).alias(f"{n}_{c}") for c in ("mean_health_score", "mean_div_mean_kl") for n, f in (("avg", F.avg), ("std", F.stddev_samp))]
    return results.groupBy(*keys).agg(*parts)


def axis_norms(samples: DataFrame, keys: Sequence[str], triads: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(keys, a column each): mean Euclidean norms of triads of columns."""
    norm = lambda axes: F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0)))
    return samples.groupBy(*keys).agg(*(F.avg(norm(axes)).alias(name) for name, axes in triads.items()))


def centripetal(conditions: DataFrame, rpm: str = "rpm", radius_m: float = 0.019) -> DataFrame:
    """Angular speed (rad/s) and centripetal acceleration (m/s^2) at revolutions a minute."""
    omega = 2 * F.pi() * F.col(rpm) / 60
    return conditions.withColumn("omega", omega).withColumn("a_c", omega * omega * radius_m)
