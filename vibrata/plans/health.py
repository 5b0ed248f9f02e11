"""The health analysis of sensors end to end, as one set of distributed jobs over all sensors and conditions.

Samples are long: (sensor, condition, channel, idx, value), and so are features, a row for each window of a channel: no
step turns channels into columns. Tables that several steps read are written once to the shared folder, so plans stay
small and a lost executor costs little; only tables of a row for each sensor, condition or feature reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.operators import divergences, faults, scoring, signals, stability, windows
from vibrata.operators.extract import Families, FeatureExtractor
from vibrata.operators.joins import looked_up
from vibrata.sources.conditions import AXES, CONDITIONS, TRIADS, condition_table
from vibrata.sources.scratch import written


@dataclass(frozen=True)
class Settings:
    """The analysis's defaults."""

    fs: float = 100.0
    window_sec: float = 3.0
    step_sec: float = 1.5
    level: int = 5
    trim_start_sec: float = 60.0
    trim_end_sec: float = 30.0
    base_sec: int = 60
    healthy_quantile: float = 0.95
    channels: tuple[str, ...] = tuple(AXES)
    reference_channel: str = "AccX"
    conditions: tuple[str, ...] = tuple(CONDITIONS)
    base_conditions: tuple[str, ...] = tuple(c for c in CONDITIONS if c != "stationary")
    mandatory: tuple[str, ...] = ("sq_snr", "sq_noise_floor", "sq_baseline_stability")
    pool: int = 48
    most_cv: float = 0.35
    n_stable: int = 8
    n_sensitive: int = 4
    seed: int = 42
    chosen_families: Families | None = None

    @property
    def families(self) -> Families:
        return self.chosen_families or Families(allan=False, wavelet_level=self.level)

    @property
    def size(self) -> int:
        return windows.samples_of(self.window_sec, self.fs)

    @property
    def step(self) -> int:
        return windows.samples_of(self.step_sec, self.fs)

    @property
    def names(self) -> list[str]:
        """Features of one channel."""
        return self.families.names(self.size, self.fs)

    @property
    def wide_names(self) -> list[str]:
        return [f"{c}_{n}" for c in self.channels for n in self.names]

    @property
    def wide_mandatory(self) -> list[str]:
        return [f"{c}_{n}" for c in self.channels for n in self.mandatory]


SIGNAL = ("sensor", "condition", "channel")
CELL = ("sensor", "fault_type", "severity", "trial")


def samples_of_recordings(recordings: DataFrame, s: Settings, axes: dict[str, str] = AXES) -> DataFrame:
    """Trimmed long samples of the recordings' axes, ordered by Time_ms."""
    numbered = signals.indexed(recordings, ["sensor", "condition"], "Time_ms", spread=1e6)
    cut = signals.trimmed(numbered, ["sensor", "condition"], s.fs, s.trim_start_sec, s.trim_end_sec)
    return signals.long_channels(cut, ["sensor", "condition", "idx"], axes)


def channel_features(samples: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    return FeatureExtractor(s.fs, s.families).process(samples, [*keys, "channel"], s.window_sec, s.step_sec)


def wide_features(features: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """A row for each window, with the features of all channels as <channel>_<feature>; channels meet by key and start."""
    own = [*keys, "window_start_sample", "window_start_sec"]
    pick = lambda c, n: F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"{c}_{n}")
    return features.groupBy(*own).agg(*(pick(c, n) for c in s.channels for n in s.names))


def fault_base(samples: DataFrame, s: Settings, wanted: Sequence[str] | None = None) -> DataFrame:
    """(sensor, channel, idx, value): middles of the moving conditions, one after another, ``base_sec`` long together.

    Each condition gives its share of what is still missing, or all it has; what is missing at the end comes from the
    middle of the last one again.
    """
    total = windows.samples_of(s.base_sec, s.fs)
    order = [c for c in (wanted if wanted is not None else s.base_conditions)]
    ords = F.create_map(*(F.lit(x) for i, c in enumerate(order) for x in (c, i)))
    active = samples.where(F.col("condition").isin(*order))
    sizes = active.groupBy("sensor", "condition", "channel").agg(F.count(F.lit(1)).cast("int").alias("n"))
    part = lambda c, take, at: F.struct(c.alias("condition"), take.cast("int").alias("take"), at.cast("int").alias("at"))
    none = F.expr("cast(array() as array<struct<condition:string,take:int,at:int>>)")
    state = lambda rest, left, parts: F.struct(rest.cast("int").alias("rest"), left.cast("int").alias("left"), parts.alias("parts"))
    listed = sizes.groupBy("sensor", "channel").agg(F.sort_array(F.collect_list(F.struct(F.element_at(ords, F.col("condition")).alias("o"), "condition", "n"))).alias("cs"))
    take = lambda a, c: F.least(c["n"], F.greatest(F.lit(1), F.floor(a["rest"] / a["left"]).cast("int")))
    step = lambda a, c: state(a["rest"] - take(a, c), a["left"] - 1, F.concat(a["parts"], F.array(part(c["condition"], take(a, c), total - a["rest"]))))
    last = F.element_at("cs", -1)["condition"]
    full = lambda a: F.concat(a["parts"], F.when(a["rest"] > 0, F.array(part(last, a["rest"], total - a["rest"]))).otherwise(none))
    planned = listed.select("sensor", "channel", F.explode(F.aggregate("cs", state(F.lit(total), F.size("cs"), none), step, full)).alias("p")).select("sensor", "channel", "p.*")
    placed = looked_up(active, sizes.join(planned, ["sensor", "condition", "channel"]), ["sensor", "condition", "channel"])
    start = F.greatest(F.floor((F.col("n") - F.col("take")) / 2), F.lit(0))
    inside = placed.where((F.col("idx") >= start) & (F.col("idx") < start + F.col("take")))
    return inside.select("sensor", "channel", (F.col("at") + F.col("idx") - start).cast("long").alias("idx"), "value").where(F.col("idx") < total)


def degraded_features(base: DataFrame, s: Settings, severities: Sequence[float], trials: int = 1, types: Sequence[str] = faults.FAULT_TYPES) -> tuple[DataFrame, DataFrame]:
    """Samples and channel features of every cell of fault, severity and trial."""
    hurt = faults.injected_cells(base, ["sensor", "channel"], types, severities, trials, s.seed)
    return hurt, channel_features(hurt, CELL, s)


def long_means(features: DataFrame, by: Sequence[str], s: Settings) -> DataFrame:
    """(by, feature, mean) with features named <channel>_<feature>."""
    means = stability.feature_means(features, [*by, "channel"], s.names)
    return means.select(*by, F.concat_ws("_", "channel", "feature").alias("feature"), "mean")


def long_stats(features: DataFrame, by: Sequence[str], s: Settings) -> DataFrame:
    """(by, feature, mean, std) with features named <channel>_<feature>."""
    stats = stability.reference_stats(features, s.names, [*by, "channel"])
    return stats.select(*by, F.concat_ws("_", "channel", "feature").alias("feature"), "mean", "std")


def fault_responses(base_features: DataFrame, hurt_features: DataFrame, stats: DataFrame, candidates: DataFrame, s: Settings) -> DataFrame:
    """(sensor, feature, fault_response, response_rank) of the candidates: mean over faults of how far a mean moves, in std."""
    own = ["sensor", "feature"]
    before = long_means(base_features, ["sensor"], s).withColumnRenamed("mean", "base")
    after = long_means(hurt_features, ["sensor", "fault_type"], s)
    moved = after.join(candidates.select(*own), own).join(before, own).join(stats.select(*own, "std"), own)
    table = moved.groupBy(*own).agg(F.coalesce(F.avg(F.abs(F.col("mean") - F.col("base")) / F.greatest("std", F.lit(stability.TINY))), F.lit(0.0)).alias("fault_response"))
    return table.withColumn("response_rank", F.row_number().over(Window.partitionBy("sensor").orderBy(F.desc("fault_response"), "feature")))


def model_selection(table: DataFrame, responses: DataFrame, s: Settings) -> DataFrame:
    """(sensor, role, place, feature): mandatory, stable (of those that respond most) and sensitive (the next) features.

    A sensor without any stable feature gets the plain selection by variation.
    """
    judged = stability.calm(table, ["sensor"], s.most_cv, s.n_stable, s.pool)
    ranked = responses.join(judged.select("sensor", "feature", "fits"), ["sensor", "feature"]).where(~F.col("feature").isin(*s.wide_mandatory))
    number = lambda *part: F.row_number().over(Window.partitionBy("sensor", *part).orderBy("response_rank"))
    marked = ranked.withColumn("k", number("fits")).withColumn("is_stable", F.col("fits") & (F.col("k") <= s.n_stable))
    stable = marked.where("is_stable").select("sensor", F.lit("stable").alias("role"), (F.col("k") - 1).alias("place"), "feature")
    rest = marked.where("NOT is_stable").withColumn("j", number()).where(F.col("j") <= s.n_sensitive)
    sensitive = rest.select("sensor", F.lit("sensitive").alias("role"), (F.col("j") - 1).alias("place"), "feature")
    sensors = table.select("sensor").distinct()
    listed = F.posexplode(F.array(*(F.lit(m) for m in s.wide_mandatory)))
    mandatory = sensors.select("sensor", F.lit("mandatory").alias("role"), listed.alias("place", "feature"))
    chosen = stable.unionByName(sensitive).unionByName(mandatory)
    lacking = sensors.join(stable.select("sensor").distinct(), "sensor", "left_anti")
    plain = stability.selected(table.join(lacking, "sensor", "left_semi"), s.n_stable, s.n_sensitive, "cv_across_conditions", s.wide_mandatory, ["sensor"])
    enough = chosen.join(lacking, "sensor", "left_anti")
    return enough.withColumn("place", F.col("place").cast("int")).unionByName(plain)


def pooled(samples: DataFrame, s: Settings) -> DataFrame:
    """(sensor, idx, value): the reference channel's conditions one after another."""
    own = samples.where(F.col("channel") == s.reference_channel)
    ords = F.create_map(*(F.lit(x) for i, c in enumerate(s.conditions) for x in (c, i)))
    sizes = own.groupBy("sensor", "condition").agg(F.count(F.lit(1)).alias("n")).withColumn("o", F.element_at(ords, F.col("condition")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sensor").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return looked_up(own, sizes.withColumn("before", before), ["sensor", "condition"]).select("sensor", (F.col("before") + F.col("idx")).alias("idx"), "value")


def window_divergences(samples: DataFrame, reference: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """(keys, window_start_sec, divergences and their summary) of the reference channel's windows that have any."""
    own = samples.where(F.col("channel") == s.reference_channel)
    cut = windows.sliding(own, keys, s.size, s.step).withColumn("window_start_sec", F.col("window_start_sample") / F.lit(s.fs))
    return divergences.with_window_divergence(cut, reference, s.level, keys=["sensor"]).drop("value").where("div_mean_kl IS NOT NULL")


def raw_vectors(features: DataFrame, model: dict[str, DataFrame], keep: Sequence[str], s: Settings) -> DataFrame:
    return scoring.channel_vectors(features, s.names, s.channels, model["selection"], model["stats"], ["sensor"], keep)


def health_models(samples: DataFrame, s: Settings = Settings()) -> dict[str, DataFrame]:
    """Models of all sensors: features, stability, stats, responses, selection, calibration, reference, vectors, divergences.

    ``samples`` are trimmed long samples of healthy sensors. Empty samples give empty tables.
    """
    cells, window = ["sensor", "condition"], ["window_start_sample", "window_start_sec"]
    samples = written(samples)
    features = written(channel_features(samples, cells, s))
    table = written(stability.across_means(long_means(features, cells, s), ["sensor"]))
    stats = written(long_stats(features, ["sensor"], s))
    base = written(fault_base(samples, s))
    hurt_features = degraded_features(base, s, [2.0])[1]
    responses = written(fault_responses(channel_features(base, ["sensor"], s), hurt_features, stats, table.where(F.col("stability_rank") <= s.pool), s))
    model = {"features": features, "stability": table, "stats": stats, "base": base, "responses": responses}
    model["selection"] = written(model_selection(table, responses, s))
    healthy = written(raw_vectors(features, model, [*cells, *window], s))
    model["calibration"] = written(scoring.fit_calibration(healthy, ["sensor"], s.healthy_quantile))
    model["reference"] = written(divergences.reference_distributions(pooled(samples, s), ["sensor"], s.level))
    own = signals.lengths(samples.where(F.col("channel") == s.reference_channel), cells, "n").withColumn("seconds", F.col("n") / F.lit(s.fs)).drop("n")
    conditions = condition_table(samples.sparkSession, {c: CONDITIONS.get(c, 0) for c in s.conditions})  # a row a condition
    places = own.join(F.broadcast(conditions), "condition")
    model["vectors"] = scoring.timeline(scoring.calibrated(healthy, model["calibration"], ["sensor"]), places)
    model["divergences"] = scoring.timeline(window_divergences(samples, model["reference"], cells, s), places)
    return model


def fault_validation(model: dict[str, DataFrame], s: Settings = Settings(), severities: Sequence[float] = tuple(2 * i / 6 for i in range(7)), trials: int = 3, types: Sequence[str] = faults.FAULT_TYPES) -> DataFrame:
    """(sensor, fault_type, severity, trial) with mean health, raw health and divergences of the degraded base signal."""
    hurt, features = degraded_features(model["base"], s, severities, trials, types)
    raw = raw_vectors(features, model, [*CELL, "window_start_sample"], s)
    health = scoring.calibrated(raw, model["calibration"], ["sensor"])
    scores = health.groupBy(*CELL).agg(F.avg("qv_health_score").alias("mean_health_score"), F.avg("qv_health_score_raw").alias("mean_health_score_raw"))
    apart = window_divergences(hurt, model["reference"], CELL, s).groupBy(*CELL).agg(F.avg("div_mean_kl").alias("mean_div_mean_kl"), F.avg("div_mean_jsd").alias("mean_div_mean_jsd"))
    return scores.join(apart, list(CELL), "left")


def analysis(recordings: DataFrame, s: Settings = Settings(), severities: Sequence[float] = tuple(2 * i / 6 for i in range(7)), trials: int = 3) -> dict[str, DataFrame]:
    """All results from recordings: trimmed samples, models, summaries, cross-sensor divergences, fault validation, norms."""
    samples = written(samples_of_recordings(recordings, s))
    model = health_models(samples, s)
    return {
        "trimmed_signals": samples, **model,
        "modwt_segments": signals.head(samples.where((F.col("condition") == s.conditions[0]) & (F.col("channel") == s.reference_channel)), 5.0, s.fs),
        "condition_summary": scoring.condition_summary(model["vectors"], model["divergences"]),
        "cross_sensor_matrix": divergences.cross_matrix(model["reference"], "sensor"), "cross_sensor_bands": divergences.cross_divergence(model["reference"], "sensor"),
        "fault_results": fault_validation(model, s, severities, trials),
        "sanity_summary": scoring.axis_norms(recordings.where(F.col("condition") == s.conditions[0]), ["sensor"], TRIADS),
    }


def main(arguments: Sequence[str] | None = None) -> None:
    """Command line: --data-root, --output-dir, --sensors, --seed, --fs."""
    import argparse

    from pyspark.sql import SparkSession

    from vibrata.sources.conditions import default_patterns, recordings
    from vibrata.sources.sinks import write_summary

    parser = argparse.ArgumentParser(description="Health analysis of recorded sensors")
    parser.add_argument("--data-root", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--sensors", nargs="+", required=True)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--fs", type=float, default=100.0)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    s = Settings(fs=asked.fs, seed=asked.seed)
    results = analysis(recordings(spark, asked.data_root, default_patterns(asked.sensors)), s)
    tables = {n: results[n] for n in ("condition_summary", "cross_sensor_matrix", "cross_sensor_bands", "fault_results", "sanity_summary")}
    # The record holds what was fitted: a few numbers and names for each sensor.
    fitted = [r.asDict() for r in results["calibration"].collect()]
    chosen = [r.asDict() for r in results["selection"].orderBy("sensor", "role", "place").collect()]
    write_summary(spark, asked.output_dir, tables, {"data_root": asked.data_root, "calibration": fitted, "selected_features": chosen})


if __name__ == "__main__":
    main()
