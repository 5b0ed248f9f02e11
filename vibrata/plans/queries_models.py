"""Queries of stability, quality vectors, faults, detection, learning and the whole health analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.operators import autoencoder, divergences, evaluation, faults, learning, scoring, signals, stability, windows
from vibrata.operators.extract import FeatureExtractor, window_features
from vibrata.plans import health, oracle as o
from vibrata.plans.queries_windows import KEY, PLAIN_SQL
from vibrata.plans.registry import query
from vibrata.plans.tables import CELLS_KEYS, FS, PLAIN, PLAIN_NAMES, cells, events, plain_features, read, rounded, signal
from vibrata.sources.scratch import shared_folder, written
from vibrata.streaming.windows import timed_totals

NAMES = ["mean", "variance", "rms", "kurtosis", "quantile_50"]
UNPIVOT = f"unnest({NAMES}) AS feature, unnest([{', '.join(NAMES)}]) AS value"
LONG = f"{PLAIN_SQL}, long AS (SELECT signal_id, condition, ws, {UNPIVOT} FROM feat)"
MEANS = "means AS (SELECT signal_id, condition, feature, avg(value) AS mean FROM long GROUP BY ALL)"
ACROSS = f"""{LONG}, {MEANS}, stab AS (SELECT signal_id, feature, avg(mean) AS m, coalesce(stddev_samp(mean), 0) AS sd, count(*)::INTEGER AS n_conditions FROM means GROUP BY ALL),
rk AS (SELECT *, sd / (abs(m) + 1e-12) AS cv, row_number() OVER (PARTITION BY signal_id ORDER BY sd / (abs(m) + 1e-12), feature)::INTEGER AS stability_rank FROM stab)"""
STATS = "st AS (SELECT signal_id, feature, avg(value) AS mean, stddev_samp(value) + 1e-12 AS std FROM long GROUP BY ALL)"
#: The vector: kurtosis is mandatory, the two calmest features are stable and the least calm one is sensitive.
ROLES = "pick AS (SELECT signal_id, feature, bool_or(stability_rank = 5) AS sensitive FROM rk WHERE stability_rank <= 2 OR stability_rank = 5 OR feature = 'kurtosis' GROUP BY ALL)"
VECTORS = f"""{ACROSS}, {STATS}, {ROLES}, qv AS (SELECT signal_id, condition, ws, avg(abs((value - mean) / std)) AS raw, avg(abs((value - mean) / std)) FILTER (WHERE sensitive) AS degradation
  FROM long JOIN st USING (signal_id, feature) JOIN pick USING (signal_id, feature) GROUP BY ALL)"""
CALIBRATION = """cal AS (SELECT signal_id, quantile_cont(raw, 0.95) AS threshold, greatest(quantile_cont(raw, 0.95) - quantile_cont(raw, 0.5), quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25), 1e-6) AS scale FROM qv GROUP BY 1)"""
HEALTH = "hl AS (SELECT *, greatest(raw - threshold, 0) AS excess, 1 / (1 + greatest(raw - threshold, 0) / scale) AS health FROM qv JOIN cal USING (signal_id))"


@query(f"""WITH {o.SIGNAL}, {o.windows('sig', KEY, 64, 32)}, {o.time_features('win', KEY, 'feat')}, seg AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY ws) - 1 AS rn, count(*) OVER (PARTITION BY signal_id) // 4 AS s FROM feat),
long AS (SELECT signal_id, least(rn // s, 3) AS seg, {UNPIVOT} FROM seg WHERE s > 0), m AS (SELECT signal_id, seg, feature, avg(value) AS v FROM long GROUP BY ALL),
t AS (SELECT signal_id, feature, avg(v) AS mean, stddev_samp(v) AS std, stddev_samp(v) / (abs(avg(v)) + 1e-12) AS cv FROM m GROUP BY ALL)
SELECT signal_id, feature, {o.r('mean', 'mean')}, {o.r('std', 'std')}, {o.r('cv', 'cv')}, row_number() OVER (PARTITION BY signal_id ORDER BY cv, feature)::INTEGER AS stability_rank FROM t""")
def j01_stability_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = FeatureExtractor(FS, PLAIN).process(signal(spark, sf_dir), KEY, 0.64, 0.32)
    return rounded(stability.over_time(features, KEY, "window_start_sample", NAMES, spread=1 << 16))


@query(f"{ACROSS} SELECT signal_id, feature, {o.r('m', 'mean_across_conditions')}, {o.r('sd', 'std_across_conditions')}, n_conditions, {o.r('cv', 'cv_across_conditions')}, stability_rank FROM rk")
def j02_stability_across_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.across_conditions(plain_features(spark, sf_dir), "condition", NAMES, KEY))


def _selection(features: DataFrame) -> DataFrame:
    table = stability.across_conditions(features, "condition", NAMES, KEY)
    return stability.selected(table, 2, 1, "cv_across_conditions", ["kurtosis"], KEY)


@query(f"""{ACROSS} SELECT signal_id, 'stable' AS role, stability_rank - 1 AS place, feature FROM rk WHERE stability_rank <= 2 UNION ALL
SELECT signal_id, 'sensitive', 0, feature FROM rk WHERE stability_rank = 5 UNION ALL SELECT DISTINCT signal_id, 'mandatory', 0, 'kurtosis' FROM rk""")
def j03_feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(plain_features(spark, sf_dir))


def _vectors(features: DataFrame) -> DataFrame:
    return scoring.quality_vectors(features, NAMES, _selection(features), None, KEY, [*CELLS_KEYS, "window_start_sample", "window_start_sec"])


@query(f"{VECTORS} SELECT signal_id, condition, ws AS window_start_sample, {o.r('raw', 'qv_health_score_raw')}, {o.r('degradation', 'qv_degradation_score_raw')} FROM qv")
def j04_quality_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _vectors(plain_features(spark, sf_dir))
    return rounded(scored.select(*CELLS_KEYS, "window_start_sample", "qv_health_score_raw", "qv_degradation_score_raw"))


@query(f"{VECTORS}, {CALIBRATION} SELECT signal_id, 0.95::DOUBLE AS healthy_quantile, {o.r('threshold', 'healthy_threshold')}, {o.r('scale', 'healthy_scale')} FROM cal")
def j05_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.fit_calibration(_vectors(plain_features(spark, sf_dir)), KEY))


@query(f"{VECTORS}, {CALIBRATION}, {HEALTH} SELECT signal_id, condition, ws AS window_start_sample, {o.r('excess', 'qv_health_excess')}, {o.r('health', 'qv_health_score')} FROM hl")
def j06_health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _vectors(plain_features(spark, sf_dir))
    told = scoring.calibrated(scored, scoring.fit_calibration(scored, KEY), KEY)
    return rounded(told.select(*CELLS_KEYS, "window_start_sample", "qv_health_excess", "qv_health_score"))


@query(f"""WITH {o.CELLS}, va AS (SELECT signal_id, condition, idx, value FROM cells), vb AS (SELECT signal_id, condition, idx, k AS value FROM cells), {o.windows('va', CELLS_KEYS, 64, 32, 'wa')}, {o.windows('vb', CELLS_KEYS, 64, 32, 'wb')},
{o.time_features('wa', CELLS_KEYS, 'fa')}, {o.time_features('wb', CELLS_KEYS, 'fb')}
SELECT signal_id, condition, ws AS window_start_sample, {', '.join(f'round(fa.{n}, 6) + 0.0 AS AccX_{n}, round(fb.{n}, 6) + 0.0 AS AccY_{n}' for n in PLAIN_NAMES)} FROM fa JOIN fb USING (signal_id, condition, ws)""")
def j07_multi_channel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two channels side by side, which meet by key and start."""
    long = signals.long_channels(cells(spark, sf_dir), [*CELLS_KEYS, "idx"], {"AccX": "value", "AccY": "k"})
    s = health.Settings(window_sec=0.64, step_sec=0.32, channels=("AccX", "AccY"), chosen_families=PLAIN)
    return rounded(health.wide_features(health.channel_features(long, CELLS_KEYS, s), CELLS_KEYS, s).drop("window_start_sec"))


@query(f"{LONG}, {STATS} SELECT signal_id, feature, {o.r('mean', 'mean')}, {o.r('std', 'std')} FROM st")
def j09_reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.reference_stats(plain_features(spark, sf_dir), NAMES, KEY))


@query(f"""WITH {o.CELLS}, n AS (SELECT signal_id, condition, count(*) AS n FROM cells GROUP BY ALL),
pivoted AS (SELECT signal_id, max(CASE condition WHEN 'c1' THEN n END) AS n1, max(CASE condition WHEN 'c2' THEN n END) AS n2 FROM n GROUP BY 1),
takes AS (SELECT *, least(n1, 50) AS t1, least(n2, 100 - least(n1, 50)) AS t2 FROM pivoted)
SELECT signal_id, idx - greatest((n1 - t1) // 2, 0) AS idx, value FROM cells JOIN takes USING (signal_id) WHERE condition = 'c1' AND idx >= greatest((n1 - t1) // 2, 0) AND idx < greatest((n1 - t1) // 2, 0) + t1
UNION ALL SELECT signal_id, t1 + idx - greatest((n2 - t2) // 2, 0), value FROM cells JOIN takes USING (signal_id) WHERE condition = 'c2' AND idx >= greatest((n2 - t2) // 2, 0) AND idx < greatest((n2 - t2) // 2, 0) + t2""")
def j10_fault_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = cells(spark, sf_dir).select(F.col("signal_id").alias("sensor"), "condition", F.lit("AccX").alias("channel"), "idx", "value")
    found = health.fault_base(samples, health.Settings(base_sec=1, conditions=("c0", "c1", "c2"), base_conditions=("c1", "c2")))
    return found.select(F.col("sensor").alias("signal_id"), "idx", "value")


@query(f"""{VECTORS}, {CALIBRATION}, {HEALTH}, n AS (SELECT signal_id, condition, count(*) / 100.0 AS s FROM cells GROUP BY ALL),
b AS (SELECT signal_id, condition, coalesce(sum(s) OVER (PARTITION BY signal_id ORDER BY condition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT signal_id, condition, ws / 100.0 AS window_start_sec, {o.r('before + ws / 100.0', 'window_start_sec_global')}, {o.r('health', 'qv_health_score')} FROM hl JOIN b USING (signal_id, condition)""")
def j12_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _vectors(plain_features(spark, sf_dir))
    told = scoring.calibrated(scored, scoring.fit_calibration(scored, KEY), KEY)
    lengths = signals.lengths(cells(spark, sf_dir), CELLS_KEYS).select(*CELLS_KEYS, (F.col("n") / F.lit(FS)).alias("seconds"), F.col("condition").alias("ord"))
    return rounded(scoring.timeline(told, lengths, KEY).select(*CELLS_KEYS, "window_start_sec", "window_start_sec_global", "qv_health_score"))


SHORT = health.Settings(window_sec=0.64, step_sec=0.32, level=3, channels=("AccX",), conditions=("c0", "c1", "c2"), base_conditions=("c1", "c2"), chosen_families=PLAIN)
#: Distributions of the pooled conditions of each sensor (``ref``), and divergences of windows of cells from them (``dv``).
POOLED = f"""pooled AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY condition, idx) - 1 AS i, value AS x FROM cells), {o.modwt('pooled', KEY, 3, 'pc')}, {o.histogram('pc', ['signal_id', 'band'], 'v', 'ref')}"""


def _apart(source: str, keys: list[str], name: str) -> str:
    k = ", ".join(keys)
    return f"""{o.modwt(source, [*keys, 'ws'], 3, f'{name}_c')}, {o.histogram(f'{name}_c', [*keys, 'ws', 'band'], 'v', f'{name}_h')},
{o.aligned(f'ref p JOIN {name}_h q ON p.signal_id = q.signal_id AND p.band = q.band', ', '.join(f'q.{c}' for c in [*keys, 'ws', 'band']), f'{name}_al')}, {o.divergences(f'{name}_al', f'{k}, ws, band', f'{name}_dv')},
{name} AS (SELECT {k}, ws, avg(sym) AS kl, max(sym) AS worst, avg(jsd) AS jsd FROM {name}_dv GROUP BY {k}, ws)"""


def _short_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(F.col("signal_id").alias("sensor"), "condition", F.lit(SHORT.channels[0]).alias("channel"), "idx", "value")


def _reference(samples: DataFrame) -> DataFrame:
    return written(divergences.reference_distributions(health.pooled(samples, SHORT), ["sensor"], SHORT.level))


def _window_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _short_samples(spark, sf_dir)
    return health.window_divergences(samples, _reference(samples), ["sensor", "condition"], SHORT).withColumnRenamed("sensor", "signal_id")


DIVERGED = f"WITH {o.CELLS}, {o.windows('cells', CELLS_KEYS, 64, 32)}, {POOLED}, {_apart('win', CELLS_KEYS, 'ap')}"


@query(f"""{DIVERGED}, n AS (SELECT signal_id, condition, count(*) / 100.0 AS s FROM cells GROUP BY ALL),
b AS (SELECT signal_id, condition, coalesce(sum(s) OVER (PARTITION BY signal_id ORDER BY condition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT signal_id, condition, {o.r('before + ws / 100.0', 'window_start_sec_global')}, {o.r('kl', 'div_mean_kl')}, {o.r('worst', 'div_max_kl')}, {o.r('jsd', 'div_mean_jsd')} FROM ap JOIN b USING (signal_id, condition)""")
def i11_divergence_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of every condition's windows from the sensor's pooled distributions, conditions one after another."""
    lengths = signals.lengths(cells(spark, sf_dir), CELLS_KEYS).select(*CELLS_KEYS, (F.col("n") / F.lit(FS)).alias("seconds"), F.col("condition").alias("ord"))
    told = scoring.timeline(_window_divergences(spark, sf_dir), lengths, KEY)
    return rounded(told.select(*CELLS_KEYS, "window_start_sec_global", "div_mean_kl", "div_max_kl", "div_mean_jsd"))


@query(f"{DIVERGED} SELECT signal_id, condition, count(*) AS n_windows, {o.r('avg(kl)', 'mean_kl')}, {o.r('max(worst)', 'max_kl')}, {o.r('avg(jsd)', 'mean_jsd')} FROM ap GROUP BY ALL")
def i12_divergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.divergence_summary(_window_divergences(spark, sf_dir), CELLS_KEYS))


@query(f"""{VECTORS}, {CALIBRATION}, {HEALTH}, {POOLED}, {_apart('win', CELLS_KEYS, 'ap')}, a AS (SELECT signal_id, condition, avg(kl) AS kl, avg(jsd) AS jsd FROM ap GROUP BY ALL)
SELECT signal_id, condition, {o.r('avg(health)', 'mean_health_score')}, {o.r('stddev_samp(health)', 'std_health_score')}, {o.r('avg(raw)', 'mean_health_score_raw')},
{o.r('any_value(kl)', 'mean_div_mean_kl')}, {o.r('any_value(jsd)', 'mean_div_mean_jsd')} FROM hl JOIN a USING (signal_id, condition) GROUP BY ALL""")
def j15_condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health scores and divergences by condition."""
    scored = _vectors(plain_features(spark, sf_dir))
    told = scoring.calibrated(scored, scoring.fit_calibration(scored, KEY), KEY)
    return rounded(scoring.condition_summary(told, _window_divergences(spark, sf_dir), CELLS_KEYS))


@query(f"""SELECT l_returnflag, {o.r('avg(sqrt(l_quantity ** 2 + l_discount ** 2 + l_tax ** 2))', 'cal_norm')}, {o.r('avg(sqrt(l_extendedprice ** 2 + l_quantity ** 2 + l_linenumber ** 2))', 'raw_norm', 3)} FROM lineitem GROUP BY 1""")
def j16_axis_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    triads = {"cal_norm": ("l_quantity", "l_discount", "l_tax"), "raw_norm": ("l_extendedprice", "l_quantity", "l_linenumber")}
    found = scoring.axis_norms(read(spark, sf_dir, "lineitem"), ["l_returnflag"], triads)
    return found.select("l_returnflag", (F.round("cal_norm", 6) + 0.0).alias("cal_norm"), (F.round("raw_norm", 3) + 0.0).alias("raw_norm"))


SEVERITIES = (0.0, 0.5, 1.0, 2.0)
POINTWISE = [f for f in faults.FAULT_TYPES if f != "bandwidth_loss"]


def _hurt_sql() -> str:
    """``hurt`` (signal_id, fault_type, severity, idx, value) from ``sig``."""
    key, sample = ["signal_id", "fault_type", "severity"], ["signal_id", "fault_type", "severity", "idx"]
    u = "(idx / greatest(n - 1, 1))"
    sign = f"(CASE WHEN {o.uniform(42, key, 'sign')} < 0.5 THEN -1.0 ELSE 1.0 END)"
    side = f"(CASE WHEN {o.uniform(42, sample, 'side')} < 0.5 THEN -1.0 ELSE 1.0 END)"
    return f"""f_st AS (SELECT signal_id, count(*) AS n, avg(value) AS m, stddev_pop(value) + 1e-8 AS d, greatest(max(abs(value)), stddev_pop(value) + 1e-8, 1e-8) AS scale FROM sig GROUP BY 1),
f_cells AS (SELECT unnest({POINTWISE}) AS fault_type), f_rows AS (SELECT sig.*, n, d, scale, fault_type, severity::DOUBLE AS severity FROM sig JOIN f_st USING (signal_id) CROSS JOIN f_cells CROSS JOIN (SELECT unnest({list(SEVERITIES)}) AS severity)),
clipped AS (SELECT *, least(greatest(value, -least(greatest(0.95 - 0.30 * severity, 0.12), 0.95) * scale), least(greatest(0.95 - 0.30 * severity, 0.12), 0.95) * scale) AS c, greatest(scale * (0.01 + 0.02 * severity), 1e-8) AS q FROM f_rows),
hurt AS (SELECT signal_id, fault_type, severity, idx, CASE fault_type
  WHEN 'noise_increase' THEN value + {o.normal(42, sample, 'noise')} * (0.5 + 2.5 * {u} ** 1.5) * d * severity
  WHEN 'bias_drift' THEN value + {sign} * 3.0 * d * severity * {u} ** 1.5
  WHEN 'spike_injection' THEN CASE WHEN {o.uniform(42, sample, 'spike')} < 0.02 * severity + 0.08 * severity * {u} THEN value + {side} * (3 + 3 * {o.uniform(42, sample, 'size')}) * d * severity ELSE value END
  WHEN 'saturation' THEN CASE WHEN severity > 0 THEN round_even(c / q, 0) * q ELSE c END
  ELSE value * CASE WHEN {o.uniform(42, key, 'gain')} < 0.5 THEN greatest(0.1, 1 - 0.45 * severity) ELSE 1 + 1.2 * severity END END AS value FROM clipped)"""


@query(f"""WITH {o.SIGNAL}, {_hurt_sql()}
SELECT signal_id, fault_type, severity, count(*) AS n, {o.r('avg(value)', 'mean', 5)}, {o.r('stddev_pop(value)', 'std', 5)}, {o.r('min(value)', 'low', 5)}, {o.r('max(value)', 'high', 5)} FROM hurt GROUP BY ALL""")
def j20_pointwise_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, drift, spikes, saturation and gain at four severities; draws are hashes, so SQL can make the same."""
    hurt = faults.injected_cells(signal(spark, sf_dir), KEY, POINTWISE, SEVERITIES)
    told = hurt.groupBy("signal_id", "fault_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(told, 5)


@query(f"""WITH {o.SIGNAL}, st AS (SELECT signal_id, count(*) AS n, avg(value) AS m, stddev_pop(value) + 1e-8 AS d FROM sig GROUP BY 1),
spread AS (SELECT a.signal_id, a.idx, t.o, CASE WHEN a.idx + t.o < 0 THEN -1 - (a.idx + t.o) WHEN a.idx + t.o >= n THEN 2 * n - 1 - (a.idx + t.o) ELSE a.idx + t.o END AS p FROM sig a JOIN st USING (signal_id) CROSS JOIN range(-11, 12) t(o)),
smooth AS (SELECT s.signal_id, s.idx, avg(b.value) AS x FROM spread s JOIN sig b ON b.signal_id = s.signal_id AND b.idx = s.p GROUP BY ALL),
lv AS (SELECT signal_id, avg(x) AS l, stddev_pop(x) + 1e-8 AS sd FROM smooth GROUP BY 1)
SELECT signal_id, idx, {o.r('(x - l) * (d / sd) * 0.6 + m', 'value')} FROM smooth JOIN lv USING (signal_id) JOIN st USING (signal_id)""")
def j23_bandwidth_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(faults.injected(signal(spark, sf_dir), KEY, F.lit("bandwidth_loss"), F.lit(1.0)))


@query(f"""WITH {o.SIGNAL}, st AS (SELECT signal_id, count(*) AS n, max(value) - min(value) AS span FROM sig GROUP BY 1),
sp AS (SELECT a.signal_id, a.idx, avg(b.value) AS local FROM sig a JOIN st USING (signal_id) JOIN sig b ON b.signal_id = a.signal_id AND abs(b.idx - a.idx) <= greatest(floor(1 + 20 * (a.idx / n)), 1) // 2 GROUP BY ALL)
SELECT signal_id, idx, {o.r('value + 2 * (idx / (n - 1)) ** 2', 'drifted')}, {o.r('local', 'slowed')}, {o.r('value + 0.5 * span * (idx / (n - 1))', 'linear')} FROM sig JOIN st USING (signal_id) JOIN sp USING (signal_id, idx)""")
def j27_degradations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degradations without draws: squared drift, a widening local mean, and a straight drift."""
    own = signal(spark, sf_dir)
    of = lambda table, name: table.withColumnRenamed("value", name)
    drifted, slowed = of(faults.degraded(own, KEY, "bias_drift"), "drifted"), of(faults.degraded(own, KEY, "bandwidth_loss"), "slowed")
    return rounded(drifted.join(slowed, [*KEY, "idx"]).join(of(faults.linear_drift(own, KEY, 0.5), "linear"), [*KEY, "idx"]))


HASHED = "SELECT *, md5(concat_ws('|', '42', vec_id::VARCHAR)) AS h FROM embeddings"


@query(f"""WITH n AS (SELECT floor(min(c) * 0.2) AS take FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))
SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) <= take AS is_test FROM ({HASHED}) CROSS JOIN n""")
def j31_balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.balanced_split(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


@query(f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS k FROM ({HASHED})) WHERE k <= 25")
def j39_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_sample(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 25)


@query("""WITH s AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS p FROM embeddings)
SELECT round(avg(CASE WHEN len(list_filter(range(0, 10), lambda c: p[c + 1] > p[label + 1] OR (p[c + 1] = p[label + 1] AND c > label))) < 3 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS top_k_accuracy FROM s WHERE label BETWEEN 0 AND 9""")
def j32_top_k_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where("label BETWEEN 0 AND 9")
    p = F.map_from_arrays(F.sequence(F.lit(0), F.lit(9)), F.slice(F.col("embedding").cast("array<double>"), 1, 10))
    return rounded(evaluation.top_k_accuracy(rows, "label", p, 3))


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("window_start_sample"), p.alias("p"))
    names = F.array(*(F.lit(f"m{i}") for i in range(3)))
    return rows.select("label", "window_start_sample", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("predicted"), F.map_from_arrays(names, F.col("p")).alias("probabilities"))


GUESSED = "g AS (SELECT label, vec_id, embedding[1]::DOUBLE AS p0, embedding[2]::DOUBLE AS p1, embedding[3]::DOUBLE AS p2, 'm' || CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS predicted FROM embeddings)"


@query(f"""WITH {GUESSED}, v AS (SELECT label, predicted, count(*) AS v, min(vec_id) AS first FROM g GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, first) AS k, sum(v) OVER (PARTITION BY label) AS n FROM v),
m AS (SELECT label, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM g GROUP BY 1)
SELECT label, predicted AS modality, {o.r('v / n', 'confidence')}, n::BIGINT AS n_windows, {o.r('p0', 'p0')}, {o.r('p1', 'p1')}, {o.r('p2', 'p2')} FROM w JOIN m USING (label) WHERE k = 1""")
def j35_window_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning.signal_predictions(_guessed(spark, sf_dir), ["label"])
    return rounded(found.select("label", "modality", "confidence", "n_windows", *(F.element_at("probabilities", f"m{i}").alias(f"p{i}") for i in range(3))))


@query(f"WITH {GUESSED} SELECT 'm' || (label % 3)::VARCHAR AS truth, predicted, count(*) AS n FROM g GROUP BY ALL")
def j38_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _guessed(spark, sf_dir).withColumn("truth", F.concat(F.lit("m"), (F.col("label") % 3).cast("string")))
    return evaluation.confusion(rows, "truth", "predicted")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("condition", (F.col("value") + F.when(F.col("signal_id") == "error", 15.0).otherwise(0.0)).alias("score"), (F.col("signal_id") == "error").cast("int").alias("label"))


DETECTED = "d AS (SELECT 'c' || (user_id % 3)::VARCHAR AS condition, value + CASE WHEN event_type = 'error' THEN 15.0 ELSE 0.0 END AS score, (event_type = 'error')::INTEGER AS label FROM events)"


@query(f"""WITH {DETECTED}, c AS (SELECT condition, score, sum(label) AS p, sum(1 - label) AS q FROM d GROUP BY ALL),
t AS (SELECT condition, score, sum(p) OVER w / nullif(sum(p) OVER a, 0) AS tpr, sum(q) OVER w / nullif(sum(q) OVER a, 0) AS fpr FROM c WINDOW w AS (PARTITION BY condition ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY condition)),
l AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0 FROM t WINDOW w AS (PARTITION BY condition ORDER BY score DESC))
SELECT condition, {o.r('score', 'threshold')}, {o.r('fpr', 'fpr')}, {o.r('tpr', 'tpr')}, {o.r('sum((fpr - f0) * (tpr + t0) / 2) OVER (PARTITION BY condition)', 'auc')} FROM l""")
def j42_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluation.roc_curve(_detected(spark, sf_dir), "score", "label", ["condition"])
    area = curve.groupBy("condition").agg(F.sum("area").alias("auc"))
    return rounded(curve.join(area, "condition").drop("area"))


@query(f"""WITH {DETECTED}, t AS (SELECT condition, quantile_cont(score, 0.95) AS threshold FROM d WHERE label = 0 GROUP BY 1),
c AS (SELECT condition, threshold, count(*) FILTER (WHERE score > threshold AND label = 1) AS tp, count(*) FILTER (WHERE score > threshold AND label = 0) AS fp, count(*) FILTER (WHERE score <= threshold AND label = 0) AS tn, count(*) FILTER (WHERE score <= threshold AND label = 1) AS fn
  FROM d JOIN t USING (condition) GROUP BY ALL)
SELECT condition, {o.r('threshold', 'threshold')}, tp, fp, tn, fn, {o.r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {o.r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
  {o.r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, {o.r('(tp + tn) / (tp + fp + tn + fn)', 'accuracy')} FROM c""")
def j43_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.detection(_detected(spark, sf_dir), "score", "label", ["condition"]))


@query(f"""WITH {DETECTED}, p AS (SELECT condition, avg(score) FILTER (WHERE label = 0) AS m0, avg(score) FILTER (WHERE label = 1) AS m1, stddev_pop(score) FILTER (WHERE label = 0) AS s0, stddev_pop(score) FILTER (WHERE label = 1) AS s1 FROM d GROUP BY 1)
SELECT condition, {o.r('m0', 'healthy_mean')}, {o.r('m1', 'degraded_mean')}, {o.r('(m1 - m0) / (sqrt((s0 * s0 + s1 * s1) / 2) + 1e-8)', 'cohens_d')}, {o.r('m1 / (m0 + 1e-8)', 'separation')} FROM p""")
def j44_effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.effect_size(_detected(spark, sf_dir), "score", "label", ["condition"]))


@query(f"""{LONG}, {MEANS}, b AS (SELECT signal_id, feature, mean AS base FROM means WHERE condition = 'c0')
SELECT signal_id, condition, feature, {o.r('abs(mean - base) / CASE WHEN abs(base) > 1e-12 THEN abs(base) ELSE 1 END', 'shift')} FROM means JOIN b USING (signal_id, feature) WHERE condition <> 'c0'""")
def j45_relative_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.relative_shifts(plain_features(spark, sf_dir), "condition", "c0", NAMES, KEY))


@query(f"{ACROSS} SELECT feature, {o.r('max(cv)', 'max_cv')} FROM rk GROUP BY feature HAVING bool_and(cv < 0.5)")
def j45_agreeing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are stable for every sensor."""
    table = stability.across_conditions(plain_features(spark, sf_dir), "condition", NAMES, KEY)
    return rounded(stability.agreeing(table, "signal_id", most=0.5))


@query(f"{LONG}, {MEANS} SELECT signal_id, condition, feature, {o.r('mean', 'mean')}, {o.r('(mean - avg(mean) OVER w) / (stddev_samp(mean) OVER w + 1e-12)', 'z')} FROM means WINDOW w AS (PARTITION BY signal_id, feature)")
def j46_condition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.condition_scores(plain_features(spark, sf_dir), "condition", NAMES, KEY))


@query(f"""{LONG}, {MEANS}, z AS (SELECT *, (mean - avg(mean) OVER w) / (stddev_samp(mean) OVER w + 1e-12) AS z FROM means WHERE signal_id IN ('click', 'view') WINDOW w AS (PARTITION BY signal_id, condition)),
m AS (SELECT a.condition, feature, a.z AS za, b.z AS zb FROM z a JOIN z b USING (condition, feature) WHERE a.signal_id = 'click' AND b.signal_id = 'view'),
k AS (SELECT condition, corr(za, zb) OVER (PARTITION BY condition) AS correlation, feature, abs(za - zb) AS apart, row_number() OVER (PARTITION BY condition ORDER BY abs(za - zb) DESC, feature)::INTEGER AS outlier_rank FROM m)
SELECT condition, {o.r('correlation', 'correlation')}, feature, {o.r('apart', 'apart')}, outlier_rank FROM k WHERE outlier_rank <= 3""")
def j47_sensor_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.agreement(plain_features(spark, sf_dir), "signal_id", "click", "view", "condition", NAMES))


@query(f"""{PLAIN_SQL}, m AS (SELECT signal_id, condition, avg(ln(variance + 1e-12)) AS l, avg(variance) AS v FROM feat GROUP BY ALL)
SELECT signal_id, {o.r('stddev_pop(l) / (abs(avg(l)) + 1e-12)', 'cv_log')}, {o.r('stddev_samp(v) / (abs(avg(v)) + 1e-12)', 'cv_raw')} FROM m GROUP BY 1""")
def b12_log_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a logarithm makes a feature calmer over conditions."""
    return rounded(stability.log_variation(plain_features(spark, sf_dir), "condition", ["variance"], KEY).drop("feature"))


@query(f"{ACROSS} SELECT signal_id, feature, {o.r('cv', 'cv_across_conditions')} FROM rk r WHERE CASE WHEN (SELECT count(*) FROM rk c WHERE c.signal_id = r.signal_id AND c.cv <= 0.1) >= 2 THEN cv <= 0.1 ELSE stability_rank <= 3 END")
def b10_variation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features under a variation; where too few are, the calmest ones."""
    table = stability.across_conditions(plain_features(spark, sf_dir), "condition", NAMES, KEY)
    return rounded(stability.calm(table, KEY, 0.1, 2, 3).where("fits").select(*KEY, "feature", "cv_across_conditions"))


@query(f"SELECT n_nationkey, {o.r('2 * pi() * (n_nationkey * 10) / 60', 'omega')}, {o.r('(2 * pi() * (n_nationkey * 10) / 60) ** 2 * 0.019', 'a_c')} FROM nation")
def j49_centripetal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 10).alias("rpm"))
    return rounded(scoring.centripetal(rows).drop("rpm"))


@query(f"""{PLAIN_SQL} SELECT signal_id, condition, count(*) AS n, {o.r('avg(mean)', 'mean')} FROM feat GROUP BY ROLLUP (signal_id, condition)""")
def k01_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plain_features(spark, sf_dir).rollup(*CELLS_KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean")))


@query("""WITH w AS (SELECT event_type AS signal_id, unnest([floor(epoch_us(ts) / 1e6 / 43200), floor(epoch_us(ts) / 1e6 / 43200) - 1]) * 43200 AS s, value FROM events)
SELECT signal_id, s::BIGINT AS window_start, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM w GROUP BY ALL""")
def k02_timed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window operator over a finished table: windows of a day every half day."""
    rows = events(spark, sf_dir).select("signal_id", "ts", "value")
    cut = timed_totals(rows, "signal_id", "ts", "value", "1 day", "12 hours")
    return rounded(cut.select("signal_id", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "n", "total"))


def _sensors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, health.Settings]:
    """Events as sensors with four channels made of two, and short settings that the small tables have samples for."""
    long = signals.long_channels(cells(spark, sf_dir), [*CELLS_KEYS, "idx"], {"AccX": "value", "AccY": "k"})
    s = health.Settings(window_sec=1.28, step_sec=0.64, base_sec=2, channels=("AccX", "AccY"), conditions=("c0", "c1", "c2"), base_conditions=("c1", "c2"))
    return long.withColumnRenamed("signal_id", "sensor"), s


@query()
def j13_health_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected features of every sensor."""
    return health.health_models(*_sensors(spark, sf_dir))["selection"]


@query()
def j14_fault_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, s = _sensors(spark, sf_dir)
    return health.fault_validation(health.health_models(samples, s), s, (0.0, 1.0, 2.0), 2)


CELL = ["signal_id", "fault_type", "severity"]


@query(f"""{VECTORS}, {CALIBRATION}, {o.SIGNAL}, {_hurt_sql()}, {o.windows('hurt', CELL, 64, 32, 'hw')}, {o.time_features('hw', CELL, 'hf')},
hlong AS (SELECT signal_id, fault_type, severity, ws, {UNPIVOT} FROM hf),
hqv AS (SELECT signal_id, fault_type, severity, ws, avg(abs((value - mean) / std)) AS raw FROM hlong JOIN st USING (signal_id, feature) JOIN pick USING (signal_id, feature) GROUP BY ALL),
hh AS (SELECT signal_id, fault_type, severity, avg(1 / (1 + greatest(raw - threshold, 0) / scale)) AS health FROM hqv JOIN cal USING (signal_id) GROUP BY ALL),
{POOLED}, {_apart('hw', CELL, 'ap')}, hk AS (SELECT signal_id, fault_type, severity, avg(kl) AS kl FROM ap GROUP BY ALL)
SELECT fault_type, severity, {o.r('avg(health)', 'avg_mean_health_score')}, {o.r('stddev_samp(health)', 'std_mean_health_score')}, {o.r('avg(kl)', 'avg_mean_div_mean_kl')}, {o.r('stddev_samp(kl)', 'std_mean_div_mean_kl')}
FROM hh JOIN hk USING (signal_id, fault_type, severity) GROUP BY ALL""")
def j18_severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health and divergence of all signals under pointwise faults, by severity, against the healthy cells' calibration."""
    healthy = plain_features(spark, sf_dir)
    selection, stats = _selection(healthy), stability.reference_stats(healthy, NAMES, KEY)
    calibration = scoring.fit_calibration(_vectors(healthy), KEY)
    reference = _reference(_short_samples(spark, sf_dir)).withColumnRenamed("sensor", "signal_id")
    hurt = faults.injected_windows(signal(spark, sf_dir), KEY, POINTWISE, SEVERITIES, SHORT.size, SHORT.step)
    apart = divergences.with_window_divergence(hurt, reference, SHORT.level, keys=KEY)
    features = window_features(apart, SHORT.size, FS, PLAIN, keep=[*CELL, "div_mean_kl"])
    scored = scoring.calibrated(scoring.quality_vectors(features, NAMES, selection, stats, KEY, [*CELL, "div_mean_kl"]), calibration, KEY)
    results = scored.groupBy(*CELL).agg(F.avg("qv_health_score").alias("mean_health_score"), F.avg("div_mean_kl").alias("mean_div_mean_kl"))
    return rounded(scoring.severity_summary(results.where("mean_div_mean_kl IS NOT NULL"), ["fault_type", "severity"]))


@query(f"""WITH {o.SIGNAL}, st AS (SELECT signal_id, count(*) AS n, avg(value) AS m, stddev_pop(value) + 1e-8 AS d, stddev_pop(value) AS s FROM sig GROUP BY 1)
SELECT signal_id, idx, {o.r("least(greatest(value, m - greatest(2.0 - 1.2, 0.3) * d), m + greatest(2.0 - 1.2, 0.3) * d)", 'saturated')},
{o.r(f"(value - m) * CASE WHEN {o.uniform(42, ['signal_id'], 'gain')} < 0.5 THEN greatest(0.2, 1 - 0.6) ELSE 1.8 END + m", 'gained')},
{o.r(f"value + {o.normal(42, ['signal_id', 'idx'], 'noise')} * 0.5 * s", 'noisy')} FROM sig JOIN st USING (signal_id)""")
def j26_j28_older_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rules of saturation and gain, about the mean, and noise in deviations of the signal."""
    own = signal(spark, sf_dir)
    of = lambda fault, name: faults.injected(own, KEY, F.lit(fault), F.lit(1.0), older=True).withColumnRenamed("value", name)
    noisy = faults.added_noise(own, KEY, 0.5).withColumnRenamed("value", "noisy")
    return rounded(of("saturation", "saturated").join(of("gain_change", "gained"), [*KEY, "idx"]).join(noisy, [*KEY, "idx"]))


@query(f"""{LONG}, {STATS}, v AS (SELECT unnest(['level', 'level', 'shape']) AS vector, unnest(['mean', 'rms', 'kurtosis']) AS feature)
SELECT vector, signal_id, condition, {o.r('avg(score)', 'mean_health_score')} FROM (
  SELECT vector, signal_id, condition, ws, avg(abs((value - mean) / std)) AS score FROM long JOIN st USING (signal_id, feature) JOIN v USING (feature) GROUP BY ALL) GROUP BY ALL""")
def j48_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different features compared over conditions."""
    features = plain_features(spark, sf_dir)
    return rounded(scoring.composition(features, NAMES, {"level": ["mean", "rms"], "shape": ["kurtosis"]}, features, ["condition"], KEY))


@query(f"""WITH {o.CELLS}, {o.windows('cells', CELLS_KEYS, 128, 64)}, w AS (SELECT DISTINCT signal_id, condition, ws FROM win),
k AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT condition FROM cells))
SELECT signal_id, condition, ws AS window_start_sample, CASE WHEN k < floor(0.7 * n + 1e-9) THEN 'train' WHEN k < floor(0.85 * n + 1e-9) THEN 'val' ELSE 'test' END AS split,
({o.uniform(42, ['signal_id', 'condition', 'ws'], 'degraded')} < 0.5)::INTEGER AS label, 128::BIGINT AS n FROM w JOIN k USING (condition)""")
def j41_window_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows split by subject (here condition), half of them degraded, scaled by the healthy training windows."""
    cut = written(windows.sliding(cells(spark, sf_dir), CELLS_KEYS, 128, 64))
    split = learning.subject_splits(cut, "condition")
    mixed = written(learning.degraded_share(split, [*CELLS_KEYS, "window_start_sample"]))
    scaled = learning.scaled_windows(mixed, mixed.where("split = 'train' AND label = 0"))
    return scaled.select(*CELLS_KEYS, "window_start_sample", "split", "label", F.size("value").cast("long").alias("n"))


@query()
def j35_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor that is fitted, saved, loaded and asked about every signal and condition."""
    samples = cells(spark, sf_dir)
    features = written(FeatureExtractor(FS, PLAIN).process(samples, CELLS_KEYS, 2.0, 1.0))
    model = learning.fit_modality(features, PLAIN.names(200, FS), "signal_id", trees=20, depth=5)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    learning.ModalityPredictor(model, tuple(PLAIN.names(200, FS)), PLAIN).save(path)
    return learning.ModalityPredictor.load(path, PLAIN).predict(samples, CELLS_KEYS, FS).select(*CELLS_KEYS, "modality", "confidence", "n_windows", "error")


@query()
def j30_modality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on window features, its vote for every signal and condition."""
    features = plain_features(spark, sf_dir)
    split = evaluation.balanced_split(features, "signal_id", [*CELLS_KEYS, "window_start_sample"], 0.2)
    model = learning.fit_modality(split.where("NOT is_test"), PLAIN_NAMES, "signal_id", trees=20, depth=5)
    told = learning.window_predictions(model, split.where("is_test"), PLAIN_NAMES)
    return learning.signal_predictions(told, CELLS_KEYS).select(*CELLS_KEYS, "modality", "confidence", "n_windows")


@query()
def j36_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = plain_features(spark, sf_dir)
    found = learning.projected(learning.fit_pca(features, PLAIN_NAMES), features, PLAIN_NAMES)
    return found.select(*CELLS_KEYS, "window_start_sample", F.col("pca")[0].alias("pc1"), F.col("pca")[1].alias("pc2"))


@query()
def j40_anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of rebuilding healthy and degraded windows from components of healthy ones."""
    healthy = windows.sliding(signals.normalised(signal(spark, sf_dir), KEY), KEY, 64, 32)
    hurt = windows.sliding(faults.injected(signals.normalised(signal(spark, sf_dir), KEY), KEY, F.lit("noise_increase"), F.lit(1.0)), KEY, 64, 32)
    model = learning.fit_window_pca(healthy, k=8)
    both = healthy.withColumn("label", F.lit(0)).unionByName(hurt.withColumn("label", F.lit(1)))
    return learning.reconstruction_error(model, both).select(*KEY, "window_start_sample", "label", "error")


@query()
def j40_sequence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a recurrent autoencoder that learns from healthy windows, on healthy and degraded ones."""
    normal = signals.normalised(signal(spark, sf_dir), KEY)
    healthy = written(windows.sliding(normal, KEY, 64, 32))
    hurt = windows.sliding(faults.injected(normal, KEY, F.lit("noise_increase"), F.lit(1.0)), KEY, 64, 32)
    both = written(healthy.withColumn("label", F.lit(0)).unionByName(hurt.withColumn("label", F.lit(1))))
    model = autoencoder.fit(healthy, validation=both, rounds=3, epochs=2, hidden=16)
    return model.score(both).select(*KEY, "window_start_sample", "label", "error")


SWEPT = {"noise": (0.0, 0.5, 1.0, 2.0), "drift": (0.5, 1.0)}
SWEEP = ["signal_id", "sweep", "severity"]


@query(f"""{LONG}, {STATS}, {o.SIGNAL}, own AS (SELECT signal_id, count(*) AS n, stddev_pop(value) AS s, max(value) - min(value) AS r FROM sig GROUP BY 1),
grid AS (SELECT unnest({[k for k, v in SWEPT.items() for _ in v]}) AS sweep, unnest({[x for v in SWEPT.values() for x in v]})::DOUBLE AS severity),
raised AS (SELECT signal_id, sweep, severity, idx, CASE sweep WHEN 'noise' THEN value + {o.normal(42, ['signal_id', 'idx'], 'noise')} * severity * s ELSE value + severity * r * idx / greatest(n - 1, 1) END AS value FROM sig JOIN own USING (signal_id) CROSS JOIN grid),
{o.windows('raised', SWEEP, 64, 32, 'rw')}, {o.time_features('rw', SWEEP, 'rf')}, rlong AS (SELECT signal_id, sweep, severity, ws, {UNPIVOT} FROM rf),
v AS (SELECT unnest(['level', 'level', 'shape', 'centre']) AS vector, unnest(['mean', 'rms', 'kurtosis', 'quantile_50']) AS feature)
SELECT vector, signal_id, sweep, severity, {o.r('avg(score)', 'mean_health_score')} FROM (
  SELECT vector, signal_id, sweep, severity, ws, avg(abs((value - mean) / std)) AS score FROM rlong JOIN st USING (signal_id, feature) JOIN v USING (feature) GROUP BY ALL) GROUP BY ALL""")
def j48_composition_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different features under rising noise and drift, against the healthy windows."""
    reference = plain_features(spark, sf_dir)
    hurt = written(faults.swept(signal(spark, sf_dir), KEY, SWEPT))
    features = FeatureExtractor(FS, PLAIN).process(hurt, SWEEP, 0.64, 0.32)
    vectors = {"level": ["mean", "rms"], "shape": ["kurtosis"], "centre": ["quantile_50"]}
    return rounded(scoring.composition(features, NAMES, vectors, reference, ["sweep", "severity"], KEY))


@query(f"""WITH {o.SIGNAL}, {o.windows('sig', KEY, 64, 32, 'bw')}, {o.time_features('bw', KEY, 'bf')}, blong AS (SELECT signal_id, ws, {UNPIVOT} FROM bf),
st AS (SELECT signal_id, feature, avg(value) AS base, stddev_samp(value) + 1e-12 AS std FROM blong GROUP BY ALL),
{_hurt_sql()}, worst AS (SELECT * FROM hurt WHERE severity = 2.0), {o.windows('worst', CELL, 64, 32, 'hw')}, {o.time_features('hw', CELL, 'hf')}, hlong AS (SELECT signal_id, fault_type, ws, {UNPIVOT} FROM hf),
moved AS (SELECT signal_id, fault_type, feature, avg(value) AS mean FROM hlong GROUP BY ALL),
told AS (SELECT signal_id, feature, avg(abs(mean - base) / greatest(std, 1e-12)) AS response FROM moved JOIN st USING (signal_id, feature) GROUP BY ALL)
SELECT signal_id, feature, {o.r('response', 'fault_response')}, row_number() OVER (PARTITION BY signal_id ORDER BY response DESC, feature)::INTEGER AS response_rank FROM told""")
def j11_response_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features ranked by how far faults at severity 2 move their means, in deviations of the healthy windows."""
    extractor = FeatureExtractor(FS, PLAIN)
    own = signal(spark, sf_dir)
    healthy = written(extractor.process(own, KEY, 0.64, 0.32))
    hurt = extractor.process(written(faults.injected_cells(own, KEY, POINTWISE, (2.0,))), CELL, 0.64, 0.32)
    return rounded(stability.response_ranks(healthy, hurt, NAMES, stability.reference_stats(healthy, NAMES, KEY), keys=KEY))


@query(f"""WITH {o.CELLS}, {o.windows('cells', CELLS_KEYS, 64, 32)}, {o.time_features('win', CELLS_KEYS, 'feat')},
codes AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS code FROM (SELECT DISTINCT condition FROM feat WHERE condition <> 'c1'))
SELECT signal_id, f.condition, ws AS window_start_sample, coalesce(code, -1)::INTEGER AS code, CASE WHEN code IS NULL THEN NULL ELSE f.condition END AS again, {o.r("CASE WHEN f.skewness > 1 THEN 0.0 ELSE f.skewness END", 'skewness')}
FROM feat f LEFT JOIN codes USING (condition)""")
def j34_encoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two conditions given to windows of all three, and the labels back; missing features filled."""
    features = plain_features(spark, sf_dir)
    codes = learning.label_codes(features.where("condition <> 'c1'"), "condition")
    given = learning.encoded(features, codes, "condition")
    back = learning.decoded(given.withColumnRenamed("condition", "own"), codes, "condition").withColumnRenamed("condition", "again").withColumnRenamed("own", "condition")
    holed = back.withColumn("skewness", F.when(F.col("skewness") <= 1, F.col("skewness")))
    return rounded(learning.filled(holed, ["skewness"]).select(*CELLS_KEYS, "window_start_sample", "code", "again", "skewness"))


@query(f"""WITH {o.CELLS}, {o.windows('cells', CELLS_KEYS, 128, 64)},
k AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT condition FROM cells)),
w AS (SELECT signal_id, condition, ws, i, x, CASE WHEN k < floor(0.7 * n + 1e-9) THEN 'train' WHEN k < floor(0.85 * n + 1e-9) THEN 'val' ELSE 'test' END AS split,
  ({o.uniform(42, ['signal_id', 'condition', 'ws'], 'degraded')} < 0.5)::INTEGER AS label FROM win JOIN k USING (condition)),
st AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM w WHERE split = 'train' AND label = 0)
SELECT signal_id, condition, ws AS window_start_sample, split, label, CASE WHEN label = 0 THEN round(avg((x - m) / s), 6) + 0.0 END AS mean, CASE WHEN label = 0 THEN round(min((x - m) / s), 6) + 0.0 END AS low,
  CASE WHEN label = 0 THEN round(max((x - m) / s), 6) + 0.0 END AS high, CASE WHEN label = 0 THEN round(max((x - m) / s) FILTER (WHERE i = 0), 6) + 0.0 END AS first FROM w CROSS JOIN st GROUP BY signal_id, condition, ws, split, label""")
def j41_window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled values of the healthy windows of the dataset; those of degraded ones, which have random faults, are left null."""
    cut = written(windows.sliding(cells(spark, sf_dir), CELLS_KEYS, 128, 64))
    mixed = written(learning.degraded_share(learning.subject_splits(cut, "condition"), [*CELLS_KEYS, "window_start_sample"]))
    scaled = learning.scaled_windows(mixed, mixed.where("split = 'train' AND label = 0"))
    mean = F.aggregate("value", F.lit(0.0), lambda s, x: s + x) / F.size("value")
    told = {"mean": mean, "low": F.array_min("value"), "high": F.array_max("value"), "first": F.get("value", F.lit(0))}
    return rounded(scaled.select(*CELLS_KEYS, "window_start_sample", "split", "label", *(F.when(F.col("label") == 0, c).alias(n) for n, c in told.items())))
