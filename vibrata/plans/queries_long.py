"""Queries of whole long signals, and of joins and sessions in time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.functions import allan, quality, registered, spectrum, wavelet
from vibrata.operators import temporal, whole, windows
from vibrata.operators.extract import Families, FeatureExtractor
from vibrata.plans import oracle as o
from vibrata.plans.queries_windows import _welch_sql
from vibrata.plans.registry import query
from vibrata.plans.tables import FS, PLAIN_NAMES, read, rounded, signal
from vibrata.sources.scratch import shared_folder
from vibrata.streaming.windows import lateness, replayed, replayed_in_order, session_totals

KEY = ["signal_id"]
WHOLE = f"WITH {o.SIGNAL}, base AS (SELECT signal_id, 0 AS ws, idx AS i, value AS x FROM sig)"
BANDS = ((0.5, 5.0), (5.0, 20.0))


@query(f"{WHOLE}, {o.time_features('base', KEY, 'feat')} SELECT signal_id, {', '.join(o.r(n, n) for n in PLAIN_NAMES)} FROM feat")
def c09_long_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-domain features of whole sensors, however long."""
    stepped = whole.with_earlier(whole.sound_signals(signal(spark, sf_dir), KEY), KEY, rows=1000)
    return rounded(whole.time_features(stepped, KEY))


@query(f"""WITH {o.SIGNAL}, base AS (SELECT signal_id, idx AS i, floor(value / 20) AS x, count(*) OVER (PARTITION BY signal_id) AS n FROM sig),
d AS (SELECT *, x - lag(x) OVER w AS d, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS new FROM base WINDOW w AS (PARTITION BY signal_id ORDER BY i)),
m AS (SELECT signal_id, quantile_cont(d, 0.5) AS m FROM d GROUP BY ALL),
noise AS (SELECT signal_id, quantile_cont(abs(d - m), 0.5) * 1.4826 / sqrt(2) AS sq_noise_floor FROM d JOIN m USING (signal_id) GROUP BY ALL),
steady AS (SELECT signal_id, stddev_pop(a) AS sq_baseline_stability FROM (SELECT signal_id, i // (n // 4) AS s, avg(x) AS a FROM base WHERE i // (n // 4) < 4 GROUP BY ALL) GROUP BY ALL),
runs AS (SELECT signal_id, n, g, count(*) AS c FROM (SELECT *, sum(new) OVER (PARTITION BY signal_id ORDER BY i) AS g FROM d) GROUP BY ALL),
drops AS (SELECT signal_id, sum(CASE WHEN c >= 3 THEN c ELSE 0 END) / any_value(n)::DOUBLE AS sq_dropout_rate FROM runs GROUP BY signal_id),
spans AS (SELECT signal_id, size, unnest(range(0, n - size + 1, greatest(size // 2, 1))) AS s FROM (SELECT DISTINCT signal_id, n, greatest(n // 8, 4) AS size FROM base)),
peaks AS (SELECT signal_id, CASE WHEN avg(p) < 1e-12 THEN 0 ELSE stddev_pop(p) / avg(p) END AS sq_peak_consistency FROM (
  SELECT b.signal_id, s, max(x) - min(x) AS p FROM base b JOIN spans ON spans.signal_id = b.signal_id AND i >= s AND i < s + size GROUP BY ALL) GROUP BY ALL),
rest AS (SELECT signal_id, CASE WHEN var_pop(d) / 2 < 1e-20 THEN 60 WHEN var_pop(x) < 1e-20 THEN -60 ELSE 10 * log10(var_pop(x) / (var_pop(d) / 2)) END AS sq_snr, regr_r2(x, i) AS sq_response_linearity FROM d GROUP BY ALL)
SELECT signal_id, {', '.join(o.r(n, n) for n in quality.NAMES)}
FROM noise JOIN steady USING (signal_id) JOIN drops USING (signal_id) JOIN peaks USING (signal_id) JOIN rest USING (signal_id)""")
def c09_long_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six quality features of whole sensors; values are cut to steps of 20, so that repeats occur."""
    own = signal(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20).cast("double"))
    return rounded(whole.quality_features(whole.with_earlier(whole.sound_signals(own, KEY), KEY, rows=1000), KEY))


SEGMENTS = f"{WHOLE}, size AS (SELECT signal_id, count(*) AS n FROM base GROUP BY ALL), starts AS (SELECT signal_id, unnest(range(0, n - 255, 128)) AS s FROM size), segs AS (SELECT b.signal_id, ws, s AS seg, i - s AS i, x FROM base b JOIN starts t ON t.signal_id = b.signal_id AND i >= s AND i < s + 256), {_welch_sql('segs', 256, 'psd')}"


@query(f"{SEGMENTS} SELECT signal_id, k::INTEGER AS bin, {o.r('f', 'frequency')}, {o.r('p', 'density')} FROM psd")
def e01_long_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch densities of whole sensors, the mean over all their segments."""
    found = whole.densities(whole.sound_signals(signal(spark, sf_dir), KEY), KEY, FS)
    return rounded(found.select(*KEY, F.posexplode(F.arrays_zip("freqs", "densities")).alias("bin", "d")).select(*KEY, "bin", F.col("d.freqs").alias("frequency"), F.col("d.densities").alias("density")))


@query(f"""{SEGMENTS}, c AS (SELECT *, greatest(p, 1e-12) AS q, sum(greatest(p, 1e-12)) OVER (PARTITION BY signal_id) AS t FROM psd)
SELECT signal_id, {o.r('regr_slope(log10(greatest(p, 1e-300)), log10(greatest(f, 1e-300))) FILTER (WHERE f > 0 AND p > 0)', 'psd_slope')}, {o.r('-sum(q / t * ln(q / t))', 'spectral_entropy')},
  {o.r('exp(avg(ln(q))) / avg(q)', 'spectral_flatness')}, {o.r('sum(f * p) / (sum(p) + 1e-12)', 'spectral_centroid')},
  {o.r('sum(p) FILTER (WHERE f >= 0.5 AND f < 5)', 'band_energy_0_5_5_0')}, {o.r('sum(p) FILTER (WHERE f >= 5 AND f < 20)', 'band_energy_5_0_20_0')} FROM c GROUP BY signal_id""")
def e02_long_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whole.densities(whole.sound_signals(signal(spark, sf_dir), KEY), KEY, FS)
    own = found.select(*KEY, *spectrum.spectral_features(F.col("freqs"), F.col("densities"), BANDS))
    return rounded(own.select(*KEY, *(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in own.columns[1:])))


_STATS = """stats AS (SELECT signal_id, band, energy, variance, rms, -sum(q * log2(q)) AS entropy, CASE WHEN sqrt(variance) < 1e-12 THEN 0 ELSE kurt END AS kurtosis FROM (
  SELECT c.signal_id, c.band, energy, variance, rms, kurt, greatest(v * v / (energy + 1e-12), 1e-12) AS q FROM coef c
  JOIN (SELECT signal_id, band, sum(v * v) AS energy, var_pop(v) AS variance, sqrt(avg(v * v)) AS rms, kurtosis_pop(v) AS kurt FROM coef GROUP BY ALL) USING (signal_id, band)) GROUP BY ALL)"""
_BANDS = {"d1": "D1", "d2": "D2", "d3": "D3", "a": "A3"}


@query(f"""WITH {o.SIGNAL}, base AS (SELECT signal_id, idx AS i, value AS x FROM sig), {o.modwt('base', KEY, 3, 'coef')}, {_STATS}
SELECT signal_id, {', '.join(o.r(f"max({s}) FILTER (band = '{band}')", f'modwt_{b}_{s}') for b, band in _BANDS.items() for s in wavelet.STATISTICS)}, {o.r('sum(energy)', 'modwt_total_energy')},
  {o.r("sum(energy) FILTER (band IN ('D1', 'D2')) / (max(energy) FILTER (band = 'A3') + 1e-12)", 'modwt_energy_ratio_hf_lf')} FROM stats GROUP BY signal_id""")
def f09_long_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelet features of whole sensors."""
    found = whole.wavelet_features(whole.sound_signals(signal(spark, sf_dir), KEY), KEY, 3)
    return rounded(found.select(*KEY, *(f"modwt_{b}_{s}" for b in _BANDS for s in wavelet.STATISTICS), "modwt_total_energy", "modwt_energy_ratio_hf_lf"))


LONG_TAUS = [0.01, 0.02, 0.05, 0.1, 0.37, 1.0, 2.5, 5.0]
LONG_MS = allan.strides(LONG_TAUS, 1 << 20, FS)


@query(f"""{WHOLE}, ph AS (SELECT signal_id, i + 1 AS j, sum(x) OVER (PARTITION BY signal_id ORDER BY i) / 100.0 AS p FROM base UNION ALL SELECT DISTINCT signal_id, 0, 0.0 FROM base)
SELECT a.signal_id, m::BIGINT AS m, {o.r('m / 100.0', 'tau')}, {o.r('sqrt(avg((c.p - 2 * b.p + a.p) ** 2) / (2 * (m / 100.0) ** 2))', 'adev')}
FROM (SELECT *, unnest({LONG_MS}) AS m FROM ph) a JOIN ph b ON b.signal_id = a.signal_id AND b.j = a.j + m JOIN ph c ON c.signal_id = a.signal_id AND c.j = a.j + 2 * m GROUP BY a.signal_id, m HAVING count(*) > 1""")
def h01_long_allan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping Allan deviations of whole sensors, at strides of up to 500 samples."""
    return rounded(whole.allan_deviations(whole.sound_signals(signal(spark, sf_dir), KEY), KEY, FS, LONG_TAUS))


EVENTS = "e AS (SELECT event_id, 'c' || (user_id % 3)::VARCHAR AS condition, user_id, ts, event_type, value FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", condition.alias("condition"), "user_id", "ts", "event_type", "value")


@query(f"""WITH {EVENTS} SELECT l.event_id, l.condition, {o.r('r.value', 'last_purchase')}, r.event_id AS purchase_id
FROM e l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') r ON l.condition = r.condition AND l.ts >= r.ts""")
def k03_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at each event of a condition."""
    own = _events(spark, sf_dir)
    bought = own.where("event_type = 'purchase'")
    return rounded(temporal.as_of(own.select("event_id", "condition", "ts"), bought, ["condition"], "ts", {"last_purchase": "value", "purchase_id": "event_id"}).drop("ts"))


@query(f"""WITH {EVENTS} SELECT l.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(l.ts) <= 3600000000 THEN r.event_id END AS next_error
FROM (SELECT * FROM e WHERE event_type <> 'error') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') r ON l.user_id = r.user_id AND l.ts < r.ts""")
def k03_next_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's next error within the hour after each other event."""
    own = _events(spark, sf_dir)
    found = temporal.as_of(own.where("event_type <> 'error'"), own.where("event_type = 'error'"), ["user_id"], "ts", {"next_error": "event_id"}, forward=True, exact=False, tolerance=3600.0)
    return found.select("event_id", "next_error")


@query(f"""WITH {EVENTS}, spans AS (SELECT event_id AS span_id, user_id, ts AS start, ts + to_hours(1 + (event_id % 100)::INTEGER) AS stop FROM e WHERE event_type = 'signup')
SELECT e.event_id, span_id FROM e JOIN spans s ON s.user_id = e.user_id AND e.ts >= s.start AND e.ts < s.stop""")
def k04_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in spans of 1 to 100 hours that begin at signups."""
    own = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    stop = F.timestamp_micros(F.unix_micros("ts") + (1 + F.col("event_id") % 100) * 3_600_000_000)
    spans = own.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("start"), stop.alias("stop"))
    found = temporal.in_spans(own.select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", {"span_id": "event_id"})
    return found.select("event_id", "span_id")


SESSIONS = f"""WITH {EVENTS}, marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 900000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY condition ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY condition ORDER BY ts) AS no FROM marked)
SELECT condition, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n, {o.r('sum(value)', 'amount')} FROM numbered GROUP BY condition, no"""


@query(SESSIONS)
def k05_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a condition's events, apart by 15 minutes or more."""
    found = temporal.sessions(_events(spark, sf_dir), ["condition"], "ts", 900.0, amounts={"amount": "value"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rounded(found.select("condition", micros("session_start").alias("started"), micros("session_end").alias("ended"), "n", "amount"))


@query(SESSIONS)
def k05_streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from the events as a stream of several files, a batch each, run to its end.

    Tasks finish in any order and the stream takes files by their age, so a batch may be older than those before it.
    """
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events")
    rows.repartitionByRange(4, "ts").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    condition = F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))
    own = stream.select(condition.alias("condition"), F.col("ts").cast("timestamp").alias("ts"), "value")
    late = lateness(rows.select(F.col("ts").cast("timestamp").alias("ts")), "ts")
    found = replayed(session_totals(own, "condition", "ts", "value", "15 minutes", late), f"{folder}/found")
    return rounded(found.select("condition", F.unix_micros("session_start").alias("started"), F.unix_micros("session_end").alias("ended"), "n", F.col("total").alias("amount")))


@query(f"WITH {o.SIGNAL}, {o.windows('sig', KEY, 300, 150)} SELECT signal_id, ws AS window_start_sample, list(x ORDER BY i) AS value FROM win GROUP BY signal_id, ws")
def k06_sql_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows by SQL text, from the table function."""
    registered.register(spark)
    signal(spark, sf_dir).createOrReplaceTempView("sampled")
    return spark.sql("SELECT signal_id, window_start_sample, value FROM sliding_windows(TABLE(SELECT signal_id, idx, value FROM sampled), 300, 150)")


_MASSES = "SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) + 1e-6) AS v FROM embeddings)"


@query(f"""WITH m AS ({_MASSES}), d AS (SELECT a.vec_id, a.p AS pl, b.p AS ql FROM m a JOIN m b ON b.vec_id = a.vec_id + 1),
{o.divergences('d', 'vec_id', 'divs').replace('range(1, 51)', 'range(1, 65)')} SELECT vec_id, {o.r('kl', 'kl')}, {o.r('sym', 'sym_kl')}, {o.r('jsd', 'jsd')} FROM divs""")
def k06_sql_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of neighbouring vectors as distributions, by SQL text."""
    registered.register(spark)
    read(spark, sf_dir, "embeddings").createOrReplaceTempView("vectors")
    masses = "SELECT vec_id, transform(v, x -> x / aggregate(v, 0D, (s, y) -> s + y)) AS p FROM (SELECT vec_id, transform(embedding, x -> abs(CAST(x AS DOUBLE)) + 1e-6D) AS v FROM vectors)"
    return rounded(spark.sql(f"WITH m AS ({masses}) SELECT a.vec_id, kl_divergence(a.p, b.p) AS kl, sym_kl(a.p, b.p) AS sym_kl, jsd(a.p, b.p) AS jsd FROM m a JOIN m b ON b.vec_id = a.vec_id + 1"))


@query(f"WITH emb AS (SELECT vec_id, p.i - 1 AS i, embedding[p.i]::DOUBLE AS x FROM embeddings CROSS JOIN range(1, 65) p(i)), {o.modwt('emb', ['vec_id'], 3, 'coef')} SELECT vec_id, i, {o.r('v', 'coef')} FROM coef WHERE band = 'D2'")
def k06_sql_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second detail band of vectors, by SQL text."""
    registered.register(spark)
    read(spark, sf_dir, "embeddings").createOrReplaceTempView("vectors")
    found = spark.sql("SELECT vec_id, posexplode(modwt_band(CAST(embedding AS ARRAY<DOUBLE>), 3, 2)) AS (i, coef) FROM vectors")
    return rounded(found.withColumn("i", F.col("i").cast("long")))


@query(f"""WITH {o.SIGNAL}, n AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1),
starts AS (SELECT signal_id, w AS "window", floor({o.uniform(42, ['signal_id', 'w'], 'start')} * (n - 49))::BIGINT AS s FROM n CROSS JOIN range(20) t(w) WHERE n >= 50)
SELECT signal_id, "window"::INTEGER AS "window", s AS window_start_sample, (idx - s)::INTEGER AS place, {o.r('value', 'value')} FROM starts JOIN sig USING (signal_id) WHERE idx >= s AND idx < s + 50""")
def c03_random_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of windows at random starts."""
    own = signal(spark, sf_dir)
    cut = windows.at_starts(own, windows.random_starts(own, KEY, 50, 20), KEY, 50)
    return rounded(cut.select(*KEY, "window", "window_start_sample", F.posexplode("value").alias("place", "value")))


@query(f"""WITH {o.SIGNAL}, {o.windows('sig', KEY, 100, 100)}, {o.time_features('win', KEY, 'feat')}
SELECT signal_id, ws AS window_start_sample, {', '.join(o.r(n, n) for n in ('mean', 'variance', 'rms', 'skewness', 'kurtosis', 'zcr', 'quantile_25', 'quantile_50', 'quantile_75'))} FROM feat""")
def c10_only_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other families switched off: the columns that are left, with their values."""
    found = FeatureExtractor(FS, Families(spectrum=False, allan=False, wavelet_level=None, signal_quality=False)).process(signal(spark, sf_dir), KEY, 1.0, 1.0)
    return rounded(found.drop("window_start_sec"))


@query(f"WITH {o.SIGNAL}, {o.windows('sig', KEY, 64, 32)} SELECT signal_id, ws AS window_start_sample, {o.r('avg(x)', 'mean')}, {o.r('max(x) FILTER (WHERE i = 0)', 'first')}, {o.r('max(x) FILTER (WHERE i = 63)', 'last')} FROM win GROUP BY signal_id, ws")
def k07_ordered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a count of samples from a stream whose batches come out of order; two late rows of no sensor end it."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.repartition(4, F.xxhash64("ts")).write.parquet(f"{folder}/events")
    latest = rows.agg(F.max("ts").alias("ts"))
    for days in (100, 200):  # the first lets the watermark pass all samples, the second lets it be noticed
        end = latest.select(F.lit("end").alias("signal_id"), (F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), F.lit(0.0).alias("value"))
        end.where("ts IS NOT NULL").coalesce(1).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    found = replayed_in_order(stream, "signal_id", "ts", "value", 64, 32, f"{folder}/found", "60 days", "10 minutes")
    mean = F.aggregate("value", F.lit(0.0), lambda s, x: s + x) / F.size("value")
    return rounded(found.select(*KEY, "window_start_sample", mean.alias("mean"), F.get("value", F.lit(0)).alias("first"), F.element_at("value", -1).alias("last")))
