"""Queries of sources, filters, windows and window features. Names begin with the identifier of what they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibrata.functions import allan, divergence, quality, spectrum, time, wavelet
from vibrata.operators import signals, windows
from vibrata.operators.extract import Families, FeatureExtractor, window_features
from vibrata.plans import oracle as o
from vibrata.plans.registry import query
from vibrata.plans.tables import CELLS_KEYS, FS, PLAIN, PLAIN_NAMES, cells, events, plain_features, read, rounded, signal
from vibrata.sources import synthetic, text_tables

KEY = ["signal_id"]
SIG300 = f"WITH {o.SIGNAL}, {o.windows('sig', KEY, 300, 150)}"


@query("SELECT ts, value::FLOAT AS value, user_id::FLOAT AS user_id FROM events")
def a01_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.tabular(spark, f"{sf_dir}/events.parquet", "ts", ["value", "user_id"])


@query(f"""WITH steps AS (SELECT event_type AS signal_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts) AS d FROM events)
SELECT signal_id, {o.r('1 / quantile_cont(d, 0.5)', 'sample_rate')} FROM steps WHERE d > 0 GROUP BY signal_id""")
def a02_sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.sample_rates(events(spark, sf_dir), KEY, "ts"))


@query("SELECT l_orderkey::FLOAT AS s0, l_quantity::FLOAT AS s2, l_discount::FLOAT AS s4, CASE WHEN l_linenumber <> 3 THEN l_tax::FLOAT END AS s5 FROM lineitem")
def a03_whitespace_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whitespace columns by position; NaN becomes null."""
    tax = F.when(F.col("l_linenumber") == 3, F.lit("NaN")).otherwise(F.col("l_tax").cast("string"))
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")]
    lines = read(spark, sf_dir, "lineitem").select(F.concat_ws("  ", *parts, tax).alias("value"))
    return text_tables.cmapss(lines, (0, 2, 4, 5))


@query("""SELECT label, vec_id AS row, vec_id * 64 + p.i - 1 AS idx, embedding[p.i]::DOUBLE AS value
FROM embeddings CROSS JOIN range(1, 65) p(i)""")
def a05_flattened_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("row"), "embedding")
    return text_tables.flattened_rows(rows, ["label"], "row", "embedding", 64)


@query("SELECT event_id::DOUBLE AS timestamp, value AS accel_x, user_id::DOUBLE AS accel_y FROM events WHERE user_id % 5 <> 0")
def a06_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a NaN in any column, as the motion files hold them."""
    missing = F.when(F.col("user_id") % 5 == 0, F.lit("NaN")).otherwise(F.lit("0"))
    text = F.concat_ws(" ", F.col("event_id").cast("string"), F.col("value").cast("string"), F.col("user_id").cast("string"), *[F.lit("0")] * 6, missing)
    lines = read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), text.alias("value"))
    return text_tables.shl_motion(lines).select("timestamp", "accel_x", "accel_y")


OCTAVES = " + ".join(o.normal(42, ["signal_id", str(k), f"(idx >> {k})"], "pink") for k in range(synthetic.OCTAVES))
NOISE = f"""{o.SIGNAL}, draws AS (SELECT kind, signal_id, idx, CASE kind WHEN 'white' THEN {o.normal(42, ['signal_id', 'idx'], 'white')} WHEN 'brown' THEN {o.normal(42, ['signal_id', 'idx'], 'brown')} ELSE {OCTAVES} END AS d
  FROM sig CROSS JOIN (SELECT unnest(['white', 'brown', 'pink']) AS kind)),
raw AS (SELECT kind, signal_id, idx, CASE kind WHEN 'brown' THEN sum(d) OVER (PARTITION BY kind, signal_id ORDER BY idx) ELSE d END AS v FROM draws)"""


def _noises(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, made = signal(spark, sf_dir), None
    for kind in synthetic.KINDS:
        one = synthetic.noise_like(own, KEY, 1.5, 2.0, kind).withColumn("kind", F.lit(kind))
        made = one if made is None else made.unionByName(one)
    return made


@query(f"WITH {NOISE} SELECT kind, signal_id, idx, {o.r('(v - avg(v) OVER w) / stddev_pop(v) OVER w * 2.0 + 1.5', 'value')} FROM raw WINDOW w AS (PARTITION BY kind, signal_id)")
def a11_drawn_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White, brown and pink noise for each sample of every sensor."""
    return rounded(_noises(spark, sf_dir))


@query(f"WITH {o.SIGNAL} SELECT unnest(['white', 'brown', 'pink']) AS kind, signal_id, 1.5::DOUBLE AS mean, 2.0::DOUBLE AS std, n FROM (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1)")
def a11_synthetic_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the three kinds of noise in the shape of every sensor's signal; they are what was asked for."""
    return rounded(_noises(spark, sf_dir).groupBy("kind", *KEY).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")))


@query(f"""SELECT event_type AS signal_id, channel, {o.r('value * CASE channel WHEN $$accel$$ THEN 0.061e-3 * 9.81 ELSE 1 / 131.0 END', 'value', 9)}
FROM (SELECT event_type, unnest(['accel', 'gyro']) AS channel, unnest([value, (props->>'$.k')::DOUBLE]) AS value FROM events)""".replace("$$", "'"))
def a14_unit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = signals.long_channels(events(spark, sf_dir), KEY, {"accel": "value", "gyro": "k"})
    return rounded(signals.scaled(long, {"accel": 0.061e-3 * 9.81, "gyro": 1 / 131.0}), 9)


@query("""WITH long AS (SELECT event_type AS signal_id, user_id % 40 AS unit, unnest(['value', 'k']) AS channel,
    unnest([value, CASE WHEN (props->>'$.k')::DOUBLE > 20 THEN (props->>'$.k')::DOUBLE END]) AS x FROM events),
  sound AS (SELECT *, count(*) OVER (PARTITION BY signal_id, unit, channel) AS n FROM long WHERE x IS NOT NULL)
SELECT signal_id, unit, channel, count(*) AS n, round(sum(x), 6) + 0.0 AS total FROM sound WHERE n >= 45 GROUP BY ALL""")
def a15_collected_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("signal_id"), (F.col("user_id") % 40).alias("unit"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    rows = rows.withColumn("k", F.when(F.col("k") > 20, F.col("k")))
    long = signals.long_channels(rows, ["signal_id", "unit"], {"value": "value", "k": "k"})
    kept = signals.collected_channels(long, ["signal_id", "unit"], 45)
    return rounded(kept.groupBy("signal_id", "unit", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("SELECT event_id, user_id % 7 AS activity, value FROM events WHERE user_id % 7 IN (2, 3)")
def b01_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("activity"), "value")
    return signals.only_labels(rows, "activity", [2, 3])


@query("""SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY ts) - 1 AS idx, value
FROM (SELECT event_type AS signal_id, ts, value FROM events WHERE user_id % 4 > 1)""")
def b02_finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that aren't finite go before the rest is numbered."""
    bad = F.when(F.col("user_id") % 4 == 0, F.lit(float("nan"))).when(F.col("user_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("signal_id"), "ts", bad.alias("value"))
    return signals.indexed(signals.finite(rows), KEY, "ts", 7 * 86400).select("signal_id", "idx", "value")


@query(f"""WITH {o.SIGNAL}, n AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1)
SELECT signal_id, CASE WHEN n <= 300 THEN idx ELSE idx - 200 END AS idx, value FROM sig JOIN n USING (signal_id) WHERE n <= 300 OR (idx >= 200 AND idx < n - 100)""")
def b03_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.trimmed(signal(spark, sf_dir), KEY, FS, 2, 1)


@query("SELECT event_id, unnest(['AccX', 'AccY']) AS channel, unnest([value, (props->>'$.k')::DOUBLE]) AS value FROM events")
def b04_axis_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").alias("k"))
    return signals.long_channels(rows, ["event_id"], {"AccX": "value", "AccY": "k"})


@query(f"WITH {o.SIGNAL} SELECT * FROM sig WHERE idx < 150")
def b05_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.head(signal(spark, sf_dir), 1.5, FS)


@query(f"""WITH {o.SIGNAL}, n AS (SELECT signal_id, greatest((count(*) - 100) // 2, 0) AS s FROM sig GROUP BY 1)
SELECT signal_id, idx - s AS idx, value FROM sig JOIN n USING (signal_id) WHERE idx >= s AND idx < s + 100""")
def b06_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.middle(signal(spark, sf_dir), KEY, 100)


@query(f"WITH {o.SIGNAL} SELECT signal_id, idx, {o.r('(value - avg(value) OVER w) / stddev_pop(value) OVER w', 'value')} FROM sig WINDOW w AS (PARTITION BY signal_id)")
def b08_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.normalised(signal(spark, sf_dir), KEY))


@query(f"""{SIG300} SELECT signal_id, ws AS window_start_sample, ws / 100.0 AS window_start_sec, count(*) AS n, arg_min(x, i) AS first, arg_max(x, i) AS last, {o.r('sum(x)', 'total')}
FROM win GROUP BY signal_id, ws""")
def c01_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.sliding(signal(spark, sf_dir), KEY, 300, 150)
    w = F.col("value")
    return rounded(cut.select(*KEY, "window_start_sample", (F.col("window_start_sample") / F.lit(FS)).alias("window_start_sec"), F.size(w).cast("long").alias("n"), F.get(w, 0).alias("first"), F.element_at(w, -1).alias("last"), F.aggregate(w, F.lit(0.0), lambda s, x: s + x).alias("total")))


@query(f"""WITH {o.SIGNAL}, {o.windows('sig', KEY, 100, 100)}
SELECT signal_id, ws AS window_start_sample, {o.r('min(x)', 'min')}, {o.r('max(x)', 'max')}, {o.r('avg(x)', 'mean')}, {o.r('median(x)', 'median')}, {o.r('stddev_pop(x)', 'std')} FROM win GROUP BY signal_id, ws""")
def c02_d08_tumbling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.tumbling(signal(spark, sf_dir), KEY, 100).withColumn("__s", time.five_statistics(F.col("value")))
    return rounded(cut.select(*KEY, "window_start_sample", *(F.col("__s")[n].alias(n) for n in time.FIVE)))


@query(f"""WITH {o.SIGNAL}, n AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1),
starts AS (SELECT signal_id, w AS "window", (w * 7919) % (n - 49) AS start FROM n CROSS JOIN range(20) t(w) WHERE n >= 50)
SELECT signal_id, "window"::INTEGER AS "window", start AS window_start_sample, count(*) AS n, {o.r('avg(value)', 'mean')} FROM starts JOIN sig USING (signal_id) WHERE idx >= start AND idx < start + 50 GROUP BY ALL""")
def c03_stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at the starts of a table."""
    own = signal(spark, sf_dir)
    room = signals.lengths(own, KEY).where("n >= 50")
    starts = room.select(*KEY, "n", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("window")).select(*KEY, "window", (F.col("window") * 7919 % (F.col("n") - 49)).alias("start"))
    cut = windows.at_starts(own, starts, KEY, 50)
    return rounded(cut.select(*KEY, "window", "window_start_sample", F.size("value").cast("long").alias("n"), (F.aggregate("value", F.lit(0.0), lambda s, x: s + x) / 50).alias("mean")))


@query(f"""WITH {o.SIGNAL}, n AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1)
SELECT signal_id, w::INTEGER AS "window", floor({o.uniform(42, ['signal_id', 'w'], 'start')} * (n - 49))::BIGINT AS window_start_sample, 50 AS n FROM n CROSS JOIN range(20) t(w) WHERE n >= 50""")
def c03_random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signal(spark, sf_dir)
    return windows.at_starts(own, windows.random_starts(own, KEY, 50, 20), KEY, 50).select(*KEY, "window", "window_start_sample", F.size("value").alias("n"))


@query(f"""WITH {o.SIGNAL}, n AS (SELECT signal_id, count(*) // 4 AS s FROM sig GROUP BY 1)
SELECT signal_id, least(idx // s, 3)::INTEGER AS segment, count(*) AS n, {o.r('avg(value)', 'mean')}, count(*) FILTER (WHERE idx // s < 4) AS without_rest FROM sig JOIN n USING (signal_id) WHERE s > 0 GROUP BY ALL""")
def c04_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signal(spark, sf_dir)
    whole = windows.segments(own, KEY, 4).groupBy(*KEY, "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    cut = windows.segments(own, KEY, 4, keep_rest=False).groupBy(*KEY, "segment").agg(F.count(F.lit(1)).alias("without_rest"))
    return rounded(whole.join(cut, [*KEY, "segment"]))


@query(f"""WITH {o.CELLS}, a AS (SELECT signal_id, condition, idx, value FROM cells), b AS (SELECT signal_id, condition, idx, k AS value FROM cells),
{o.windows('a', ['signal_id', 'condition'], 128, 64, 'wa')}, {o.windows('b', ['signal_id', 'condition'], 128, 64, 'wb')}
SELECT signal_id, condition, ws AS window_start_sample, {o.r('corr(wa.x, wb.x)', 'correlation')} FROM wa JOIN wb USING (signal_id, condition, ws, i) GROUP BY ALL""")
def c07_multi_channel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two channels, which stay aligned."""
    cut = windows.sliding(cells(spark, sf_dir), CELLS_KEYS, 128, 64, values=("value", "k"))
    pairs = F.arrays_zip("value", "k")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    both = cut.withColumn("ma", mean("value")).withColumn("mb", mean("k"))
    total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, x: s + x)
    a, b = (lambda p: p["value"] - F.col("ma")), (lambda p: p["k"] - F.col("mb"))
    r = total(lambda p: a(p) * b(p)) / F.sqrt(total(lambda p: a(p) * a(p)) * total(lambda p: b(p) * b(p)))
    return rounded(both.select(*CELLS_KEYS, "window_start_sample", r.alias("correlation")))


PLAIN_SQL = f"WITH {o.CELLS}, {o.windows('cells', CELLS_KEYS, 64, 32)}, {o.time_features('win', CELLS_KEYS, 'feat')}"


@query(f"{PLAIN_SQL} SELECT signal_id, condition, ws AS window_start_sample, ws / 100.0 AS window_start_sec, {', '.join(o.r(n, n) for n in PLAIN_NAMES)} FROM feat")
def c08_batch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all signals and conditions in one job."""
    return rounded(plain_features(spark, sf_dir))


@query(f"""WITH {o.SIGNAL}, cen AS (SELECT signal_id, idx, value - avg(value) OVER (PARTITION BY signal_id) AS value FROM sig),
{o.windows('cen', KEY, 300, 150)}, {o.time_features('win', KEY, 'feat')}
SELECT signal_id, ws AS window_start_sample, {', '.join(o.r(n, n) for n in PLAIN_NAMES)} FROM feat""")
def d01_time_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments, crossings and quartiles of windows of signals without their mean."""
    own = signals.centred(signal(spark, sf_dir), KEY)
    cut = windows.sliding(own, KEY, 300, 150).withColumn("__t", time.moments(F.col("value")))
    return rounded(cut.select(*KEY, "window_start_sample", *(F.col("__t")[n].alias(n) for n in PLAIN_NAMES)))


def _welch_sql(source: str, size: int, name: str) -> str:
    """``name`` (signal_id, ws, f, p) from segments (signal_id, ws, seg, i, x) of ``size``."""
    return f"""{name}_h AS (SELECT signal_id, ws, seg, i, (x - avg(x) OVER (PARTITION BY signal_id, ws, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / {size})) AS y FROM {source}),
{name}_f AS (SELECT signal_id, ws, seg, k, sum(y * cos(2 * pi() * ((k * i) % {size}) / {size})) AS re, sum(y * sin(2 * pi() * ((k * i) % {size}) / {size})) AS im
  FROM {name}_h CROSS JOIN range({size // 2 + 1}) t(k) GROUP BY ALL),
{name} AS (SELECT signal_id, ws, k, k * 100.0 / {size} AS f, avg((re * re + im * im) * CASE WHEN k = 0 OR k = {size // 2} THEN 1 ELSE 2 END)
  / (100.0 * (SELECT sum((0.5 - 0.5 * cos(2 * pi() * t.i / {size})) ** 2) FROM range({size}) t(i))) AS p FROM {name}_f GROUP BY signal_id, ws, k)"""


@query(f"""WITH {o.SIGNAL}, {o.windows('sig', KEY, 1000, 1000)}, segs AS (SELECT signal_id, ws, s AS seg, i - s * 128 AS i, x FROM win CROSS JOIN range(6) t(s) WHERE i >= s * 128 AND i < s * 128 + 256),
{_welch_sql('segs', 256, 'psd')} SELECT signal_id, ws AS window_start_sample, k::INTEGER AS bin, {o.r('p', 'density')} FROM psd""")
def e01_welch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of windows of ten seconds, each a mean over six segments."""
    cut = windows.sliding(signal(spark, sf_dir), KEY, 1000, 1000)
    return rounded(cut.select(*KEY, "window_start_sample", F.posexplode(spectrum.welch(F.col("value"), FS)).alias("bin", "density")))


@query(f"""{SIG300}, segs AS (SELECT signal_id, ws, 0 AS seg, i, x FROM win WHERE i < 256), {_welch_sql('segs', 256, 'psd')},
c AS (SELECT *, greatest(p, 1e-12) AS q, sum(greatest(p, 1e-12)) OVER (PARTITION BY signal_id, ws) AS t FROM psd)
SELECT signal_id, ws AS window_start_sample, {o.r('regr_slope(log10(p), log10(f)) FILTER (WHERE f > 0 AND p > 0)', 'psd_slope')}, {o.r('-sum(q / t * ln(q / t))', 'spectral_entropy')},
  {o.r('exp(avg(ln(q))) / avg(q)', 'spectral_flatness')}, {o.r('sum(f * p) / (sum(p) + 1e-12)', 'spectral_centroid')},
  {o.r('sum(p) FILTER (WHERE f >= 0.5 AND f < 5)', 'band_energy_0_5_5_0')}, {o.r('sum(p) FILTER (WHERE f >= 5 AND f < 20)', 'band_energy_5_0_20_0')} FROM c GROUP BY signal_id, ws""".replace("log10(p), log10(f)", "log10(greatest(p, 1e-300)), log10(greatest(f, 1e-300))"))
def e02_spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.sliding(signal(spark, sf_dir), KEY, 300, 150)
    out = window_features(cut, 300, FS, Families(bands=((0.5, 5.0), (5.0, 20.0)), allan=False, wavelet_level=None, signal_quality=False))
    names = [*spectrum.NAMES, "band_energy_0.5_5.0", "band_energy_5.0_20.0"]
    return rounded(out.select(*KEY, "window_start_sample", *(F.col(f"`{n}`").alias(n.replace(".", "_")) for n in names)))


EMB = f"WITH emb AS (SELECT vec_id, p.i - 1 AS i, embedding[p.i]::DOUBLE AS x FROM embeddings CROSS JOIN range(1, 65) p(i)), {o.modwt('emb', ['vec_id'], 3, 'coef')}"
STATS = """stats AS (SELECT vec_id, band, energy, variance, rms, -sum(q * log2(q)) AS entropy, CASE WHEN sqrt(variance) < 1e-12 THEN 0 ELSE kurt END AS kurtosis FROM (
  SELECT c.vec_id, c.band, energy, variance, rms, kurt, greatest(v * v / (energy + 1e-12), 1e-12) AS q FROM coef c
  JOIN (SELECT vec_id, band, sum(v * v) AS energy, var_pop(v) AS variance, sqrt(avg(v * v)) AS rms, kurtosis_pop(v) AS kurt FROM coef GROUP BY ALL) USING (vec_id, band)) GROUP BY ALL)"""


@query(f"{EMB}, {STATS} SELECT vec_id, band, {', '.join(o.r(n, n) for n in wavelet.STATISTICS)} FROM stats")
def f01_wavelet_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the bands of vectors taken as windows of 64 samples, which allow three levels."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(wavelet.wavelet_statistics(F.col("embedding").cast("array<double>"))).alias("b", "s"))
    band = F.when(F.col("b") == 3, F.lit("A3")).otherwise(F.concat(F.lit("D"), (F.col("b") + 1).cast("string")))
    return rounded(rows.select("vec_id", band.alias("band"), *(F.col("s")[i].alias(n) for i, n in enumerate(wavelet.STATISTICS))))


@query(f"""{EMB}, e AS (SELECT vec_id, max(CASE band WHEN 'D1' THEN e END) AS d1, max(CASE band WHEN 'D2' THEN e END) AS d2, max(CASE band WHEN 'D3' THEN e END) AS d3, max(CASE band WHEN 'A3' THEN e END) AS a
  FROM (SELECT vec_id, band, sum(v * v) AS e FROM coef GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, 3.0::DOUBLE AS modwt_levels, {o.r('d1 + d2 + d3 + a', 'modwt_total_energy')}, {', '.join(o.r(f'{b} / (d1 + d2 + d3 + a + 1e-12)', f'modwt_{b}_rel_energy') for b in ('d1', 'd2', 'd3', 'a'))},
  {o.r('(d1 + d2) / (a + 1e-12)', 'modwt_energy_ratio_hf_lf')}, (CASE WHEN d1 >= d2 AND d1 >= d3 THEN 1 WHEN d2 >= d3 THEN 2 ELSE 3 END)::DOUBLE AS modwt_max_energy_level FROM e""")
def f09_wavelet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", wavelet.wavelet_statistics(F.col("embedding").cast("array<double>")).alias("s"))
    out = rows.select("vec_id", *wavelet.wavelet_features(F.col("s"), 3))
    return rounded(out.select("vec_id", "modwt_levels", "modwt_total_energy", *(f"modwt_{b}_rel_energy" for b in ("d1", "d2", "d3", "a")), "modwt_energy_ratio_hf_lf", "modwt_max_energy_level"))


@query(f"""WITH {o.SIGNAL}, step AS (SELECT signal_id, idx, floor(value / 20) AS value FROM sig), {o.windows('step', KEY, 300, 150)},
d AS (SELECT *, x - lag(x) OVER w AS d, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS new FROM win WINDOW w AS (PARTITION BY signal_id, ws ORDER BY i)),
m AS (SELECT signal_id, ws, quantile_cont(d, 0.5) AS m FROM d GROUP BY ALL),
noise AS (SELECT signal_id, ws, quantile_cont(abs(d - m), 0.5) * 1.4826 / sqrt(2) AS sq_noise_floor FROM d JOIN m USING (signal_id, ws) GROUP BY ALL),
base AS (SELECT signal_id, ws, stddev_pop(a) AS sq_baseline_stability FROM (SELECT signal_id, ws, i // 75 AS s, avg(x) AS a FROM win WHERE i // 75 < 4 GROUP BY ALL) GROUP BY ALL),
runs AS (SELECT signal_id, ws, g, count(*) AS c FROM (SELECT *, sum(new) OVER (PARTITION BY signal_id, ws ORDER BY i) AS g FROM d) GROUP BY ALL),
drops AS (SELECT signal_id, ws, sum(CASE WHEN c >= 3 THEN c ELSE 0 END) / 300.0 AS sq_dropout_rate FROM runs GROUP BY ALL),
peaks AS (SELECT signal_id, ws, CASE WHEN avg(p) < 1e-12 THEN 0 ELSE stddev_pop(p) / avg(p) END AS sq_peak_consistency FROM (
  SELECT signal_id, ws, s, max(x) - min(x) AS p FROM win CROSS JOIN range(0, 264, 18) t(s) WHERE i >= s AND i < s + 37 GROUP BY ALL) GROUP BY ALL),
rest AS (SELECT signal_id, ws, CASE WHEN var_pop(d) / 2 < 1e-20 THEN 60 WHEN var_pop(x) < 1e-20 THEN -60 ELSE 10 * log10(var_pop(x) / (var_pop(d) / 2)) END AS sq_snr,
  CASE WHEN var_pop(x) * 300 < 1e-12 THEN 1 ELSE regr_r2(x, i) END AS sq_response_linearity FROM d GROUP BY ALL)
SELECT signal_id, ws AS window_start_sample, {', '.join(o.r(n, n) for n in quality.NAMES)}
FROM noise JOIN base USING (signal_id, ws) JOIN drops USING (signal_id, ws) JOIN peaks USING (signal_id, ws) JOIN rest USING (signal_id, ws)""")
def g01_signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six quality features; values are cut to steps of 20, so that repeats occur."""
    own = signal(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20).cast("double"))
    cut = windows.sliding(own, KEY, 300, 150).withColumn("__q", quality.signal_quality(F.col("value")))
    return rounded(cut.select(*KEY, "window_start_sample", *(F.col("__q")[n].alias(n) for n in quality.NAMES)))


MS = allan.strides(allan.default_taus(300, FS), 300, FS)


@query(f"""{SIG300}, ph AS (SELECT signal_id, ws, i + 1 AS j, sum(x) OVER (PARTITION BY signal_id, ws ORDER BY i) / 100.0 AS p FROM win UNION ALL SELECT DISTINCT signal_id, ws, 0, 0.0 FROM win),
av AS (SELECT a.signal_id, a.ws, m, sqrt(avg((c.p - 2 * b.p + a.p) ** 2) / (2 * (m / 100.0) ** 2)) AS ad
  FROM (SELECT *, unnest({MS}) AS m FROM ph) a JOIN ph b ON b.signal_id = a.signal_id AND b.ws = a.ws AND b.j = a.j + m JOIN ph c ON c.signal_id = a.signal_id AND c.ws = a.ws AND c.j = a.j + 2 * m GROUP BY a.signal_id, a.ws, m)
SELECT signal_id, ws AS window_start_sample, {', '.join(o.r(f'max(CASE WHEN m = {m} THEN ad END)', f'adev_{m}') for m in MS)}, {o.r('regr_slope(log10(ad), log10(m / 100.0))', 'adev_slope')} FROM av GROUP BY signal_id, ws""")
def h01_allan_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.sliding(signal(spark, sf_dir), KEY, 300, 150)
    out = window_features(cut, 300, FS, Families(spectrum=False, wavelet_level=None, signal_quality=False))
    return rounded(out.select(*KEY, "window_start_sample", *(F.col(f"`adev_{m / FS:.2f}s`").alias(f"adev_{m}") for m in MS), "adev_slope"))


@query(f"""WITH emb AS (SELECT vec_id, 0 AS ws, p.i - 1 AS i, embedding[p.i]::DOUBLE AS x FROM embeddings CROSS JOIN range(1, 65) p(i)), {o.time_features('emb', ['vec_id'], 'feat')}
SELECT vec_id, {', '.join(o.r(n, n) for n in PLAIN_NAMES)} FROM feat""")
def c09_whole_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of vectors as whole signals, without windowing."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("value"))
    return rounded(FeatureExtractor(FS, PLAIN).process_whole(rows, 64))


TWENTY = allan.default_taus(1000, FS, 20)
MS20 = allan.strides(TWENTY, 1000, FS)


@query(f"""WITH {o.SIGNAL}, {o.windows('sig', KEY, 1000, 1000)}, ph AS (SELECT signal_id, ws, i + 1 AS j, sum(x) OVER (PARTITION BY signal_id, ws ORDER BY i) / 100.0 AS p FROM win UNION ALL SELECT DISTINCT signal_id, ws, 0, 0.0 FROM win)
SELECT a.signal_id, a.ws AS window_start_sample, {o.r('m / 100.0', 'tau')}, {o.r('sqrt(avg((c.p - 2 * b.p + a.p) ** 2) / (2 * (m / 100.0) ** 2))', 'adev')}
FROM (SELECT *, unnest({MS20}) AS m FROM ph) a JOIN ph b ON b.signal_id = a.signal_id AND b.ws = a.ws AND b.j = a.j + m JOIN ph c ON c.signal_id = a.signal_id AND c.ws = a.ws AND c.j = a.j + 2 * m GROUP BY a.signal_id, a.ws, m""")
def h02_twenty_taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allan deviations of windows of ten seconds at twenty taus."""
    cut = windows.sliding(signal(spark, sf_dir), KEY, 1000, 1000)
    told = cut.select(*KEY, "window_start_sample", F.explode(allan.allan_deviation(F.col("value"), FS, TWENTY)).alias("a"))
    return rounded(told.select(*KEY, "window_start_sample", "a.tau", "a.adev"))


@query()
def c10_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families at the default settings, Allan deviation included; each is checked by a query of its own."""
    out = FeatureExtractor(FS).process(signal(spark, sf_dir), KEY, 3.0, 1.5)
    return out.select(*(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in out.columns))


@query(f"""WITH {o.SIGNAL}, base AS (SELECT signal_id, idx AS i, value AS x FROM sig WHERE signal_id = 'view'), {o.modwt('base', KEY, 5, 'coef')}, {o.histogram('coef', ['signal_id', 'band'], 'v', 'h')},
{o.windows('sig', KEY, 300, 150)}, {o.modwt('win', ['signal_id', 'ws'], 5, 'wc')}, {o.histogram('wc', ['signal_id', 'ws', 'band'], 'v', 'wh')},
{o.aligned('h p JOIN wh q ON p.band = q.band', 'q.signal_id, q.ws, q.band', 'al')}, {o.divergences('al', 'signal_id, ws, band', 'dv')}
SELECT signal_id, ws AS window_start_sample, {o.r('avg(sym)', 'div_mean_kl')}, {o.r('max(sym)', 'div_max_kl')}, {o.r('avg(jsd)', 'div_mean_jsd')} FROM dv GROUP BY signal_id, ws""")
def i08_divergence_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with divergences from one reference through the extractor."""
    from vibrata.operators.divergences import reference_distributions

    own = signal(spark, sf_dir)
    reference = reference_distributions(own.where("signal_id = 'view'"), KEY).drop("signal_id")
    families = Families(spectrum=False, allan=False, wavelet_level=5, signal_quality=False, divergence=True)
    out = FeatureExtractor(FS, families).process(own, KEY, 3.0, 1.5, reference=reference)
    return rounded(out.select(*KEY, "window_start_sample", "div_mean_kl", "div_max_kl", "div_mean_jsd"))


@query(f"""WITH {o.SIGNAL}, {o.histogram('sig', KEY, 'value', 'h')} SELECT signal_id, b - 1 AS bin, {o.r('cs[b]', 'center')}, {o.r('ps[b]', 'prob', 9)} FROM (SELECT *, unnest(range(1, 51))::INTEGER AS b FROM h)""")
def i01_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vibrata.operators.divergences import histograms

    found = histograms(signal(spark, sf_dir), KEY, "value")
    long = found.select(*KEY, F.posexplode(F.arrays_zip("centers", "probs")).alias("bin", "x"))
    return long.select(*KEY, "bin", (F.round("x.centers", 6) + 0.0).alias("center"), (F.round("x.probs", 9) + 0.0).alias("prob"))


@query(f"""WITH {o.SIGNAL}, s AS (SELECT signal_id, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) AS sd FROM sig GROUP BY 1),
g AS (SELECT *, 0.1 * (hi - lo + 1e-12) AS m, sd * (3.0 * n / 4) ** -0.2 AS w FROM s),
d AS (SELECT signal_id, b, lo - m + b * ((hi - lo + 2 * m) / 49) AS x, sum(exp(-0.5 * ((lo - m + b * ((hi - lo + 2 * m) / 49) - value) / w) ** 2)) / (any_value(n) * any_value(w) * sqrt(2 * pi())) AS p
  FROM sig JOIN g USING (signal_id) CROSS JOIN range(50) t(b) GROUP BY ALL)
SELECT signal_id, b::INTEGER AS bin, {o.r('x', 'center')}, {o.r('p / (sum(p) OVER (PARTITION BY signal_id) + 1e-12)', 'prob', 9)} FROM d""")
def i02_kernel_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vibrata.operators.divergences import densities

    found = densities(signal(spark, sf_dir), KEY, "value")
    long = found.select(*KEY, F.posexplode(F.arrays_zip("centers", "probs")).alias("bin", "x"))
    return long.select(*KEY, "bin", (F.round("x.centers", 6) + 0.0).alias("center"), (F.round("x.probs", 9) + 0.0).alias("prob"))


@query(f"""WITH {o.SIGNAL}, {o.histogram('sig', KEY, 'value', 'h')}, {o.aligned('h p JOIN h q ON p.signal_id <> q.signal_id', 'p.signal_id AS sensor_a, q.signal_id AS sensor_b', 'al')},
{o.divergences('al', 'sensor_a, sensor_b', 'dv')} SELECT sensor_a, sensor_b, {o.r('kl', 'kl')}, {o.r('sym', 'symmetric_kl')}, {o.r('jsd', 'jsd')} FROM dv""")
def i03_i06_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned distributions of the signals' values and the three divergences of every ordered pair."""
    from vibrata.operators.divergences import histograms

    found = histograms(signal(spark, sf_dir), KEY, "value").select(F.lit(1).alias("one"), *KEY, F.struct("centers", "probs").alias("d"))
    a, b = (found.select("one", F.col("signal_id").alias(f"sensor_{s}"), F.col("d").alias(s)) for s in "ab")
    met = a.join(b, "one").where("sensor_a <> sensor_b").withColumn("pq", divergence.aligned(F.col("a"), F.col("b")))  # a row for each sensor
    p, q = F.col("pq.p"), F.col("pq.q")
    return rounded(met.select("sensor_a", "sensor_b", divergence.kl(p, q).alias("kl"), divergence.symmetric_kl(p, q).alias("symmetric_kl"), divergence.jensen_shannon(p, q).alias("jsd")))


LONG = f"WITH {o.SIGNAL}, base AS (SELECT signal_id, idx AS i, value AS x FROM sig WHERE signal_id IN (SELECT signal_id FROM sig GROUP BY 1 HAVING count(*) >= {wavelet.LEAST})), {o.modwt('base', KEY, 5, 'coef')}"


@query(f"{LONG} SELECT signal_id, band, i AS idx, {o.r('v', 'coef')} FROM coef")
def f01_long_modwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of whole signals, block by block."""
    from vibrata.operators.divergences import long_modwt

    own = signals.with_length(signal(spark, sf_dir), KEY, "n").where(F.col("n") >= wavelet.LEAST).drop("n")
    return rounded(long_modwt(own, KEY, 5, block=512).select(*KEY, "band", "idx", "coef"))


@query(f"{LONG}, {o.histogram('coef', ['signal_id', 'band'], 'v', 'h')} SELECT signal_id, band, {o.r('c0', 'first_center')}, {o.r('c1', 'last_center')}, {o.r('list_max(ps)', 'largest', 9)}, {o.r('list_sum(list_transform(ps, lambda p: p * ln(p)))', 'information', 9)} FROM h")
def i07_reference_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vibrata.operators.divergences import reference_distributions

    own = signal(spark, sf_dir)
    found = reference_distributions(own, KEY)
    told = found.select(*KEY, "band", F.get("centers", 0).alias("first_center"), F.element_at("centers", -1).alias("last_center"), F.array_max("probs").alias("largest"), F.aggregate("probs", F.lit(0.0), lambda s, p: s + p * F.ln(p)).alias("information"))
    return told.select(*KEY, "band", *((F.round(c, d) + 0.0).alias(c) for c, d in (("first_center", 6), ("last_center", 6), ("largest", 9), ("information", 9))))


@query(f"""{LONG}, {o.histogram('coef', ['signal_id', 'band'], 'v', 'h')}, {o.windows('sig', KEY, 300, 150)}, {o.modwt('win', ['signal_id', 'ws'], 5, 'wc')}, {o.histogram('wc', ['signal_id', 'ws', 'band'], 'v', 'wh')},
{o.aligned('h p JOIN wh q ON p.signal_id = q.signal_id AND p.band = q.band', 'q.signal_id, q.ws, q.band', 'al')}, {o.divergences('al', 'signal_id, ws, band', 'dv')}
SELECT signal_id, ws AS window_start_sample, {o.r('avg(sym)', 'div_mean_kl')}, {o.r('max(sym)', 'div_max_kl')}, {o.r('avg(jsd)', 'div_mean_jsd')},
  {', '.join(o.r(f"max(CASE band WHEN '{b}' THEN sym END)", f'div_{n}_kl') for b, n in (('D1', 'd1'), ('D5', 'd5'), ('A5', 'a')))} FROM dv GROUP BY signal_id, ws""")
def i08_window_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each signal against the signal's own reference."""
    from vibrata.operators.divergences import band_columns, reference_distributions, with_window_divergence

    own = signal(spark, sf_dir)
    cut = windows.sliding(own, KEY, 300, 150)
    told = band_columns(with_window_divergence(cut, reference_distributions(own, KEY), keys=KEY))
    return rounded(told.select(*KEY, "window_start_sample", "div_mean_kl", "div_max_kl", "div_mean_jsd", "div_d1_kl", "div_d5_kl", "div_a_kl"))


@query(f"""{LONG}, {o.histogram('coef', ['signal_id', 'band'], 'v', 'h')}, {o.aligned('h p JOIN h q ON p.band = q.band AND p.signal_id <> q.signal_id', 'p.signal_id AS sensor_a, q.signal_id AS sensor_b, p.band', 'al')},
{o.divergences('al', 'sensor_a, sensor_b, band', 'dv')} SELECT sensor_a, sensor_b, {o.r('avg(sym)', 'mean_kl')} FROM dv GROUP BY ALL UNION ALL SELECT DISTINCT signal_id, signal_id, 0.0 FROM h""")
def i09_cross_sensor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vibrata.operators.divergences import cross_matrix, reference_distributions

    own = signal(spark, sf_dir)
    return rounded(cross_matrix(reference_distributions(own, KEY), "signal_id"))


