"""Functions by SQL text against the operators that they stand for."""

import math

import numpy as np
import pytest

from vibrata.functions import registered, wavelet
from vibrata.operators.windows import sliding


@pytest.mark.parametrize(("size", "step"), [(5, 2), (3, 3), (2, 7), (1, 1), (40, 1)])
def test_the_table_function_gives_the_windows_of_the_operator(spark, size, step):
    registered.register(spark)
    rows = [(k, i, None if i == 4 else float(i)) for k, n in (("a", 23), ("b", 4), (None, 9)) for i in range(n)]
    table = spark.createDataFrame(rows, "sensor string, idx long, v double")
    table.repartition(3).createOrReplaceTempView("samples_to_cut")
    found = spark.sql(f"SELECT * FROM sliding_windows(TABLE(samples_to_cut), {size}, {step})")
    assert found.columns == ["sensor", "window_start_sample", "v"]
    order = lambda r: (r[0] or "", r[1])
    named = table.na.fill({"sensor": "none"})
    want = [(None if r.sensor == "none" else r.sensor, r.window_start_sample, r.v) for r in sliding(named, ["sensor"], size, step, "idx", ("v",)).collect()]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)


def test_the_table_function_refuses_wrong_arguments(spark):
    registered.register(spark)
    spark.range(3).createOrReplaceTempView("only_ids")
    for text in ("SELECT * FROM sliding_windows(TABLE(only_ids), 3, 1)", "SELECT * FROM sliding_windows(TABLE(SELECT 'a' AS k, id, id AS v FROM only_ids), 0, 1)"):
        with pytest.raises(Exception, match="table of signal|constant of one sample"):
            spark.sql(text).collect()


def test_divergences_and_bands(spark):
    registered.register(spark)
    p, q = np.array([0.2, 0.3, 0.5]), np.array([0.6, 0.4, 0.0])
    clip = lambda x: np.maximum(x, 1e-12)
    kl = lambda a, b: float((clip(a) * np.log(clip(a) / clip(b))).sum())
    m = (p + q) / 2
    text = lambda a: "array(" + ", ".join(f"{x}D" for x in a) + ")"
    row = spark.sql(f"SELECT kl_divergence({text(p)}, {text(q)}) AS a, sym_kl({text(p)}, {text(q)}) AS b, jsd({text(p)}, {text(q)}) AS c, jsd(NULL, {text(q)}) AS d").head()
    assert math.isclose(row.a, kl(p, q)) and math.isclose(row.b, (kl(p, q) + kl(q, p)) / 2) and math.isclose(row.c, (kl(p, m) + kl(q, m)) / 2) and row.d is None
    rng = np.random.default_rng(1)
    windows = [rng.normal(size=n) for n in (64, 16, 5)]
    spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(windows)] + [(3, None)], "id int, w array<double>").createOrReplaceTempView("windows_to_cut")
    for r in spark.sql("SELECT id, b, modwt_band(w, 2, b) AS found FROM windows_to_cut CROSS JOIN (SELECT explode(array(0, 1, 2, 3, 4)) AS b)").collect():
        bands = wavelet.modwt(windows[r.id][None], 2)[:, 0] if r.id < 2 else []
        assert (r.found is None) == (not 0 < r.b <= len(bands))
        if r.found is not None:
            assert np.allclose(r.found, bands[r.b - 1])
