"""Joins in time and sessions against plain loops, with stretches of a few rows and keys that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from vibrata.operators import signals, temporal

LEFT, RIGHT = "k string, t double, id long, v string", "k string, t double, v long"


def made(seed, n=120, times=40):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    at = lambda: rng.choice([None, *map(float, range(times))])
    left = [(key(), at(), i, "own") for i in range(n)]
    right = [(key(), at(), rng.choice([None, rng.randrange(9)])) for _ in range(n // 3)]
    return left, right


def plain_as_of(left, right, forward, exact, tolerance):
    out = []
    for k, t, i, _ in left:
        found = None
        if k is not None and t is not None:
            ok = lambda u: (u >= t if exact else u > t) if forward else (u <= t if exact else u < t)  # noqa: E731, B023
            rows = [(u, v) for q, u, v in right if q == k and u is not None and ok(u)]
            # Nulls are the smallest values.
            rank = lambda r: (r[0], r[1] is not None, r[1] or 0)
            best = (min if forward else max)(rows, key=rank, default=None)
            if best is not None and (tolerance is None or abs(best[0] - t) <= tolerance):
                found = best[1]
        out.append((i, found))
    return sorted(out)


@pytest.mark.parametrize(("seed", "forward", "exact", "tolerance", "rows"), [(1, False, True, None, 7), (2, True, True, None, 5), (3, False, False, 6.0, 9), (4, True, False, 3.0, 1 << 16)])
def test_as_of(spark, seed, forward, exact, tolerance, rows):
    left, right = made(seed)
    found = temporal.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", {"last": "v"}, forward=forward, exact=exact, tolerance=tolerance, rows=rows)
    assert found.columns == ["k", "t", "id", "v", "last"]
    assert sorted((r.id, r["last"]) for r in found.collect()) == plain_as_of(left, right, forward, exact, tolerance)


def test_as_of_without_rows_or_of_other_types(spark):
    left, right = made(5)
    none = spark.createDataFrame([], RIGHT)
    found = temporal.as_of(spark.createDataFrame(left, LEFT), none, ["k"], "t", {"last": "v"})
    assert found.count() == len(left) and found.where("last IS NOT NULL").isEmpty()
    assert temporal.as_of(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", {"last": "v"}).count() == 0
    with pytest.raises(ValueError, match="different types"):
        temporal.as_of(spark.createDataFrame(left, LEFT), none.withColumn("t", F.col("t").cast("long")), ["k"], "t", {"last": "v"})


def test_a_hot_key_is_dealt_to_many_stretches(spark):
    """All rows of one key, half of them in one second."""
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 10_000, F.col("id") / 10_000).otherwise(F.col("id").cast("double")).alias("t"), "id")
    sizes = [r["count"] for r in signals.stretched(rows, "t", rows=1000).groupBy("__stretch").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1600
    found = temporal.as_of(rows, rows.where("id % 100 = 0"), ["k"], "t", {"last": "id"}, rows=1000)
    assert found.where("last <> id - id % 100").isEmpty() and found.count() == 20_000


@pytest.mark.parametrize(("seed", "left", "per_span", "salts"), [(1, False, 8, 8), (2, True, 1, 1), (3, True, 50, 3)])
def test_in_spans(spark, seed, left, per_span, salts):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "b", None])
    samples = [(key(), rng.choice([None, rng.random() * 100]), i) for i in range(150)] + [("hot", 10.0, 900), ("hot", 20.0, 901)]
    spans = [(key(), s := rng.choice([None, rng.random() * 100]), None if s is None else s + rng.choice([-1, 0, 0.5, 5, 80, 1000]), i) for i in range(40)]
    spans += [("hot", 10.0, 20.0, 99), ("hot", 10.0, 20.0, 99), ("hot", -1e6, 1e6, 98)]  # edges, a repeat, and one far longer than all others
    want = []
    for k, t, i in samples:
        met = [s for q, a, b, s in spans if None not in (k, t, q, a, b) and q == k and a <= t < b]
        want += [(i, s) for s in met] or ([(i, None)] if left else [])
    found = temporal.in_spans(
        spark.createDataFrame(samples, "k string, t double, start long"), spark.createDataFrame(spans, "k string, start double, stop double, label long"), ["k"], "t", {"label": "label"}, left=left, per_span=per_span, salts=salts
    )
    assert found.columns == ["k", "t", "start", "label"]
    order = lambda r: (r[0], r[1] or -1)
    assert sorted(((r["start"], r.label) for r in found.collect()), key=order) == sorted(want, key=order)


def test_in_spans_joins_by_equal_bins_and_without_spans(spark):
    samples = spark.createDataFrame([("a", 1.0)], "k string, t double")
    spans = spark.createDataFrame([("a", 0.0, 2.0)], "k string, start double, stop double")
    plan = temporal.in_spans(samples, spans, ["k"], "t", {})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.in_spans(samples, spans.limit(0), ["k"], "t", {}).count() == 0
    assert temporal.in_spans(samples, spans.limit(0), ["k"], "t", {}, left=True).count() == 1


@pytest.mark.parametrize("left", [False, True])
def test_many_spans_are_never_broadcast(spark, left):
    """Spark takes a table of 10,000 spans for small, whatever rows they are laid out to; few spans are broadcast."""
    spans = spark.range(10_000).select((F.col("id") % 50).alias("k"), F.col("id").cast("double").alias("start"), (F.col("id") + 2.5).alias("stop"), F.col("id").alias("label"))
    samples = spark.range(0, 10_100, 50).select((F.col("id") % 50).alias("k"), F.col("id").cast("double").alias("t"))
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    found = temporal.in_spans(samples, spans, ["k"], "t", {"label": "label"}, left=left)
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    told = [(r.t, r.label) for r in found.collect()]
    want = [(float(t), t) for t in range(0, 10_000, 50)] + ([(10_000.0, None), (10_050.0, None)] if left else [])
    assert sorted(told, key=lambda r: r[0]) == want
    assert "BroadcastHashJoin" in plan(temporal.in_spans(samples, spans.limit(100), ["k"], "t", {"label": "label"}, left=left))


@pytest.mark.parametrize("rows", [4, 11, 1 << 16])
def test_sessions(spark, rows):
    """Sessions that last through many stretches, and stretches with many sessions."""
    rng = random.Random(rows)
    at, samples = 0.0, []
    for i in range(300):
        at += rng.choice([0.0, 0.5, 1.0, 9.0]) if i < 150 else 0.25
        samples.append((rng.choice(["hot", "hot", "b"]), at, rng.choice([None, 1, 2])))
    samples += [(None, 1.0, 1), ("b", None, 1)]
    want = []
    for k in ("hot", "b"):
        now = None
        for t, v in sorted((t, v or 0) for q, t, v in samples if q == k and t is not None):
            if now is None or t - now[2] >= 5.0:
                now = [k, t, t, 0, 0]
                want.append(now)
            now[2:] = [t, now[3] + 1, now[4] + v]
    found = temporal.sessions(spark.createDataFrame(samples, "k string, t double, v long"), ["k"], "t", 5.0, rows, {"total": "v"})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    assert temporal.sessions(spark.createDataFrame([], "k string, t double, v long"), ["k"], "t", 5.0, rows).count() == 0
