import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SF, documents
from vibrata.llm import mixing, queries, sharding, topk


def test_sharding_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots, loads = defaultdict(list), Counter()
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 40
    assert max(loads.values()) - min(loads[s] for s in range(40)) < 0.1 * mean + max(r.size for r in got)
    again = queries.op4_sharding(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_sharding_of_odd_rows(spark, clashing):
    got = sharding.sharding(documents(spark, ODD, clashing)).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == sum(len((t or "").encode()) + 16 for _, t, *_ in ODD)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharding(documents(spark, [])).count() == 0


def test_rebalancing_moves_little_and_is_versioned(spark, tmp_path):
    loads = spark.range(64).select(F.col("id").cast("int").alias("v_slot"), F.when(F.col("id") % 4 == 0, 100).otherwise(10).alias("bytes"))
    first = sharding.first_map(spark, 64, 4)
    second = sharding.rebalanced(first, loads, 4).cache()
    total = second.join(loads, "v_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r.b for r in total) - min(r.b for r in total) <= 100 and {r.version for r in second.collect()} == {2}
    settled = sharding.rebalanced(second, loads, 4)
    kept = settled.alias("a").join(second.alias("b"), "v_slot").where("a.shard = b.shard").count()
    assert kept >= 56  # what is balanced stays
    path = str(tmp_path / "map")
    sharding.store_map(first, path)
    sharding.store_map(second, path)
    sharding.store_map(second, path)
    assert sharding.read_map(spark, path).select("version").distinct().collect()[0][0] == 2
    assert sharding.read_map(spark, path, 1).count() == 64 and spark.read.parquet(path).count() == 128
    fewer = sharding.rebalanced(second, loads, 3)
    assert {r.shard for r in fewer.select("shard").distinct().collect()} == {0, 1, 2}


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, []), (None, [1.0, 1.0]), (1, [3.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(table).collect()}
    vectors = [(0, (256, 512)), (50, (256, 512)), (1, (768, -256)), (1, (768, -256)), (2, (256, 512)), (7, ())]  # the repeated row is there twice
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip((256, 512), v)), i) for i, v in vectors if i != q)[:5]
        assert [got[q, k + 1] for k in range(len(want))] == [(i, -s) for s, i in want]
    assert topk.exact_top_k(table.limit(0)).count() == 0


def test_top_k_of_repeats_and_large_components_against_all_pairs(spark):
    """Repeated ids are rows of their own, and components of any size are multiplied exactly."""
    from fractions import Fraction

    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(9)]) for i in range(120)]
    rows += [(50, [draw.gauss(0, 1) for _ in range(9)]), (7, [9.0] * 9), (7, [9.0] * 9), (100, rows[100][1]), (3, rows[2][1])]
    rows += [(200, [1e9] * 9), (250, [3e5, -2.0**40] + [0.5] * 7), (300, [1e306] * 3), (301, [-1e306, 5.0]), (302, [2e18, 1.0, 1e-300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(table).collect()))
    for blocks in ({}, {"candidate_block": 7, "query_block": 2, "pilots": 5}, {"pilots": 0}):
        found = topk.top_k(table, F.col("vec_id") % 50 == 0, **blocks)
        assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect()) == got, blocks
    vectors = [(i, [int(Fraction(x) * 256 // 1) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in vectors if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for p, v in vectors if p == q for i, w in vectors if i != q)
        want += [(q, k + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for k, (s, i) in enumerate(scores[:5])]
    assert got == want


def test_top_k_blocks_agree_with_one_block(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = topk.top_k(table, F.col("vec_id") % 50 == 0).collect()
    parts = topk.top_k(table, F.col("vec_id") % 50 == 0, candidate_block=37, query_block=3).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_mixing_meets_targets(spark):
    got = queries.op10_mixing(spark, SF).collect()
    by_source = defaultdict(list)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by_source[r.source].append(r)
    for rows in by_source.values():
        assert sum(r["size"] for r in rows) == rows[0].source_size and rows[0].target <= 2 * rows[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows)
    assert abs(sum(rows[0].target for rows in by_source.values()) - 1.5 * sum(r["size"] for r in got)) < 1


@pytest.mark.parametrize("clashing", [False, True])
def test_mixing_of_odd_rows(spark, clashing):
    table = documents(spark, ODD, clashing)
    got = mixing.mixing(table).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r["size"] for r in got)
    taken = mixing.mixed_documents(table)
    assert taken.columns == table.columns
    assert mixing.mixing(documents(spark, [])).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], 10) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    got = mixing.mix(table, F.col("sources"), F.col("size"), ["doc_id"], weights={"a": 1.0, "b": 3.0}, share=1.0).collect()
    taken = Counter()
    for r in got:
        taken[tuple(r["__members"])] += r["__copies"] * r["__size"]
    goal = {s.source: s.target for r in got for s in r["__sources"]}
    assert abs(sum(taken.values()) - sum(goal.values())) <= 30
    assert taken[("a",)] <= goal["a"] + 10 and goal["b"] >= goal["a"]
    # Convex costs: nothing is repeated while something that could serve is left out.
    assert max(r["__copies"] for r in got if "b" in r["__members"]) - min(r["__copies"] for r in got if r["__members"] == ["b"]) <= 1


def test_routes_are_cheapest_against_brute_force():
    """All ways to send small patterns to quotas: as much as possible, and of that the fewest repeated words."""
    import itertools

    draw = random.Random(8)
    for _ in range(60):
        patterns = {i: (draw.randrange(0, 4), draw.sample(["a", "b", "c"], draw.randrange(1, 4))) for i in range(3)}
        quotas = {s: draw.randrange(0, 7) for s in "abc"}
        got = mixing.route(patterns, quotas, 2)
        sent, used = Counter(), Counter()
        for (p, s), words in got.items():
            assert s in patterns[p][1] and words > 0
            sent[p] += words
            used[s] += words
        assert all(sent[p] <= 2 * patterns[p][0] for p in patterns) and all(used[s] <= quotas[s] for s in quotas)
        best = max(_reached(patterns, quotas, amounts) for amounts in itertools.product(*(range(2 * n + 1) for n, _ in patterns.values())))
        assert (sum(sent.values()), -sum(max(sent[p] - patterns[p][0], 0) for p in patterns)) == best


def _reached(patterns, quotas, amounts):
    """(words, minus the repeated ones) if these amounts fit the quotas, by Hall's condition over sets of sources."""
    import itertools

    for k in range(1, 4):
        for some in itertools.combinations("abc", k):
            if sum(n for n, (_, sources) in zip(amounts, patterns.values()) if set(sources) <= set(some)) > sum(quotas[s] for s in some):
                return (-1, 0)
    return sum(amounts), -sum(max(n - size, 0) for n, (size, _) in zip(amounts, patterns.values()))


def test_many_patterns_are_routed():

    draw = random.Random(1)
    patterns = {i: (draw.randrange(1, 1000), draw.sample(range(50), 3)) for i in range(20_000)}
    patterns = {i: (n, [str(s) for s in ss]) for i, (n, ss) in patterns.items()}
    quotas = {str(s): 200_000 + 5_000 * s for s in range(50)}
    got = mixing.route(patterns, quotas, 2)
    used = Counter()
    for (_, s), words in got.items():
        used[s] += words
    assert all(used[s] <= quotas[s] for s in quotas)
    assert sum(used.values()) == min(sum(quotas.values()), 2 * sum(n for n, _ in patterns.values()))


@pytest.mark.parametrize("operator", ["mixing", "mixed_documents"])
def test_mixing_of_columns_named_like_its_own(spark, operator):
    table = documents(spark, ODD)
    for name in ("__size", "__members", "__order", "__bucket", "row"):
        table = table.withColumn(name, F.lit("clash"))
    got = getattr(mixing, operator)(table)
    assert got.columns == (table.columns if operator == "mixed_documents" else ["doc_id", "size", "source_size", "target", "taken", "source"])
    assert operator == "mixing" or all(r["__size"] == "clash" for r in got.collect())


def test_repeated_rows_are_spread_over_shards(spark):
    rows = [(7, "the same text")] * 4000 + [(None, "no id")] * 400 + [(i, f"text {i}") for i in range(200)]
    got = sharding.sharding(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(loads.values()) - min(loads[s] for s in range(40)) < 0.05 * sum(loads.values()) / 40 + 64
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 8)
    table = spark.createDataFrame([(1, 2)] * 50 + [(3, 4)] * 3 + [(5, 6)] * 8 + [(7, 8)], "a int, b int")
    got = sorted(map(tuple, sharding.numbered_copies(table, ["a", "b"], "c").collect()))
    assert got == sorted([(1, 2, i) for i in range(50)] + [(3, 4, i) for i in range(3)] + [(5, 6, i) for i in range(8)] + [(7, 8, 0)])


def test_a_stored_map_is_edited_and_not_made_anew(spark, tmp_path):
    path, rows = str(tmp_path / "map"), [(i, f"text {i} " * (1 + i % 50)) for i in range(2000)]
    first = {r.doc_id: r for r in sharding.sharded(documents(spark, rows), shards=8, map_path=path).collect()}
    again = {r.doc_id: r for r in sharding.sharded(documents(spark, rows), shards=8, map_path=path).collect()}
    assert {r.version for r in first.values()} == {2} and {r.version for r in again.values()} == {3}
    assert sum(first[d].shard != again[d].shard for d in first) < 0.1 * len(rows)
    more = {r.doc_id: r for r in sharding.sharded(documents(spark, rows), shards=9, map_path=path).collect()}
    assert {r.shard for r in more.values()} == set(range(9))
    moved = sum(more[d].size for d in more if more[d].shard != again[d].shard)  # a ninth must move
    assert moved < 0.2 * sum(r.size for r in more.values())
    assert all(again[d].v_slot == more[d].v_slot for d in more)


def plain_rebalanced(shard_of, loads, shards):
    """The rule of rebalancing in plain Python: what fits into the mean stays, the rest goes to the least loaded."""
    mean = sum(loads.values()) / shards
    out, load, moving = {}, Counter({s: 0 for s in range(shards)}), []
    for shard in sorted(set(shard_of.values())):
        running = 0
        for slot in sorted((s for s in shard_of if shard_of[s] == shard), key=lambda s: (-loads.get(s, 0), s)):
            running += loads.get(slot, 0)
            if shard < shards and running <= mean:
                out[slot] = shard
                load[shard] += loads.get(slot, 0)
            else:
                moving.append(slot)
    for slot in sorted(moving, key=lambda s: (-loads.get(s, 0), s)):
        least = min(load, key=lambda s: (load[s], s))
        out[slot] = least
        load[least] += loads.get(slot, 0)
    return out


def test_rebalancing_against_the_plain_rule(spark):

    draw = random.Random(2)
    loads = {s: draw.randrange(1, 500) for s in range(128) if draw.random() < 0.8}
    table = spark.createDataFrame(sorted(loads.items()), "v_slot int, bytes long")
    now = sharding.first_map(spark, 128, 6)
    shard_of = {s: s % 6 for s in range(128)}
    for shards in (6, 5, 7):
        now, shard_of = spark.createDataFrame(sharding.rebalanced(now, table, shards).collect()), plain_rebalanced(shard_of, loads, shards)
        assert {r.v_slot: r.shard for r in now.collect()} == shard_of


def cancelling(rng, q, score):
    """Whole numbers below 2^31 whose products with q = (a, b, 2^29, 1), of 58 bits each, add up to ``score``."""
    x, y = (rng.randrange(2**27, 2**28) for _ in "xy")
    part, rest = divmod(q[0] * x + q[1] * y, 2**29)
    return [x, y, -part, score - rest]


def test_top_k_of_sums_that_rounding_lifts(spark):
    """First bounds are floating-point sums; candidates whose terms cancel must not fall below them."""
    rng = random.Random(7)
    for seed in range(3):
        q = [rng.randrange(2**28, 2**29) | 1, rng.randrange(2**28, 2**29) | 1, 2**29, 1]
        rows = [(0, q)] + [(i, cancelling(rng, q, 9)) for i in range(1, 7)] + [(i, cancelling(rng, q, 12)) for i in range(7, 13)]
        table = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        found = topk.exact_top_k(table).where("query_id = 0").orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in found] == [(i, 12) for i in range(7, 12)], seed


def test_top_k_splits_wide_vectors_off(spark):
    """A few components beyond all longs among ordinary ones: whole numbers decide, also between the two kinds."""
    rng = random.Random(3)
    size = lambda i: 2**70 if i % 37 == 0 else 2**33 if i % 11 == 0 else 300
    rows = [(i, [rng.randrange(-size(i), size(i)) for _ in range(6)]) for i in range(250)]
    table = spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    exact = {i: [int(float(x)) for x in v] for i, v in rows}
    clamp = lambda x: max(min(x, 2**63 - 1), -(2**63))
    want = []
    for i in range(0, 250, 50):
        scores = sorted((-sum(a * b for a, b in zip(exact[i], v, strict=True)), j) for j, v in exact.items() if j != i)[:5]
        want += [(i, rank, j, clamp(-s)) for rank, (s, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, topk.exact_top_k(table).collect())) == want
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0, candidate_block=30, query_block=2).collect())) == want
