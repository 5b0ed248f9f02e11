import hashlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SF, documents
from tests.oracle import compared, connection
from vibrata.llm import components, exact_dedup, queries, simhash


@pytest.mark.parametrize("name", ["op3_exact_top_k", "op8_exact_dedup", "op10_mixing"])
def test_oracle(spark, name):
    rows, wrong = compared(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLE_SQL[name])
    assert rows and not wrong


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_dedup_of_odd_rows(spark, clashing):
    got = exact_dedup.exact_dedup(documents(spark, ODD, clashing)).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[text or ""].append(doc_id)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    table = documents(spark, ODD, True)
    kept = exact_dedup.deduplicated(table)
    assert kept.columns == table.columns
    assert kept.count() == len({t or "" for _, t, *_ in ODD})
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_chunks_restore_texts(spark):
    table = documents(spark, [(i, t) for i, (_, t, *_) in enumerate(ODD)]).repartition(3)
    key = exact_dedup.verified_key(table)
    store = exact_dedup.chunk_store(table, key)
    recipes = table.select("doc_id", exact_dedup.recipe(F.coalesce("text", F.lit("")), key).alias("recipe"))
    back = {r.doc_id: r.text for r in exact_dedup.restore(recipes, store).collect()}
    assert back == {i: t or "" for i, (_, t, *_) in enumerate(ODD)}
    # Copies of a long text share their chunks.
    assert store.where("uses > 1").count() > 0


def test_colliding_identifiers_are_refused(spark):
    table = documents(spark, [(1, "one"), (2, "two")])
    same = lambda c: F.lit("same")
    right = exact_dedup.KEYS[0]
    assert exact_dedup.verified_key(table, keys=(same, right)) is right
    with pytest.raises(ValueError):
        exact_dedup.verified_key(table, keys=(same,))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint) -> least reachable id by position, over all pairs of distinct fingerprints."""
    distinct = sorted({f for _, f in rows})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in rows]


def by_row(x):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)


def test_simhash_against_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in table.select("doc_id", "text").collect()])
    got = [tuple(r) for r in queries.op9_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=by_row) == sorted(want, key=by_row)
    assert len({c for _, _, c in want}) < len(want)


@pytest.mark.parametrize("clashing", [False, True])
def test_simhash_of_odd_rows(spark, clashing):
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in ODD])
    table = documents(spark, ODD, clashing)
    got = [tuple(r) for r in simhash.simhash_near_dedup(table).collect()]
    assert sorted(got, key=by_row) == sorted(want, key=by_row)
    assert simhash.simhash_near_dedup(documents(spark, [])).count() == 0


def test_simhash_plans_cover_all_bits():
    import numpy as np

    rng = np.random.default_rng(1)
    fps = rng.integers(-(1 << 63), 1 << 63, 600, dtype=np.int64)
    for n in (10, 10_000, 10**9):
        parts = simhash.plan(fps, 4, n)
        assert sum(t + 1 for _, t in parts) == 5
        bits = [b for p, _ in parts for b in p]
        assert len(bits) == len(set(bits))


def test_large_buckets_in_tiles_find_the_same_components(spark):
    """Many fingerprints in one bucket, dealt over tiles of 8 rows."""
    import random

    random.seed(3)
    base = 0x0123456789ABCDEF
    fps = {base ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(20)) for _ in range(150)}
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    import numpy as np

    parts = simhash.plan(np.array([simhash.signed(f) for f in fps], np.int64), 4, len(fps))
    found = components.components(simhash.links(table, 4, parts, block=8), "a", "b")
    roots = {r.node & (1 << 64) - 1: r.root for r in found.collect()}
    want = defaultdict(set)
    for _, f, c in plain_components([(i, f) for i, f in enumerate(sorted(fps))]):
        want[c].add(int(f, 16))
    got = defaultdict(set)
    for f in fps:
        got[roots.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (100, 101)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similar_components(rows):
    """(doc_id, text) -> lists of the places of rows that similarities of 0.8 or more connect, over all pairs."""
    sets, root = [sets_of(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[:k]:
            a, b = sets[i], sets[j]
            if len(b) >= 0.8 * len(a) and (a == b or a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return list(groups.values())


def varied(n=60, length=120, seed=5):
    """Texts and copies of each with single words changed, from very alike to not alike."""
    import random

    draw = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{draw.randrange(5000)}" for _ in range(length)]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 6):
            changed = list(words)
            for place in draw.sample(range(length), c):
                changed[place] = f"x{draw.randrange(5000)}"
            rows.append((10 * k + c, " ".join(changed)))
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = varied()
    kept = {r.doc_id for r in simhash.near_deduplicated(documents(spark, rows)).collect()}
    groups = [{rows[i][0] for i in g} for g in similar_components(rows)]
    # Of texts whose similarity is exactly decided none is lost wrongly, and few groups keep a second one.
    assert all(g & kept for g in groups) and len(kept) - len(groups) < 0.1 * len(rows)
    assert sum(min(g) in kept for g in groups) == len(groups)


@pytest.mark.parametrize("clashing", [False, True])
def test_near_deduplication_of_odd_rows(spark, clashing):
    table = documents(spark, ODD, clashing)
    if clashing:
        table = table.withColumn("__row", F.lit("x")).withColumn("fp", F.lit(1.5)).withColumn("raw_text", F.lit(None).cast("string"))
    kept = simhash.near_deduplicated(table)
    got = kept.collect()
    groups = similar_components(ODD)
    assert kept.columns == table.columns and len(got) == len(groups)
    want = {min((ODD[i][0] for i in g if ODD[i][0] is not None), default=None) for g in groups}
    assert {r.doc_id for r in got} == want
    if clashing:
        assert all(r["__row"] == "x" and r.fp == 1.5 and r["row"] == "clash" for r in got)
    assert simhash.near_deduplicated(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block,similarity", [(40, 0.0), (1 << 18, 0.0), (7, 0.8), (40, 0.8), (1 << 18, 0.8)])
def test_blocks_of_any_size_find_the_same_links(spark, block, similarity):
    """Texts of several lengths, two of them frequent, against all pairs at 12 bits whose sizes allow the similarity."""
    rows, sets = varied(20) + varied(20, 130, 6) + varied(12, 300, 7), {}
    for _, text in rows:
        hashes = simhash.shingle_hashes(text.encode(), 5)
        sets[simhash.majority([hashes]), len(hashes)] = len(sets)
    nodes = sorted(sets)
    table = spark.createDataFrame([(k, simhash.signed(fp), size) for k, (fp, size) in enumerate(nodes)], "row long, fp long, size long")
    roots = list(range(len(nodes)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    def linked(x, y):
        (a, m), (b, n) = nodes[x], nodes[y]
        return (a ^ b).bit_count() <= 12 and min(m, n) >= similarity * max(m, n)

    for x in range(len(nodes)):
        for y in range(x):
            if linked(x, y):
                roots[find(x)] = find(y)
    want, got = defaultdict(set), defaultdict(set)
    found = simhash.candidate_links(table, 12, similarity, block)
    pairs = [tuple(r) for r in found.distinct().collect()]
    assert pairs and all(x < y and linked(x, y) for x, y in pairs)
    named = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    for x in range(len(nodes)):
        want[find(x)].add(x)
        got[named.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forests_are_the_lightest():
    """The sorted weights of the edges are those that taking all allowed edges by rising weight gives."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n, similarity in ((0, 0.8), (1, 0.8), (40, 0.0), (40, 0.8), (90, 0.8)):
        fps = np.full(n, 77, np.uint64)
        for _ in range(9):
            fps ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        sizes = rng.integers(80, 130, n)
        pairs = sorted((int(fps[i] ^ fps[j]).bit_count(), i, j) for i in range(n) for j in range(i) if min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]))
        tree, want = list(range(n)), []
        for weight, i, j in pairs:
            if weight <= 12 and tree[i] != tree[j]:
                want.append(weight)
                tree = [tree[j] if t == tree[i] else t for t in tree]
        edges = simhash.lightest_forest(fps, sizes, 12, similarity)
        assert sorted(int(fps[i] ^ fps[j]).bit_count() for i, j in edges) == want
        assert all(min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]) for i, j in edges)


@pytest.mark.parametrize("operator", [exact_dedup.deduplicated, simhash.near_deduplicated])
def test_rows_that_come_out_of_a_shuffle(spark, operator):
    """The same documents stay however they come and whichever columns are read."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r.doc_id for r in operator(table).collect())
    for k in (3, 7):
        mixed = table.repartition(k).withColumn("noise", F.rand()).sort("noise").drop("noise")
        found = operator(mixed)
        assert found.count() == len(want) and sorted(r.doc_id for r in found.select("doc_id").collect()) == want
        assert sorted(r.doc_id for r in found.collect()) == want


@pytest.mark.parametrize("kind", ["lines", "words", "code", "characters", "sentences"])
def test_an_inserted_character_changes_the_chunks_about_it_alone(spark, kind):
    """Texts without stops too: lines that begin with a letter, one long line, and letters without white space."""
    import random

    rng = random.Random(kind)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9)))
    joined = {"lines": lambda: f"{word()} {word()} {word()}\n", "words": lambda: f"{word()} ", "code": lambda: f"{word()}={word()};\n", "characters": lambda: rng.choice("漢字仮名交文中日月火水木金土")}
    text = "".join(joined.get(kind, lambda: f"{word()} {word()}. ")() for _ in range({"characters": 60_000}.get(kind, 6000)))
    at = len(text) // 3
    rows = [(0, text), (1, "!" + text), (2, text[:at] + "!" + text[at:]), (3, text[:at] + "a longer passage in between " * 9 + text[at:])]
    found = {r.doc_id: r.c for r in documents(spark, rows).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    assert all("".join(found[i]) == t for i, t in rows) and max(map(len, found[0])) <= exact_dedup.LONGEST
    assert len(found[0]) > 20
    for i in (1, 2):
        assert len(set(found[0]) & set(found[i])) > 0.9 * len(set(found[0])), (kind, i)
    # Behind a long insertion, a third into the text, texts fall into step again.
    assert len(set(found[0]) & set(found[3])) > 0.6 * len(set(found[0])), (kind, len(set(found[0]) & set(found[3])), len(set(found[0])))
