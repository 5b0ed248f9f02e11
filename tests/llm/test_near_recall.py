"""Recall of the near-duplicate stage in bands of similarity, against all pairs, and its candidates for any block size."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents
from tests.llm.test_dedup import sets_of
from vibrata.llm import simhash
from vibrata.llm.common import table

BANDS = (0.8, 0.85, 0.9, 0.95, 1.0)


def all_pairs(sets, least=0.8):
    """(i, j, similarity) of all pairs of sets of ``least`` or more, exactly: such sets share one of their rarest members."""
    often = Counter(x for s in sets for x in s)
    met = defaultdict(list)
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]:
            met[x].append(i)
    pairs = {(i, j) for rows in met.values() if len(rows) > 1 for k, i in enumerate(rows) for j in rows[k + 1 :] if least * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])) + 1e-9}
    shared = ((i, j, len(sets[i] & sets[j])) for i, j in pairs)
    return [(i, j, n / (len(sets[i]) + len(sets[j]) - n)) for i, j, n in shared if n >= least * (len(sets[i]) + len(sets[j]) - n) - 1e-9]


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def prints_of(spark, texts):
    rows = []
    for k, text in enumerate(texts):
        hashes = simhash.shingle_hashes(text.encode(), 5)
        rows.append((k, simhash.signed(simhash.majority([hashes])), len(hashes), *(int(x) for x in simhash.sketch(hashes).view(np.int64))))
    return spark.createDataFrame(rows, "row long, fp long, size long, s0 long, s1 long, s2 long, s3 long")


def connected(spark, texts, sets, block):
    """Roots of the texts by candidates that the sets confirm, in blocks of ``block`` rows."""
    found = simhash.candidate_links(prints_of(spark, texts), simhash.radius(0.8), 0.8, block).distinct().collect()
    alike = [(a, b) for a, b in map(tuple, found) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    return roots_of(len(texts), alike)


def shares(pairs, roots):
    """By band: pairs, and the share of them that is connected."""
    counts, hits = Counter(), Counter()
    for i, j, similarity in pairs:
        band = max(b for b in BANDS if b <= similarity + 1e-12)
        counts[band] += 1
        hits[band] += roots[i] == roots[j]
    return {b: (counts[b], hits[b] / counts[b]) for b in counts}


def edited(n=250, seed=4):
    """Texts of several lengths, each with copies that differ in a few words up to a similarity of about 0.8, and a group of many."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        length = rng.randrange(60, 400)
        words = [f"w{min(int(rng.expovariate(0.004)), 5000)}" for _ in range(length)]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for place in rng.sample(range(length), rng.randrange(max(length // 48, 2))):
                copy[place] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    base = [f"g{rng.randrange(900)}" for _ in range(200)]
    for _ in range(150):
        copy = list(base)
        for place in rng.sample(range(200), rng.randrange(1, 5)):
            copy[place] = f"y{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("made", [True, False])
def test_recall_in_every_band(spark, made):
    """On made-up texts, and on all documents of the middle test table."""
    if made:
        texts = edited()
    else:
        rows = table(spark, "/root/testdata/sf0.1", "documents").select("text").collect()
        texts = list({" ".join((r.text or "").lower().split()): r.text for r in rows if r.text}.values())
    sets = [sets_of(t) for t in texts]
    pairs = all_pairs(sets)
    blocks = (1 << 18, 200) if made else (1 << 18, 1500)
    found = [connected(spark, texts, sets, block) for block in blocks]
    told = [shares(pairs, roots) for roots in found]
    print(told)
    assert all(share >= 0.9 for by_band in told for _, share in by_band.values()), told
    # How the rows lie in blocks decides on a text of a hundred at most: on which links of dense groups the texts are asked.
    together = [{(i, j) for i, j, _ in pairs if roots[i] == roots[j]} for roots in found]
    assert len(together[0] ^ together[1]) <= 0.01 * len(pairs), told


def _grouped(roots):
    out = defaultdict(set)
    for i, r in enumerate(roots):
        out[r].add(i)
    return out.values()


def test_the_stage_keeps_one_of_each_group_that_the_candidates_connect(spark):
    texts = edited(60, 9)
    sets = [sets_of(t) for t in texts]
    kept = {r.doc_id for r in simhash.near_deduplicated(documents(spark, list(enumerate(texts)))).collect()}
    assert kept == {min(g) for g in _grouped(connected(spark, texts, sets, 1 << 18))}


def test_groups_of_the_stage_are_those_of_all_candidates(spark):
    """In dense groups at the edge of similarity, where the link with the nearest sketch often fails and another holds."""
    rng, texts = random.Random(12), []
    for g in range(4):
        base = [f"{g}g{i}" for i in range(160)]
        for _ in range(80):
            copy = list(base)
            for place in rng.sample(range(160), rng.randrange(1, 5)):
                copy[place] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    hashes = [simhash.shingle_hashes(t.encode(), 5) for t in texts]
    sets, fps = [set(h.tolist()) for h in hashes], np.array([simhash.majority([h]) for h in hashes], np.uint64)
    sketches, radius = np.stack([simhash.sketch(h) for h in hashes]), simhash.radius(0.8)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius) & simhash.agreeing(sketches[:, None], sketches[None])
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert max(Counter(x for link in links for x in link).values()) > simhash.DEGREE
    kept = {r.doc_id for r in simhash.near_deduplicated(documents(spark, list(enumerate(texts)))).collect()}
    assert kept == {min(g) for g in _grouped(roots_of(len(texts), links))}


def test_links_of_a_forest_connect_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    for nodes, n in ((1, 3), (5, 0), (40, 25), (300, 200), (300, 5000)):
        pairs = rng.integers(0, nodes, (n, 2)) * 7
        kept = simhash.spanning(pairs)
        roots, all_roots = (roots_of(7 * nodes, p) for p in (kept, pairs))
        assert {frozenset(g) for g in _grouped(roots)} == {frozenset(g) for g in _grouped(all_roots)}
        assert len(kept) == 7 * nodes - len(set(all_roots)) and set(map(tuple, kept.tolist())) <= set(map(tuple, pairs.tolist()))


def test_a_forest_of_circles_ends():
    """Trees whose first pairs as left ends run in a circle of three, or of many."""
    for n in (3, 4, 1000):
        circle = np.stack([np.arange(n), (np.arange(n) + 1) % n], 1)
        assert simhash.spanning(circle).tolist() == circle[:-1].tolist()
        assert simhash.spanning(circle, np.arange(n)[::-1]).tolist() == circle[:0:-1].tolist()


def unlike(n, seed=21, changed=10):
    """Texts of one base, nearly all of whose pairs are candidates though hardly any is as similar as 0.8."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        copy = [f"base{i}" for i in range(300)]
        for place in rng.sample(range(300), changed):
            copy[place] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


def test_rows_of_a_dense_group_without_links_stay_in_proportion(spark, monkeypatch):
    """What is shuffled for a dense group that sketches don't tell from alike is a few rows a text, and the result that of all pairs."""
    texts = unlike(240)
    sets, seen, written = [sets_of(t) for t in texts], [], simhash.written

    def watched(frame):
        out = written(frame)
        seen.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(simhash, "written", watched)
    monkeypatch.setattr(simhash, "DEGREE", 2)
    asked, similar_links = [], simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda links, *more: (asked.append(links.count()), similar_links(links, *more))[1])
    kept = {r.doc_id for r in simhash.near_deduplicated(documents(spark, list(enumerate(texts)))).collect()}
    links = [(i, j) for i, j, _ in all_pairs(sets)]
    pairs = simhash.candidate_links(prints_of(spark, texts), simhash.radius(0.8), 0.8).distinct().count()
    assert pairs > 10 * len(texts) > 0  # candidates: a square
    assert kept >= {min(g) for g in _grouped(roots_of(len(texts), links))}
    assert max(n for n, _ in seen) <= 8 * len(texts) and sum(asked) <= 8 * len(texts), (seen, asked, pairs)


@pytest.mark.parametrize("members,hashes", [(1 << 14, 1 << 21), (7, 1 << 21), (1 << 14, 3000)])
def test_classes_cut_in_blocks_of_any_size_give_the_same_links(spark, members, hashes):
    """Two classes, one with a root of many texts, against all candidates of each whose roots differ."""
    texts = unlike(40, 3, 5) + unlike(40, 4, 6)
    made = [simhash.shingle_hashes(t.encode(), 5) for t in texts]
    rows = [tuple(r) for r in prints_of(spark, texts).collect()]
    root = [0 if i < 20 else 40 if i in (41, 42) else i for i in range(80)]
    nodes = spark.createDataFrame([(i // 40 * 40, root[i], *rows[i]) for i in range(80)], "class long, root long, row long, fp long, size long, s0 long, s1 long, s2 long, s3 long")
    table = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = [tuple(r) for r in simhash.class_links(nodes, table, 5, simhash.radius(0.8), 0.8, members, hashes).collect()]
    sketches, fps = np.stack([simhash.sketch(h) for h in made]), np.array([r[1] for r in rows], np.int64).view(np.uint64)

    def candidate(i, j):
        return (int(fps[i]) ^ int(fps[j])).bit_count() <= simhash.radius(0.8) and bool(simhash.agreeing(sketches[i], sketches[j]))

    known = list(enumerate(root))
    want = [(i, j) for i in range(80) for j in range(i + 1, 80) if i // 40 == j // 40 and candidate(i, j) and simhash.similarity_of(made[i], made[j]) >= 0.8]
    assert all((i, j) in want and root[i] != root[j] for i, j in found) and found
    groups = [{frozenset(g) for g in _grouped(roots_of(80, known + pairs))} for pairs in (found, want)]
    assert groups[0] == groups[1]


def test_sketches_agree_with_similarity():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.3, 0.8, 0.9, 1.0):
        agreed = []
        for _ in range(200):
            n = int(rng.integers(20, 300))
            both = round(2 * n * share / (1 + share))  # shared members of two sets of n
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            agreed.append(bool(simhash.agreeing(simhash.sketch(np.unique(a)), simhash.sketch(np.unique(b)))))
        assert (np.mean(agreed) > 0.97) if share >= 0.8 else (np.mean(agreed) < 0.05), share
    assert simhash.agreeing(simhash.sketch(np.zeros(0, np.uint64)), simhash.sketch(np.zeros(0, np.uint64)))


def test_a_radius_holds_the_share_asked():
    rng = np.random.default_rng(6)
    angle = np.arccos(2 * 0.8 / 1.8) / np.pi
    for recall in (0.8, 0.95):
        tau = simhash.radius(0.8, recall)
        drawn = rng.binomial(64, angle, 200_000)
        assert (drawn <= tau).mean() >= recall > (drawn <= tau - 1).mean()
