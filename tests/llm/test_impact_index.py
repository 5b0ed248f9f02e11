"""Ranked search against plain scores of all documents, and the bit-sliced arithmetic against whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import ODD, SMALL, documents
from tests.oracle import compared, connection
from vibrata.llm import impact_index
from vibrata.llm.common import table


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(rows, items, k=20):
    docs = [(r[0], Counter(terms_of(r[1]))) for r in rows if terms_of(r[1])]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in terms.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.mark.parametrize(("seed", "per_block", "most"), [(0, 1 << 12, 1 << 18), (1, 3, 1 << 18), (2, 70, 4)])
def test_ranks_are_those_of_all_scores(spark, seed, per_block, most):
    """Ties at the twentieth place, repeated terms, blocks of a few documents, and an index of all terms in several rounds."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Ñandú", "漢字", "X9"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(words[min(int(rng.expovariate(0.15)), 32)] for _ in range(n))
    rows = [(k, text(rng.choice([0, 1, 2, 5, 40]))) for k in range(150)]
    rows += [(1000 + k, "w1 w2 w3") for k in range(40)]  # ties
    items = [(k, text(rng.choice([1, 3, 20]))) for k in range(15)] + [(3, text(4)), (90, "w1 " * 13 + "w2"), (91, "unheard of"), (92, None), (None, "w3 w4")]
    found = impact_index.ranked(documents(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20, per_block, most)
    assert rows_of(found) == plain(rows, items)


def test_odd_rows_repeats_and_clashing_columns(spark):
    items = [(1, "a b c lorem"), (2, "größe 漢字 id"), (3, "x" * 100_000), (4, "word WORD")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    assert rows_of(impact_index.ranked_lexical_search(documents(spark, ODD, clashing=True), asked)) == plain(ODD, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert impact_index.ranked_lexical_search(documents(spark, [(1, "a")]), none).count() == 0
    assert impact_index.ranked_lexical_search(documents(spark, []), spark.createDataFrame([(1, "a")], none.schema)).count() == 0
    assert impact_index.ranked_lexical_search(documents(spark, [(1, None), (2, " ")]), spark.createDataFrame([(1, "a")], none.schema)).count() == 0


def packed(numbers, bits):
    """(bits, words) slices of whole numbers."""
    rows = [np.packbits(np.pad([n >> b & 1 for n in numbers], (0, -len(numbers) % 64)), bitorder="little").view(np.uint64) for b in range(bits)]
    return np.array(rows)


def test_carry_arithmetic_equals_whole_numbers():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**20, 130), rng.integers(0, 2**12, 130)
    sums = packed(a, 30)[:, None, :].copy()
    impact_index.add(sums, packed(b, 12)[:, None, :], 5)
    assert np.array_equal(impact_index.values(sums[:, 0], np.arange(130)), a + (b << 5))
    weight = rng.integers(0, 2**15, 3)  # one for each word of 64 numbers
    product = impact_index.weighted(packed(a, 20), weight)
    assert np.array_equal(impact_index.values(product, np.arange(130)), a * weight[np.arange(130) // 64])


def test_descending_slices_finds_the_best_with_ties_to_lower_places():
    rng = np.random.default_rng(5)
    for high, k in ((3, 20), (2**30, 7), (2, 1), (1, 5)):
        numbers = [rng.integers(0, high, 200) for _ in range(3)]
        sums = np.stack([packed(x, 31) for x in numbers], 1)
        for x, places in zip(numbers, impact_index.best_places(sums, k), strict=True):
            want = sorted((-v, i) for i, v in enumerate(x) if v > 0)[:k]
            assert sorted(places) == sorted(i for _, i in want)


def test_the_index_holds_every_document_and_impact(spark):
    rows = [(k, "a b " * (k % 5) + "c") for k in range(300)]
    index, n, total = impact_index.build(documents(spark, rows), per_block=100)
    assert (n, total) == (300, sum(len(terms_of(t)) for _, t in rows))
    for row in index.collect():
        assert list(row.doc_ids) == sorted(row.doc_ids)
        slices, words = impact_index.unpacked(row["slices"], row.bits), np.frombuffer(row.words, np.int32)
        for i, term in enumerate(row["terms"]):
            lo, hi = row["columns"][i], row["columns"][i + 1]
            dense = np.zeros((row.bits, -(-len(row.doc_ids) // 64)), np.uint64)
            dense[:, words[lo:hi]] = slices[:, lo:hi]
            have = impact_index.values(dense, np.arange(len(row.doc_ids)))
            for doc, impact in zip(row.doc_ids, have, strict=True):
                c = Counter(terms_of(rows[doc][1]))
                m = 75 + (25 * sum(c.values()) * n) // total
                assert impact == ((10**9 * c[term]) // (1000 * c[term] + 12 * m) if c[term] else 0)


def test_sql_agrees(spark):
    found = impact_index.ranked_lexical_search(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"))
    rows, wrong = compared(found, connection(SMALL), impact_index.SQL)
    assert rows and not wrong
