"""Decontamination against a plain search of windows."""

import hashlib
import random
import re

import pytest

from tests.llm.helpers import ODD, SMALL, documents
from tests.oracle import compared, connection
from vibrata.llm import decontamination
from vibrata.llm.common import table

ITEM = "item_id long, text string"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(rows, items, window=10):
    wanted = [(i, w, min(len(w), window)) for i, w in ((i, plain_words(t)) for i, t in items) if w]
    out = []
    for row in rows:
        words = plain_words(row[1])
        hit, named = set(), set()
        for item, w, k in wanted:
            theirs = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)}
            for p in range(len(words) - k + 1):
                if tuple(words[p : p + k]) in theirs:
                    hit |= set(range(p, p + k))
                    named.add(item)
        ids = sorted(str(i) for i in named if i is not None)
        out.append((row[0], len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_it_finds_what_a_plain_search_finds(spark, seed):
    """Few different words, so k-grams repeat, windows tie and periodic passages occur."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "ñ", "c3", "Äb"][: 2 + seed])
    text = lambda n: rng.choice([" ", ", ", "--"]).join(word() for _ in range(n))
    items = [(k, text(rng.choice([0, 3, 9, 10, 11, 25]))) for k in range(12)] + [(3, text(14)), (None, text(12)), (50, None), (51, ".;!")]
    rows = [(k, text(rng.randrange(60))) for k in range(40)] + [(100 + k, f"{text(5)} {t} {text(4)}") for k, (_, t) in enumerate(items) if t]
    found = decontamination.decontamination(documents(spark, rows), spark.createDataFrame(items, ITEM))
    assert rows_of(found) == plain(rows, items)


def test_windows_of_any_length_and_several_rounds(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items, rows = [(k, text(k + 1)) for k in range(4, 12)], [(k, text(80)) for k in range(30)]
    whole = decontamination.contamination(documents(spark, rows), spark.createDataFrame(items, ITEM), window=7)
    parts = decontamination.contamination(documents(spark, rows), spark.createDataFrame(items, ITEM), window=7, most=20)
    got = sorted((r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in whole.collect())
    assert got == sorted((r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in parts.collect())
    want = {r[0]: r[2] for r in plain(rows, items, 7)}
    assert {d: n for d, n, _, _ in got} == want
    # Spans are places of words: each is at least as long as the shortest window, and together they hold the hits.
    for _, n, _, spans in got:
        assert len(set().union(*(range(a, b + 1) for a, b in spans))) == n


def test_odd_rows_repeats_and_clashing_columns(spark):
    items = [(1, "a b c d e f g"), (1, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem"), (2, "no id here"), (None, "WORD"), (3, None)]
    found = decontamination.decontamination(documents(spark, ODD, clashing=True), spark.createDataFrame([(i, t, "x") for i, t in items], f"{ITEM}, mark string"))
    assert rows_of(found) == plain(ODD, items)


def test_empty_tables(spark):
    docs, none = documents(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], ITEM)
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontamination.decontamination(docs, none).orderBy("doc_id").collect()] == [(2, 0, False), (0, 0, False)]
    assert decontamination.decontamination(documents(spark, []), spark.createDataFrame([(1, "a b")], ITEM)).count() == 0


def test_a_document_with_many_copies_of_an_item(spark):
    """Each window meets the same item place; the spans run into each other where copies join."""
    item = " ".join(f"w{k}" for k in range(15))
    found = decontamination.contamination(documents(spark, [(1, f"{item} " * 300), (2, f"{item} gap " * 50)]), spark.createDataFrame([(7, item)], ITEM))
    assert [(r.n_words, r.n_hit, r["items"]) for r in found.orderBy("doc_id").collect()] == [(4500, 4500, ["7"]), (800, 750, ["7"])]


def test_sql_agrees(spark):
    found = decontamination.decontamination(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"))
    rows, wrong = compared(found, connection(SMALL), decontamination.SQL)
    assert rows and not wrong
