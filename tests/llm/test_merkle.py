"""The Merkle manifest against trees built whole, and its fragments as a monoid."""

import random
import zlib
from hashlib import sha256
from itertools import groupby

from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SMALL, documents
from tests.oracle import compared, connection
from vibrata.llm import merkle
from vibrata.llm.common import table


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def record(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        run = at // 3 * 3
        path.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return path


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: h(*map(record, (*r[:4], text)))
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    sources = {s: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s, own in groupby(sorted(rows, key=key), key)}
    trees = {s: levels_of([leaf(r, r[4]) for r in own]) for s, own in sources.items()}
    top = levels_of([t[-1][0] for t in trees.values()])
    out = []
    for k, (s, own) in enumerate(sources.items()):
        for at, r in enumerate(own):
            path = path_of(trees[s], at) + path_of(top, k)
            cut = r[4] is not None and zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 2 == 0
            back = leaf(r, r[4].replace("\n", "") if cut else r[4])
            for left, right in path:
                back = h(*left, back, *right)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in (*a, *b))), back, back == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").select("doc_id", "text", "lang", "source", "n_chars")


def rows_of(found):
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def made(n, seed=1, sources=("a", "b", "é", "", None)):
    """A third and more of the rows in one source."""
    rng = random.Random(seed)
    return [(k, "hot" if rng.random() < 0.4 else rng.choice(sources), "en", rng.randrange(9), rng.choice(["one\ntwo", "three", "\n", ""])) for k in rng.sample(range(10 * n), n)]


def test_trees_equal_those_built_whole_whatever_the_parts(spark):
    rows = made(333)
    want = plain(rows)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    for per_part, fan in ((merkle.LEAVES, merkle.FAN), (11, 2)):
        found = merkle.manifest(frame(spark, rows).repartition(5), text, merkle.id_remainder("doc_id", 2) == 0, per_part, fan)
        assert rows_of(found) == want


def test_odd_rows_repeats_and_many_sources(spark):
    rows = [(r[0], r[3] if len(r) > 3 else "src", "en", None, r[1]) for r in ODD]
    rows += [(5, "same", None, 1, "x\n")] * 40 + [(2**60 + k, f"s{k}", "de", 2, None) for k in range(30)] + [(None, None, None, None, None)] * 2
    extra = frame(spark, rows).select("*", *(F.lit("clash").alias(c) for c in ("tree", "leaf", "part", "at", "level", "hash", "total", "__tie")))
    assert rows_of(merkle.merkle_manifest(extra)) == plain(rows)
    small = merkle.manifest(extra, F.replace(F.col("text"), F.lit("\n"), F.lit("")), merkle.id_remainder("doc_id", 2) == 0, 4, 3)
    assert rows_of(small) == plain(rows)


def test_an_empty_table_and_a_lone_row(spark):
    assert merkle.merkle_manifest(documents(spark, [])).count() == 0
    (row,) = merkle.merkle_manifest(frame(spark, [(3, "a", "en", 1, "t")])).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("") and row.verified


def test_fragments_merge_in_any_order_to_the_same_root():
    rng = random.Random(4)
    for n in (1, 2, 3, 4, 10, 27, 28, 100):
        leaves = [h(str(k)) for k in range(n)]
        want = levels_of(leaves)
        pieces = [{(0, k): leaves[k]} for k in range(n)]
        while len(pieces) > 1:
            a, b = pieces.pop(rng.randrange(len(pieces))), pieces.pop(rng.randrange(len(pieces)))
            both = a | b
            new, unresolved = merkle.grown(both, n)
            both |= new
            top = (len(want) - 1, 0)
            pieces.append({k: x for k, x in both.items() if k in unresolved or k == top})
        assert pieces[0] == {(len(want) - 1, 0): want[-1][0]}
        assert merkle.level_sizes(n) == [len(x) for x in want]


def test_a_fragment_of_neighbours_holds_a_few_nodes_a_level():
    nodes = {(0, k): h(str(k)) for k in range(1000, 9000)}
    _, unresolved = merkle.grown(nodes, 1_000_000)
    assert len(unresolved) <= 2 * (merkle.ARITY - 1) * len(merkle.level_sizes(8000))


def test_sql_agrees(spark):
    rows, wrong = compared(merkle.merkle_manifest(table(spark, SMALL, "documents")), connection(SMALL), merkle.SQL)
    assert rows and not wrong
