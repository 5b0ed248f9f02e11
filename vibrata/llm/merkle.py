"""A Merkle manifest of a dataset: trees of arity 3 over the rows of each source, and one over the sources' roots.

A fragment is a sparse forest: the nodes of a tree, keyed by level and index, whose run of siblings is not complete in the
rows at hand. Two fragments are merged by putting their nodes together and replacing every run that is now complete by its
parent, as often as that happens; as the sizes of all levels follow from the number of leaves, a short last run is known
to be complete too. This is associative and commutative, so partitions make fragments of their own leaves and a tree of
merges brings them together; a fragment of neighbouring leaves holds a few nodes a level, whatever its number of leaves.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.llm.common import id_remainder
from vibrata.operators.joins import looked_up
from vibrata.sources.scratch import written

ARITY = 3
LEAVES, FAN = 1 << 14, 8  # leaves of a partition, about, and fragments that one task merges
LEVELS = 34  # more levels than any tree has
TAMPER = 2  # texts are tampered with where this divides the id's crc32


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def level_sizes(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the single root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def grown(nodes: dict[tuple[int, int], str], leaves: int) -> tuple[dict[tuple[int, int], str], set[tuple[int, int]]]:
    """The parents that the nodes' complete runs have, level by level, and the keys of all nodes whose run is incomplete."""
    sizes, by_level, made, unresolved = level_sizes(leaves), {}, {}, set()
    for level, at in nodes:
        by_level.setdefault(level, set()).add(at)
    known = dict(nodes)
    for level, size in enumerate(sizes[:-1]):
        for run in {at // ARITY for at in by_level.get(level, ())}:
            keys = [(level, at) for at in range(run * ARITY, min((run + 1) * ARITY, size))]
            here = [key for key in keys if key in known]
            if len(here) < len(keys):
                unresolved.update(here)
            elif (level + 1, run) not in known:
                known[level + 1, run] = made[level + 1, run] = digest([known[key] for key in keys])
                by_level.setdefault(level + 1, set()).add(run)
    return made, unresolved


def siblings(nodes: dict[tuple[int, int], str], level: int, at: int, sizes: list[int]) -> tuple[list[str], list[str]]:
    """Digests of the run's other nodes, left and right of a node."""
    first = at // ARITY * ARITY
    return [nodes[level, i] for i in range(first, at)], [nodes[level, i] for i in range(at + 1, min(first + ARITY, sizes[level]))]


def numbered(leaves: DataFrame, per_part: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (tree, ..., leaf), which must be written, in range partitions: with ``part`` and ``at``, and segments.

    Segments are (part, tree, start, count, total): the leaves of a tree in a part, the number of those before them and of
    the tree's. Columns between tree and leaf order the leaves of a tree, nulls first, then the leaf itself; rows that
    are alike altogether are dealt to neighbouring parts by the place where they were read.
    """
    parts = -(-leaves.count() // per_part) or 1
    order = [F.asc_nulls_first(f"`{c}`") for c in (*leaves.columns[: leaves.columns.index("leaf") + 1], "__tie")]
    dealt = leaves.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("__tie"))
    counts = rows.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("count"))
    # A row for each part and one more for each tree.
    before = F.sum("count").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("count").over(Window.partitionBy("tree"))
    return rows, written(counts.select("part", "tree", F.coalesce(before, F.lit(0)).alias("start"), "count", whole.alias("total")))


def segment_leaves(leaves: pd.DataFrame, segments: pd.DataFrame):
    """(tree, start, total, rows) of each segment of a part, rows in order."""
    leaves = leaves.sort_values("at", kind="stable")
    named = {s.tree: s for s in segments.itertuples()}
    for tree, rows in leaves.groupby("tree", sort=False):
        yield tree, int(named[tree].start), int(named[tree].total), rows


def fragments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(part, tree, total, level, at, hash, open) of the nodes that a part's leaves leave unresolved, and of the trees' roots in it."""

    def local(leaves: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, start, total, own in segment_leaves(leaves, known):
            nodes = {(0, start + i): h for i, h in enumerate(own["leaf"])}
            made, unresolved = grown(nodes, total)
            nodes |= made
            root = (len(level_sizes(total)) - 1, 0)
            out += [(own["part"].iloc[0], tree, total, *key, nodes[key], True) for key in sorted(unresolved)]
            out += [(own["part"].iloc[0], tree, total, *root, nodes[root], False)] if root in nodes else []
        return pd.DataFrame(out, columns=["part", "tree", "total", "level", "at", "hash", "open"])

    found = rows.select("part", "tree", "leaf", "at").groupBy("part").cogroup(segments.groupBy("part"))
    return written(found.applyInPandas(local, "part int, tree string, total long, level int, at long, hash string, open boolean"))


def reduced(rows: DataFrame, segments: DataFrame, fan: int = FAN) -> DataFrame:
    """(tree, level, at, hash): all nodes that some part cannot make from its own leaves, roots among them.

    The fragments of ``fan`` neighbouring parts are merged in one task, those of as many such groups in the next round, and
    so on until no run is open; a round is written, so a lost executor costs a part of one round.
    """
    now = fragments(rows, segments)
    kept = [now.select("tree", "level", "at", "hash")]

    def merged(found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, total), own in found.groupby(["tree", "total"], sort=False):
            nodes = {(int(level), int(at)): h for level, at, h in zip(own["level"], own["at"], own["hash"], strict=True)}
            made, unresolved = grown(nodes, int(total))
            group = own["part"].iloc[0] // fan
            out += [(group, tree, total, *key, h, key in unresolved, True) for key, h in made.items()]
            out += [(group, tree, total, *key, nodes[key], True, False) for key in unresolved if key in nodes]
        return pd.DataFrame(out, columns=["part", "tree", "total", "level", "at", "hash", "open", "fresh"])

    while not (left := now.where("open")).isEmpty():
        grouped = left.withColumn("group", F.floor(F.col("part") / fan)).groupBy("group")
        now = written(grouped.applyInPandas(merged, "part int, tree string, total long, level int, at long, hash string, open boolean, fresh boolean"))
        kept.append(now.where("fresh").select("tree", "level", "at", "hash"))
    nodes = kept[0]
    for more in kept[1:]:
        nodes = nodes.unionAll(more)
    return written(nodes)


def above(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, tree, level, at, hash): for each segment, the nodes of ``nodes`` that the paths of its first and last leaf meet.

    What lies between these paths a part makes itself. There are 2 * ARITY such nodes a level at most.
    """
    width = lambda level: F.pow(F.lit(float(ARITY)), level).cast("long")
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.pow(F.lit(float(ARITY)), level) < F.col("total").cast("double"))
    ends = segments.select("part", "tree", "total", "start", (F.col("start") + F.col("count") - 1).alias("last"), F.explode(levels).alias("level"))
    run = lambda leaf: F.floor(F.col(leaf) / width(F.col("level") + 1)) * ARITY
    runs = F.array_distinct(F.array(run("start"), run("last")))
    wanted = ends.select("part", "tree", "level", F.explode(runs).alias("first")).select("part", "tree", "level", F.explode(F.sequence(F.col("first"), F.col("first") + (ARITY - 1))).alias("at"))
    return wanted.join(nodes, ["tree", "level", "at"]).select("part", "tree", "level", "at", "hash")


def paths(nodes: dict[tuple[int, int], str], sizes: list[int]):
    """A function from a leaf's place to its siblings up to the root: (left, right) for each level."""
    cache: dict[tuple[int, int], list] = {(len(sizes) - 1, 0): []}

    def path(level: int, at: int) -> list:
        if (level, at) not in cache:
            upper = path(level + 1, at // ARITY)
            here = siblings(nodes, level, at, sizes)
            if level == 0:
                return [here, *upper]
            cache[level, at] = [here, *upper]
        return cache[level, at]

    return lambda at: path(0, at)


def folded(leaf: str, path: list) -> str:
    """The root that a leaf and its siblings give; a run of one is hashed too."""
    for left, right in path:
        leaf = digest([*left, leaf, *right])
    return leaf


def subtree_roots(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(tree, root)."""
    top = F.size(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.pow(F.lit(float(ARITY)), level) < F.col("total").cast("double")))
    return segments.select("tree", "total").distinct().select("tree", top.alias("level"), F.lit(0).cast("long").alias("at")).join(nodes, ["tree", "level", "at"]).select("tree", F.col("hash").alias("root"))


def record(column: Column) -> Column:
    """A value as its number of bytes, a colon and itself, `-` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(record(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), record(text)).cast("binary"), 256)


def manifest(documents: DataFrame, tampered: Column, is_tampered: Column, per_part: int = LEAVES, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is a text that replaces a document's where ``is_tampered``; ``folded_root`` is what its leaf and the
    original siblings give. Nulls are written `-`, which no value is, so they differ from empty texts. Leaves of a source go
    by doc_id, null ids first; rows that share an id go by their leaf, and of wholly equal rows each is a leaf of its
    own. A null source is a source, the first. An empty table gives an empty result; other columns are ignored.

    No task holds a source: leaves lie in range partitions of ``per_part`` rows about, however they are spread over
    sources. The tree of the sources' roots is made in the same way.
    """
    source = F.col("source").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # orders as sources do, null first
    leaf = leaf_hash(F.col("text"))
    leaves = written(documents.select(tree.alias("tree"), F.col("doc_id").alias("doc_id"), leaf.alias("leaf"), F.when(is_tampered, leaf_hash(tampered)).alias("given")))
    rows, segments = numbered(leaves, per_part)
    nodes = reduced(rows, segments, fan)
    subroots = subtree_roots(nodes, segments)
    tops, top_segments = numbered(written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf"))), per_part)
    top_nodes = reduced(tops, top_segments, fan)

    def top_paths(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out, kinds = [], known["level"] < 0
        for _, start, total, rows in segment_leaves(own, known[kinds].rename(columns={"at": "start", "more": "total"})):
            found = whole(rows["leaf"], start, total, known[~kinds])
            path = paths(found, level_sizes(total))
            out += [(s, leaf, folded(leaf, path(start + i)), [x for x, _ in path(start + i)], [x for _, x in path(start + i)]) for i, (s, leaf) in enumerate(zip(rows["source"], rows["leaf"], strict=True))]
        return pd.DataFrame(out, columns=["tree", "subroot", "root", "left", "right"])

    upper = written(_with_above(tops, top_segments, top_nodes, top_paths, "tree string, subroot string, root string, left array<array<string>>, right array<array<string>>"))
    named = looked_up(segments, upper, ["tree"], most=1 << 12)

    def told(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out, kinds = [], known["level"] < 0
        info = known[kinds].rename(columns={"at": "start", "more": "total"})
        upper_of = {r.tree: r for r in info.itertuples()}
        for name, start, total, rows in segment_leaves(own, info):
            top = upper_of[name]
            over = [(list(a), list(b)) for a, b in zip(top.left, top.right, strict=True)]
            path = paths(whole(rows["leaf"], start, total, known[~kinds & (known["tree"] == name)]), level_sizes(total))
            for i, (doc_id, leaf, given) in enumerate(zip(rows["doc_id"], rows["leaf"], rows["given"], strict=True)):
                here = path(start + i) + over
                back = folded(leaf if given is None else given, here)
                out.append((doc_id, leaf, top.subroot, top.root, digest([h for a, b in here for h in (*a, *b)]), back, back == top.root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # Ids travel as text, as long numbers with nulls among them would come as doubles.
    own = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = _with_above(own, named, nodes, told, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def whole(leaves: pd.Series, start: int, total: int, outer: pd.DataFrame) -> dict[tuple[int, int], str]:
    """The nodes of a segment's paths: what its leaves give, and what was merged elsewhere."""
    nodes = {(0, start + i): h for i, h in enumerate(leaves)}
    nodes |= grown(nodes, total)[0]
    return nodes | {(int(level), int(at)): h for level, at, h in zip(outer["level"], outer["at"], outer["hash"], strict=True)}


def _with_above(rows: DataFrame, segments: DataFrame, nodes: DataFrame, function, schema: str) -> DataFrame:
    """Parts with their segments (level -1) and outer nodes in one table: a task gets a part and what it needs besides."""
    carried = [c for c in ("subroot", "root", "left", "right") if c in segments.columns]
    kinds = dict(segments.dtypes)
    own = segments.select("part", "tree", F.lit(-1).alias("level"), F.col("start").alias("at"), F.col("total").alias("more"), F.lit(None).cast("string").alias("hash"), *carried)
    outer = above(segments, nodes).select("part", "tree", "level", "at", F.lit(None).cast("long").alias("more"), "hash", *(F.lit(None).cast(kinds[c]).alias(c) for c in carried))
    known = own.unionByName(outer)
    return rows.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(function, schema)


def merkle_manifest(documents: DataFrame) -> DataFrame:
    """The production query: line ends are deleted from the texts whose id's crc32 is even, null ids counting as empty text."""
    return manifest(documents, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")), id_remainder("doc_id", TAMPER) == 0)


_TEXT = "replace(text, chr(10), '')"
_RECORDS = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text", _TEXT)]
_OPS = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], CASE WHEN doc_id IS NULL THEN [] ELSE {_OPS} END), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """Nodes (level, tree, pos, n, h) from leaves (tree, pos, n, h)."""
    return f"""{name}(level, tree, pos, n, h) AS (
  SELECT 0::BIGINT, tree, pos, n, h FROM {leaves} UNION ALL
  SELECT level + 1, tree, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY level, tree, pos // {ARITY}, n)"""


def _sides(name: str, leaves: str, key: str, nodes: str, offset: int) -> str:
    """For each leaf and level the siblings' digests, left and right."""
    return f"""{name} AS (SELECT l.{key} AS key, {offset} + b.level AS step, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < l.pos // p.width), '') AS lhs,
  coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > l.pos // p.width), '') AS rhs
  FROM {leaves} l CROSS JOIN (SELECT level, power({ARITY}, level)::BIGINT AS width FROM range({LEVELS}) r(level)) p
  JOIN {nodes} b ON b.tree = l.tree AND b.level = p.level AND b.n > 1 AND b.pos // {ARITY} = l.pos // p.width // {ARITY} GROUP BY ALL)"""


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce('=' || source, '') AS tree,
    sha256({' || '.join(_RECORDS[:5])}) AS h, sha256({' || '.join([*_RECORDS[:4], _RECORDS[5]])}) AS given, {_CRC} % {TAMPER} = 0 AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, rn) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree('nodes', 'l')},
subroots AS (SELECT tree AS source, h FROM nodes WHERE n = 1),
t AS (SELECT '' AS tree, source, row_number() OVER (ORDER BY source) - 1 AS pos, count(*) OVER () AS n, h FROM subroots),
{_tree('tops', 't')},
{_sides('low', 'l', 'rn', 'nodes', 0)},
{_sides('high', 't', 'source', 'tops', LEVELS)},
steps AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY step) AS i, lhs, rhs FROM (
  SELECT key AS rn, step, lhs, rhs FROM low UNION ALL SELECT l.rn, step, lhs, rhs FROM l JOIN high ON high.key = l.tree)),
proofs AS (SELECT rn, sha256(string_agg(lhs || rhs, '' ORDER BY i)) AS proof, max(i) AS steps FROM steps GROUP BY rn),
fold(rn, i, h) AS (SELECT rn, 0::BIGINT, CASE WHEN tampered THEN given ELSE h END FROM l UNION ALL
  SELECT fold.rn, fold.i + 1, sha256(s.lhs || fold.h || s.rhs) FROM fold JOIN steps s ON s.rn = fold.rn AND s.i = fold.i + 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, tops.h AS root, coalesce(proof, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = tops.h AS verified
FROM l JOIN subroots s ON s.source = l.tree JOIN tops ON tops.n = 1 LEFT JOIN proofs USING (rn) JOIN fold ON fold.rn = l.rn AND fold.i = coalesce(proofs.steps, 0)
"""
