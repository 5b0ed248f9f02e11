"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas, then seeded documents.

Documents that belong to the same set of sources are one pattern. The flow routes each pattern's words to the quotas of
its sources; a pattern's first repetition is cheaper than its second, and so on, so that repeats come last. The corpus
is only aggregated and windowed by Spark; the driver sees one row per pattern.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vibrata.llm.common import WORD, quoted
from vibrata.sources.scratch import written

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2  # production: weights repeat over the sources, 150 % of all words, 2 repetitions
BUCKETS = 1024  # into which the seeded order of a pattern's documents is cut
MOST_PATTERNS = 100_000


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def by_code_point(source: str | None) -> tuple:
    return source is None, (source or "").encode()


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float, most: float) -> dict[str | None, float]:
    """Shares of ``share`` times all words in proportion to weights, none above ``most`` times its source's size.

    What a full source can't take goes to the others by weight. Sources of weight zero get nothing.
    """
    total = share * sum(sizes.values())
    out = {s: 0.0 for s in sizes}
    open_ = sorted((s for s in sizes if weights[s] > 0), key=lambda s: (most * sizes[s] / weights[s], by_code_point(s)))
    weight = sum(weights[s] for s in open_)
    for s in open_:  # the source that fills up first, then the next
        out[s] = float(min(most * sizes[s], total * weights[s] / weight)) if weight > 0 else 0.0
        total, weight = max(total - out[s], 0.0), weight - weights[s]
    return out


class Flow:
    """A network from 0 to 1 whose flow is raised, along shortest ways, as capacity is added."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for tail, head, r in ((a, b, room), (b, a, 0)):
            self.out[tail].append(len(self.head))
            self.head.append(head)
            self.room.append(r)
        return len(self.head) - 2

    def levels(self) -> list[int]:
        level, line = [-1] * len(self.out), deque([0])
        level[0] = 0
        while line:
            a = line.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.head[e]] < 0:
                    level[self.head[e]] = level[a] + 1
                    line.append(self.head[e])
        return level

    def fill(self) -> None:
        """Raise the flow until no way from 0 to 1 has room: all shortest ways at once, again and again."""
        out, head, room = self.out, self.head, self.room
        while (level := self.levels())[1] >= 0:
            at, way, a = [0] * len(out), [], 0
            while True:
                if a == 1:
                    amount = min(room[e] for e in way)
                    for e in way:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    k = next(i for i, e in enumerate(way) if not room[e])  # go on from the first edge that is full
                    a, way = head[way[k] ^ 1], way[:k]
                    continue
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if room[e] and level[head[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(out[a]):
                    way.append(out[a][at[a]])
                    a = head[way[-1]]
                elif a == 0:
                    break
                else:
                    a = head[way.pop() ^ 1]
                    at[a] += 1


def route(patterns: dict[int, tuple[int, list[str | None]]], quotas: dict[str | None, int], most: int) -> dict[tuple[int, str | None], int]:
    """Words of each (pattern, source) of a min-cost flow: patterns -> their sources -> quotas.

    Repetition r of a pattern's words holds as many words as the pattern, at a cost that rises with r. As costs hang on the
    repetition alone, the cheapest ways are those of the lowest repetition that has room: capacity is added repetition by
    repetition, and each time the flow is raised as far as it goes, which never takes back what an earlier one sent out.
    The flow meets all quotas that the patterns' capacity allows.
    """
    names = sorted(quotas, key=by_code_point)
    place = {s: 2 + i for i, s in enumerate(names)}
    flow, first = Flow(2 + len(names) + len(patterns)), 2 + len(names)
    for s in names:
        flow.edge(place[s], 1, quotas[s])
    inlets, ways = [], {}
    for node, (p, (size, sources)) in enumerate(sorted(patterns.items()), first):
        inlets.append((flow.edge(0, node, 0), size))
        for s in sorted(set(sources), key=by_code_point):
            ways[p, s] = flow.edge(node, place[s], size * most)
    for _ in range(most):
        for e, size in inlets:
            flow.room[e] += size
        flow.fill()
    return {k: flow.room[e ^ 1] for k, e in ways.items() if flow.room[e ^ 1]}


def mix(
    documents: DataFrame, members: Column, size: Column, keep: list[str], weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS,
    share: float = SHARE, most: int = MOST, seed: int = 17, order_by: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``row`` (a struct of the columns ``keep``) of every row, with __size, __members, __copies and __sources.

    ``members`` is an array of source names (null is a source; a row without any is a member of the source null), sorted
    and without repeats in effect. ``weights`` are by source, or repeat over the sources by code point, null last.
    __copies counts how often the mix takes the row, 0 to ``most``; __sources are structs (source, source_size, target)
    of its members. Within a pattern, rows are taken in an order of seeded hashes of ``order_by`` and size until its routed words
    are reached, to the nearest row; the same rows always give the same mix. Rows that tie there (repeated rows)
    are ordered by size, else they are alike. A row of size 0 is never taken. The empty table gives an empty result.
    More than MOST_PATTERNS distinct sets of sources are refused.
    """
    named = [F.col(f"`{c}`") for c in order_by]
    keys = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in named), size.cast("string"))
    normal = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(members), F.lit(0)) > 0, members).otherwise(F.array(F.lit(None).cast("string")))))
    rows = documents.select(F.struct(*quoted(keep)).alias("row"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(named))).alias("__keys"), normal.alias("__members"), size.cast("long").alias("__size"), F.md5(keys.cast("binary")).alias("__order"))
    rows = rows.withColumn("__bucket", (F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))
    # Buckets are cut from the front of the hash, so their order and the order in them are seeded alike.
    buckets = written(rows.groupBy("__members", "__bucket").agg(F.sum("__size").alias("words")))
    seen = buckets.groupBy("__members").agg(F.sum("words").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(seen) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} sets of sources")
    seen = sorted(((tuple(r[0]), r[1]) for r in seen), key=lambda x: [by_code_point(s) for s in x[0]])
    sizes: dict[str | None, int] = defaultdict(int)
    for members_, words in seen:
        for s in members_:
            sizes[s] += words
    by_source = sorted(sizes, key=by_code_point)
    chosen = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(by_source)}
    # Overlaps count once in the words to share out.
    goal = targets({s: sizes[s] for s in by_source}, chosen, share * sum(w for _, w in seen) / max(sum(sizes.values()), 1), most)
    flow = route({i: (w, list(m)) for i, (m, w) in enumerate(seen)}, {s: round(t) for s, t in goal.items()}, most)
    routed: dict[int, int] = defaultdict(int)
    for (p, _), words in flow.items():
        routed[p] += words
    spark = documents.sparkSession
    described = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    schema = T.StructType([T.StructField("__members", T.ArrayType(T.StringType())), T.StructField("__pattern", T.LongType()), T.StructField("__routed", T.LongType()), T.StructField("__sources", described)])
    quota = spark.createDataFrame([(list(m), w, routed[i], [(s, sizes[s], goal[s]) for s in m]) for i, (m, w) in enumerate(seen)], schema)
    # ``quota`` holds MOST_PATTERNS rows at most.
    quota = F.broadcast(quota)
    # Words of the buckets before this one; buckets of a pattern are BUCKETS rows at most.
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("__members").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = buckets.withColumn("__ahead", ahead).drop("words")
    # A bucket is a thousandth of a pattern: a pattern with a third of all rows still spreads over all tasks.
    inside = Window.partitionBy("__members", "__bucket").orderBy("__order", "__size", "__keys").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    joined = numbered.join(placed, ["__members", "__bucket"]).join(quota, "__members")
    middle = F.col("__ahead") + F.col("__inside") + F.col("__size") / 2
    whole = F.floor(F.col("__routed") / F.greatest("__pattern", F.lit(1)))
    more = F.when(middle <= F.col("__routed") - whole * F.col("__pattern"), 1).otherwise(0)
    copies = F.when(F.col("__size") > 0, F.least(whole + more, F.lit(most))).otherwise(0)
    return joined.select("row", "__size", "__members", copies.cast("int").alias("__copies"), "__sources")


def mixing(documents: DataFrame) -> DataFrame:
    """The production query: what the mix takes of every document, one source a row, by the production rules.

    Null texts have no words and are not taken; null sources are a source; null and repeated ids are rows like any other.
    Texts are read once, for a narrow table of sizes.
    """
    narrow = written(documents.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("words")))
    mixed = mix(narrow, F.array("source"), F.col("words"), ["doc_id"])
    own = F.element_at("__sources", 1)
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), F.col("__size").alias("size"), own["source_size"].alias("source_size"), F.round(own["target"], 6).alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"), own["source"].alias("source"),
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows as often as the mix takes them, with all their columns; otherwise as ``mixing``."""
    taken = mix(documents, F.array(F.col("source").cast("string")), n_words(F.col("text").cast("string")), documents.columns).where("__copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "__copies"))).select(*(F.col("row")[c].alias(c) for c in documents.columns))


SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('17', chr(31), coalesce(doc_id::VARCHAR, ''), chr(31), coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::VARCHAR)) AS ord FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM words GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source IS NULL, encode(source)) AS k FROM sources),
open AS (
  SELECT *, 1.5 * (SELECT sum(source_size) FROM ranked) - coalesce(sum(2 * source_size) OVER before, 0) AS words_left,
         sum(weight) OVER (ORDER BY k DESC) AS weight_left FROM ranked
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT k, words_left / weight_left AS share FROM open WHERE words_left * weight <= 2 * source_size * weight_left ORDER BY k LIMIT 1),
goals AS (
  SELECT r.source, r.source_size,
         CASE WHEN l.k IS NULL OR r.k < l.k THEN 2.0 * r.source_size ELSE l.share * r.weight END AS target
  FROM ranked r LEFT JOIN level l ON true),
placed AS (
  SELECT w.*, g.source_size, g.target, round_even(g.target, 0)::BIGINT AS routed,
         sum(size) OVER (PARTITION BY w.source ORDER BY ('0x' || substr(ord, 1, 8))::BIGINT % 1024, ord, size, doc_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle
  FROM words w JOIN goals g ON w.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, source,
       (size * CASE WHEN size = 0 THEN 0 ELSE least(2, routed // greatest(source_size, 1)
         + CASE WHEN middle <= routed - (routed // greatest(source_size, 1)) * source_size THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM placed
"""
