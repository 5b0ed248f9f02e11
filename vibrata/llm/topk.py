"""Exact top-k search by columnar branch-and-bound.

Candidate blocks and query blocks meet on a grid, one task group for each pair of blocks. In a group the vectors lie in
columns: inner products are accumulated dimension block by dimension block; after each, the mass that is left in the
remaining dimensions bounds what a candidate can still gain, and candidates that cannot reach a query's k-th best lower
bound are compacted away. A query comes with a first bound, its k-th best score among a few pilot vectors, and candidates
lie in stripes of their norms, so pairs of blocks that no score can come from are not dealt at all.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vibrata.sources.scratch import written

EXACT, LONGS = 2.0**52, 2.0**62  # sums of products up to here are exact in floating point, and in longs
PILOTS = 1024  # vectors of the largest norm, and as many drawn by hash, that give queries their first bounds
STRIPES = 16  # of candidates, by norm


def sound_vector(embedding: Column) -> Column:
    """The vector as doubles; null for vectors that are null, or hold null or non-finite components."""
    doubles = embedding.cast("array<double>")
    return F.when(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), doubles)


def scaled(vectors: list, dims: int, factor: int) -> np.ndarray:
    """(dims, n): floor(factor * x) of every component, a vector down a column, padded with zeros.

    As doubles where they hold the products exactly, else as whole numbers of any size.
    """
    out = np.zeros((dims, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    with np.errstate(over="ignore"):
        plain = np.floor(out * factor)
    if np.abs(plain).max(initial=0) < 2.0**31:
        return plain
    return np.array([[int(Fraction(float(x)) * factor // 1) for x in row] for row in out], object).reshape(out.shape)


def rough(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as doubles, those beyond them as infinite."""
    if numbers.dtype != object:
        return numbers.astype(float)
    return np.array([[float(x) if abs(x) < 10**300 else (np.inf if x > 0 else -np.inf) for x in row] for row in numbers]).reshape(numbers.shape)


def remaining(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """(len(cuts), n): Euclidean norms of what lies in the dimensions from each cut on, rounded up."""
    squares = np.cumsum((rows.astype(float) ** 2)[::-1], axis=0)[::-1]
    return np.stack([np.sqrt(squares[c]) if c < len(rows) else np.zeros(rows.shape[1]) for c in cuts]) * (1 + 1e-12)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, bars: np.ndarray | None = None, width: int = 8) -> tuple[list[int], list[int], list[int]]:
    """Exact k best (query, id, score) of a block; ``queries`` and ``columns`` are (dims, n), a vector down a column.

    Candidates of the query's own id take no part. Ties go to the smaller id. A query's k best lie at its bar or above;
    what lies below may be left out.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        size = lambda m: (rough(m) ** 2).sum(1)
        order = np.argsort(-size(queries) * size(columns), kind="stable")
        queries, columns = queries[order], columns[order]
        by_id = np.argsort(ids, kind="stable")
        ids, columns = ids[by_id], columns[:, by_id]
        dims = len(columns)
        most = float(np.abs(rough(queries)).max(initial=0)) * float(np.abs(rough(columns)).max(initial=0)) * max(dims, 1)
    if not most < LONGS:
        return search_mixed(query_ids, queries, ids, columns, k, bars, width)
    kind = float if most < EXACT else np.int64
    queries, columns = queries.astype(kind), np.ascontiguousarray(columns.astype(kind))
    cuts = list(range(width, dims, width)) + [dims]
    left_q, left_c = remaining(queries, cuts), remaining(columns, cuts)
    first = queries[: cuts[0]].T @ columns[: cuts[0]]
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    for q, own in enumerate(query_ids):
        alive = np.flatnonzero(ids != own)
        partial, given = first[q, alive], -np.inf if bars is None else bars[q]
        for step in range(1, len(cuts) + 1):
            gain = left_q[step - 1, q] * left_c[step - 1, alive]
            bar = given
            if len(alive) > k:
                floor = partial - gain
                bar = max(bar, np.partition(floor, len(floor) - k)[len(floor) - k])
            if bar > -np.inf:
                # The slack covers the rounding of the bounds; it only lets more candidates go on.
                stay = partial + gain >= bar - 1e-6 * (1 + abs(bar))
                if not stay.all():
                    alive, partial = alive[stay], partial[stay]
            if step == len(cuts) or not len(alive):
                break
            lo, hi = cuts[step - 1], cuts[step]
            partial = partial + queries[lo:hi, q] @ columns[lo:hi, alive]
        best = np.lexsort((ids[alive], -partial))[:k]
        found[0].extend([int(own)] * len(best))
        found[1].extend(ids[alive[best]].tolist())
        found[2].extend(int(x) for x in partial[best])
    return found


def search_mixed(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, bars: np.ndarray | None, width: int) -> tuple[list[int], list[int], list[int]]:
    """``search_block`` where some products leave the range of longs: the vectors they come from are searched apart.

    A query may get k candidates from each part.
    """
    narrow = np.sqrt(LONGS / max(len(columns), 1)) * (1 - 1e-9)
    small_q, small_c = (np.abs(rough(m)).max(axis=0, initial=0) < narrow for m in (queries, columns))
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    for of_q, of_c in ((small_q, small_c), (small_q, ~small_c), (~small_q, np.ones_like(small_c))):
        if of_q.any() and of_c.any():
            mine, theirs = (query_ids[of_q], queries[:, of_q]), (ids[of_c], columns[:, of_c])
            if of_c is small_c:
                part = search_block(*mine, *theirs, k, None if bars is None else bars[of_q], width)
            else:
                part = search_wide(*mine, *theirs, k)
            for into, more in zip(found, part, strict=True):
                into.extend(more)
    return found


def search_wide(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """``search_block`` for components so large that products leave the range of longs: whole numbers of any size."""
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    queries, columns = whole(queries), whole(columns)
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    for q, own in enumerate(query_ids):
        scores = (columns * queries[:, q : q + 1]).sum(0)
        best = sorted((-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != own)[:k]
        found[0].extend([int(own)] * len(best))
        found[1].extend(i for _, i in best)
        found[2].extend(-s for s, _ in best)
    return found


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256,
    candidate_block: int = 4096, query_block: int = 1024, pilots: int = PILOTS,
) -> DataFrame:
    """(query_id, rank, id, score): every query's k best candidates by inner product of scaled vectors.

    Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Shorter vectors
    count as padded with zeros. Rows that repeat an id are candidates each, and never of a query with their own id; the
    results of queries that share an id are ranked together. Ties go to the smaller id; a query with fewer than k
    candidates gets all. The empty table gives an empty result; other columns are ignored. Scores are ranked exactly,
    whatever the size of the components; one beyond the range of longs is given as the end of that range.
    """
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), sound_vector(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Of rows that are wholly alike no more than k can be among the k best, on either side.
    alike = sound.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.max("asks").alias("asks"), F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    above = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * factor + 1, F.lit(2.0))))  # no less than the scaled vector's norm
    once = written(alike.select("id", "v", "asks", above.alias("norm"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")))
    cuts = once.agg(F.percentile_approx("norm", [i / STRIPES for i in range(1, STRIPES)], 1000)).head()[0] or []
    stripe = sum((F.when(F.col("norm") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    stripes = once.groupBy(stripe.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.count(F.when(F.col("asks"), 1)).alias("q")).orderBy("s").collect()
    loud = once.orderBy(F.desc("norm"), "id").limit(pilots).select("id", "v")
    pilot = loud.unionAll(once.orderBy(F.xxhash64("id", "v"), "id").limit(pilots).select("id", "v")).distinct().collect()  # 2 * pilots rows at most
    shared = vectors.sparkSession.sparkContext.broadcast(([r.id for r in pilot], [r.v for r in pilot], [r.norm for r in stripes]))
    asked = max(-(-sum(r.q for r in stripes) // query_block), 1)
    blocks = [(r.s, b) for r in stripes for b in range(-(-r.n // candidate_block))]
    first_block = {s: min((i for i, x in enumerate(blocks) if x[0] == s), default=0) for s, _ in blocks}
    count_of = {r.s: -(-r.n // candidate_block) for r in stripes}

    def bounded(batches):
        """Queries with their first bar, and the first stripe that a score at the bar can come from."""
        ids, vs, norms = shared.value
        ids = np.array(ids, np.int64)
        for b in batches:
            if not len(b):
                continue
            dims = max(max(map(len, vs), default=0), b["v"].map(len).max(), 1)
            with np.errstate(over="ignore", invalid="ignore"):
                mine, theirs = rough(scaled(list(b["v"]), dims, factor)), rough(scaled(vs, dims, factor))
                size = lambda m: np.sqrt((m**2).sum(0))
                # What rounding can have added to a sum of products, so that no bar lies above the true score.
                scores = mine.T @ theirs - (dims + 4) * 2.0**-51 * size(mine)[:, None] * size(theirs)[None, :]
                scores[~np.isfinite(scores)] = -np.inf
            scores[b["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            bar = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(b), -np.inf)
            need = np.where(bar > 0, bar / b["norm"].to_numpy() * (1 - 1e-9), -np.inf)
            yield b[["id", "v"]].assign(bar=bar, lowest=np.searchsorted(np.array(norms), need).astype(np.int32))

    wanted = once.where("asks").select("id", "v", "norm").mapInPandas(bounded, "id long, v array<double>, bar double, lowest int")
    seat = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    pick = lambda of, key: F.element_at(F.create_map(*(F.lit(x) for kv in (of or {0: 0}).items() for x in kv)), key)
    own = pick(first_block, F.col("s")) + seat(pick(count_of or {0: 1}, F.col("s")))
    candidates = once.select("id", "v", stripe.alias("s"), "copy").select("id", "v", own.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("q"))
    start = pick({i: first_block[r.s] for i, r in enumerate(stripes)} | {len(stripes): len(blocks)}, F.col("lowest"))
    after = F.explode(F.when(start < len(blocks), F.sequence(start, F.lit(len(blocks) - 1))))
    queries = wanted.select("id", "v", "bar", after.alias("c"), seat(F.lit(asked)).alias("q"))

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "id": [], "score": [], "exact": []}).astype({"query_id": "int64", "id": "int64", "score": "int64", "exact": "object"})
        dims = max(mine["v"].map(len).max(), theirs["v"].map(len).max(), 1)
        mine = mine.sort_values("id")
        found = search_block(mine["id"].to_numpy(), scaled(list(mine["v"]), dims, factor), theirs["id"].to_numpy(), scaled(list(theirs["v"]), dims, factor), k, mine["bar"].to_numpy())
        clamped = [min(max(x, -(2**63)), 2**63 - 1) for x in found[2]]
        # What lies beyond the longs is ranked by its sign, number of digits and digits, as text.
        exact = [None if a == b else order_text(b) for a, b in zip(clamped, found[2], strict=True)]
        return pd.DataFrame({"query_id": np.array(found[0], np.int64), "id": np.array(found[1], np.int64), "score": np.array(clamped, np.int64), "exact": pd.Series(exact, dtype="object")})

    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("query_id", "id", "score")), T.StructField("exact", T.StringType())])
    local = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(meet, schema)
    # A query has k rows from each candidate block at most.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def order_text(value: int) -> str:
    """Text that sorts as the numbers beyond the longs do, among those of one sign."""
    digits = str(abs(value))
    told = f"{len(digits):06d}{digits}"
    return told if value > 0 else "".join(chr(ord("9") - (ord(c) - ord("0"))) for c in told)


def exact_top_k(embeddings: DataFrame) -> DataFrame:
    """The production query: rows whose id is divisible by 50 against all rows."""
    found = top_k(embeddings, F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
