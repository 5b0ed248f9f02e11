"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibrata.sources.scratch import removed, written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For every ``u``, the least of itself and its neighbours; combined in each task before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least neighbour of u."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least_neighbour(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges: root is the component's least node. Loops and copies don't matter.

    Each round writes its edges to the shared folder and removes those of the round before, so a lost executor costs one
    round at most. The rounds stop when every node hangs on a node that hangs on none; their number grows with the
    logarithm of a component's width.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        # Stars already: every upper end has one lower end, and no lower end is an upper one.
        before, now = now, written(_small_star(_large_star(now)))
        removed(now.sparkSession, before)
        tops = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = now.select(F.col("v").alias("u")).distinct()
        if tops.where("n > 1").isEmpty() and tops.join(roots, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
