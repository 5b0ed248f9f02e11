"""Joins in time: the last known row of another table at each sample, samples in labelled spans, and sessions.

None of them sorts a whole key in one task: rows are cut into stretches of time, worked on apart, and what reaches from one
stretch into the next is a row for each key and stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.operators.joins import MOST, looked_up
from vibrata.operators.signals import STRETCH, _place, stretched

SALTS = 8  # tasks that the samples of one bin of spans are dealt to
PER_SPAN = 8  # bins that a span of mean length covers


def _known(names: Sequence[str]) -> Column:
    """That none of the columns is null."""
    found = F.lit(True)
    for name in names:
        found = found & F.col(f"`{name}`").isNotNull()
    return found


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], right_order: str | None = None,
    forward: bool = False, exact: bool = True, tolerance: float | None = None, rows: int = STRETCH,
) -> DataFrame:
    """Every row of ``left`` with ``values`` (name -> column of ``right``) of the last row of ``right`` that is no later.

    Rows meet within equal ``keys``, of both tables; ``right_order`` is ``order`` where it isn't named, and of the same type:
    a number or timestamp. With ``forward`` the next row that is no earlier counts. Without ``exact`` rows of the same
    time don't. ``tolerance``, in units of ``order`` or seconds, is the longest distance. Of several rows of ``right`` at
    one time the one with the largest values counts (forward: the smallest). Rows of ``left`` without a match, or whose keys
    or order are null, have nulls; rows of ``right`` whose keys or order are null don't count. Null values count as values.

    Both sides lie in the same stretches of ``rows`` rows, about; a stretch begins with the row that the ones before it end
    with. Each side is read three times.
    """
    right_order = right_order or order
    kinds = left.schema[order].dataType, right.schema[right_order].dataType
    if kinds[0] != kinds[1]:
        raise ValueError(f"orders of different types: {kinds[0].simpleString()} and {kinds[1].simpleString()}")
    quoted = [f"`{c}`" for c in left.columns]
    theirs = right.where(_known([*keys, right_order])).select(*keys, F.col(right_order).alias("__at"), F.struct(F.col(right_order).alias("__when"), *(F.col(c).alias(n) for n, c in values.items())).alias("__right"))
    mine = left.select(*keys, F.col(order).alias("__at"), F.struct(*quoted).alias("__left"))
    sound = mine.where(_known([*keys, "__at"])).withColumn("__right", F.lit(None).cast(theirs.schema["__right"].dataType))
    both = sound.unionByName(theirs.withColumn("__left", F.lit(None).cast(mine.schema["__left"].dataType)))
    cut = stretched(both, "__at", None, "__stretch", rows)
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    ahead = F.col("__right").isNull() if exact else F.col("__right").isNotNull()  # false sorts before true
    inside = Window.partitionBy(*keys, "__stretch").orderBy(turn("__at"), ahead, turn("__right")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.struct("__at", "__right")
    furthest = (F.min if forward else F.max)(F.when(F.col("__right").isNotNull(), end))["__right"]
    ends = cut.groupBy(*keys, "__stretch").agg(furthest.alias("__end"))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy(turn("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "__stretch", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    own = cut.withColumn("__own", F.last("__right", ignorenulls=True).over(inside)).where("__left IS NOT NULL").drop("__right")
    met = looked_up(own, starts, [*keys, "__stretch"]).select("__at", "__left", F.coalesce("__own", "__before").alias("__match"))
    if tolerance is not None:
        at, when = _place(met, "__at"), _place(met.select(F.col("__match.__when").alias("__when")), "__when")
        met = met.withColumn("__when", F.col("__match.__when")).withColumn("__match", F.when(F.abs(at - when) <= tolerance, F.col("__match")))
    told = [F.col(f"__match.`{n}`").alias(n) for n in values]
    unsound = mine.where(~_known([*keys, "__at"])).withColumn("__match", F.lit(None).cast(theirs.schema["__right"].dataType))
    return met.select("__left", "__match").unionByName(unsound.select("__left", "__match")).select("__left.*", *told)


def in_spans(
    samples: DataFrame, spans: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], start: str = "start", stop: str = "stop",
    left: bool = False, per_span: int = PER_SPAN, salts: int = SALTS,
) -> DataFrame:
    """Every sample with ``values`` (name -> column of ``spans``) of each span that holds it: start <= order < stop.

    Samples in several spans are there several times; those in none are left out, or with ``left`` have nulls. Rows with
    null keys, order or ends meet nothing; spans that end before they start hold nothing. Repeated spans count each.

    Spans are laid out over bins of equal length, ``per_span`` for a span of mean length and so ``per_span`` + 2 times the
    spans at most, whatever their lengths; samples meet them by bin, where both edges are checked. The samples of a bin
    are dealt to ``salts`` tasks. Where all spans have MOST rows in bins at most, those are broadcast instead and not dealt;
    beyond, both sides are sorted, as Spark estimates spans by their table and not by the rows that they are laid out to.
    """
    begin, end = _place(spans, start), _place(spans, stop)
    laid = spans.where(_known([*keys, start, stop])).withColumn("__begin", begin).withColumn("__end", end).where("__begin < __end")
    total, n = laid.agg(F.sum(F.col("__end") - F.col("__begin")), F.count(F.lit(1))).head()
    width = total / (per_span * n) if n else 1.0
    few = n * (per_span + 2) <= MOST
    salts = 1 if few else salts
    bin_of = lambda place: F.floor(place / F.lit(width)).cast("long")
    bins = F.explode(F.sequence(bin_of(F.col("__begin")), bin_of(F.col("__end"))))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    told = [F.col(c).alias(f"__v{i}") for i, c in enumerate(values.values())]
    theirs = laid.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), "__begin", "__end", *told, bins.alias("__bin")).withColumn("__salt", salt)
    theirs = F.broadcast(theirs) if few else theirs.hint("merge")
    at = _place(samples, order)
    mine = samples.withColumn("__at", at).withColumn("__own_bin", bin_of(F.col("__at"))).withColumn("__own_salt", F.pmod(F.xxhash64(*(f"`{c}`" for c, kind in samples.dtypes if "map<" not in kind)), F.lit(salts)).cast("int"))
    same = (F.col("__own_bin") == F.col("__bin")) & (F.col("__own_salt") == F.col("__salt"))
    for i, c in enumerate(keys):
        same = same & (mine[c] == F.col(f"__k{i}"))
    inside = (F.col("__at") >= F.col("__begin")) & (F.col("__at") < F.col("__end"))
    met = mine.join(theirs, same & inside, "left" if left else "inner")
    return met.select(*(mine[f"`{c}`"] for c in samples.columns), *(F.col(f"__v{i}").alias(n) for i, n in enumerate(values)))


def sessions(samples: DataFrame, keys: Sequence[str], order: str, gap: float, rows: int = STRETCH, amounts: dict[str, str] | None = None) -> DataFrame:
    """keys, session_start, session_end, n and sums of ``amounts`` (name -> column), a row for each session.

    A session goes on as long as the next row is less than ``gap`` (units of ``order``, or seconds) after the last; its
    ends are the first and last row's order. Rows with null keys or order are left out, null amounts count as 0.

    Sessions are made inside stretches; only the first and the last of a key's stretch can go on in another, and a row for
    each of these tells which belong together, however many stretches a session lasts.
    """
    amounts = amounts or {}
    sound = samples.where(_known([*keys, order])).select(*keys, F.col(order).alias("__at"), *(F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in amounts.items()))
    cut = stretched(sound, "__at", None, "__stretch", rows)
    cut = cut.withColumn("__place", _place(cut, "__at"))
    inside = Window.partitionBy(*keys, "__stretch").orderBy("__at")
    fresh = F.coalesce(F.col("__place") - F.lag("__place").over(inside) >= gap, F.lit(True)).cast("long")
    numbered = cut.withColumn("__fresh", fresh).withColumn("__no", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = numbered.groupBy(*keys, "__stretch", "__no").agg(
        F.min("__at").alias("session_start"), F.max("__at").alias("session_end"), F.min("__place").alias("__first"), F.max("__place").alias("__last"), F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in amounts)
    )
    # A row for each key and stretch: where its first session began to be one with what came before.
    edges = parts.groupBy(*keys, "__stretch").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.max("__no").alias("__sessions"))
    order_ = Window.partitionBy(*keys, F.lit(0)).orderBy("__stretch")
    apart = F.coalesce(F.col("__first") - F.lag("__last").over(order_) >= gap, F.lit(True))
    # Sessions are numbered through a key: a stretch adds those it has, less one where its first goes on with the last before.
    added = F.col("__sessions") - F.when(apart, 0).otherwise(1)
    before = F.coalesce(F.sum(added).over(order_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = edges.select(*keys, "__stretch", (before - F.when(apart, 0).otherwise(1)).alias("__offset"))
    whole = looked_up(parts, starts, [*keys, "__stretch"]).withColumn("__session", F.col("__offset") + F.col("__no"))
    found = whole.groupBy(*keys, "__session").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in amounts))
    return found.drop("__session")
