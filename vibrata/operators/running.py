"""Running totals, quantiles and counts in an order, with no task that holds a whole key.

The values of the order are cut at approximate quantiles into buckets; totals inside buckets and totals of whole buckets
together give the exact total before each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.operators.joins import looked_up
from vibrata.sources.scratch import written

BUCKETS, COARSE = 1024, 32  # buckets of a key; cuts between them are searched in COARSE steps of as many
MOST_KEYS = 1 << 11  # keys whose cuts are broadcast, 16 MB at most
LEAST = 4096  # distinct values of a key that a bucket should hold: a smaller key has fewer buckets


def totals_before(table: DataFrame, keys: Sequence[str], order: str, amounts: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``table`` with before_<amount> and all_<amount>: sums over the key's rows of smaller ``order``, and over all.

    ``order`` is numeric and unique within a key; rows where it is null are left out. The table is written once, as it is
    read for its cuts, for the buckets' totals and for its rows.
    """
    rows = written(table.where(F.col(order).isNotNull()))
    share = lambda i: F.lit(i / buckets)
    cuts = F.percentile_approx(order, F.array(*(share(i) for i in range(1, buckets))), F.lit(10 * buckets))
    whole = rows.groupBy(*keys).agg(cuts.alias("__cuts"), F.count(F.lit(1)).alias("__n"), *(F.sum(a).alias(f"all_{a}") for a in amounts))
    # A key of few rows keeps every so manieth cut.
    stride = F.greatest(F.floor(buckets / F.greatest(F.ceil(F.col("__n") / LEAST), F.lit(1))), F.lit(1))
    few = F.filter("__cuts", lambda c, i: (i + 1) % F.col("__stride") == 0)
    whole = whole.withColumn("__stride", stride).withColumn("__cuts", few).withColumn("__steps", F.filter("__cuts", lambda c, i: (i + 1) % COARSE == 0)).drop("__n", "__stride")
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(order)))
    placed = looked_up(rows, whole, keys, most=MOST_KEYS).withColumn("__step", below("__steps") * COARSE)
    placed = placed.withColumn("__bucket", F.col("__step") + below(F.slice("__cuts", F.col("__step") + 1, F.lit(COARSE)))).drop("__cuts", "__steps", "__step")
    sums = placed.groupBy(*keys, "__bucket").agg(*(F.sum(a).alias(f"__sum_{a}") for a in amounts))
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__sum_{a}").over(earlier), F.lit(0)).alias(f"__start_{a}") for a in amounts))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *(F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"__inside_{a}") for a in amounts))
    joined = looked_up(own, starts, [*keys, "__bucket"])
    return joined.select(*table.columns, *((F.col(f"__start_{a}") + F.col(f"__inside_{a}")).alias(f"before_{a}") for a in amounts), *(f"all_{a}" for a in amounts))


def quantiles(table: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], count: str | None = None) -> DataFrame:
    """A row a key with an exact, linearly interpolated quantile for each of ``wanted`` (name -> share).

    Null, NaN and infinite values don't count; keys without others have no row. ``count`` names the number of values.
    """
    sound = table.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    counted = sound.groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(F.count(F.lit(1)).alias("c"))
    placed = totals_before(counted, keys, "__value", ["c"])
    first, last = F.col("before_c"), F.col("before_c") + F.col("c") - 1
    place = lambda q: (F.col("all_c") - 1) * F.lit(float(q))
    holds = lambda at: F.max(F.when((first <= at) & (at <= last), F.col("__value")))
    ends = [x for name, q in wanted.items() for x in (holds(F.floor(place(q))).alias(f"__low_{name}"), holds(F.ceil(place(q))).alias(f"__high_{name}"), F.max(place(q) - F.floor(place(q))).alias(f"__part_{name}"))]
    found = placed.groupBy(*keys).agg(F.max("all_c").alias("__n"), *ends)
    told = [(F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")).alias(n) for n in wanted]
    out = found.select(*keys, *told, *([F.col("__n").alias(count)] if count else []))
    return out if keys else out.where(F.col(next(iter(wanted))).isNotNull())
