"""Functions for SQL text: divergences of distributions, a wavelet band, and windows of a signal as a table function."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from vibrata.functions import wavelet
from vibrata.functions.batches import by_length

LISTS = "p ARRAY<DOUBLE>, q ARRAY<DOUBLE>"
KL = "aggregate(zip_with(p, q, (a, b) -> greatest(a, 1e-12D) * ln(greatest(a, 1e-12D) / greatest(b, 1e-12D))), 0D, (s, x) -> s + x)"
#: Bodies in SQL, so they stay expressions that Catalyst knows. Lists of one length that add up to 1.
BODIES = {
    "kl_divergence": KL,
    "sym_kl": "(kl_divergence(p, q) + kl_divergence(q, p)) / 2",
    "jsd": "(kl_divergence(p, zip_with(p, q, (a, b) -> (a + b) / 2)) + kl_divergence(q, zip_with(p, q, (a, b) -> (a + b) / 2))) / 2",
}


@pandas_udf(T.ArrayType(T.DoubleType()))
def modwt_band(w: pd.Series, level: pd.Series, band: pd.Series) -> pd.Series:
    """Coefficients of a window's band, counted from 1, the details first and the smooth last; null for a band that the
    window, by its length, or ``level`` doesn't have, for windows under eight samples and for windows with nulls."""
    out = pd.Series([None] * len(w), dtype=object)
    for (deep, number), own in pd.DataFrame({"w": w.reset_index(drop=True), "level": level.to_numpy(), "band": band.to_numpy()}).groupby(["level", "band"]):
        pick = lambda m, d=int(deep), n=int(number): [x[n - 1] if 0 < n <= len(x) else None for x in wavelet.modwt(m, d).transpose(1, 0, 2)] if d > 0 else [None] * len(m)
        for at, found in zip(own.index, by_length(own["w"].reset_index(drop=True), pick, wavelet.LEAST), strict=True):
            out.iat[at] = found
    return out


@udtf
class SlidingWindows:
    """``sliding_windows(TABLE(...), size, step)``: the table's first column names the signal, the second numbers or orders
    its samples, the third is the value; the result has the first column, window_start_sample and an array, by the names
    and types that the table has.

    Whole windows at 0, step, 2 step, ...; rows are taken in order as they come, and no more than a window is held. Null
    keys are a signal. For long signals ``operators.windows.sliding`` deals a signal to many tasks; this is one for each.
    """

    def __init__(self) -> None:
        self._held: deque[float | None] = deque()
        self._seen = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) < 3:
            raise ValueError("the first argument is a table of signal, order and value")
        for name, given in (("size", size), ("step", step)):
            if given.value is None or int(given.value) <= 0:
                raise ValueError(f"{name} is a constant of one sample at least")
        key, order, value = table.dataType.fields[:3]
        schema = T.StructType([key, T.StructField("window_start_sample", T.LongType()), T.StructField(value.name, T.ArrayType(value.dataType))])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(order.name)])

    def eval(self, row: Row, size: int, step: int) -> Iterator[tuple]:
        self._held.append(row[2])
        self._seen += 1
        if len(self._held) > size:
            self._held.popleft()
        start = self._seen - size
        if start >= 0 and start % step == 0:
            yield row[0], start, list(self._held)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session: kl_divergence, sym_kl, jsd, modwt_band and sliding_windows."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({LISTS}) RETURNS DOUBLE RETURN {body}")
    spark.udf.register("modwt_band", modwt_band)
    spark.udtf.register("sliding_windows", SlidingWindows)
