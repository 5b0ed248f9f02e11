"""Small tables of statistics joined to many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 16  # rows of a table that is broadcast
SALTS = 64  # parts of a key's rows where the table is too large for that


def looked_up(table: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", most: int = MOST) -> DataFrame:
    """``table`` joined to ``small``, which has a row for each key, without a shuffle of ``table`` by its keys.

    Up to ``most`` rows of ``small`` are fetched once and broadcast, so their number is known. A larger table is joined by
    key and salt: the rows of a frequent key are dealt to SALTS tasks, each with a copy of the key's row. ``how`` is
    inner or left.
    """
    rows = small.limit(most + 1).collect()
    if len(rows) <= most:
        local = table.sparkSession.createDataFrame(rows, small.schema, verifySchema=False)
        return table.join(F.broadcast(local), list(keys), how) if keys else table.join(F.broadcast(local), F.lit(True), how)
    # Salts are hashes of the rows, so that a task that runs again deals them alike.
    hashed = F.xxhash64(*(c for c, kind in table.dtypes if "map<" not in kind))
    salted = table.withColumn("__salt", F.pmod(hashed, F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
