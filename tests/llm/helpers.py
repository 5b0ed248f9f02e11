"""Small tables for the text operators."""

from __future__ import annotations

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators might use inside; a table that has them already must not disturb anything.
CLASHING = ("id", "key", "size", "score", "shard", "slot", "fp", "part", "word", "words", "y", "n", "c", "target", "row")


def documents(spark, rows, clashing: bool = False):
    """(doc_id, text[, lang[, source]]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", None if r[1] is None else len(r[1])) for r in rows]
    table = spark.createDataFrame(full, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        table = table.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    return table


#: Nulls, empty and white texts, one word, repeats of whole rows, equal texts under several ids, a long text, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, "A B C D E F G"),
    (8, "lorem ipsum dolor " * 30_000), (None, "no id here at all"), (9, None, None, None), (10, "naïve Größe 　 漢字 \U0001f600 \x00 end"), (11, "x" * 100_000),
]
