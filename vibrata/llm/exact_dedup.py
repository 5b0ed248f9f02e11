"""Exact dedup over content-defined chunk recipes, in DataFrame functions only.

A text is cut into chunks where its own content says so. Chunks are deduplicated by content into identifiers, which are
verified to stand for one content each; a text is then its ordered list of identifiers (its recipe), and texts are
compared by comparing those short lists. Long texts travel once, as chunks that each task has combined already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import quoted, unused
from vibrata.sources.scratch import written

#: Characters of a chunk; the last of a text may be shorter.
SHORTEST, LONGEST = 512, 4096
#: Where a chunk ends, from the shortest length on: the first kind of place that comes before the longest length counts, so
#: text without sentences is cut by its lines, its words or, without white space, by a character that comes twice. Of each
#: kind the rarer places come first: two texts that are out of step fall into step at a place that both come to first.
ENDS = (r"[.\n](?=\s+[19AIQYaiqy])", r"[.\n](?=\s|$)", r"\n(?=[19AIQYaiqy])", r"\n", r"\s(?=[19AIQYaiqy][aeiou])", r"\s", r"(.)\1(?=(.)\2)", r"(.)\3")
MOST = 1 << 20  # numbers of dropped rows that are broadcast
#: Identifiers to try, in order: the first under which no two contents meet is used.
KEYS: tuple[Callable[[Column], Column], ...] = (lambda c: F.unhex(F.md5(c.cast("binary"))), lambda c: F.unhex(F.sha2(c.cast("binary"), 256)))


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text's chunks in order; joined they give the text. The empty text has none.

    Each end depends on what lies between it and the end before, so an insertion changes the chunks about it alone.
    """
    body = f".{{{shortest},{longest - 2}}}?"
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join(body + end for end in ENDS) + f"|.{{1,{longest}}}"), F.lit(0))


def recipe(text: Column, key: Callable[[Column], Column]) -> Column:
    return F.transform(chunks(text), key)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunk_store(documents: DataFrame, key: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """Distinct chunks with identifier and number of uses; the combine in each task spares frequent chunks the trip."""
    cut = documents.select(F.explode(chunks(_text(text_col))).alias("chunk"))
    return cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("uses")).select(key(F.col("chunk")).alias("chunk_id"), "chunk", "uses")


def verified_key(documents: DataFrame, text_col: str = "text", keys: tuple[Callable[[Column], Column], ...] = KEYS) -> Callable[[Column], Column]:
    """The first of ``keys`` under which every identifier stands for one chunk content, as counted over all chunks."""
    for key in keys:
        contents = chunk_store(documents, key, text_col).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("contents"))
        if (contents.agg(F.max("contents")).head()[0] or 1) == 1:
            return key
    raise ValueError("several chunks share an identifier under every key")


def restore(recipes: DataFrame, store: DataFrame, id_col: str = "doc_id", recipe_col: str = "recipe") -> DataFrame:
    """Texts from recipes and a chunk store: (id, text). Ids must be unique."""
    parts = recipes.select(id_col, F.posexplode_outer(recipe_col).alias("__at", "chunk_id")).join(store.select("chunk_id", "chunk"), "chunk_id", "left")
    ordered = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__at", "chunk"))).alias("__parts"))
    return ordered.select(id_col, F.array_join(F.transform("__parts", lambda p: F.coalesce(p["chunk"], F.lit(""))), "").alias("text"))


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[Callable[[Column], Column], ...] = KEYS) -> DataFrame:
    """One row per input row: ``__row``, id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical; null counts as empty. The row with the largest id of a group stays, null ids being
    the smallest; of repeated rows with that id the last in the order of the scan stays, so one of a group always does.
    An empty table gives an empty result; columns other than the two named are ignored. ``__row`` is a number that the
    rows got once, when their recipes were written.
    """
    key = verified_key(documents, text_col, keys)
    text = _text(text_col)
    rows = written(
        documents.select(
            F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), recipe(text, key).alias("__recipe"),
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        )
    )
    best = written(rows.groupBy("__recipe").agg(F.max(F.struct("__id", "__row")).alias("__best"), F.count(F.lit(1)).alias("group_size")))
    # The grouped side has one row per recipe and is written first, so that the join's two sides are plain exchanges: the
    # adaptive planner can then split a hot recipe's rows over several tasks.
    return rows.join(best, "__recipe").select(
        "__row", F.col("__id").alias(id_col), F.col("__best.__id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("__best.__row")).alias("kept"), "text_sha256", F.size("__recipe").alias("n_chunks"),
    )


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[Callable[[Column], Column], ...] = KEYS) -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts the one with the largest id.

    Null texts count as empty, null ids as the smallest; of repeated rows with the largest id one stays, whichever. An
    empty table gives an empty result. Rows are written once, with a number and their recipe; the numbers alone are
    compared, and the rows that go are taken out where they lie, by a broadcast of up to MOST numbers, or else by a shuffle.
    """
    key = verified_key(documents, text_col, keys)
    columns = documents.columns
    number, own = unused(columns, "row", "recipe")
    rows = written(documents.select(*quoted(columns), F.monotonically_increasing_id().alias(number), recipe(_text(f"`{text_col}`"), key).alias(own)))
    narrow = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(number).alias("number"), F.col(own).alias("recipe"))
    best = written(narrow.groupBy("recipe").agg(F.max(F.struct("id", "number"))["number"].alias("number")))
    gone = written(narrow.select("number").join(best.hint("shuffle_hash"), "number", "left_anti").withColumnRenamed("number", number))
    few = gone.limit(MOST + 1).count() <= MOST
    return rows.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), number, "left_anti").select(*quoted(columns))


def exact_dedup(documents: DataFrame) -> DataFrame:
    """The production query."""
    return groups(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
