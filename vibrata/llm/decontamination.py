"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed in runs of k (k-grams); of each window of w consecutive hashes the least is kept, the rightmost of equal
ones. Two texts that share k + w - 1 words in a row keep the same k-gram of them, so fingerprints that meet in a join are
extended word by word to both sides, and every shared run of that length is found. An item's windows are 10 words, or the
whole item where it has fewer; k + w - 1 is the length of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import GAP, LOWER, UPPER, words_of
from vibrata.sources.scratch import written

WINDOW = 10  # words of an item's window
MOST = 1 << 17  # places of items, with 2 * WINDOW words each at most, that are broadcast at a time


def gram_size(length: int) -> int:
    """k for windows of ``length`` words; w is length - k + 1."""
    return (length + 1) // 2


class Kept:
    """The kept k-grams of texts as columns, for windows of ``length`` words, over ``hashes`` of single words.

    ``mark`` is the least hash of a k-gram in the window that begins at ``start``, null for windows before the first.
    """

    def __init__(self, length: int, hashes: str = "hashes", start: str = "start"):
        self.k = gram_size(length)
        self.w = length - self.k + 1
        self.length, self.hashes, self.start = length, F.col(hashes), F.col(start)
        self.mark = F.when(self.start >= 0, self.least(self.start))

    def gram(self, at: Column) -> Column:
        return F.xxhash64(*(F.get(self.hashes, at + j) for j in range(self.k)))

    def least(self, start: Column) -> Column:
        return F.least(*(self.gram(start + j) for j in range(self.w))) if self.w > 1 else self.gram(start)

    def fresh(self, mark: Column) -> Column:
        """Whether no window before keeps the same k-gram."""
        return (self.start == 0) | (mark == self.gram(self.start + (self.w - 1))) | (mark != self.least(self.start - 1))

    def windows(self, texts: DataFrame, words: str = "words") -> DataFrame:
        """``texts`` with a row for each window and one more, whose ``start`` is -1 and whose ``mark`` is null.

        Word by word only single hashes are made; what is made for each window then runs in generated code.
        """
        hashed = texts.withColumn("hashes", F.transform(words, lambda x: F.xxhash64(x)))
        starts = F.sequence(F.lit(-1), F.greatest(F.size("hashes") - self.length, F.lit(-1)))
        return hashed.withColumn("start", F.explode(starts)).withColumn("mark", self.mark)


def surrounded(rows: DataFrame, length: int, others: list[str]) -> DataFrame:
    """``others``, at, before, gram and after, for windows: where the kept k-gram begins, words before it (nearest first), its
    own and those behind it, as far as a window with it can reach.

    First each row is cut down to the words about its window, in generated code: a text's words are not copied for its
    windows. For the rows without a window what comes out has no meaning.
    """
    k = gram_size(length)
    w, reach = length - k + 1, length - k
    start = F.greatest(F.col("start"), F.lit(0))
    low = F.greatest(start - reach, F.lit(0))
    around, hashes = F.slice("words", low + 1, start - low + length + reach), F.slice("hashes", start + 1, length)
    cut = rows.select(*others, "mark", "start", (start - low).alias("ahead"), around.alias("around"), hashes.alias("hashes"))
    own = Kept(length)
    # The rightmost of the least: the first that is found backwards.
    backwards = F.transform(F.sequence(F.lit(w - 1), F.lit(0), F.lit(-1)), own.gram)
    found = cut.withColumn("inside", w - F.array_position(backwards, F.col("mark")).cast("int")).withColumn("place", F.col("ahead") + F.col("inside"))
    place = F.col("place")
    before = F.reverse(F.slice("around", F.greatest(place - reach, F.lit(0)) + 1, F.least(place, F.lit(reach))))
    gram, after = F.slice("around", place + 1, k), F.slice("around", place + 1 + k, reach)
    known = lambda c: F.when(F.col("start") >= 0, c)
    return found.select(*others, known(F.col("start") + F.col("inside")).alias("at"), known(before).alias("before"), known(gram).alias("gram"), known(after).alias("after"))


def places_of_items(items: DataFrame, length: int, id_col: str = "item_id") -> DataFrame:
    """(mark, before, gram, after, items): the different surroundings of kept k-grams, with the ids of their items."""
    kept = Kept(length)
    every = kept.windows(items.select(F.col(id_col).cast("string").alias("item"), "words")).where("start >= 0").where(kept.fresh(F.col("mark")))
    return surrounded(every.withColumn("its_mark", F.col("mark")), length, ["item", "its_mark"]).groupBy(F.col("its_mark").alias("mark"), "before", "gram", "after").agg(F.collect_set("item").alias("items"))


def alike(ours: str, theirs: str) -> Column:
    """How many words of two lists agree, from the first on."""
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    place = F.array_position(same, F.lit(False))
    return F.when(place > 0, place - 1).otherwise(F.size(same).cast("long")).cast("int")


def extended(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Hits of the kept k-grams of ``texts`` (row, id, n_words, words) against a bounded table of items' places.

    (row, id, n_words, span, items): ``span`` is first and last, word places from 0, where at least ``length`` words agree;
    it and ``items`` are null in the other rows, of which every text has one at least.
    """
    kept, mark = Kept(length), F.col("mark")
    theirs = places.select("mark", *(F.col(c).alias(f"its_{c}") for c in ("before", "gram", "after")), "items")
    met = kept.windows(texts).join(F.broadcast(theirs), "mark", "left")
    found = met.where(mark.isNull() | F.col("its_gram").isNotNull())
    near = surrounded(found, length, ["row", "id", "n_words", "its_before", "its_gram", "its_after", "items"])
    first, last = F.col("at") - alike("before", "its_before"), F.col("at") + (kept.k - 1) + alike("after", "its_after")
    agree = (F.col("gram") == F.col("its_gram")) & (last - first + 1 >= length)
    # Not a filter: a join whose rows pass a test that has no generated code copies the text's words for every k-gram.
    return near.select("row", "id", "n_words", F.when(agree, F.struct(first.alias("first"), last.alias("last"))).alias("span"), F.when(agree, F.col("items")).alias("items"))


def covered(spans: Column) -> Column:
    """Number of places in the union of spans (first, last)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["last"] - F.greatest(s["first"], a["end"] + 1) + 1, F.lit(0))).alias("n"), F.greatest(a["end"], s["last"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"].cast("long"))


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids as sorted text), spans (first and last word of each place found).

    Null and empty texts have no words. A document word is hit where it lies inside an occurrence of an item's window.
    Items without words have no window. Items that share an id are one item in ``items``, their texts stay apart; the
    windows of an item without an id count as hits, but name no item. Repeated documents are rows each. An empty table
    of documents gives an empty result, one of items no hits. Other columns are ignored.

    Item places are broadcast, ``most`` at a time: more of them take several passes over the documents. Rows of a hot
    passage stay where their documents are read, and a document's hits alone are brought together.
    """
    asked = written(items.select(F.col(item_col), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0))
    lengths = sorted({min(r.n, window) for r in asked.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()})  # ``window`` of them at most
    rounds: list[tuple[int, DataFrame]] = []
    for length in lengths:
        of_length = asked.where(F.size("words") == length if length < window else F.size("words") >= window)
        places = written(places_of_items(of_length, length, item_col))
        parts = -(-places.agg(F.coalesce(F.sum(F.greatest(F.size("items"), F.lit(1))), F.lit(0)).alias("n")).head().n // most)
        rounds.extend((length, places.where(F.pmod(F.xxhash64("mark"), F.lit(parts)) == part) if parts > 1 else places) for part in range(parts))
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    if len(rounds) > 1:
        texts = written(texts)  # the rows' numbers must be the same in every pass
    if rounds:
        hits = extended(texts, rounds[0][1], rounds[0][0])
        for length, places in rounds[1:]:
            hits = hits.unionByName(extended(texts, places, length))
    else:
        none = (F.lit(None).cast("struct<first:int,last:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
        hits = texts.select("row", "id", "n_words", *none)
    whole = hits.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("__items"))
    found = F.array_sort(F.array_distinct(F.flatten("__items")))
    return whole.select(id_col, "n_words", covered(F.col("spans")).alias("n_hit"), found.alias("items"), F.array_sort("spans").alias("spans"))


def decontamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The production query."""
    found = contamination(documents, items)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORD = GAP.replace("[", "[^")
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
runs AS (SELECT row, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM windows))),
met AS (SELECT row, p, k, item_id FROM runs JOIN windows USING (k, g)),
hit AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(p, p + k)) AS place FROM met) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
