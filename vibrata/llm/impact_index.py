"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks; in a block a document is a bit place, by ascending id. A term's impacts in the block are bitmaps,
one for each bit of the impact, held only for the 64-bit words in which the term occurs. A query's scores are made for
all documents of a block at once: slices are multiplied by the term's weight and added up by bitwise carry arithmetic, and
the k best are found from the most significant slice of the sums down, without reading a score of any other document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.llm.common import GAP, LOWER, UPPER, binaries, words_of
from vibrata.sources.scratch import written

DOCUMENTS, POSTINGS = 1 << 12, 1 << 20  # of a block, at most; a document with more terms than that is a block of its own
MOST = 1 << 18  # terms that are broadcast at a time
TOGETHER = 64  # items whose scores are added up at a time
#: Bytes of words, A-Z lower-cased; all others become spaces.
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
BLOCK = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("tfs", pa.binary()),
    ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])
BLOCK_DDL = "doc_ids array<long>, lengths array<long>, terms array<string>, counts array<int>, places binary, tfs binary, n_docs long, n_terms long"
SLICED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("columns", pa.list_(pa.int32())), ("words", pa.binary()), ("slices", pa.binary()), ("bits", pa.int32())])
SLICED_DDL = "doc_ids array<long>, terms array<string>, counts array<int>, columns array<int>, words binary, slices binary, bits int"


def block_of(ids: list, lengths: list[int], terms: dict[bytes, int], postings: tuple[list[int], list[int], list[int]]) -> pa.RecordBatch:
    """One row: documents by ascending id (null last), postings by term and place. ``postings`` are term, document, tf."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    term, doc, tf = (np.array(x, np.int32) for x in postings)
    doc = place[doc]
    by = np.lexsort((doc, term))
    counts = np.bincount(term, minlength=len(terms)).astype(np.int32)
    row = [[[ids[i] for i in order]], [[lengths[i] for i in order]], [[t.decode(errors="replace") for t in terms]], [counts], [doc[by].tobytes()], [tf[by].tobytes()], [len(ids)], [sum(lengths)]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, BLOCK, strict=True)], schema=BLOCK)


def inverted(documents: DataFrame, wanted: set[bytes] | None, per_block: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block of documents: ids, lengths in terms, and postings of the wanted terms, or of all.

    Blocks are runs of documents as they are read, so nothing is shuffled. Documents without a term take no part.
    """
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared.value
        fresh = lambda: ([], [], {}, ([], [], []))
        ids, lengths, terms, postings = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binaries(batch, "text"), strict=True):
                found = text.translate(FOLD).split()
                if not found:
                    continue
                tfs = Counter(found)
                names = list(tfs if only is None else only & tfs.keys())
                if ids and (len(ids) >= per_block or len(postings[0]) + len(names) > POSTINGS):
                    yield block_of(ids, lengths, terms, postings)
                    ids, lengths, terms, postings = fresh()
                postings[0].extend([terms.setdefault(t, len(terms)) for t in names])
                postings[1].extend([len(ids)] * len(names))
                postings[2].extend([tfs[t] for t in names])
                ids.append(doc_id)
                lengths.append(len(found))
        if ids:
            yield block_of(ids, lengths, terms, postings)

    return written(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(blocks, BLOCK_DDL))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to a document of ``length`` terms, for each unit of its weight."""
    m = 100 - 25 + (25 * length.astype(np.int64) * n) // total
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def slices_of(term: np.ndarray, place: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, word, slices) of the columns: slices are (bits, columns), a column for each term and 64-bit word with a posting.

    Postings come by term and place.
    """
    word = place >> 6
    starts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(word) != 0))) if len(term) else np.zeros(0, np.int64)
    at = (place & 63).astype(np.uint64)
    bits = int(impact.max(initial=0)).bit_length()
    rows = [np.bitwise_or.reduceat(((impact >> b) & 1).astype(np.uint64) << at, starts) if len(starts) else np.zeros(0, np.uint64) for b in range(bits)]
    return term[starts], word[starts], np.array(rows, np.uint64).reshape(bits, len(starts))


def unpacked(slices: bytes, bits: int) -> np.ndarray:
    """(bits, columns) of a block."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(slices), np.uint64).reshape(bits, -1) if bits else np.zeros((0, 0), np.uint64)


def sliced(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """The index: blocks with the slices of their impacts, given the collection's number of documents and of terms.

    Slices of rare terms are mostly zeros, so a block's are kept compressed; a task unpacks one block at a time.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                places = np.frombuffer(row["places"], np.int32)
                term = np.repeat(np.arange(len(counts)), counts)
                impact = impacts(np.frombuffer(row["tfs"], np.int32), np.array(row["lengths"], np.int64)[places], n, total)
                of, words, slices = slices_of(term, places, impact)
                columns = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
                out = [[row["doc_ids"]], [row["terms"]], [row["counts"]], [columns], [words.astype(np.int32).tobytes()], [pack.compress(slices.tobytes())], [len(slices)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SLICED, strict=True)], schema=SLICED)

    return written(blocks.drop("n_docs", "n_terms").mapInArrow(made, SLICED_DDL))


def build(documents: DataFrame, wanted: set[bytes] | None = None, per_block: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(index, N, L): the index of all documents for the wanted terms, or for all; N and L count all documents and terms."""
    blocks = inverted(documents, wanted, per_block, id_col, text_col)
    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).head()
    return sliced(blocks, n or 0, total or 1), n or 0, total or 0


def add(sums: np.ndarray, addend: np.ndarray, shift: int = 0) -> None:
    """Bit-sliced addition: ``sums`` += ``addend`` << ``shift``; both have the least significant slice first."""
    carry = np.zeros_like(sums[0])
    for b, x in enumerate(addend):
        a = sums[b + shift]
        either = a ^ x
        more = (a & x) | (carry & either)  # before ``a``, which is a view, changes
        sums[b + shift] = either ^ carry
        carry = more
    for b in range(len(addend) + shift, len(sums)):
        if not carry.any():
            return
        sums[b], carry = sums[b] ^ carry, sums[b] & carry


def weighted(slices: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slices times a whole number for each column, by shifts and additions."""
    bits = int(weight.max(initial=0)).bit_length()
    out = np.zeros((len(slices) + bits, slices.shape[1]), np.uint64)
    for j in range(bits):
        chosen = np.where((weight >> j) & 1 == 1, ~np.uint64(0), np.uint64(0))
        add(out, slices & chosen, j)
    return out


def best_places(sums: np.ndarray, k: int) -> list[np.ndarray]:
    """For each item the places of its k highest sums above 0, ties to lower places; sums are (bits, items, words).

    From the most significant slice down, ``sure`` holds places that are above the k-th sum for certain and ``open`` those
    that agree with it so far.
    """
    still = np.bitwise_or.reduce(sums, axis=0) if len(sums) else np.zeros(sums.shape[1:], np.uint64)
    sure = np.zeros_like(still)
    for row in sums[::-1]:
        higher = still & row
        many = np.bitwise_count(sure | higher).sum(1, dtype=np.int64) > k
        sure = np.where(many[:, None], sure, sure | higher)
        still = np.where(many[:, None], higher, still & ~row)
    out = []
    for a, b in zip(sure, still, strict=True):
        certain, tied = (np.flatnonzero(np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little")) for x in (a, b))
        out.append(np.concatenate([certain, tied[: max(k - len(certain), 0)]]))
    return out


def values(sums: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sums at some places of one item; ``sums`` is (bits, words)."""
    bit = (sums[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return (bit.astype(np.int64) << np.arange(len(sums), dtype=np.int64)[:, None]).sum(0)


def searched(row: dict, items: list[list[tuple[str, int, int]]], k: int, together: int = TOGETHER) -> Iterator[tuple[int, list, np.ndarray]]:
    """(item's number, doc ids, scores) of a block's k best for each item; items are lists of (term, times, weight)."""
    needed = {t: w for terms in items for t, _, w in terms if w > 0}
    columns, words = row["columns"], np.frombuffer(row["words"], np.int32)
    held = [(t, i) for i, t in enumerate(row["terms"]) if t in needed]
    if not held:
        return
    slices = unpacked(row["slices"], row["bits"])
    spans = [np.arange(columns[i], columns[i + 1]) for _, i in held]
    taken = np.concatenate(spans)
    product = weighted(slices[:, taken], np.repeat(np.array([needed[t] for t, _ in held], np.int64), [len(s) for s in spans]))
    ends = np.cumsum([0] + [len(s) for s in spans])
    part_of = {t: (int(ends[j]), int(ends[j + 1])) for j, (t, _) in enumerate(held)}
    words, width = words[taken], -(-len(row["doc_ids"]) // 64)
    for lo in range(0, len(items), together):
        some = items[lo : lo + together]
        steps: dict[int, list[list[str]]] = defaultdict(lambda: [[] for _ in some])  # by the power of two in a term's times
        for i, terms in enumerate(some):
            for t, times, _ in terms:
                if t in part_of:
                    for j in range(times.bit_length()):
                        if times >> j & 1:
                            steps[j][i].append(t)
        most = max((sum(times for t, times, _ in terms if t in part_of) for terms in some), default=0)
        sums = np.zeros((len(product) + max(most, 1).bit_length(), len(some), width), np.uint64)
        for shift, lists in sorted(steps.items()):
            for step in range(max(map(len, lists))):
                addend = np.zeros((len(product), len(some), width), np.uint64)
                for i, terms in enumerate(lists):
                    if step < len(terms):
                        a, b = part_of[terms[step]]
                        addend[:, i, words[a:b]] = product[:, a:b]
                add(sums, addend, shift)
        for i, places in enumerate(best_places(sums, k)):
            if len(places):
                yield lo + i, [row["doc_ids"][p] for p in places], values(sums[:, i], places)


def search(index: DataFrame, n: int, asked: DataFrame, k: int, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item; ``asked`` is (item_id, term, times).

    Items are broadcast, in rounds by the hash of their ids so that ``most`` terms go at a time, about. A task keeps the k
    best of each item over its blocks; ranks are given to those.
    """
    session = index.sparkSession
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))
    known = written(asked.join(df, "term").select("item_id", "term", "times", weight.cast("long").alias("w")))
    rounds = -(-known.count() // most) or 1
    found = None
    for part in range(rounds):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == part).collect()
        by_item: dict[int | None, list[tuple[str, int, int]]] = defaultdict(list)
        for r in rows:
            by_item[r.item_id].append((r.term, r.times, r.w))
        one = _round(index, session.sparkContext.broadcast((list(by_item), list(by_item.values()))), k)
        found = one if found is None else found.unionAll(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _round(index: DataFrame, shared, k: int) -> DataFrame:
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items = shared.value
        kept: dict[int, list] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                for i, ids, scores in searched(row, items, k):
                    kept[i] = sorted([*kept[i], *((-int(s), d is None, d) for s, d in zip(scores, ids, strict=True))], key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        told = [(names[i], d, -s) for i, rows in kept.items() for s, _, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*told, strict=True) if told else ([], [], []))], schema=schema)

    return index.drop("counts").mapInArrow(best, "item_id long, doc_id long, score long")


def terms_of_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times)."""
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(words_of(F.col(text_col))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def ranked(documents: DataFrame, items: DataFrame, k: int = 20, per_block: int = DOCUMENTS, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's k highest-scoring documents with a score above 0.

    Null and empty texts have no terms; documents without terms don't count. Repeated documents are rows each, ranked each.
    Equal scores go by ascending doc_id, null ids last. Items that share an id, null among them, are one item with the
    terms of all their texts. An item without matches has no row; an empty table of either kind gives an empty result.
    Other columns are ignored. The index holds the items' terms where these are ``most`` at most, else all terms.
    """
    asked = written(terms_of_items(items))
    terms = asked.select("term").distinct().limit(most + 1).collect()
    index, n, _ = build(documents, {r.term.encode() for r in terms} if len(terms) <= most else None, per_block)
    return search(index, n, asked, k, most)


WORD = GAP.replace("[", "[^")
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM d),
p AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(w) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN totals GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, rn, doc_id, sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN p USING (term) JOIN d USING (rn) CROSS JOIN totals GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def ranked_lexical_search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The production query."""
    return ranked(documents, items)
