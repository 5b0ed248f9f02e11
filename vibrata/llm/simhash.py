"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints that differ in at most ``tau`` bits must, for any partition of the bits with thresholds t_i such that
sum(t_i + 1) = tau + 1, differ in at most t_i bits of some part i. Bits that go together are put into one part; the
thresholds are allotted by dynamic programming on estimated numbers of candidates; each fingerprint probes the keys
within t_i bits of its own in every part, candidates are verified, and links become connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import binaries, carried, fields, quoted, unused
from vibrata.llm.components import components
from vibrata.operators.joins import looked_up
from vibrata.sources.scratch import written

BITS = 64
SAMPLE = 4096  # fingerprints from which correlations and candidate counts are estimated; the results don't depend on it
PROBE_COST, VERIFY_COST = 1.0, 0.002  # of one probe row and one verification, relative
BLOCK, BLOCKS = 1 << 18, 16  # rows of a block, at most about, and blocks of a small table, for near-dedup by similarity
TILE = [("i", np.int32), ("j", np.int32), ("own", bool), ("row", np.int64), ("fp", np.int64), ("size", np.int64)]  # what a tile holds
SKETCH = ["s0", "s1", "s2", "s3"]  # longs of 16 minwise values of 4 bits each
MINWISE = np.random.default_rng(64).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # odd multipliers
#: Equal values of 64 that a sketch needs: sets as similar as 0.8 have 52 on average, and fewer than 40 once in ten thousand times.
AGREEING = 40
DEGREE = 32  # candidates in a key up to which all of a node's are kept at first; the others are asked where they connect what is apart
NODES, HASHES = 1 << 14, 1 << 21  # texts and hashes of a block of a class, at most about; a task compares two blocks
RECALL = 0.95  # of pairs that are just as similar as asked, for the choice of a radius


def digests(words: list[bytes], shingle: int, seed: int = 42):
    """Hashes of the shingles of some words, repeats included, in blocks that bound the memory of very long texts."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        if words:
            yield np.array([digest(joined, seed)], np.uint64)
        return
    starts = np.zeros(len(words), np.int64)
    np.cumsum(np.fromiter(map(len, words[:-1]), np.int64, len(words) - 1) + 1, out=starts[1:])
    ends = np.append(starts[1:] - 1, len(joined))[shingle - 1 :].tolist()
    starts = starts.tolist()
    for lo in range(0, len(ends), 1 << 15):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)], strict=False)], np.uint64)


def majority(blocks) -> int:
    """The bits that are set in over half of some hashes; of none, 0."""
    total, n = np.zeros(BITS, np.int64), 0
    for block in blocks:
        total += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Majority of the bits of the shingles' hashes; a text without words gives 0."""
    return majority(digests(text.lower().split(), shingle, seed))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``__row``, id and ``fp`` (the fingerprint as a signed long) of every row, in one narrow pass over whole texts."""

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t, shingle) for t in binaries(b, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*carried(b, ["__row", "__id"]), pa.array(values)], ["__row", "__id", "fp"])

    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, f"__row bigint, __id {kind}, fp bigint")


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1; column i is the bit of value 2**i."""
    return ((fps.view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int8)


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each grown from a seed by the strongest mean correlation."""
    if len(bits) > 1:
        centred = bits - bits.mean(0)
        spread = np.sqrt((centred**2).mean(0)) + 1e-9
        together = np.abs(centred.T @ centred / len(bits) / np.outer(spread, spread))
    else:
        together = np.zeros((BITS, BITS))
    np.fill_diagonal(together, 0)
    left, found = list(range(BITS)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        own = [max(left, key=lambda i: (together[i, left].sum(), -i))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda i: (together[i, own].mean(), -i))
            own.append(best)
            left.remove(best)
        found.append(sorted(own))
    return found


def allotted(bits: np.ndarray, parts: list[list[int]], tau: int, n: int) -> tuple[list[int], float]:
    """Thresholds (-1: part not probed) of least estimated cost over ``n`` fingerprints, by dynamic programming.

    Candidates are estimated from pairs of the sample, together with what independent bits would give.
    """
    half = len(bits) // 2
    left, right = bits[:half], bits[half : 2 * half]
    costs = []
    for part in parts:
        width, row = len(part), [0.0]
        ball, chance, share = 0.0, 0.0, np.zeros(tau + 1)
        if half:
            for shift in range(1, min(half, 200) + 1):
                near = (left[:, part] != np.roll(right, shift, 0)[:, part]).sum(1)
                share += np.bincount(np.minimum(near, tau + 1), minlength=tau + 2)[: tau + 1]
            share = share.cumsum() / (half * min(half, 200))
        for t in range(tau + 1):
            ways = float(np.prod([(width - k) / (k + 1) for k in range(t)])) if t <= width else 0.0
            ball += ways
            chance += ways * 2.0**-width
            row.append(PROBE_COST * n * ball + VERIFY_COST * n * n / 2 * max(share[t], chance))
        costs.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units in range(tau + 2 - used):
                option = (cost + row[units], [*chosen, units - 1])
                if used + units not in after or option < after[used + units]:
                    after[used + units] = option
        best = after
    cost, thresholds = best[tau + 1]
    return thresholds, cost


def plan(sample: np.ndarray, tau: int, n: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of the least estimated cost, over several numbers of parts."""
    bits = bit_matrix(sample)
    options = []
    for count in range(max(2, (tau + 4) // 4), tau + 2):
        parts = correlated_parts(bits, count)
        thresholds, cost = allotted(bits, parts, tau, n)
        options.append((cost, count, [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0]))
    return min(options)[2]


def probes(fp: Column, parts: list[tuple[list[int], int]]) -> Column:
    """Array of (part, key, own): the fingerprint's own key in every part, and those at 1 to t flipped bits.

    A pair is met from one side at least when one of the two keeps its own key, so only own keys are an index.
    """
    rows = []
    for number, (part, threshold) in enumerate(parts):
        mask = sum(1 << b for b in part)
        key = fp.bitwiseAND(F.lit(signed(mask)))
        for flips in range(threshold + 1):
            for flip in combinations(part, flips):
                moved = key.bitwiseXOR(F.lit(signed(sum(1 << b for b in flip)))) if flip else key
                rows.append(F.struct(F.lit(number).alias("part"), moved.alias("key"), F.lit(not flip).alias("own")))
    return F.array(*rows)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def forest(fps: np.ndarray, tau: int) -> np.ndarray:
    """Edges (k, 2) of a spanning forest of the graph that links fingerprints differing in at most ``tau`` bits.

    A search takes what it reaches off the list of the unvisited, so dense groups take time near their size.
    """
    unvisited, edges = fps.copy(), []
    while len(unvisited):
        queue, unvisited = [unvisited[0]], unvisited[1:]
        while queue and len(unvisited):
            at = queue.pop()
            near = np.bitwise_count(unvisited ^ at) <= tau
            if near.any():
                reached = unvisited[near]
                edges += [(at, x) for x in reached]
                queue += list(reached)
                unvisited = unvisited[~near]
    return np.array(edges, np.uint64).reshape(-1, 2)


def bucket_edges(own: np.ndarray, visiting: np.ndarray, tau: int) -> np.ndarray:
    """Links of one key's bucket, thinned to a forest: between its owners, and between owners and visitors."""
    return forest(np.unique(np.concatenate([own, visiting])), tau)


def links(distinct: DataFrame, tau: int, parts: list[tuple[list[int], int]], block: int = 4096) -> DataFrame:
    """Verified links (a, b) that connect all that links of at most ``tau`` bits connect; copies may repeat.

    Rows of a key are dealt to ``tiles``: a key of many fingerprints is a square of blocks, and a row goes to the tiles
    of its block with each other one, so no task holds more than two blocks of a key.
    """
    rows = distinct.select("fp", F.explode(probes(F.col("fp"), parts)).alias("p")).select("fp", "p.part", "p.key", "p.own")
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("own"), 1)).alias("owners"))
    useful = sizes.where("owners > 0 and size > 1").select("part", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    met = rows.join(useful, ["part", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))))
    tiled = met.withColumn("tile", tile).select("part", "key", "tile.i", "tile.j", "fp", "own")
    dealt = tiled.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            columns = [carried(b, [c])[0].to_numpy(zero_copy_only=False) for c in ("part", "key", "i", "j", "fp", "own")]
            held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            out, held = settle(held, tau, last=False)
            yield from out
        if held:
            yield from settle(held, tau, last=True)[0]

    return dealt.mapInArrow(run, "a bigint, b bigint")


def settle(held: list[np.ndarray], tau: int, last: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
    """Links of the buckets that are complete, and the rows of the one that may go on."""
    part, key, i, j, fp, own = held
    n = len(fp)
    if not n:
        return [], held
    new = np.ones(n, bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.flatnonzero(new)
    if not last:
        done, rest = starts[-1], [x[starts[-1] :] for x in held]
        starts = starts[:-1]
    else:
        done, rest = n, []
    if not len(starts):
        return [], rest
    fps, own = fp[:done].view(np.uint64), own[:done].astype(bool)
    lengths = np.diff(np.append(starts, done))
    found = [np.zeros((0, 2), np.uint64)]
    # Small buckets, all at once: compare each row with those that follow it at distance 1, 2, ... in its bucket.
    end = np.repeat(starts + lengths, lengths)
    small = np.repeat(lengths <= 32, lengths)
    for step in range(1, int(lengths[lengths <= 32].max(initial=1))):
        at = np.flatnonzero(small[: done - step] & (np.arange(done - step) + step < end[: done - step]))
        at = at[(own[at] | own[at + step]) & (np.bitwise_count(fps[at] ^ fps[at + step]) <= tau)]
        found.append(np.stack([fps[at], fps[at + step]], 1))
    for s, k in zip(starts[lengths > 32], lengths[lengths > 32], strict=True):
        piece, mine = fps[s : s + k], own[s : s + k]
        found.append(bucket_edges(piece[mine], piece[~mine], tau))
    edges = np.concatenate(found)
    edges = edges[edges[:, 0] != edges[:, 1]].view(np.int64)
    return [pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])], rest


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4) -> DataFrame:
    """One row per input row: ``__row``, id, ``fp``, component_id (the smallest id reachable by links), ``__first``.

    Fingerprints link at ``tau`` or fewer differing bits, so rows with equal fingerprints link; texts without words,
    null texts included, have fingerprint zero and link like any other. Fewer words than a shingle make one shingle.
    Null ids come last in a component; if all are null so is component_id. ``__first`` is the ``__row`` of the row with
    the component's smallest id, the first of repeated ones. An empty table gives an empty result; columns other than
    the two named are ignored.
    """
    rows = written(fingerprints(documents, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("first")
    distinct = written(rows.groupBy("fp").agg(first))
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    pairs = links(distinct.select("fp"), tau, plan(sample, tau, max(n, 1)))
    member = components(written(pairs.distinct()), "a", "b")  # (node, root) of linked fingerprints only
    rooted = distinct.join(member, distinct.fp == member.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Written first, so that the join's two sides are plain exchanges and the fingerprints of a large component can be split.
    best = written(rooted.groupBy("root").agg(F.min("first").alias("best")))
    lookup = rooted.join(best, "root").select("fp", "best")
    # One row per fingerprint on the right, so a hot fingerprint is spread by splitting the left side alone.
    return rows.join(lookup, "fp").select("__row", F.col("__id").alias(id_col), "fp", F.col("best.__id").alias("component_id"), F.col("best.__row").alias("__first"))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; fewer words than a shingle make one, none make none."""
    blocks = list(digests(text.lower().split(), shingle))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Four longs: 4 bits of the least of a set's hashes under each of 64 multipliers; of the empty set, zeros."""
    least = np.full(64, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[lo : lo + (1 << 12), None] * MINWISE).min(0), out=least)
    nibbles = (least >> np.uint64(24)) & np.uint64(15) if len(hashes) else np.zeros(64, np.uint64)
    return np.bitwise_or.reduce(nibbles.reshape(4, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1)


def disagreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of 64 values sketches (..., 4) don't have in common."""
    apart = a ^ b
    apart = apart | (apart >> np.uint64(1))
    apart = (apart | (apart >> np.uint64(2))) & np.uint64(0x1111111111111111)
    return np.bitwise_count(apart).sum(-1, dtype=np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches have AGREEING values in common."""
    return 64 - disagreeing(a, b) >= AGREEING


def radius(similarity: float, recall: float = RECALL) -> int:
    """Bits in which fingerprints of sets of one size and this similarity differ at most, in a share ``recall`` of cases.

    A bit differs with the angle between the sets over pi; bits count as independent.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total, tau = 0.0, -1
    while total < recall and tau < BITS - 1:
        tau += 1
        total += math.comb(BITS, tau) * share**tau * (1 - share) ** (BITS - tau)
    return max(tau, 0)


def lightest_forest(fps: np.ndarray, sizes: np.ndarray, tau: int, similarity: float, sketches: np.ndarray | None = None) -> np.ndarray:
    """Edges (k, 2), as places, of a minimum spanning forest over bit distances up to ``tau``, grown from node to node.

    With sketches the weight of an edge is what tells most about similarity: twice the values that differ, and the bits.
    Sets whose sizes alone keep them from being as similar as ``similarity``, or whose sketches don't agree, have no edge.
    Memory is linear in the nodes.
    """
    n = len(fps)
    least_alike = 2 * (64 - AGREEING) if sketches is not None else 0
    away, via, free, edges = np.full(n, tau + least_alike + 1, np.uint8), np.zeros(n, np.int64), np.ones(n, bool), []
    alike = not n or sizes.min() >= similarity * sizes.max() - 1e-9
    at = 0
    for _ in range(n - 1):
        free[at], away[at] = False, 255
        apart = np.bitwise_count(fps ^ fps[at])
        closer = (apart <= tau) & (apart < away) & free
        if not alike:
            closer &= np.minimum(sizes, sizes[at]) >= similarity * np.maximum(sizes, sizes[at]) - 1e-9
        if sketches is not None:
            some = np.flatnonzero(closer)
            differ = disagreeing(sketches[some], sketches[at])
            apart[some] += (2 * differ).astype(np.uint8)
            closer[some] = (differ <= 64 - AGREEING) & (apart[some] < away[some])
        np.copyto(away, apart, where=closer)
        via[closer] = at
        at = int(away.argmin())
        if away[at] <= tau + least_alike:
            edges.append((via[at], at))
    return np.array(edges, np.int64).reshape(-1, 2)


def spanning(pairs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Those of some pairs (k, 2) that make a spanning forest, the lightest by ``weights``: fewer than the nodes, and they connect what all do."""
    if weights is not None:
        pairs = pairs[np.argsort(weights, kind="stable")]
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends, root, taken, left = ends.reshape(-1, 2), np.arange(len(nodes)), [], np.arange(len(pairs))
    while True:
        tops = root[ends[left]]
        left, tops = left[tops[:, 0] != tops[:, 1]], tops[tops[:, 0] != tops[:, 1]]
        if not len(left):
            return pairs[np.unique(np.concatenate([left, *taken]))]
        # Every tree takes the first pair that leaves it, whichever end it is; two that take the same pair are the only circles.
        mine, at = np.unique(tops.ravel(), return_index=True)
        at //= 2
        taken.append(left[at])
        root[mine] = tops[at].sum(1) - mine
        both = mine[(root[root[mine]] == mine) & (mine < root[mine])]
        root[both] = both
        while (root != root[root]).any():
            root = root[root]


def key_links(fps: np.ndarray, sizes: np.ndarray, own: np.ndarray, visiting: np.ndarray, tau: int, similarity: float, sketches: np.ndarray | None = None, roots: np.ndarray | None = None, degree: int = DEGREE) -> Iterator[np.ndarray]:
    """Links (k, 2) of places: a key's owners with its visitors, where bits, sizes and sketches allow that they are alike.

    All links are kept of nodes that have ``degree`` or fewer in the key, so that the texts decide on each; those among the
    others, which lie in dense groups, are thinned to a minimum spanning forest of bit distances. With ``roots``, the
    components that confirmed links have made, nothing is thinned: all links are given whose ends have different roots.
    """

    def met(visiting: np.ndarray, own: np.ndarray, lo: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        v, o = np.nonzero(np.bitwise_count(fps[visiting[lo : lo + step], None] ^ fps[None, own]) <= tau)
        v += lo
        a, b = visiting[v], own[o]
        # In a block's tile with itself owners visit too, and meet themselves.
        good = (a != b) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9)
        if roots is not None:
            good &= roots[a] != roots[b]
        v, o = v[good], o[good]
        if sketches is not None and len(v):
            good = agreeing(sketches[visiting[v]], sketches[own[o]])
            v, o = v[good], o[good]
        return v, o

    def steps(visiting: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max((1 << 20) // max(len(own), 1), 1)
        return (met(visiting, own, lo, step) for lo in range(0, len(visiting), step))

    if roots is not None:
        known, often = np.unique(np.concatenate([roots[own], roots[visiting]]), return_counts=True)
        if len(known) > 1:
            # Nodes of the key's largest component meet the others only, so a dense group that is one takes no squares.
            first = known[often.argmax()]
            inside, theirs = roots[visiting] == first, own[roots[own] != first]
            for guests, hosts in ((visiting[~inside], own), (visiting[inside], theirs)):
                for v, o in steps(guests, hosts):
                    yield np.stack([guests[v], hosts[o]], 1)
        return
    once = [*steps(visiting, own)] if len(own) * len(visiting) <= 1 << 20 else None
    by_owner, by_visitor = np.zeros(len(own), np.int64), np.zeros(len(visiting), np.int64)
    for v, o in once or steps(visiting, own):
        by_owner += np.bincount(o, minlength=len(own))
        by_visitor += np.bincount(v, minlength=len(visiting))
    for v, o in once or steps(visiting, own):
        few = (by_visitor[v] <= degree) | (by_owner[o] <= degree)
        yield np.stack([visiting[v[few]], own[o[few]]], 1)
    many = np.union1d(own[by_owner > degree], visiting[by_visitor > degree])
    if len(many):
        yield many[lightest_forest(fps[many], sizes[many], tau, similarity, None if sketches is None else sketches[many])]


def keyed(fps: np.ndarray, places: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their keys, the keys that occur, and where each begins and ends."""
    keys = fps[places] & np.uint64(mask)
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return places[order], found, np.append(starts, len(places))


def tile_links(fps: np.ndarray, sizes: np.ndarray, own: np.ndarray, visiting: np.ndarray, tau: int, parts: list[tuple[list[int], int]], similarity: float, sketches: np.ndarray | None = None, roots: np.ndarray | None = None, spanned: bool = False, degree: int = DEGREE) -> Iterator[np.ndarray]:
    """Links (k, 2) of places in a tile: in every part each owner's key is probed for visitors within its threshold.

    They are given out by about a million, so copies may repeat. If ``spanned``, only a spanning forest of the tile's links is.
    """
    found, held, most = [], 0, 1 << 20
    for part, threshold in parts:
        mask = sum(1 << b for b in part)
        flips = np.array([sum(1 << b for b in flip) for k in range(threshold + 1) for flip in combinations(part, k)], np.uint64)
        mine, keys, begins = keyed(fps, own, mask)
        guests, theirs, starts = keyed(fps, visiting, mask)
        step = max((1 << 20) // len(flips), 1)
        for lo in range(0, len(keys), step):
            probed = keys[lo : lo + step, None] ^ flips[None, :]
            at = np.minimum(np.searchsorted(theirs, probed), len(theirs) - 1)
            hit = theirs[at] == probed
            for k in np.flatnonzero(hit.any(1)):
                met = np.concatenate([guests[starts[x] : starts[x + 1]] for x in at[k, hit[k]]])
                for some in key_links(fps, sizes, mine[begins[lo + k] : begins[lo + k + 1]], met, tau, similarity, sketches, roots, degree):
                    found.append(some)
                    held += len(some)
                    if held > most and spanned:
                        found = [spanning(np.concatenate(found))]
                        held = len(found[0])
                        most = max(1 << 20, 2 * held)
                    elif held > most:
                        yield np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
                        found, held = [], 0
    if held:
        last = np.concatenate(found)
        yield spanning(last) if spanned else np.unique(np.sort(last, axis=1), axis=0)


def size_blocks(prints: DataFrame, blocks: int) -> DataFrame:
    """``prints`` (row, fp, size) with ``block``: ranges of sizes that hold about as many rows each, from 0 to blocks - 1.

    Rows of one size are spread by the hash of their fingerprint, so a frequent size may fill several blocks.
    """
    place = F.col("size") + F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    bounds = prints.select(F.percentile_approx(place, [k / blocks for k in range(1, blocks)], 100 * blocks).alias("x")).first().x if blocks > 1 else None
    if not bounds:
        return prints.withColumn("block", F.lit(0))
    return prints.withColumn("block", F.size(F.filter(F.lit([float(b) for b in bounds]), lambda b: b < place)))


def candidate_links(prints: DataFrame, tau: int, similarity: float, block: int = BLOCK, least: int = BLOCKS, thinned: bool = False, spanned: bool = False) -> DataFrame:
    """(a, b) rows of ``prints`` (row, fp, size and, if it has them, the longs of a sketch) whose fingerprints differ in at
    most ``tau`` bits and whose sketches agree; copies may repeat.

    They are all such links; if ``prints`` has a ``root`` of each row, those between rows of different roots, and if
    ``thinned``, fewer in dense groups (``key_links``), and if ``spanned`` a spanning forest of each tile's, fewer than its rows. Rows lie in blocks by the sizes of their sets, of at
    most about ``block`` rows, and a tile is a pair of blocks: a row goes only to tiles whose other block holds sizes
    that can be as similar as ``similarity``. Parts are probed inside a tile, so what is shuffled is a row for each
    block in reach, however many keys the plan probes; a task holds two blocks of numbers. Small tables are cut in
    ``least`` blocks (of 256 rows or more), to keep all cores busy.
    """
    n = prints.count()
    blocks = max(math.ceil(n / block), min(least, n // 256), 1)
    sample = np.array([r[0] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp", "row").limit(SAMPLE).collect()], np.int64)
    parts = plan(sample, tau, max(n // blocks, 1))
    placed = written(size_blocks(prints, blocks))
    # A row for each block, which are as many as the table has millions of rows, times four.
    ranges = sorted(tuple(r) for r in placed.groupBy("block").agg(F.min("size"), F.max("size")).collect())
    reach = [
        (k, min(k, m), max(k, m), float(similarity * lo - 1e-9), float(hi + 1e-9))
        for k, least_own, most_own in ranges for m, lo, hi in ranges
        if min(most_own, hi) >= similarity * max(least_own, lo) - 1e-9
    ]
    tiles = prints.sparkSession.createDataFrame(reach, "block int, i int, j int, lo double, hi double")
    met = looked_up(placed, tiles, ["block"]).where((F.col("size") >= F.col("lo")) & (F.col("size") * F.lit(float(similarity)) <= F.col("hi")))
    more, rooted = [c for c in SKETCH if c in prints.columns], [c for c in ("root",) if c in prints.columns]
    degree = DEGREE  # the driver's, for all tasks
    held_columns = [*TILE, *((c, np.int64) for c in (*rooted, *more))]
    dealt = met.select("i", "j", (F.col("block") == F.col("i")).alias("own"), "row", "fp", "size", *rooted, *more)
    dealt = dealt.repartition(max(len({r[1:3] for r in reach}), 1), "i", "j").sortWithinPartitions("i", "j")

    def run(batches):
        held: list[np.ndarray] = []

        def settled(last: bool):
            nonlocal held
            i, j, own, row, fp, size, *longs = held
            roots = longs.pop(0) if rooted else None if thinned else row
            sketches = np.stack(longs, 1).view(np.uint64) if longs else None
            new = np.ones(len(fp), bool)
            new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            starts = np.append(np.flatnonzero(new), len(fp))
            stop = len(starts) - (1 if last else 2)
            held = [] if last else [x[starts[stop] :] for x in held]
            for s, e in zip(starts[:stop], starts[1 : stop + 1], strict=True):
                mine = np.flatnonzero(own[s:e])
                others = mine if i[s] == j[s] else np.flatnonzero(~own[s:e])
                if len(mine) and len(others):
                    cut = [None if x is None else x[s:e] for x in (sketches, roots)]
                    for places in tile_links(fp[s:e].view(np.uint64), size[s:e], mine, others, tau, parts, similarity, *cut, spanned, degree):
                        edges = row[s:e][places]
                        yield pa.RecordBatch.from_arrays([pa.array(edges.min(1)), pa.array(edges.max(1))], ["a", "b"])

        for b in batches:
            columns = [carried(b, [c])[0].to_numpy(zero_copy_only=False).astype(t) for c, t in held_columns]
            held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            if len(held[0]):
                yield from settled(last=False)
        if held and len(held[0]):
            yield from settled(last=True)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def similar_links(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b: row numbers) whose texts' sets of shingles are as similar as asked, compared exactly.

    ``texts`` is (row, text). A link fetches its two texts; rows of the links are as many as linked texts, about.
    """

    def run(batches):
        for b in batches:
            left, right = binaries(b, "left"), binaries(b, "right")
            alike = [similarity_of(shingle_hashes(x, shingle), shingle_hashes(y, shingle)) >= similarity for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays(carried(b, ["a", "b"]), ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    left = links.join(texts.select(F.col("row").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("row").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a bigint, b bigint")


def class_places(nodes: DataFrame, members: int, hashes: int) -> DataFrame:
    """``nodes`` (class, root, row, size, ...) with the ``tile`` they meet others in, a row for each, and whether they are its ``left`` side.

    A class is cut in blocks of about ``members`` rows and ``hashes`` in their sets; a tile is a pair of blocks. A root that
    would fill a block lies in blocks of its own, which don't meet each other, so what is connected already takes no squares.
    """
    full = lambda n, size: F.greatest(F.ceil(n / members), F.ceil(size / hashes), F.lit(1)).cast("int")
    load = written(nodes.groupBy("class", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes")))
    # Each of these has a row for a block that is full, about; classes of one block, as nearly all are, have none.
    wide = load.where(full(F.col("n"), F.col("hashes")) > 1).select("class", "root", F.col("root").alias("of"))
    housed = lambda table: looked_up(table, wide, ["class", "root"], "left").withColumn("of", F.coalesce("of", F.lit(-1)))
    cells = written(housed(load).groupBy("class", "of").agg(full(F.sum("n"), F.sum("hashes")).alias("blocks")))
    cells = cells.join(cells.groupBy("class").agg(F.sum("blocks").alias("all")).where("all > 1"), "class").select("class", "of", "blocks")
    others = cells.select("class", F.col("of").alias("their_of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("their_block"))
    blocked = looked_up(housed(nodes), cells, ["class", "of"], "left").withColumn("block", F.pmod(F.xxhash64("row"), F.coalesce("blocks", F.lit(1))).cast("int"))
    met = looked_up(blocked, others, ["class"], "left").withColumn("their_of", F.coalesce("their_of", F.lit(-1))).withColumn("their_block", F.coalesce("their_block", F.lit(0)))
    met = met.where("of <> their_of or of = -1")
    mine, theirs = F.struct("of", "block"), F.struct(F.col("their_of").alias("of"), F.col("their_block").alias("block"))
    i, j = F.least(mine, theirs), F.greatest(mine, theirs)
    tile = F.concat_ws(" ", "class", i["of"], i["block"], j["of"], j["block"])
    return met.withColumn("tile", tile).withColumn("left", mine == i).withColumn("right", mine == j).select(*nodes.columns, "tile", "left", "right")


def class_edges(fps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, tau: int, similarity: float) -> list[tuple[int, int]]:
    """Links of places whose sets are as similar as asked, of a ``left`` and a ``right`` one, thinned to those that join different roots.

    All candidates (``tau`` bits, sizes, sketches) are compared by their whole sets, unless they are connected already.
    """
    _, label = np.unique(roots, return_inverse=True)
    members, flat = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = np.array([len(x) for x in sets])
    starts = np.cumsum(lengths) - lengths
    marked, edges, right = np.zeros(len(members), bool), [], np.flatnonzero(right)
    for x in np.flatnonzero(left):
        may = right[(label[right] != label[x]) & ((right > x) | ~left[right])]
        may = may[np.bitwise_count(fps[may] ^ fps[x]) <= tau]
        may = may[np.minimum(sizes[may], sizes[x]) >= similarity * np.maximum(sizes[may], sizes[x]) - 1e-9]
        may = may[agreeing(sketches[may], sketches[x])]
        if not len(may):
            continue
        own = flat[starts[x] : starts[x] + lengths[x]]
        marked[own] = True
        n, of = lengths[may], np.repeat(np.arange(len(may)), lengths[may])
        at = np.arange(len(of)) + (starts[may] - (np.cumsum(n) - n))[of]
        shared = np.bincount(of, marked[flat[at]], len(may))
        marked[own] = False
        both = n + lengths[x] - shared
        alike = may[np.divide(shared, both, out=np.ones(len(may)), where=both > 0) >= similarity]
        found, first = np.unique(label[alike], return_index=True)
        edges += [(x, y) for y in alike[first]]
        label[np.isin(label, found)] = label[x]
    return edges


def class_links(nodes: DataFrame, texts: DataFrame, shingle: int, tau: int, similarity: float, members: int = NODES, hashes: int = HASHES) -> DataFrame:
    """Links (a, b) that connect all that similar candidates in the classes of ``nodes`` (class, root, row, fp, size, a sketch) connect.

    ``texts`` is (row, text). A text is fetched once and its set goes to the tiles of its class, one for most, so rows
    are as many as nodes however many pairs of a class are candidates; the pairs are met inside the tasks.
    """

    columns = nodes.columns

    def hashed(batches):
        for b in batches:
            sets = [shingle_hashes(t, shingle).tobytes() for t in binaries(b, "text")]
            yield pa.RecordBatch.from_arrays([*carried(b, columns), pa.array(sets, pa.binary())], [*columns, "members"])

    def run(batches):
        tile, held = None, []

        def settled():
            row, fp, size, root, left, right, sets, *longs = zip(*held, strict=True)
            sketches = np.array(longs, np.int64).T.view(np.uint64)
            sets = [np.frombuffer(x, np.uint64) for x in sets]
            edges = class_edges(np.array(fp, np.int64).view(np.uint64), np.array(size), sketches, np.array(root), sets, np.array(left), np.array(right), tau, similarity)
            ends = np.array(row, np.int64)[np.array(edges, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["a", "b"])

        for b in batches:
            rows = [x.to_pylist() for x in carried(b, ["tile", "row", "fp", "size", "root", "left", "right", "members", *SKETCH])]
            for at, *values in zip(*rows, strict=True):
                if at != tile and held:
                    yield settled()
                    held = []
                tile = at
                held.append(values)
        if held:
            yield settled()

    kinds = ", ".join(f"`{n}` {t}" for n, t in nodes.dtypes)
    fetched = nodes.join(texts.select("row", "text"), "row").select(*columns, "text")
    placed = class_places(written(fetched.mapInArrow(hashed, f"{kinds}, members binary")), members, hashes)
    return placed.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a bigint, b bigint")


def near_deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tau: int | None = None) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id, with all its columns.

    Texts link when the sets of their ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more.
    Fingerprints of those sets find the candidates, at ``tau`` or fewer of 64 bits (by default the ``radius`` of the
    similarity), minwise sketches leave out those that are not alike by far, and the texts themselves decide: on a few
    candidates of each in dense groups first, then on all whose ends are still apart, so that groups are those of all candidates; of texts
    just as similar as asked about one pair in twenty has fingerprints further apart and is found through others only. Texts of
    the same words link, so null texts and texts without words are one group. Null ids come last in a group, and of
    repeated rows one stays. An empty table gives an empty result. Rows are written once with their number and
    fingerprint, so the result doesn't hang on the order in which rows come.
    """
    columns = documents.columns
    tau = radius(similarity) if tau is None else tau
    row, one, two, three, raw, *longs = unused(columns, "row", "fp", "words", "size", "raw_text", *SKETCH)

    def run(batches):
        for b in batches:
            prints, same, sizes, minwise = [], [], [], [np.zeros((0, 4), np.uint64)]
            for text in binaries(b, raw):
                hashes = shingle_hashes(text, shingle)
                prints.append(majority([hashes]))
                same.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7))
                sizes.append(len(hashes))
                minwise.append(sketch(hashes)[None])
            values = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, same, sizes)]
            values += [pa.array(x) for x in np.concatenate(minwise).view(np.int64).T.copy()]
            yield pa.RecordBatch.from_arrays([*carried(b, [*columns, row]), *values], [*columns, row, one, two, three, *longs])

    numbered = documents.select(*quoted(columns), F.monotonically_increasing_id().alias(row))
    if dict(documents.dtypes)[text_col] == "string":
        raw = text_col
    else:
        numbered = numbered.withColumn(raw, F.col(f"`{text_col}`").cast("string"))
    rows = written(numbered.mapInArrow(run, f"{fields(documents, columns)}, `{row}` bigint, `{one}` bigint, `{two}` bigint, `{three}` bigint, {', '.join(f'`{c}` bigint' for c in longs)}"))
    sketched = [F.col(c).alias(s) for c, s in zip(longs, SKETCH, strict=True)]
    narrow = rows.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(one).alias("fp"), F.col(two).alias("words"), F.col(three).alias("size"), *sketched)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # A row for each sequence of words, and of those one for each fingerprint and size; the rest hang on these.
    texts = written(narrow.groupBy("fp", "size", "words").agg(F.min(first).alias("first"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in SKETCH)))
    prints = written(texts.groupBy("fp", "size").agg(F.min(F.struct("row", *SKETCH)).alias("of")).select("of.row", "fp", "size", *(f"of.{c}" for c in SKETCH)))
    named = written(candidate_links(prints, tau, similarity, thinned=True).distinct())
    alike = texts.join(prints.select("fp", "size", F.col("row").alias("of")), ["fp", "size"]).where("row <> of").select(F.col("row").alias("a"), F.col("of").alias("b"))
    sources = rows.select(F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sure = written(similar_links(named.unionAll(alike), sources, shingle, similarity))
    member = components(sure, "a", "b")
    # What was thinned, or hangs on another text, is asked too where it would connect what is still apart: a class is what
    # such candidates connect, told by forests of them, as they may be the square of a dense group; its texts meet in tasks.
    apart = written(texts.join(member, texts.row == member.node, "left").select("row", "fp", "size", *SKETCH, F.coalesce("root", "row").alias("root")))
    rest = written(candidate_links(apart, tau, similarity, spanned=True))
    if not rest.isEmpty():
        classes = components(rest, "a", "b").select(F.col("node").alias("row"), F.col("root").alias("class"))
        more = class_links(apart.join(classes, "row"), sources, shingle, tau, similarity)
        member = components(sure.unionAll(more), "a", "b")
    rooted = texts.join(member, texts.row == member.node, "left").select("first", F.coalesce("root", "row").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("best")).select(F.col("best.row").alias(row))
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*quoted(columns))


def simhash_near_dedup(documents: DataFrame) -> DataFrame:
    """The production query."""
    return near_groups(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
