"""Language-model scoring by a gated recurrent network in numpy.

Word counts are gathered over the whole corpus by Spark. The most frequent words are the network's vocabulary; every
other word is a member of one of its rare-word buckets, and its probability is the bucket's, by the network, times its
smoothed share of the bucket, by the counts. The output softmax is factored into classes of equal size. Training is
truncated backpropagation; the production query learns from every training text: tasks train on their pieces of them
and the networks are averaged, round by round. Scoring carries the state over whole documents.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import binaries, carried, checkpointed, id_remainder

CLASSES, MEMBERS, RARE = 32, 32, 128  # classes of the softmax, words in each, and how many of the words are rare-word buckets
END = b" "  # the end of a text, as a token; no word holds a blank
KNOWN_WORDS = 1 << 18  # at most, of the most frequent words, whose counts each task has at hand; the others' are joined
HELD = 500_000  # distinct words that a counting task gathers before it passes them on
STEP = 256  # positions scored at once in every lane
SHARE, FEWEST = 1 / 8, 3000  # of the texts that the network learns from, where no share is named; of fewer texts than FEWEST in that share, more
PIECE, ROUNDS = 1 << 23, 3  # tokens of a task's piece, about, and rounds; a large piece is learned from by parts, one a round
WANTED = 3 << 20  # tokens that a task learns from at least in all rounds: texts of a smaller piece take part in several
LANE = 1 << 15  # tokens of a piece for each lane of its batches, of which it has 64 to 256
STRETCH = 4096  # positions of a text that follow each other in a lane when learning; a longer text is dealt in stretches


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def rare_bucket(word: bytes) -> int:
    """A rare word's bucket, by its ending and whether a sign follows it."""
    stem = word.rstrip(b".,;:!?")
    return zlib.crc32(stem[-2:]) % (RARE // 2) * 2 + (len(stem) < len(word))


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts, ends included; tasks combine before the shuffle."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def passed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for text in binaries(b, "__text"):
                held.update(tokens(text))
                if len(held) > HELD:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    return documents.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def count_level() -> Column:
    """The level of a count: sixteen to each doubling."""
    return F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")


def known_level(counts: DataFrame, most: int) -> int:
    """The lowest level such that no more than ``most`` words lie there or above: a count per level, no sort of words."""
    level = 64 * 16
    for at, n in sorted((tuple(r) for r in counts.groupBy(count_level().alias("level")).agg(F.count(F.lit(1))).collect()), reverse=True):
        most -= n
        if most < 0:
            break
        level = at
    return level


@dataclass
class Network:
    embed: np.ndarray  # (symbols + 1, dim); the last symbol starts a text
    w_in: np.ndarray  # (dim, 3 * hidden): update, reset, candidate
    b_in: np.ndarray
    w_state: np.ndarray  # (hidden, 3 * hidden)
    w_class: np.ndarray  # (hidden, classes)
    b_class: np.ndarray
    w_word: np.ndarray  # (classes, hidden, members)
    b_word: np.ndarray  # (classes, members)

    @property
    def start(self) -> int:
        return len(self.embed) - 1

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.w_in, self.b_in, self.w_state, self.w_class, self.b_class, self.w_word, self.b_word]


def lanes(docs: list[np.ndarray], most: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents dealt to lanes of about equal length: inputs, targets and document number, each (lane, position).

    The number of lanes is so low that the longest document does not outlast them. Positions after a lane's last
    document have the number ``len(docs)``.
    """
    lengths = [len(d) for d in docs]
    count = max(1, min(most, sum(lengths) // max(lengths)))
    heap, placed = [(0, i) for i in range(count)], []
    for d in sorted(range(len(docs)), key=lambda d: -lengths[d]):
        filled, lane = heapq.heappop(heap)
        placed.append((d, lane, filled))
        heapq.heappush(heap, (filled + lengths[d], lane))
    width = max(f for f, _ in heap)
    inputs, targets = np.full((count, width), start, np.int16), np.zeros((count, width), np.int16)
    number = np.full((count, width), len(docs), np.int32)
    for d, lane, at in placed:
        n = lengths[d]
        inputs[lane, at + 1 : at + n] = docs[d][:-1]
        targets[lane, at : at + n] = docs[d]
        number[lane, at : at + n] = d
    return inputs, targets, number


def untrained(counts: np.ndarray, hidden: int = 16, dim: int = 16, seed: int = 5) -> Network:
    """A network that is a unigram model: the output biases start at the symbols' ``counts`` in the whole corpus."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    mass = (counts + 0.5).reshape(CLASSES, MEMBERS)
    return Network(
        normal(CLASSES * MEMBERS + 1, dim, scale=0.3), normal(dim, 3 * hidden, scale=dim**-0.5), np.zeros(3 * hidden, np.float32),
        normal(hidden, 3 * hidden, scale=hidden**-0.5), np.zeros((hidden, CLASSES), np.float32), np.log(mass.sum(1) / mass.sum()).astype(np.float32),
        np.zeros((CLASSES, hidden, MEMBERS), np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
    )


@dataclass
class Learner:
    """A network with Adam's moments of its parameters; as one vector they can be sent and averaged."""

    network: Network
    first: list[np.ndarray]
    second: list[np.ndarray]
    steps: int = 0

    @classmethod
    def of(cls, network: Network) -> Learner:
        return cls(network, [np.zeros_like(p) for p in network.parameters()], [np.zeros_like(p) for p in network.parameters()])

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in [*self.network.parameters(), *self.first, *self.second]])

    def at(self, vector: np.ndarray, steps: int) -> Learner:
        """A learner of the same shape with these values."""
        shapes = [p.shape for p in self.network.parameters()]
        cut = np.split(vector.astype(np.float32), np.cumsum([np.prod(x) for x in shapes * 3])[:-1])
        parts = [x.reshape(shape) for x, shape in zip(cut, shapes * 3, strict=True)]
        k = len(shapes)
        return Learner(Network(*parts[:k]), parts[k : 2 * k], parts[2 * k :], steps)


def train_network(docs: list[np.ndarray], counts: np.ndarray, epochs: int = ROUNDS, seed: int = 5) -> Network:
    """A network fitted on these texts in this process."""
    learner = Learner.of(untrained(counts, seed=seed))
    for epoch in range(epochs):
        learn(learner, docs, (seed, epoch), last=epoch == epochs - 1)
    return learner.network


def part_of_round(docs: list[np.ndarray], k: int, rounds: int) -> list[np.ndarray]:
    """Those of a piece's texts that round ``k`` learns from: each text is there in one round at least, and in more, or all, of a piece below WANTED tokens."""
    times = min(max(math.ceil(WANTED / max(sum(map(len, docs)), 1)), 1), rounds)
    return [d for i, d in enumerate(docs) if (k - i) % rounds < times]


def learn(learner: Learner, docs: list[np.ndarray], seed: tuple[int, ...], last: bool, window: int = 24, lanes_: int = 64, rate: float = 6e-3) -> None:
    """One pass of truncated backpropagation through time with Adam; the state goes on from window to window."""
    docs = [d[lo : lo + STRETCH] for d in docs for lo in range(0, len(d), STRETCH)]
    if not docs:
        return
    rng, net, first, second = np.random.default_rng(seed), learner.network, learner.first, learner.second
    hidden = len(net.w_state)
    h2 = hidden * 2
    order = rng.permutation(len(docs))
    inputs, targets, number = lanes([docs[i] for i in order], lanes_, net.start)
    state = np.zeros((len(inputs), hidden), np.float32)
    for lo in range(0, inputs.shape[1], window):
        x, y, weigh = np.ascontiguousarray(inputs[:, lo : lo + window].T), targets[:, lo : lo + window].T.ravel(), (number[:, lo : lo + window] < len(docs)).T.ravel()
        keep = (x != net.start).astype(np.float32)[:, :, None]
        from_in = (net.embed @ net.w_in + net.b_in)[x]
        before, gates, n, candidate, states = (np.empty((*x.shape, k), np.float32) for k in (hidden, h2, hidden, hidden, hidden))
        for t in range(len(x)):
            h = np.multiply(state, keep[t], out=before[t])
            from_state = h @ net.w_state
            open_ = np.add(from_in[t, :, :h2], from_state[:, :h2], out=gates[t])
            np.exp(np.negative(open_, out=open_), out=open_)
            open_ += 1
            np.reciprocal(open_, out=open_)
            candidate[t] = from_state[:, h2:]
            np.tanh(from_in[t, :, h2:] + open_[:, hidden:] * candidate[t], out=n[t])
            state = np.add(n[t], open_[:, :hidden] * (h - n[t]), out=states[t])
        z, r = gates[..., :hidden], gates[..., hidden:]
        # Positions in the order of their targets' classes, so that a class is one product.
        c, m = y // MEMBERS, y % MEMBERS
        by_class = np.argsort(c, kind="stable")
        c, m, flat = c[by_class], m[by_class], states.reshape(-1, hidden)[by_class]
        scale = (weigh[by_class] / max(weigh.sum(), 1)).astype(np.float32)[:, None]
        at, bounds = np.arange(len(y)), np.searchsorted(c, np.arange(CLASSES + 1))

        def errors(p: np.ndarray, of: np.ndarray, scale: np.ndarray) -> np.ndarray:
            """Gradient of logits ``p``, in their place."""
            np.exp(p, out=p)
            p *= scale / (p @ np.ones((p.shape[1], 1), np.float32))
            p[at[: len(p)], of] -= scale[:, 0]
            return p

        p_class = errors(flat @ net.w_class + net.b_class, c, scale)
        g_flat = p_class @ net.w_class.T
        g_word, g_word_bias = np.zeros_like(net.w_word), np.zeros_like(net.b_word)
        for k in range(CLASSES):
            own = slice(bounds[k], bounds[k + 1])
            if own.start < own.stop:
                p_word = errors(flat[own] @ net.w_word[k] + net.b_word[k], m[own], scale[own])
                g_word[k], g_word_bias[k] = flat[own].T @ p_word, p_word.sum(0)
                g_flat[own] += p_word @ net.w_word[k].T
        g_states = np.empty_like(g_flat)
        g_states[by_class] = g_flat
        g_states = g_states.reshape(states.shape)
        # What a unit of a state's gradient pushes into candidate, update and, from the candidate's, reset.
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), candidate * r * (1 - r)
        push_in, push_state, back = np.empty_like(from_in), np.empty_like(from_in), np.ascontiguousarray(net.w_state.T)
        g_h = np.zeros_like(state)
        for t in reversed(range(len(x))):
            g_h += g_states[t]
            push = push_in[t]
            g_n = np.multiply(g_h, to_n[t], out=push[:, h2:])
            np.multiply(g_h, to_z[t], out=push[:, :hidden])
            np.multiply(g_n, to_r[t], out=push[:, hidden:h2])
            push_state[t, :, :h2] = push[:, :h2]
            np.multiply(g_n, r[t], out=push_state[t, :, h2:])
            g_h *= z[t]
            g_h += push_state[t] @ back
            g_h *= keep[t]
        g_state = before.reshape(-1, hidden).T @ push_state.reshape(-1, 3 * hidden)
        symbols = x.ravel()
        by_symbol = np.argsort(symbols, kind="stable")
        found, starts = np.unique(symbols[by_symbol], return_index=True)
        g_table = np.zeros((len(net.embed), 3 * hidden), np.float32)
        g_table[found] = np.add.reduceat(push_in.reshape(-1, 3 * hidden)[by_symbol], starts)
        state = state.copy()
        grads = [g_table @ net.w_in.T, net.embed.T @ g_table, g_table.sum(0), g_state, flat.T @ p_class, p_class.sum(0), g_word, g_word_bias]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        learner.steps += 1
        pace = rate * (0.3 if last else 1.0) * np.sqrt(1 - 0.999**learner.steps) / (1 - 0.9**learner.steps)
        for p, g, a, b in zip(net.parameters(), grads, first, second, strict=True):
            g *= clip
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (pace * a / (np.sqrt(b) + 1e-8)).astype(np.float32)


def train_apart(pieces: DataFrame, network: Network, rounds: int = ROUNDS, seed: int = 5) -> Network:
    """Each round every partition of ``pieces`` (ids: the symbols of a text) learns its part from where the last round ended, and
    the learners are averaged by their tokens, first in about as many tasks as the root of their number, then here."""
    spark, n = pieces.sparkSession, max(pieces.rdd.getNumPartitions(), 1)
    learner, kind = Learner.of(network), "piece int, tokens bigint, steps bigint, state binary"
    record = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["piece", "tokens", "steps", "state"])

    def average(rows):
        """(tokens, steps, state): the mean weighted by tokens, in the order of the rows."""
        tokens, steps, state = 0, 0, 0.0
        for _, k, taken, blob in rows:
            tokens, steps, state = tokens + k, max(steps, taken), state + k * np.frombuffer(blob, np.float32).astype(np.float64)
        return tokens, steps, state / tokens

    for k in range(rounds):
        shared = spark.sparkContext.broadcast((learner.vector(), learner.steps))

        def run(batches, shared=shared, k=k):
            docs = [np.frombuffer(x, np.int16) for b in batches for x in binaries(b, "ids")]
            if docs:
                piece, mine = TaskContext.get().partitionId(), Learner.of(network).at(*shared.value)
                whole, docs = sum(map(len, docs)), part_of_round(docs, k, rounds)
                learn(mine, docs, (seed, k, piece), last=k == rounds - 1, lanes_=min(max(whole // LANE, 64), 256))
                if docs:  # fewer texts than rounds leave some rounds without
                    yield record(piece, sum(map(len, docs)), mine.steps, mine.vector().tobytes())

        def merge(batches):
            rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
            if rows:
                tokens, steps, state = average(rows)
                yield record(rows[0][0], tokens, steps, state.astype(np.float32).tobytes())

        learned = pieces.select("ids").mapInArrow(run, kind).repartition(math.isqrt(n - 1) + 1).sortWithinPartitions("piece").mapInArrow(merge, kind)
        rows = sorted(tuple(r) for r in learned.collect())
        if rows:
            _, steps, state = average(rows)
            learner = learner.at(state, steps)
    return learner.network


def log_likelihoods(net: Network, docs: list[np.ndarray], most_lanes: int = 384) -> np.ndarray:
    """Natural log-likelihood of each whole document (its symbols, the end's last)."""
    inputs, targets, number = lanes(docs, most_lanes, net.start)
    hidden = len(net.w_state)
    table = net.embed @ net.w_in + net.b_in
    table[:, : 2 * hidden] *= -1  # signs are folded in, so that exp needs no negation
    w_state = net.w_state.copy()
    w_state[:, : 2 * hidden] *= -1
    total, h = np.zeros(len(docs) + 1), np.zeros((len(inputs), hidden), np.float32)
    for lo in range(0, inputs.shape[1], STEP):
        x, y = np.ascontiguousarray(inputs[:, lo : lo + STEP].T), targets[:, lo : lo + STEP].T.ravel()
        states = np.empty((len(x), len(inputs), hidden), np.float32)
        for t in range(len(x)):
            begins = x[t] == net.start
            if begins.any():
                h = np.where(begins[:, None], np.float32(0), h)
            from_in, from_state = table[x[t]], h @ w_state
            gates = from_in[:, : 2 * hidden] + from_state[:, : 2 * hidden]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            n = gates[:, hidden:] * from_state[:, 2 * hidden :]
            n += from_in[:, 2 * hidden :]
            np.tanh(n, out=n)
            h = h - n
            h *= gates[:, :hidden]
            h += n
            states[t] = h
        flat = states.reshape(-1, hidden)
        c, m = y // MEMBERS, y % MEMBERS
        to_class = flat @ net.w_class
        to_class += net.b_class
        found = to_class[np.arange(len(y)), c].astype(np.float64)
        np.exp(to_class, out=to_class)
        found -= np.log(to_class.sum(1))
        order = np.argsort(c, kind="stable")
        bounds = np.searchsorted(c[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            mine = order[bounds[k] : bounds[k + 1]]
            if len(mine):
                to_word = flat[mine] @ net.w_word[k]
                to_word += net.b_word[k]
                hit = to_word[np.arange(len(mine)), m[mine]].astype(np.float64)
                np.exp(to_word, out=to_word)
                found[mine] += hit - np.log(to_word.sum(1))
        total += np.bincount(number[:, lo : lo + STEP].T.ravel(), found, len(total))
    return total[:-1]


@dataclass
class Model:
    """What scoring needs; its size is fixed by KNOWN_WORDS and the network's shape."""

    words: list[bytes]  # the most frequent tokens, most frequent first
    counts: np.ndarray
    network: Network
    log_share: np.ndarray  # log10 of what a rare bucket's counts are divided by
    train_tokens: int
    distinct: int
    level: int  # ``words`` are all words of this level or above

    def vocabulary(self) -> int:
        return CLASSES * MEMBERS - RARE

    def symbols(self) -> np.ndarray:
        """The network's symbol of each known word: frequent words their rank, others their bucket."""
        own = self.vocabulary()
        return np.array([i if i < own else own + rare_bucket(w) for i, w in enumerate(self.words)], np.int16)


def encode(batch_tokens: list[bytes], index: dict[bytes, int], symbols: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A text's symbols, the places of its known words in the list of them, and its other words."""
    at = np.fromiter(map(index.get, batch_tokens, repeat(-1)), np.int32, len(batch_tokens))
    out = symbols[at] if len(symbols) else np.zeros(len(at), np.int16)
    others = [batch_tokens[i] for i in np.flatnonzero(at < 0)]
    if others:
        out[at < 0] = [own + rare_bucket(w) for w in others]
    return out, at[at >= 0], others


def fit(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", known_words: int = KNOWN_WORDS, share: float = SHARE, fewest: int = FEWEST, piece: int = PIECE) -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of all counts.

    Counts, vocabulary, biases and the shares in buckets come from all texts. The network's weights are fitted on a
    ``share`` of the texts, drawn by a hash of id and text (about ``fewest``, or all, where that would be fewer): whole
    texts, dealt to partitions of about ``piece`` tokens, whose number grows with the corpus.
    """
    counts = checkpointed(word_counts(documents, text_col))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    level = known_level(counts, known_words)
    top = counts.where(count_level() >= level).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = top["word"].to_pylist(), np.array(top["c"].to_pylist(), np.int64)
    model = Model(words, c, None, np.zeros(RARE), int(sums[0]), int(sums[1]), level)
    own = model.vocabulary()
    frequent = documents.sparkSession.sparkContext.broadcast(set(words[:own]))  # ``own`` words

    def bucket_sums(batches):
        n, v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for b in batches:
            for word, k in zip(binaries(b, "word"), carried(b, ["c"])[0].to_pylist(), strict=True):
                if word not in frequent.value:
                    bucket = rare_bucket(word)
                    n[bucket] += k
                    v[bucket] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(n), pa.array(v)], ["bucket", "n", "v"])

    rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
    for bucket, n, v in counts.mapInArrow(bucket_sums, "bucket bigint, n bigint, v bigint").groupBy("bucket").agg(F.sum("n"), F.sum("v")).collect():
        rare_n[bucket], rare_v[bucket] = n, v
    model.log_share = np.log10(rare_n + rare_v + 1)
    symbol_counts = np.zeros(own + RARE)
    symbol_counts[: min(own, len(c))] = c[:own]
    symbol_counts[own:] = rare_n
    ends = int(c[words.index(END)]) if END in words else 0
    shared = documents.sparkSession.sparkContext.broadcast((words, model.symbols(), own))

    def sampled(batches):
        known, symbols, own_ = shared.value
        index = {w: i for i, w in enumerate(known)}
        for b in batches:
            ids = [encode(tokens(t), index, symbols, own_)[0].astype(np.int16).tobytes() for t in binaries(b, "__text")]
            yield pa.RecordBatch.from_arrays([*carried(b, ["__key"]), pa.array(ids, pa.binary())], ["key", "ids"])

    share = min(1.0, max(share, fewest / max(ends, 1)))
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col).cast("string"), text, F.lit(3))
    drawn = documents.select(key.alias("__key"), text.alias("__text")).where(F.pmod("__key", F.lit(1 << 20)) < round(share * (1 << 20)))
    number = math.ceil(model.train_tokens * share / piece) or 1
    dealt = drawn.mapInArrow(sampled, "key bigint, ids binary").repartition(number, "key").sortWithinPartitions("key", "ids")
    model.network = train_apart(checkpointed(dealt), untrained(symbol_counts))
    return model, counts


def score(documents: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score.

    Whole texts are scored, null as the empty text, which is its end alone. Words that no training text has share one
    place in their bucket. Repeated rows get a row each; an empty table gives an empty result; without training texts
    every word is unknown. Columns other than the two named are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        m: Model = shared.value
        index, symbols, own = {w: i for i, w in enumerate(m.words)}, m.symbols(), m.vocabulary()
        logs = np.log10(m.counts + 1.0)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            docs, plain, known, rare_words, rare_rows, rare_counts = [], [], [], [], [], []
            texts = binaries(b, "__text")
            for i, text in enumerate(texts):
                ids, at, others = encode(tokens(text), index, symbols, own)
                docs.append(ids)
                plain.append(logs[at].sum())
                known.append(len(at))
                mine = Counter(others)
                rare_words += mine
                rare_counts += mine.values()
                rare_rows += [i] * len(mine)
                at_rare = at[symbols[at] >= own]
                # Known words in buckets have their share here; the divisor of all words in buckets follows below.
                known_share = logs[at_rare].sum()
                docs[-1] = (ids, known_share - m.log_share[ids[ids >= own] - own].sum())
            if not docs:
                continue
            network = log_likelihoods(m.network, [d[0] for d in docs]) / np.log(10) + np.array([d[1] for d in docs])
            n, k = len(docs), len(rare_words)
            rows = row + np.arange(n)
            row += n
            nothing = lambda x, t: pa.array(np.concatenate([x, np.zeros(k)]).astype(t))
            key = [b" %d" % r for r in rows] + rare_words
            ids_ = pa.concat_arrays([carried(b, ["__id"])[0], pa.nulls(k, b.schema.field("__id").type)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[np.array(rare_rows, int)]]).astype(np.int64)), pa.array(key, pa.binary()), ids_,
                    pa.array(np.concatenate([np.zeros(n), rare_counts]).astype(np.int64)), nothing([len(d[0]) for d in docs], np.int64), nothing(known, np.int64),
                    nothing(plain, np.float64), nothing(network, np.float64),
                ],
                ["row", "word", "id", "times", "n_tokens", "known", "plain", "network"],
            )

    source = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    flat = source.mapInArrow(run, f"row bigint, word binary, id {kind}, times bigint, n_tokens bigint, known bigint, plain double, network double")
    # A text's own row has a key of its own that no word equals, so it takes part in the join without piling up on null.
    other = counts.where(count_level() < model.level)
    joined = flat.join(other, "word", "left")
    gain = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    summed = joined.groupBy("row").agg(
        F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("plain") + gain).alias("plain"), F.sum(F.col("network") + gain).alias("score"),
    )
    divisor = float(np.log10(model.train_tokens + model.distinct + 1))
    return summed.select(
        id_col, "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("plain") - F.col("n_tokens") * divisor).alias("base_score"), "score",
    )


def lm_scoring(documents: DataFrame) -> DataFrame:
    """The production query: every document scored by a model of those whose crc32(doc_id) mod 7 is not 2."""
    held = id_remainder("doc_id", 7) == 2
    model, counts = fit(documents.where(~held), share=1.0)
    scored = score(documents, model, counts)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
