"""Byte-level BPE in linear time: exact merges by backtracking from longest matches.

The vocabulary's bytes are mapped to Latin-1, so that a pyahocorasick automaton over text finds the longest token at a
position; shorter ones follow from a table. A sequence of tokens is what the merges would give exactly when every two neighbours are
compatible: merging their bytes alone would leave just these two. So the encoder takes the longest token, checks it
against the one before (answers are remembered), and backtracks to shorter ones. Positions from which nothing fits are
never tried twice, which keeps the time linear.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import binaries, carried, fields, quoted, unused

REMEMBERED = 1_000_000  # pieces, and pairs of neighbours, that a worker keeps: about 200 MB
LONG = 1 << 20  # characters from which a text's pieces are taken in blocks
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges join last to make this token; None if they never make it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, tuple[bytes, bytes] | None]]:
    """Ranks, and the halves of every token that merges can reach (None for single bytes)."""
    ranks = read_ranks(path)
    missing = [i for i in range(256) if bytes([i]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    halves = {t: last_merge(t, ranks) for t in ranks}
    return ranks, {t: h for t, h in halves.items() if h or len(t) == 1}


class Pieces(dict):
    """Encoded pieces by text. When full it keeps its older half, where the frequent pieces are."""

    def __init__(self, encode, most: int = REMEMBERED):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                for old in list(islice(self, self.most // 2, None)):
                    del self[old]
            self[piece] = ids
        return ids


class Tokenizer:
    """Tokens are kept as Latin-1 text, a character for each byte."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[bytes, tuple[bytes, bytes] | None], pattern: str):
        text = lambda token: token.decode("latin-1")
        self.ranks = {text(t): i for t, i in ranks.items()}
        self.halves = {text(t): h and (text(h[0]), text(h[1])) for t, h in halves.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        #: The longest token that starts each path of the automaton, and the next shorter one that starts each token.
        self.longest: dict[str, str] = {}
        self.shorter: dict[str, str | None] = {}
        for token in self.halves:
            self.automaton.add_word(token, True)
        for token in self.halves:
            best = None
            for end in range(1, len(token) + 1):
                path = token[:end]
                if path in self.halves:
                    self.shorter[path], best = best, path
                self.longest[path] = best
        self.widest = max(map(len, self.halves))
        self.decimal = {t: b"%d" % i for t, i in self.ranks.items()}
        self.token_of = {b"%d" % i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces = Pieces(self.encode_piece)

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether the merges of the pair's joined bytes end in these two tokens.

        Take back the later of the two tokens' last merges, again and again (of equal ranks, the right one is later).
        A join across the border would have come before that merge if its rank is lower, or equal and to the left.
        """
        ranks, halves, (a, b), before, fits = self.ranks, self.halves, pair, NEVER, True
        while fits:
            fits = ranks.get(a + b, NEVER) >= before
            rank_a, rank_b = (ranks[t] if halves[t] else -1 for t in (a, b))
            if rank_a == rank_b == -1:
                break
            if rank_a > rank_b:
                before, a = rank_a, halves[a][1]
            else:
                before, b = rank_b + 1, halves[b][0]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[pair] = fits
        return fits

    def tokens(self, piece: bytes) -> list[str]:
        text = piece.decode("latin-1")
        if text in self.ranks:
            return [text]
        pairs, widest, reach, longest = self.pairs, self.widest, self.automaton.longest_prefix, self.longest
        n, at, tokens, dead = len(text), 0, [""], set()
        token = None
        while at < n:
            if token is None:
                ahead = text[at : at + widest]
                token = longest[ahead[: reach(ahead)]]
            last = tokens[-1]
            while token is not None:
                if at + len(token) not in dead:
                    if not last:
                        break
                    pair = (last, token)
                    fits = pairs.get(pair)
                    if fits or fits is None and self.compatible(pair):
                        break
                token = self.shorter[token]
            if token is not None:
                tokens.append(token)
                at += len(token)
                token = None
            else:
                dead.add(at)
                while token is None:  # go back to the last place that has a shorter choice
                    back = tokens.pop()
                    at -= len(back)
                    token = self.shorter[back]
                    if token is None:
                        dead.add(at)
        return tokens[1:]

    def encode_piece(self, piece: str) -> bytes:
        decimal = self.decimal
        return b",".join([decimal[t] for t in self.tokens(piece.encode())])

    def encode_blocks(self, text: str):
        """The ids of a text as decimal numbers joined by commas, in blocks of pieces."""
        if len(text) < LONG:
            yield b",".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        else:
            pieces = (m.group() for m in self.pattern.finditer(text))
            while block := list(islice(pieces, LONG)):
                yield b",".join(map(self.pieces.__getitem__, block))

    def encode(self, text: str) -> list[int]:
        return [int(i) for block in self.encode_blocks(text) if block for i in block.split(b",")]

    def decode_block(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids.split(b","))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_block(b",".join(b"%d" % i for i in ids))


def _tokenizers(documents: DataFrame, path: str, pattern: str):
    """A function that gives a task its tokenizer; the vocabulary's size bounds what is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast((*vocabulary(path), pattern))
    made: list[Tokenizer] = []

    def own() -> Tokenizer:
        if not made:
            made.append(Tokenizer(*shared.value))
        return made[0]

    return own


def encode(documents: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Every row with all its columns and the array of ids of its text; null and empty texts have none.

    Repeated rows get a row each, and an empty table gives an empty result. ``ids_col`` must be a new column.
    """
    own, names = _tokenizers(documents, path, pattern), documents.columns
    if ids_col in names:
        raise ValueError(f"there is a column {ids_col} already")
    (read,) = unused([*names, ids_col], "text_read")

    def run(batches):
        tokenizer = own()
        for b in batches:
            ids = [tokenizer.encode(t.decode("utf-8", "replace")) for t in binaries(b, read)]
            yield pa.RecordBatch.from_arrays([*carried(b, names), pa.array(ids, pa.list_(pa.int32()))], [*names, ids_col])

    source = documents.select(*quoted(names), F.col(f"`{text_col}`").cast("string").alias(read))
    return source.mapInArrow(run, f"{fields(documents, names)}, `{ids_col}` array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with all its columns and the bytes of its ids; a null array gives no bytes. Unknown ids fail.

    ``out_col`` must be a new column.
    """
    own, names = _tokenizers(encoded, path, pattern), encoded.columns
    if out_col in names:
        raise ValueError(f"there is a column {out_col} already")

    def run(batches):
        tokenizer = own()
        for b in batches:
            out = [tokenizer.decode(ids or []) for ids in carried(b, [ids_col])[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([*carried(b, names), pa.array(out, pa.binary())], [*names, out_col])

    return encoded.mapInArrow(run, f"{fields(encoded, names)}, `{out_col}` binary")


def round_trip(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the ids in decimal joined by commas, and of the decoded bytes.

    One narrow pass. Null and empty texts have no tokens (hashes of the empty string); repeated rows get a row each;
    an empty table gives an empty result; other columns are ignored. Long texts are read whole, in blocks of pieces.
    Bytes that aren't UTF-8 count as U+FFFD.
    """
    own = _tokenizers(documents, path, pattern)

    def run(batches):
        tokenizer = own()
        for b in batches:
            counts, encoded, decoded = [], [], []
            for text in binaries(b, "__text"):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for block in tokenizer.encode_blocks(text.decode("utf-8", "replace")):
                    if block:
                        ids_hash.update(b"," * (n > 0) + block)
                        text_hash.update(tokenizer.decode_block(block))
                        n += block.count(b",") + 1
                counts.append(n)
                encoded.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([*carried(b, ["__id"]), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
