"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the vocabulary's pattern; each piece is merged on
its own.  Over the byte positions of a piece stands a segment tree whose root
holds the leftmost minimum rank of all neighbouring pairs.  A merge takes the
root, joins two neighbours and updates the pairs of the live neighbours, each
in logarithmic time, so that even a piece of a megabyte is done in O(n log n).

Texts repeat their words, so a task keeps the results of pieces and of
blank-separated chunks in caches of bounded size, which it empties at its end;
pieces that are new in a batch and short are merged side by side, each in a tree
of its own.  Encoding and decoding back is one function, so that a task has one
Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from tidemark.llm.common import document_table, give_back

#: Entries of either cache, and the longest key that is kept.
CACHE_ENTRIES, CACHED_LENGTH = 600_000, 48

NONE = 1 << 62  # larger than any pair's key
#: Pieces up to this many bytes are merged side by side, longer ones alone.
SIDE_BY_SIDE = 64
#: Texts whose chunks are looked up together: so many, and of so many bytes unless one alone has more.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1024, 4 << 20
_TWO_BLANKS = regex.compile(r"\s\s")
_LATIN_END = "\u0250"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Merges pieces; a part is known by the rank of its bytes.

    A leaf of the segment tree holds ``rank * leaves + position`` of the pair
    that starts there, so that the root is the leftmost pair of least rank.
    """

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values(), default=0) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def one(self, piece: bytes) -> bytes:
        """A piece of any length, in O(n log n)."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return np.array([whole], dtype="<u4").tobytes()
        n, pairs, width = len(piece), self.pairs, self.width
        parts = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        leaves = 1 << max(1, (n - 2).bit_length())
        tree = [NONE] * (2 * leaves)
        for i in range(n - 1):
            rank = pairs.get(parts[i] * width + parts[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        following = list(range(1, n + 1))  # start of the next live part
        previous = list(range(-1, n - 1))

        def update(position: int) -> None:
            """Set the leaf of a live part, and what stands above it."""
            after = following[position]
            rank = pairs.get(parts[position] * width + parts[after]) if after < n else None
            put(position, NONE if rank is None else rank * leaves + position)

        def put(position: int, key: int) -> None:
            node = leaves + position
            tree[node] = key
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] != NONE:
            at, rank = tree[1] % leaves, tree[1] // leaves
            gone = following[at]
            following[at] = following[gone]
            if following[gone] < n:
                previous[following[gone]] = at
            parts[at] = rank
            put(gone, NONE) if gone < n - 1 else None
            update(at)
            if at:
                update(previous[at])
        out, start = [], 0
        while start < n:
            out.append(parts[start])
            start = following[start]
        return np.array(out, dtype="<u4").tobytes()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; -1 where they make no token."""
        wanted = left * self.width + right
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[found] == wanted, self.merged[found], -1)

    def same_length(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of one length from 2 bytes on, a tree for each, a merge of each at a time."""
        n, many = len(pieces[0]), len(pieces)
        leaves = 1 << max(1, (n - 2).bit_length())
        every = np.arange(many)
        # one column more than there are parts: it stands for the end
        parts = np.zeros((many, n + 1), dtype=np.int64)
        parts[:, :n] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8).reshape(many, n)]
        following = np.tile(np.arange(1, n + 2), (many, 1))
        previous = np.tile(np.arange(-1, n), (many, 1))
        live = np.ones((many, n), dtype=bool)
        tree = np.full((many, 2 * leaves), NONE, dtype=np.int64)
        ranks = self.rank_of(parts[:, : n - 1].ravel(), parts[:, 1:n].ravel()).reshape(many, n - 1)
        tree[:, leaves : leaves + n - 1] = np.where(ranks >= 0, ranks * leaves + np.arange(n - 1), NONE)
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows: np.ndarray, position: np.ndarray, keys: np.ndarray) -> None:
            node = leaves + position
            tree[rows, node] = keys
            node = node >> 1
            for _ in range(leaves.bit_length() - 1):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        def update(rows: np.ndarray, position: np.ndarray) -> None:
            after = following[rows, position]
            rank = self.rank_of(parts[rows, position], parts[rows, after])
            put(rows, position, np.where((rank >= 0) & (after < n), rank * leaves + position, NONE))

        rows = every[tree[:, 1] != NONE]
        while len(rows):
            root = tree[rows, 1]
            at = root % leaves
            gone = following[rows, at]
            after = following[rows, gone]
            parts[rows, at] = root // leaves
            following[rows, at] = after
            previous[rows, after] = at
            live[rows, gone] = False
            inner = gone < n - 1
            put(rows[inner], gone[inner], np.full(int(inner.sum()), NONE))
            update(rows, at)
            later = at > 0
            update(rows[later], previous[rows[later], at[later]])
            rows = rows[tree[rows, 1] != NONE]
        packed = parts[:, :n][live].astype("<u4").tobytes()
        ends = (live.sum(axis=1).cumsum() * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        lengths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > SIDE_BY_SIDE:
                out[i] = self.one(piece)
            else:
                lengths.setdefault(len(piece), []).append(i)
        for places in lengths.values():
            for i, packed in zip(places, self.same_length([pieces[i] for i in places])):
                out[i] = packed
        return out


class Coder:
    """Encoder and decoder of one vocabulary; ids are packed unsigned 32-bit."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        self.merger = Merger(ranks)
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Chunks of a text that may be matched apart.

        The pattern takes a single blank into the match that follows it, so a
        text without two adjacent white-space characters may be cut before each
        blank and each line feed without changing any match.
        """
        if _TWO_BLANKS.search(text):
            return self.pattern.findall(text)
        if "\0" in text:
            first, *rest = text.replace("\n", " \n").split(" ")
            return [first, *[part if part[:1] == "\n" else f" {part}" for part in rest]]
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def matches(self, chunk: str) -> list[str]:
        """The pattern's matches; a word of Latin letters, alone or before one sign, needs no search."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word and max(word) < _LATIN_END:
            if word.isalpha():
                return [chunk]
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not cached.

        A chunk that is one piece is kept as a chunk only, and found there when
        it is a piece of another one.
        """
        kept, parts = self.chunks, self.pieces
        cut = {chunk: self.matches(chunk) for chunk in chunks}
        pieces = {piece for found in cut.values() if len(found) > 1 for piece in found}
        known = {p: ids for p in pieces if (ids := parts.get(p) or kept.get(p)) is not None}
        new = list({c for c, found in cut.items() if len(found) == 1} | (pieces - known.keys()))
        known.update(zip(new, self.merger.many([piece.encode() for piece in new])))
        out = {c: b"".join([known[p] for p in found]) for c, found in cut.items()}
        parts.update((p, known[p]) for p in pieces if p not in out and len(p) <= CACHED_LENGTH)
        if len(parts) > CACHE_ENTRIES:
            parts.clear()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(text) for text in texts]
        known = self.chunks
        unknown = set(chain.from_iterable(cut)).difference(known)
        if unknown:
            known.update(self.learn(unknown))
        found = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for chunk in unknown:
            if len(chunk) > CACHED_LENGTH:
                del known[chunk]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        return found

    def decode(self, packed: bytes) -> bytes:
        return decoded(self.tokens, packed)


def decoded(tokens: Mapping[int, bytes], packed: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


class Vocabulary:
    """Ranks and pattern as sent to the executors."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        self.ranks, self.pattern = dict(ranks), pattern

    def coder(self) -> Coder:
        """A coder for one task: it is made in a fraction of a second, and nothing stays behind in the worker."""
        return Coder(self.ranks, self.pattern)


def _portions(batch: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch in portions of bounded size; null is empty."""
    texts, size = [], 0
    for value in batch:
        text = value.as_py() or ""
        if texts and (len(texts) == TEXTS_AT_ONCE or size + len(text) > BYTES_AT_ONCE):
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


def encoder(spark: SparkSession, vocabulary: Vocabulary):
    """Function of a text column: ids packed as little-endian unsigned 32-bit.

    Null and empty texts give no ids.
    """
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = shared.value.coder()
        try:
            for batch in batches:
                yield pa.array([ids for texts in _portions(batch) for ids in coder.encode(texts)], pa.binary())
        finally:
            del coder
            give_back()

    return encode


def round_trip(spark: SparkSession, vocabulary: Vocabulary):
    """Function of a text column: ``ids`` as of ``encoder``, and the bytes ``decoded`` from them."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("ids binary, decoded binary")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = shared.value.coder()
        try:
            for batch in batches:
                ids = [packed for texts in _portions(batch) for packed in coder.encode(texts)]
                decoded = pa.array([coder.decode(packed) for packed in ids], pa.binary())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])
        finally:
            del coder
            give_back()

    return code


def decoder(spark: SparkSession, vocabulary: Vocabulary):
    """Function of a column of packed ids: the bytes they stand for.

    Null and empty ids give no bytes; an id outside the vocabulary fails.
    """
    shared = spark.sparkContext.broadcast({rank: token for token, rank in vocabulary.ranks.items()})

    @F.arrow_udf(BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([decoded(shared.value, p.as_py() or b"") for p in batch], pa.binary())

    return decode


def n_tokens(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / 4)


def with_token_ids(df: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "token_ids") -> DataFrame:
    """Add the packed ids of ``text``; a column named ``into`` is replaced."""
    return df.withColumn(into, encoder(df.sparkSession, vocabulary)(df[text]))


def public_vocabulary() -> Vocabulary:
    """The vocabulary of the registered query, from the installed package."""
    import public_tokenizers

    return Vocabulary(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests; a null text is empty."""
    code = round_trip(spark, public_vocabulary())
    coded = document_table(spark, folder).select("doc_id", code(F.col("text")).alias("coded"))
    return coded.select(
        "doc_id",
        n_tokens(F.col("coded.ids")).alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )
