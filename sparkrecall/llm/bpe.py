"""Byte-level BPE encoding and decoding with a segment tree over the byte positions of each match.

A text is split by the vocabulary's pattern, and each match is merged by itself. Byte position i of a match holds the rank of the
pair made of the part that begins there and the part behind it, none if there is no such token. A segment tree over
the positions keeps the least rank of each node's stretch; where both halves tie, the walk down goes left, so the tree
names the leftmost pair of the least rank. A merge takes its second part out and changes three positions at most: its own,
that of the part before it and that of the part taken out. Each change walks up the tree until a node stays as it was.

Matches met before are remembered by a worker, within a bound. A text of over `PART_CHARS` characters is split piece by
piece, so that its matches never stand in one list.

Defined results: a null or empty text has no ids; repeated rows have a row each; ids of a null doc_id come with that; an
id that the vocabulary lacks can't be decoded and is an error; an empty table gives no rows; other columns are ignored.
A single match is held whole, at some 40 bytes a byte while it is merged.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
PART_CHARS = 1_000_000
#: Matches kept at most by one Python worker (about 100 MB), and the longest that is kept.
CACHE_MATCHES, CACHE_CHARS = 500_000, 64
#: Longer matches are merged in flat arrays instead of lists.
LONG = 2000
NONE = (1 << 31) - 1


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairTree:
    """A segment tree over positions: the least value of all, and the leftmost position that has it."""

    def __init__(self, values: list[int]):
        self.size = size = 1 << max(0, len(values) - 1).bit_length()
        tree = [NONE] * size + values + [NONE] * (size - len(values))
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        self.tree = tree if len(values) < LONG else array("i", tree)

    def leftmost(self) -> int:
        tree, size, k = self.tree, self.size, 1
        least = tree[1]
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        return k - size

    def put(self, at: int, value: int) -> None:
        tree, k = self.tree, self.size + at
        tree[k] = value
        while k > 1:
            k >>= 1
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left <= right else right
            if tree[k] == least:
                return
            tree[k] = least


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: always the leftmost pair of the least rank becomes one part, while any pair is a token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank = ranks.get
    tree = PairTree([rank(piece[i : i + 2], NONE) for i in range(n - 1)])
    nodes = tree.tree
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a position
    if n >= LONG:
        ends, before = array("q", ends), array("q", before)
    while nodes[1] != NONE:
        i = tree.leftmost()
        second = ends[i]
        end = ends[i] = ends[second]
        if second < n - 1:  # the last position holds no pair
            tree.put(second, NONE)
        if end < n:
            before[end] = i
            tree.put(i, rank(piece[i : ends[end]], NONE))
        else:
            tree.put(i, NONE)
        if i:
            p = before[i]
            tree.put(p, rank(piece[p:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class ByteBPE:
    """encode(): the ids of a text as little-endian unsigned 32-bit integers; decode(): the bytes that ids stand for."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {k: piece for piece, k in self.ranks.items()}
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}

    def matches(self, text: str) -> Iterable[str]:
        return self.pattern.findall(text) if len(text) <= PART_CHARS else (m[0] for m in self.pattern.finditer(text))

    def match(self, match: str) -> bytes:
        ids = array("I", merged(match.encode(), self.ranks)).tobytes()
        if len(match) <= CACHE_CHARS:
            if len(self.known) >= CACHE_MATCHES:
                self.known.clear()
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known = self.known.get
        return b"".join([known(m) or self.match(m) for m in self.matches(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str | None = None) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, binary) of each whole text."""
    ranks = ranks or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [code.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds `decoded`, the bytes that `ids` stand for, to the rows of `encode`."""
    ranks = ranks or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks)
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([code.decode(i) for i in part.column(2).to_pylist()], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op12_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(documents(spark, sf_dir)))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
