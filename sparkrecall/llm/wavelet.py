"""Token ids as wavelet matrices: one succinct structure per shard, written to and read from Parquet files.

A shard is a run of documents in ascending doc_id order with about `SHARD_TOKENS` ids. Its row holds one bit
plane for each bit of an id (packed), the counts of ones before every 512th bit, and the number of zeros of
each plane. With these, `WaveletMatrix` gives any token, counts an id in a range, and finds its places
without decoding the shard. A task writes its shards to one compressed file.

Defined results: a null or empty text holds the end id alone; repeated rows are documents of their own, side
by side, ordered by a hash of their texts; a null doc_id sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, slices, texts
from .tokens import encoder, tokenizer_path

END_ID = 2
SHARD_TOKENS = 1 << 21
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)

SHARD_SCHEMA = "part int, shard int, n_tokens long, bits int, doc_ids binary, doc_known binary, doc_lengths binary, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Access, rank, select and occurrences over the bit planes of a sequence."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        now, zeros, planes, ranks = ids.astype(kind), [], [], []
        for level in range(bits):
            ones = (now & kind(1 << (bits - 1 - level))).astype(bool)
            packed = np.packbits(ones)
            packed = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
            each = _ONES[packed].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(each)]).astype("<u4").tobytes())
            low = np.flatnonzero(~ones)
            zeros.append(len(low))
            now = now.take(np.concatenate([low, np.flatnonzero(ones)]))
        return cls(len(ids), zeros, planes, ranks)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        rows = np.pad(self.planes[level], (0, BLOCK // 8)).reshape(-1, BLOCK // 8)[block]
        bit = np.unpackbits(rows, axis=1) if len(rows) else np.zeros((0, BLOCK), np.uint8)
        within = np.arange(BLOCK)[None, :] < (at - block * BLOCK)[:, None]
        return self.ranks[level][block].astype(np.int64) + (bit.astype(bool) & within).sum(1)

    def access(self, at) -> np.ndarray:
        """The ids at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones_before(level, at)
            bit = (self.planes[level][at // 8] >> (7 - at % 8).astype(np.uint8)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = out * 2 + bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        low, high = start, end
        for level, zeros in enumerate(self.zeros):
            a, b = map(int, self._ones_before(level, np.array([low, high])))
            low, high = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in [start, end)."""
        if not 0 <= token < 1 << len(self.zeros):
            return 0
        low, high = self._range(token, start, self.n if end is None else end)
        return high - low

    def rank(self, token: int, at: int) -> int:
        return self.count(token, 0, at)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        own = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - before[block]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        at = self._range(token, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of an id, ascending: its run in the last plane's order is walked up, plane by plane at once."""
        if not 0 <= token < 1 << len(self.zeros):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(token, 0, self.n), dtype=np.int64)
        for level in range(len(self.zeros) - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (len(self.zeros) - 1 - level) & 1
            of_bit = np.flatnonzero(self._bits(level) == bool(bit))
            at = of_bit[at - self.zeros[level] if bit else at]
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        bits = len(self.zeros)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            ones, zeros = self._bits(level), self.zeros[level]
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~ones)] = now[:zeros]
            up[np.flatnonzero(ones)] = now[zeros:] | kind(1 << (bits - 1 - level))
            now = up
        return now


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes whole texts, each followed by end_id, and writes them as wavelet matrices in ascending doc_id order.

    The range partitioning by doc_id, then by a hash of the text (so that rows that share an id, or have none, can be
    dealt to many tasks), is the only shuffle; a task holds one shard at a time, and a shard ends at
    the first document boundary at or after `shard_tokens` ids.
    """
    tokenizer = tokenizer or tokenizer_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        bits = max(code.tokenizer.get_vocab_size(), end_id + 1).bit_length()
        part, number, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"), bits)
            row = {
                "part": part, "shard": number, "n_tokens": m.n, "bits": bits,
                "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "doc_known": np.packbits([i is not None for i in ids]).tobytes(),
                "doc_lengths": (np.fromiter(map(len, held), "<i8", len(held)) // 4).tobytes(),
                "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for part_ids, texts_ in (s.columns for batch in batches for s in slices(batch, 1)):
            for doc_id, text in zip(part_ids.to_pylist(), texts_.to_pylist()):
                ids.append(doc_id)
                held.append(code.ids(text) + end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield shard()
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield shard()

    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the planes: doc_id, start, n_tokens and the checksum of its ids.

    A shard's first position comes from a running sum over the shards of its file, and one over the files' totals: a
    number for each task that wrote.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                known = np.unpackbits(np.frombuffer(row["doc_known"], np.uint8), count=len(lengths)).astype(bool)
                ids = _matrix(row).decode().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), row["part"], np.int32)), pa.array(np.full(len(lengths), row["shard"], np.int32)),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=~known), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    own = shards.mapInArrow(read, "part int, shard int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    narrow = shards.select("part", "shard", "n_tokens")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = narrow.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    firsts = narrow.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("within")).join(files, "part")
    firsts = firsts.select("part", "shard", (F.col("base") + F.col("within")).alias("first"))
    return own.join(firsts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """part, shard, n: occurrences of an id, by rank alone; shards without it are left out."""

    def count(batches):
        for batch in batches:
            rows = [(r["part"], r["shard"], _matrix(r).count(token)) for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["part", "shard", "n"])

    return shards.mapInArrow(count, "part int, shard int, n long").filter("n > 0")


def locate_token(shards: DataFrame, token: int) -> DataFrame:
    """part, shard, at: each place of an id within its shard."""

    def find(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                at = _matrix(row).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["part"], np.int32)), pa.array(np.full(len(at), row["shard"], np.int32)), pa.array(at)], names=["part", "shard", "at"])

    return shards.mapInArrow(find, "part int, shard int, at long")


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "wavelet")
    write_shards(documents(spark, sf_dir), path)
    return read_documents(read_shards(spark, path))
