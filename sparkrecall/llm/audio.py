"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM.

Media bytes are WAV files held in a binary column. `decode` reads them whatever their code (8-bit mu-law or
A-law, 4-bit IMA ADPCM, 16-bit PCM, mono) and `store_pcm` writes them resampled as 16-bit PCM. ADPCM is a
recurrence along a block, so the loop runs over the samples of a block and numpy over all blocks at once.

The query stores each text's bytes as the samples of a mu-law file, writes those files to a Parquet table, reads
them back, resamples the decoded sound to PCM, writes that to a table too, and derives its features from the stored
PCM, from the same bytes decoded as A-law, and from the same bytes as ADPCM blocks.

Defined results: a null or empty text is one unit of padding; repeated rows have a row each, equal texts equal
values; a null doc_id stays null; an empty table gives no rows; bytes that are no WAV file decode to null; other
columns are ignored, and those of a media table are kept: one named like an added column is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, keep, slices, texts

RATE, UNIT, PAD = 8000, 576, 255
#: Samples a second of the query's PCM; files are compressed at this level of zstd.
QUERY_RATE, LEVEL = 4000, 9
#: Bytes of an ADPCM block of the query; a unit holds three.
ADPCM_BLOCK = 192

#: WAV format codes, and the step sizes and index changes of IMA ADPCM.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
        1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte, by the rule of G.711: inverted bits, segment, step, bias 33."""
    x = ~np.arange(256) & 255
    size = ((2 * (x & 15) + 33) << (x >> 4 & 7)) - 33
    return (np.where(x & 128, -size, size) * 4).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte, by the rule of G.711: every other bit inverted, segment, step."""
    x = np.arange(256) ^ 0x55
    segment, step = x >> 4 & 7, 2 * (x & 15) + 1
    size = np.where(segment, (step + 32) << np.maximum(segment - 1, 0), step)
    return (np.where(x & 128, size, -size) * 8).astype(np.int16)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, a row each: (n, bytes a block) of uint8 -> (n, samples a block) of int16.

    A block opens with its first sample (16 bits, little-endian), its step index and a byte unused; an index
    beyond the table counts as the last.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half in (0, 4):
            code = (codes[k] >> half & 15).astype(np.int32)
            step = IMA_STEPS[index]
            size = code & 7
            # the code's bits stand for step, step / 2 and step / 4, each rounded down, on top of step / 8
            change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + IMA_INDEX[size], 0, len(IMA_STEPS) - 1)
            out[1 + 2 * k + half // 4] = value
    return out.T


def write_wav(code: int, data: bytes, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file; `block` is the bytes of an ADPCM block."""
    bits = {PCM: 16, IMA: 4}.get(code, 8)
    align = {PCM: 2, IMA: block}.get(code, 1)
    extra = struct.pack("<H", 2 * (block - 4) + 1) if code == IMA else b""
    per_second = rate * block // (2 * (block - 4) + 1) if code == IMA else rate * align
    head = struct.pack("<HHIIHHH", code, 1, rate, per_second, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(code, rate, bytes a block, data) of a mono WAV file; None if it is none."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            code, channels, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            head = (code, rate, align) if channels == 1 else None
        elif name == b"data":
            return (*head, media[at + 8 : at + 8 + size]) if head else None
        at += 8 + size + size % 2
    return None


def samples(code: int, align: int, data: bytes) -> np.ndarray | None:
    """16-bit samples of a WAV file's data; None for an unknown code."""
    if code == MULAW:
        return mulaw_table()[np.frombuffer(data, np.uint8)]
    if code == ALAW:
        return alaw_table()[np.frombuffer(data, np.uint8)]
    if code == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    if code == IMA and align > 4:
        return decode_ima(np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, align)).reshape(-1)
    return None


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new sample times; going down, after a running mean over the ratio."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    x = pcm.astype(np.float64)
    if to < rate:
        width = -(-rate // to)
        total = np.concatenate([[0.0], np.cumsum(np.pad(x, (0, width - 1), "edge"))])
        x = (total[width:] - total[:-width]) / width
    at = np.arange(max(1, len(pcm) * to // rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(x)), x)).astype(np.int16)


def decode(table: DataFrame, media: str = "media", to: int = 16_000) -> DataFrame:
    """Adds `pcm` (little-endian 16-bit samples, resampled) and `seconds` to a table with WAV files; null for others."""

    def each(column: pa.Array) -> Iterator[tuple]:
        for value in column:
            found = read_wav(value.as_py())
            pcm = samples(found[0], found[2], found[3]) if found else None
            yield (None, None) if pcm is None else (resample(pcm, found[1], to).astype("<i2").tobytes(), len(pcm) / found[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, rows=64):
                rows = list(each(part.column(part.schema.get_field_index(media))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.float64())], names=[*part.schema.names, "pcm", "seconds"])

    if clash := {c.lower() for c in table.columns} & {"pcm", "seconds"}:
        raise ValueError(f"rename the columns {sorted(clash)}: decode adds its own")
    own = table
    added = [T.StructField("pcm", T.BinaryType()), T.StructField("seconds", T.DoubleType())]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *added]))


def store_pcm(table: DataFrame, path: str, media: str = "media", to: int = 16_000) -> None:
    """Writes a media table's sound as resampled 16-bit PCM, in place of the coded files."""
    decode(table, media, to).drop(media).write.option("compression", "zstd").parquet(path)


def payload(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8")
    return len(data), data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text's bytes as the samples of a mu-law WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = [payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([write_wav(MULAW, m[1]) for m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(pcm: np.ndarray) -> str:
    """Peak, root mean square and sign changes of samples."""
    x = pcm.astype(np.int32)
    square = np.square(pcm, dtype=np.float64).sum()  # whole numbers below 2^53
    return f"peak={int(np.abs(x).max())};rms={int(np.sqrt(square / len(x)))};zero={int(np.count_nonzero((pcm[1:] >= 0) != (pcm[:-1] >= 0)))}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def decode_texts(stored: DataFrame, to: int = QUERY_RATE) -> DataFrame:
    """The checksums of stored files, read back, the features of their bytes under the other two codes, and their sound as
    resampled PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                media = part.column(2).to_pylist()
                data = [read_wav(m)[3] for m in media]
                ima = decode_ima(np.frombuffer(b"".join(data), np.uint8).reshape(-1, ADPCM_BLOCK))
                ends = np.cumsum([len(d) // ADPCM_BLOCK for d in data]).tolist()
                other = [f"alaw:{features(samples(ALAW, 1, d))}|ima:{features(ima[end - len(d) // ADPCM_BLOCK : end].reshape(-1))}" for d, end in zip(data, ends)]
                columns = [
                    part.column(0), part.column(1), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                    pa.array([zlib.crc32(d[-32:]) for d in data], pa.int64()), pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(other, pa.string()),
                    pa.array([resample(samples(MULAW, 1, d), RATE, to).astype("<i2").tobytes() for d in data], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "other", "pcm"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS + ", other string, pcm binary")


def read_features(sound: DataFrame) -> DataFrame:
    """The query's columns; `feature` opens with what the stored PCM says."""
    own = [f.name for f in sound.schema if f.name not in ("other", "pcm")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "pcm"):
                of = lambda c, part=part: part.column(part.schema.get_field_index(c))
                made = []
                for pcm, other in zip(of("pcm").to_pylist(), of("other").to_pylist()):
                    made.append(f"mulaw:{features(np.frombuffer(pcm, '<i2'))};pcm_crc32={zlib.crc32(pcm)}|{other}")
                yield pa.RecordBatch.from_arrays([*map(of, own), pa.array(made, pa.string())], names=[*own, "feature"])

    return sound.mapInArrow(run, DIGESTS + ", feature string")


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = keep(store_texts(documents(spark, sf_dir)), "audio", level=LEVEL)
    return read_features(keep(decode_texts(stored), "pcm", level=LEVEL))
