"""Fill-in-middle transformation: where a document is cut is found from remembered summaries of its chunks.

A rolling hash over the last `WINDOW` bytes ends a chunk wherever its upper bits are zero, so that texts with a passage in
common have its chunks in common, wherever it stands. A chunk's summary holds its words, its characters and what is
needed at its borders: whether it begins within a word and how that word goes on, and whether it ends in one. A worker
remembers summaries by the chunks' contents, which are compared whole: a chunk met before is never read again. Summaries
of neighbours are combined, a word over a border counting once, so a text's tokens are counted, and the chunk
with the k-th of them is found, from a few numbers a chunk; only the chunk that a cut falls in is read for its place.

A token is a word with the white space before it, or the white space at a text's end. Of its n tokens, a document
draws two cuts by the sha256 of seed and doc_id; prefix, middle and suffix are moved in one of two forms (psm, spm), or
the text stays as it is (plain).

Defined results: a null text is empty; an empty text, and one that contains a marker, is plain; white space alone is one token;
a null doc_id draws as the empty string does; repeated rows draw alike and have a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts

SEED, SHARE, SPM_SHARE = 42, 50, 80
PREFIX, MIDDLE, SUFFIX = "<P>", "<M>", "<S>"
#: Bytes that the rolling hash covers; a chunk has 2^CHUNK_BITS bytes on average and CHUNK_MOST at most.
WINDOW, CHUNK_BITS, CHUNK_MOST = 32, 8, 4096
#: Bytes of chunks that a Python worker remembers, at most.
CACHE_BYTES = 16_000_000
#: Bytes that are hashed at once.
STRETCH = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character behind its first


def _gear() -> np.ndarray:
    """A 32-bit number for each byte, by multiplication and shifts."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the `WINDOW` bytes that end there (of fewer at the beginning), by doubling."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def borders(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    found, n = [], len(data)
    view = np.frombuffer(data, np.uint8)
    for start in range(0, n, STRETCH):
        before = min(start, WINDOW - 1)
        own = rolling(view[start - before : start + STRETCH])[before:]
        found.append(np.flatnonzero(own >> np.uint32(32 - CHUNK_BITS) == 0) + start + 1)
    ends = np.concatenate([*found, [n]]) if n else np.zeros(0, np.int64)
    ends = ends[ends >= WINDOW] if n >= WINDOW else ends[-1:]
    out, at = [], 0
    for end in ends.tolist():
        while end - at > CHUNK_MOST:
            at += CHUNK_MOST
            out.append(at)
        if end > at:
            out.append(end)
            at = end
    return out


#: words, chars, head (bytes of the word that the chunk begins in the middle or at the start of), whether it ends in a word
Summary = tuple[int, int, int, bool]


def summary(chunk: bytes) -> Summary:
    first = _WORD.match(chunk)
    return len(_WORD.findall(chunk)), len(chunk.translate(None, _INNER)), first.end() if first else 0, chunk[-1] not in _SPACES


class Summaries:
    """Summaries remembered by the chunks' contents."""

    def __init__(self, most: int = CACHE_BYTES):
        self.known: dict[bytes, Summary] = {}
        self.most, self.held = most, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            found = summary(chunk)
            if self.held > self.most:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        return found


class Chunked:
    """A text in chunks: its number of tokens, and the place and characters of the first k of them."""

    def __init__(self, data: bytes, summaries: Summaries):
        self.data, self.ends = data, borders(data)
        self.starts = [0, *self.ends[:-1]]
        self.parts = [summaries.of(data[a:b]) for a, b in zip(self.starts, self.ends)]
        self.words, words, inside = [], 0, False  # words that begin up to each chunk's end
        for n, _, head, ends_inside in self.parts:
            words += n - (inside and head > 0)  # that word began before
            self.words.append(words)
            inside = ends_inside
        self.n = words + (bool(data) and not inside)

    def place(self, k: int) -> tuple[int, int]:
        """(byte, character) behind the first k tokens."""
        if k <= 0:
            return 0, 0
        if k >= self.n:
            return len(self.data), sum(p[1] for p in self.parts)
        at = int(np.searchsorted(self.words, k))  # the chunk in which the k-th word begins
        before = self.words[at - 1] if at else 0
        own = k - before + (at > 0 and self.parts[at - 1][3] and self.parts[at][2] > 0)
        start, end = self.starts[at], self.ends[at]
        found = next(islice(_WORD.finditer(self.data, start, end), own - 1, None)).end()
        chars = sum(p[1] for p in self.parts[:at]) + len(self.data[start:found].translate(None, _INNER))
        while found == end and at + 1 < len(self.parts):  # the word may go on in the next chunk
            at += 1
            start, end = self.starts[at], self.ends[at]
            head = self.parts[at][2]
            found = start + head
            chars += len(self.data[start:found].translate(None, _INNER))
        return found, chars


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers for a document."""
    own = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(own[4 * k : 4 * k + 4], "big") for k in range(4)]


def transformed(doc_id: int | None, data: bytes, summaries: Summaries, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle, output."""
    own = Chunked(data, summaries)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= share or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return own.n, "plain", None, None, data
    low, high = sorted((h1 % (own.n + 1), h2 % (own.n + 1)))
    (a, a_chars), (b, b_chars) = own.place(low), own.place(high)
    prefix, middle, suffix = (PREFIX.encode(), data[:a]), (MIDDLE.encode(), data[a:b]), (SUFFIX.encode(), data[b:])
    form, order = ("spm", (suffix, prefix, middle)) if h4 % 100 < spm_share else ("psm", (prefix, suffix, middle))
    return own.n, form, a_chars, b_chars - a_chars, b"".join(x for pair in order for x in pair)


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output, the transformed text.

    share: hundredths of the documents that are transformed; spm_share: hundredths of these in the form spm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()
        for batch in batches:
            for part in slices(batch, 1):
                made = [transformed(i, t.as_buffer().to_pybytes(), summaries, seed, share, spm_share) for i, t in zip(part.column(0).to_pylist(), part.column(1))]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)]
                output = pa.array([m[4] for m in made], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str, form: str) -> Column:
    """The text that an output was made of. Its parts hold no marker, so the output parts at the markers alone."""
    part = F.split(output, f"{PREFIX}|{MIDDLE}|{SUFFIX}")
    psm, spm = (F.concat(*[F.get(part, k) for k in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op11_chunked_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


_DRAW = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {", ".join(f"{_DRAW.format(at=8 * k + 1)} AS h{k + 1}" for k in range(4))} FROM docs),
cuts AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {SHARE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts),
made AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM parts),
back AS (SELECT *, regexp_split_to_array(output, '{PREFIX}|{SUFFIX}|{MIDDLE}') AS x FROM made)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256
FROM back
"""
