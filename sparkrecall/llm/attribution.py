"""Token counts by offset-mapped attribution: a document is encoded once, whole, and its tokens are dealt out to
fields or sections by their character spans. The library gets whole texts, a batch of them at a time, and gives the
spans; texts of over a million characters go through in parts that don't change them (`tokens.parts`).

Sections are character intervals [start, end) of a document; they may leave gaps, touch, nest or overlap, and each
is counted on its own. The tokens' spans come in order, so the interval join of a document's tokens with its
sections is a binary search per section border. A token that crosses a border is allocated by an explicit rule:

- `middle` (default): to the section with its middle character, the earlier of two;
- `start`: to the section with its first character;
- `split`: to each section by the share of its characters there.

With disjoint sections that cover a text, every rule's counts add up to the document's tokens.

Defined results: a null or empty text has no tokens and, if it has sections, counts of 0; sections reaching beyond
the text count what is inside, empty or reversed ones 0; a document without sections has no rows; repeated rows of
a document are counted one by one; a null doc_id never matches a table of sections, but has its own chunks; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts
from .tokens import Encoder, encoder, tokenizer_path

CHUNK = 1000
RULES = ("middle", "start", "split")
SECTION = "array<struct<section:string,start:bigint,end:bigint>>"
SCHEMA = "doc_id long, section string, start long, end long, n_tokens double, n_crossing long"


def shares(spans: np.ndarray, at: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each border: tokens before it, the share of crossing ones that lies before it (if asked for), and how many cross it."""
    starts, ends = spans[:, 0], spans[:, 1]
    low, high = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at, "left")
    part = np.zeros(len(at))
    for k in np.flatnonzero(high > low) if split else ():
        s, e = starts[low[k] : high[k]], ends[low[k] : high[k]]
        part[k] = ((at[k] - s) / (e - s)).sum()
    return low, part, np.maximum(high - low, 0)


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section, over one sequence of spans."""
    ends = np.maximum(starts, ends)
    first, part_first, cross_first = shares(spans, starts, rule == "split")
    last, part_last, cross_last = shares(spans, ends, rule == "split")
    empty = starts == ends
    if rule == "split":
        n = (last - first) + (part_last - part_first)
    else:
        point = spans[:, 0] if rule == "start" else spans[:, 0] + (spans[:, 1] - spans[:, 0] - 1) // 2
        n = (np.searchsorted(point, ends, "left") - np.searchsorted(point, starts, "left")).astype(float)
    # a token over both borders of a section crosses once
    both = np.maximum(0, np.searchsorted(spans[:, 0], starts, "left") - np.searchsorted(spans[:, 1], ends, "right"))
    return np.where(empty, 0.0, n), np.where(empty, 0, cross_first + cross_last - both)


def _dealt(part: pa.RecordBatch, code: Encoder, rule: str) -> pa.RecordBatch:
    """The sections of a slice of documents. Equal texts are encoded once; the tokens of all texts are laid end to end, a place
    apart, so that the sections of all documents are met with them at once."""
    lists = part.column(2)
    counts, own = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    every = [t or "" for t in part.column(1).to_pylist()]
    once = {t: k for k, t in enumerate(dict.fromkeys(every))}
    size = np.array([len(t) for t in once], np.int64)
    base = np.cumsum(size + 1) - size - 1
    spans = code.spans(list(once))
    laid = spans[0] if len(spans) == 1 else np.concatenate([s + b for s, b in zip(spans, base)])
    of = np.repeat(np.array([once[t] for t in every]), counts)
    low, high = (pc.fill_null(pc.struct_field(own, c), 0).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    # what a section has beyond its text is no other text's
    n, cross = allocate(laid, *(base[of] + np.clip(at, 0, size[of]) for at in (low, high)), rule)
    doc_ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
    return pa.RecordBatch.from_arrays([doc_ids, pc.struct_field(own, "section"), *map(pa.array, (low, high, n, cross))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])


def attribute(table: DataFrame, rule: str = "middle", tokenizer: str | None = None) -> DataFrame:
    """table: doc_id, text, sections (an array of section, start, end) -> a row per document and section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its core
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                part = part.filter(pc.greater(pc.fill_null(pc.list_value_length(part.column(2)), 0), 0))
                if part.num_rows:
                    yield _dealt(part, code, rule)

    return table.select("doc_id", "text", F.col("sections").cast(SECTION)).mapInArrow(run, SCHEMA)


def attribute_sections(docs: DataFrame, sections: DataFrame, rule: str = "middle") -> DataFrame:
    """Sections from a table of their own (doc_id, section, start, end); one document's sections meet in one row."""
    own = sections.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "section"))).alias("s"))
    own = own.select("doc_id", F.transform("s", lambda s: F.struct(s["section"].cast("string").alias("section"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))
    return attribute(texts(docs).join(own, "doc_id"), rule)


def attribute_fields(docs: DataFrame, fields: list[str], rule: str = "middle", separator: str = "\n") -> DataFrame:
    """Fields of a record that is encoded as one text: their values in order, a null one as empty, with a separator."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for name, value in zip(fields, values):
        size = F.char_length(value).cast("long")
        spans.append(F.struct(F.lit(name).alias("section"), at.alias("start"), (at + size).alias("end")))
        at = at + size + len(separator)
    return attribute(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws(separator, *values).alias("text"), F.array(*spans).alias("sections")), rule)


def chunks(chunk: int = CHUNK) -> F.Column:
    """Sections of `chunk` characters over the column text; an empty text has one, empty."""

    def cut(n: F.Column) -> F.Column:
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(chunk).cast("long"))
        return F.transform(starts, lambda s: F.struct((s / chunk).cast("long").cast("string").alias("section"), s.alias("start"), F.least(s + chunk, n).alias("end")))

    # the text is measured once, not for each of its sections
    return F.transform(F.array(F.char_length("text").cast("long")), cut)[0]


def op1_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every 1,000-character chunk of every whole text; a token over a border goes where its middle lies."""
    rows = texts(documents(spark, sf_dir)).withColumn("sections", chunks())
    return attribute(rows).select("doc_id", F.col("section").cast("long").alias("section"), "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")
