"""Toxicity by a classifier chain: categories one after the other, each model seeing the earlier ones' answers.

The chain is low_quality, toxic, severe. `toxic` and `low_quality` come from the labels; low_quality is no kind of
toxicity but a label that bears on it. `severe` has no label of its own and is weak supervision: it marks the half of
the toxic training documents in which the words that the labels tie to toxicity are densest. Its model sees the same
words, so it grades toxicity by a rule it is taught, and says nothing that `toxic` has not been told by the labels. Each
category has a logistic model over the presence of words, and one input for every earlier category: in training its
out-of-fold prediction (so a later model never sees an answer learned from the row itself), in scoring the earlier
model's probability.

The models learn from at most `TRAIN_ROWS` labels, those of the smallest hashes of doc_id. Spark counts in how many
of these documents of either class each word, word opening and sign stands; those that tell the classes apart are
the vocabulary. The models are fitted on the driver on these rows, each reduced to its part of the vocabulary.
Scoring takes every whole text, with two constants of bounded size, the vocabulary and the weights.

Defined results: a null or empty text has no words and gets the models' base rates; repeated rows have a row each;
contradicting labels of an id are averaged, a half counts as 1, and of unlike texts of one id the smallest is learned
from; labels without a document, or null, are ignored; with no training rows, or with one class only, a category's probability is the share of that class (0 without
rows); a null doc_id is scored, but can't be labelled and counts as not
held out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, keep, slices, texts
from .tokens import release

CHAIN = ("low_quality", "toxic", "severe")
TRAIN_ROWS, VOCABULARY, FOLDS = 20_000, 1_000, 3
#: A word of the vocabulary stands in so many training documents at least, so many standard deviations off the classes' shares.
LEAST_DOCS, LEAST_FAR = 5, 5.0
REJECT = 0.5
#: One document in five is held out of training: crc32 of its doc_id as text, mod 5, is 0.
HOLD_OUT = 5
WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of word openings, which stand for the words of one stem.
OPENINGS = (4, 5)


def words(text: str) -> set[str]:
    """Lower-cased words, the openings of longer ones (as ^abcd), and characters that are no letter, digit or space."""
    low = text.lower()
    found = set(WORDS.findall(low))
    stems = {w[:n] for w in found for n in OPENINGS if len(w) >= n}
    return found | {f"^{s}" for s in stems} | {c for c in set(low) if not c.isalnum() and not c.isspace()}


class Finder:
    """The vocabulary's indices in a text: what `words` gives, met with the vocabulary, without making all of it."""

    def __init__(self, vocabulary: dict[str, int]):
        self.words = {w: k for w, k in vocabulary.items() if w[0] != "^" or len(w) == 1}
        self.stems = [(n, {w[1:]: k for w, k in vocabulary.items() if w[0] == "^" and len(w) == n + 1}) for n in OPENINGS]
        self.signs = {w: k for w, k in self.words.items() if len(w) == 1 and not w.isalnum()}

    def __call__(self, text: str) -> list[int]:
        low = text.lower()
        found = set(WORDS.findall(low))
        out = [self.words[w] for w in self.words.keys() & found]
        for n, stems in self.stems:
            out += [stems[w] for w in stems.keys() & {w[:n] for w in found if len(w) >= n}]
        return out + [k for c, k in self.signs.items() if c in low]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, quality, toxic: one row per id with labels, 0 or 1 each."""
    by = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t")).filter("q is not null and t is not null")
    return by.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("q") >= 0.5).cast("int").alias("quality"), (F.col("t") >= 0.5).cast("int").alias("toxic"))


def one_text(rows: DataFrame) -> DataFrame:
    """One row for each doc_id, with the smallest of its texts: what is learned from is bounded by the labels taken."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in rest])


@dataclass
class Chain:
    """Vocabulary and, per category, weights of the words, of the earlier categories and the bias."""

    names: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    before: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """(rows, categories) of probabilities; a row is the vocabulary indices in a text."""
        at, owner = _flat(rows)
        out = np.zeros((len(rows), len(self.names)))
        for k in range(len(self.names)):
            z = np.bincount(owner, self.weights[k][at], len(rows)) + self.bias[k] + out[:, :k] @ self.before[k]
            out[:, k] = _logistic(z)
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.fromiter((i for r in rows for i in r), np.int64, int(counts.sum()))
    return at, np.repeat(np.arange(len(rows)), counts)


def fit_logistic(at: np.ndarray, owner: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int, rounds: int = 150, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse 0/1 inputs, of dense ones and the bias, by gradient steps scaled per weight (diagonal Newton)."""
    n, rate = len(y), (y.sum() + 0.5) / (len(y) + 1)
    w, v, b = np.zeros(size), np.zeros(extra.shape[1]), float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return w, v, b
    seen = np.bincount(at, minlength=size)
    step, kept = 0.0, (np.zeros(size), np.zeros(extra.shape[1]), 0.0)
    for k in range(rounds):
        z = np.bincount(owner, w[at], n) + extra @ v + b
        p = _logistic(z)
        g, s = p - y, np.maximum(p * (1 - p), 0.02)
        gw, gv, gb = np.bincount(at, g[owner], size) + l2 * w, extra.T @ g + l2 * v, g.sum()
        hw, hv, hb = np.bincount(at, s[owner], size) + l2, (extra**2).T @ s + l2, s.sum()
        step = 0.1 if k < 100 else 0.05
        kept = (0.8 * kept[0] - step * gw / hw, 0.8 * kept[1] - step * gv / hv, 0.8 * kept[2] - step * gb / hb)
        w, v, b = w + kept[0], v + kept[1], b + kept[2]
        w[seen == 0] = 0
    return w, v, float(b)


def fit_chain(rows: list[list[int]], targets: dict[str, np.ndarray], vocabulary: dict[str, int], folds: np.ndarray) -> Chain:
    """Fits the categories in order; `folds` gives each row's fold for out-of-fold predictions."""
    chain = Chain(tuple(targets), vocabulary)
    size, n = len(vocabulary), len(rows)
    at, owner = _flat(rows)
    earlier = np.zeros((n, 0))
    for y in targets.values():
        if not n:
            w, v, b = np.zeros(size), np.zeros(earlier.shape[1]), -35.0
        elif y.min() == y.max():
            w, v, b = np.zeros(size), np.zeros(earlier.shape[1]), 35.0 if y[0] else -35.0
        else:
            w, v, b = fit_logistic(at, owner, earlier, y, size)
        guess = np.full(n, y.mean() if n else 0.0)
        for f in np.unique(folds):
            own, rest = folds == f, folds != f
            if not rest.any() or y[rest].min() == y[rest].max():
                continue
            place = np.cumsum(rest) - 1
            picked = rest[owner]
            wf, vf, bf = fit_logistic(at[picked], place[owner[picked]], earlier[rest], y[rest], size)
            z = np.bincount(owner, wf[at], n) + earlier @ vf + bf
            guess[own] = _logistic(z[own])
        chain.weights.append(w), chain.before.append(v), chain.bias.append(b)
        earlier = np.column_stack([earlier, guess])
    return chain


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> Chain:
    """Learns a chain from the labels outside the held-out fifth."""
    known = labelled(labels).filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = one_text(texts(docs).join(F.broadcast(known), "doc_id"))  # at most train_rows rows of three numbers are sent

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 1):
                found = [sorted(words(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "quality", "toxic", "words"])

    kept = keep(rows.select("doc_id", "text", "quality", "toxic").mapInArrow(split, "doc_id long, quality int, toxic int, words array<string>"), "toxic-words")
    sums = kept.agg(F.count("*"), F.sum("toxic"), F.sum(1 - F.col("quality"))).first()
    total, toxic, low = (int(x or 0) for x in sums)
    counts = kept.select("toxic", "quality", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum(1 - F.col("quality")).alias("q")).filter(F.col("n") >= LEAST_DOCS)
    # how far a word's documents lie from the classes' shares, in standard deviations; the 1 keeps rare words back
    def far(count: str, share: float) -> F.Column:
        return F.abs(F.col(count) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)

    best = counts.withColumn("far", F.greatest(far("t", toxic / max(total, 1)), far("q", low / max(total, 1)))).filter(F.col("far") >= LEAST_FAR).orderBy(F.desc("far"), "word").limit(vocabulary).collect()
    index = {r["word"]: k for k, r in enumerate(best)}
    # words that stand in toxic documents alone, or nearly: their number decides `severe`
    marks = {r["word"] for r in best if r["t"] >= 0.8 * r["n"] and r["far"] >= LEAST_FAR}
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3).to_pylist()
            rows = [[index[w] for w in r if w in index] for r in found]
            dense = [sum(w in marks for w in r) / max(1, len(r)) for r in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int64())), pa.array(dense, pa.float64())], names=["doc_id", "quality", "toxic", "at", "dense"])

    own = kept.mapInArrow(reduce, "doc_id long, quality int, toxic int, at array<long>, dense double").toPandas()
    found = [list(r) for r in own["at"]]
    is_toxic, dense = own["toxic"].to_numpy(float), own["dense"].to_numpy(float)
    middle = np.median(dense[is_toxic == 1]) if is_toxic.any() else 0.0
    goals = {"low_quality": 1 - own["quality"].to_numpy(float), "toxic": is_toxic, "severe": ((is_toxic == 1) & (dense > middle)).astype(float)}
    folds = np.array([hash_fold(int(i)) for i in own["doc_id"]], np.int64)
    return fit_chain(found, goals, index, folds)


def hash_fold(doc_id: int, folds: int = FOLDS) -> int:
    return (doc_id * 2654435761 >> 8) % folds


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and a probability per category, for every whole text."""
    return _score(texts(docs).select("doc_id", "text"), chain)


def _score(table: DataFrame, chain: Chain) -> DataFrame:
    """Adds the categories' probabilities to a table with a column `text`."""
    names = chain.names
    schema = T.StructType([*table.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        find = Finder(chain.vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [find(t.as_py() or "") for t in part.column(part.schema.get_field_index("text"))]
                p = chain.score(rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, k]) for k in range(len(names)))], names=[*part.schema.names, *names])

    return table.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs that the chain does not reject as toxic."""
    chain = train(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    inner = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kept = _score(inner, chain).filter(F.col("toxic") < reject)
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = _score(texts(docs), chain).drop("text")
    return p.select("doc_id", held_out().alias("held_out"), *CHAIN, (F.col("toxic") >= REJECT).cast("int").alias("rejected"))
