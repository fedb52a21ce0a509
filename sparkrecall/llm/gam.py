"""Quality by a generalised additive model with pairwise interactions.

Each whole text gives a few numbers (`FEATURES`). A feature is cut into bins at quantiles; cyclic boosting goes
round the features, each time fits a tree of at most three leaves to the gradient along that feature's bins, and
adds it to the feature's table. Then the pairs of features whose grid explains most of what is left get tables of
their own, boosted by two-cut trees. A score is the sum of one entry per table, put through the logistic curve.

The features come from all texts in Spark tasks. The tables are fitted on the driver on at most `TRAIN_ROWS`
labelled rows (smallest hash of doc_id first), which is a documented bound; they are a few kilobytes.

Defined results: a null or empty text has features of zero and is scored like any other; repeated rows have a row
each; contradicting labels of an id are averaged, a half counts as 1, and of unlike texts of one id the smallest is
learned from; labels without a document, or null, are ignored; without training rows every score is 0.5, with one class only the score is that class; a null doc_id is
scored and counts as not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts
from .toxicity import held_out, labelled, one_text

FEATURES = (
    "chars", "words", "word_length", "word_spread", "symbols", "bars", "digits", "upper", "stops", "commas", "lines", "distinct_words",
    "repeated_lines", "short_words", "signed_words", "capital_words",
)
TRAIN_ROWS = 20_000
BINS, GRID = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 200, 80, 0.08, 6
THRESHOLD = 0.3

_SIGNS = np.zeros(256, bool)
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'!?-\"()"]] = True
_SIGN_CHARS = frozenset(chr(c) for c in np.flatnonzero(_SIGNS))


def measure(text: str) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    each = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, own = len(data), text.split()
    w = max(1, len(own))
    size = np.fromiter(map(len, own), np.int64, len(own)) if own else np.zeros(1, np.int64)
    lines = text.split("\n")
    return [
        np.log1p(n), np.log1p(len(own)), float(size.mean()), float(size.std()), each[_SIGNS].sum() / n, each[124] / n, each[48:58].sum() / n,
        each[65:91].sum() / n, each[46] / w, each[44] / w, len(lines) / w, len(set(own)) / w, 1 - len(set(lines)) / len(lines),
        float((size <= 3).mean()), sum(x[-1] in _SIGN_CHARS for x in own) / w, sum(x[0].isupper() for x in own) / w,
    ]


def features(table: DataFrame) -> DataFrame:
    """Replaces `text` by an array column `x` of its numbers."""
    at, rest = table.columns.index("text"), [c for c in table.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                x = [measure(t.as_py() or "") for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(x, pa.list_(pa.float64()))], names=[*rest, "x"])

    return table.mapInArrow(run, ", ".join([f"`{c}` {table.schema[c].dataType.simpleString()}" for c in rest] + ["x array<double>"]))


@dataclass
class Gam:
    """Cuts and table of every feature; cuts and grids of the chosen pairs."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows of numbers: one table entry per feature and pair, added up."""
        z = np.full(len(x), self.bias)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, k], "right")]
        if self.pairs:
            at = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.coarse)]
            for (i, j), grid in zip(self.pairs, self.grids):
                z += grid[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray, l2: float = 2.0) -> np.ndarray:
    return g * g / (h + l2)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 2.0, l2: float = 2.0) -> np.ndarray:
    """The step per bin of a tree along ordered bins: repeatedly the split of largest gain, up to `leaves` leaves."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            gl, hl, gr, hr = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
            gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl) + _gain(gr, hr) - _gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
            m = int(gain.argmax())
            if gain[m] > best[0]:
                best = (gain[m], k, int(at[m]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, l2: float = 2.0) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid, one along each side, and its step per cell; and what it gains."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def four(c: np.ndarray, total: float) -> list[np.ndarray]:
        a, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, total - top - left + a]

    parts_g, parts_h = four(cg, total_g), four(ch, total_h)
    gain = sum(_gain(x, y) for x, y in zip(parts_g, parts_h)) - _gain(total_g, total_h)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    for k, where in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[where] = -parts_g[k][i, j] / (parts_h[k][i, j] + l2)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    if not len(y):
        return Gam(0.0)
    if y.min() == y.max():
        return Gam(35.0 if y[0] else -35.0)
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))))
    n, f = x.shape
    model.cuts = [_cuts(x[:, k], BINS) for k in range(f)]
    at = [np.searchsorted(model.cuts[k], x[:, k], "right") for k in range(f)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(f):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size))
            model.tables[k] += step
            z += step[at[k]]
    model.coarse = [_cuts(x[:, k], GRID) for k in range(f)]
    wide = [np.searchsorted(model.coarse[k], x[:, k], "right") for k in range(f)]
    sizes = [len(c) + 1 for c in model.coarse]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * sizes[j] + wide[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = sorted(((quadrants(grid(i, j, g), grid(i, j, h))[0], -i, -j) for i, j in combinations(range(f), 2)), reverse=True)
    model.pairs = [(-i, -j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.grids = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * quadrants(grid(i, j, g), grid(i, j, h))[1]
            model.grids[k] += step
            z += step[wide[i], wide[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Gam:
    """Learns from the labels outside the held-out fifth; only these texts are measured."""
    known = labelled(labels).filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("doc_id", "quality")
    own = one_text(texts(docs).join(F.broadcast(known), "doc_id"))
    rows = features(own).toPandas()  # at most train_rows rows of as many numbers as there are features
    if not len(rows):
        return Gam(0.0)
    return fit(np.array(rows["x"].tolist(), float), rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score: the probability of label 1 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                x = np.array([measure(t.as_py()) for t in part.column(1)], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
