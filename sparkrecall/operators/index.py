"""Approximate nearest memories by an inverted-file index: every memory is in the list of its nearest centroid, a query meets
the memories of its nearest lists alone, and their scores are exact.

The centroids are fitted on a sample of at most `SAMPLE_ROWS` memories; all memories are in the index. How many lists a query
probes is measured: as many as find `RECALL` of the exact hits among the sample, whose neighbours lie farther apart
than those of all memories and so are harder to find. A large list is split, and so are the many queries that probe it, as a large user's are by `knn_blocks`. The exact searches stay the default.

Defined results: memories without a vector, or with one of no length, are in list -1, which no query probes, as they have no
score; an empty index finds nothing; with as many probes as lists the search is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.operators.vectors import _top, _unit, block_hits
from sparkrecall.schemas import TOP_K

#: Memories that the centroids are fitted on, by the smallest hashes of their ids (80 MB at 1,024 numbers), and rounds of it.
SAMPLE_ROWS, STEPS = 20_000, 8
#: Lists at most; share of exact hits that the probes are to find, and queries of the sample that it is measured by.
MOST_LISTS, RECALL, TRIALS = 1024, 0.95, 500


def lists_for(rows: int) -> int:
    """Twice as many lists as a list has rows' square root, within the bound."""
    return max(1, min(MOST_LISTS, 2 * math.isqrt(rows)))


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int = TOP_K, recall: float = RECALL) -> int:
    """The fewest lists with which queries out of x (unit vectors) find that share of their k nearest in x."""
    if len(centroids) <= 1:
        return len(centroids)
    own = (x @ centroids.T).argmax(1)
    q = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
    found = np.zeros(len(centroids))
    for k0 in range(0, len(q), 100):
        part = q[k0 : k0 + 100]
        exact = np.argpartition(-(part @ x.T), min(k, len(x)) - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(part @ centroids.T), 1), 1)
        found += np.bincount(np.take_along_axis(place, own[exact], 1).ravel(), minlength=len(centroids))
    return int(np.searchsorted(np.cumsum(found) / found.sum(), recall)) + 1


def fit_lists(memories: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> tuple[np.ndarray, int]:
    """Unit centroids by spherical k-means on the sample (nearest centroid, mean, unit length again), and how many to probe."""
    rows = memories.filter(F.size("vector") > 0)
    sample = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(sample_rows).toPandas()
    if sample.empty:
        return np.zeros((0, 0)), 0
    x = _unit(sample["vector"])
    x = x[~np.isnan(x[:, 0])]
    lists = min(lists or lists_for(rows.count()), len(x))
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(steps):
        nearest = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size == 0, 1, size), centroids)
    return centroids, probes_for(x, centroids)


def _nearest(rows: DataFrame, centroids: np.ndarray, n: int, schema: str, columns: list[str]) -> DataFrame:
    """A row for each of the n nearest lists of every row of `rows`, with the list's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.iloc[k : k + 2000]
                s = _unit(part["vector"]) @ centroids.T
                found = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(part), 1))
                found = np.where(np.isnan(s[:, :1]), -1, found)
                out = part.loc[part.index.repeat(found.shape[1]), columns].reset_index(drop=True)
                out["list"] = found.ravel().astype(np.int32)
                yield out

    return rows.select(*columns).mapInPandas(run, schema)


def listed(memories: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, user_id, vector and the list of every memory."""
    good = memories.filter(F.size("vector") > 0)
    if not len(centroids):
        return memories.select("id", "user_id", "vector", F.lit(-1).alias("list"))
    own = _nearest(good, centroids, 1, "id string, user_id string, vector array<float>, list int", ["id", "user_id", "vector"])
    rest = memories.filter(F.coalesce(F.size("vector"), F.lit(-1)) <= 0).select("id", "user_id", "vector", F.lit(-1).alias("list"))
    return own.unionByName(rest)


def write_index(memories: DataFrame, path: str, lists: int | None = None, rows: int = 1_000_000) -> None:
    """The index as folders by list, a hot list in several files, with its centroids beside it."""
    centroids, probes = fit_lists(memories, lists)
    spark = memories.sparkSession
    spark.createDataFrame([(k, [float(v) for v in c], probes) for k, c in enumerate(centroids)], "list int, vector array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-memories.count() // (rows * max(1, len(centroids)))))))
    own = listed(memories, centroids).withColumn("_salt", salt)
    own.repartition("list", "_salt").drop("_salt").write.option("maxRecordsPerFile", rows).partitionBy("list").parquet(f"{path}/lists")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """(memories with their lists, centroids, lists to probe)."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    memories = spark.read.schema("id string, user_id string, vector array<float>, list int").parquet(f"{path}/lists")
    return memories, np.array([r["vector"] for r in rows]).reshape(len(rows), -1), rows[0]["probes"] if rows else 0


def knn_index(queries: DataFrame, memories: DataFrame, centroids: np.ndarray, probes: int, k: int = TOP_K, by_user: bool = False) -> DataFrame:
    """L7 (with by_user: L6) in the lists that lie nearest: request_id, id, score, rank. memories: as `listed` or `read_index` give them."""
    if not len(centroids):
        return queries.sparkSession.createDataFrame([], "request_id string, id string, score double, rank int")
    n = max(1, min(len(centroids), probes))
    asked = _nearest(queries.filter(F.size("vector") > 0), centroids, n, "request_id string, user_id string, vector array<float>, list int", ["request_id", "user_id", "vector"]).filter("list >= 0")

    def key(user: str) -> Column:
        return F.concat_ws("\0", F.col("list").cast("string"), *([F.col(user)] if by_user else []))

    asked = asked.select("request_id", key("user_id").alias("user_id"), "vector")
    stored = memories.filter("list >= 0").select("id", key("user_id").alias("user_id"), "vector")
    return _top(block_hits(asked, stored, k), k)


