"""Nearest memories by 1 + cosine, in SQL and in blocks of matrix products, and the embedding stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecall.schemas import DIMS, TOP_K

#: Rows of a user's memories, and of the user's queries, that one task multiplies with one another; larger users are split.
#: Smaller chunks and blocks of a user share a task up to so many rows.
CHUNK_ROWS, QUERY_ROWS = 50_000, 5_000
#: Queries that are sent to all tasks at once by the global search; more are dealt out in blocks.
QUERY_BLOCK = 5_000

HITS = "request_id string, id string, score double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(a: Column, b: Column) -> Column:
    """1 + cosine, in [0, 2]; null if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 + dot(a, b) / size)


def _top(hits: DataFrame, k: int, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, memories: DataFrame, k: int = TOP_K) -> DataFrame:
    """L6 stated plainly, all of a user's pairs at once: what tests hold `knn_blocks` against. Not for large users."""
    m = memories.select("user_id", "id", F.col("vector").alias("_m"))
    hits = queries.select("request_id", "user_id", F.col("vector").alias("_q")).join(m, "user_id").select("request_id", "user_id", "id", score(F.col("_q"), F.col("_m")).alias("score"))
    return _top(hits.filter("score is not null"), k)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    size = np.sqrt((x * x).sum(1))
    return np.where(size[:, None] > 0, x / np.where(size == 0, 1, size)[:, None], np.nan)


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k best scores of each row, ascending; of equal scores the first ones."""
    if s.shape[1] <= k:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    more, ties = s > last, s == last
    kept = more | (ties & (np.cumsum(ties, 1) <= k - more.sum(1, keepdims=True)))
    return np.nonzero(kept)[1].reshape(len(s), k)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, rows: int | None = None) -> pd.DataFrame:
    """The k best of a block for each query; ids must ascend, as of equal scores (to twelve digits) the first ids stay.

    Chunks of `rows` of the block are met one after the other, and each leaves the k best so far.
    """
    scores, places = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
    rows = rows or max(1, len(m))
    for low in range(0, len(m), rows):
        s = np.round(1 + q @ m[low : low + rows].T, 12)
        s = np.where(np.isnan(s), -1.0, s)
        own = _first(s, k)
        scores, places = np.concatenate([scores, np.take_along_axis(s, own, 1)], 1), np.concatenate([places, low + own], 1)
        best = _first(scores, k)
        scores, places = np.take_along_axis(scores, best, 1), np.take_along_axis(places, best, 1)
    row, col = np.nonzero(scores >= 0)
    return pd.DataFrame({"request_id": q_ids[row], "id": ids[places[row, col]], "score": scores[row, col]})


def _blocks(rows: DataFrame, most: int, together: int, name: str) -> DataFrame:
    """(user_id, name): to how many tasks each user's rows go, in pieces of about `most` rows, as many in a task as make up
    `together` rows."""
    return rows.groupBy("user_id").agg(F.ceil(F.count("*") / (most * max(1, together // most))).cast("int").alias(name))


def knn_blocks(queries: DataFrame, memories: DataFrame, k: int = TOP_K, chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """L6 by matrix products: a user's memories are split into chunks of about chunk_rows and the user's queries into blocks
    of about query_rows; every block meets every chunk, keeps its k best, and a last top-k joins them. Only users who ask
    take part, and only ids and vectors are shuffled. Small chunks and blocks share tasks, so that what is shuffled follows
    the rows of a task and not those of a chunk, and the blocks of a task meet its chunks one after the other."""
    hits = block_hits(queries, memories, k, chunk_rows, query_rows)
    return _top(hits, k).join(queries.select("request_id", "user_id"), "request_id").select("request_id", "user_id", "id", "score", "rank")


def block_hits(queries: DataFrame, memories: DataFrame, k: int, chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(request_id, id, score): the k best of every task's chunks of memories for each query, of those with the query's user_id."""
    users = _blocks(queries, query_rows, QUERY_ROWS, "blocks")
    mine = memories.select(*[F.col(c).alias(c) for c in ("user_id", "id", "vector")])  # columns of their own, should both come from one table
    mine = mine.join(users.select("user_id"), "user_id", "left_semi")
    sizes = _blocks(mine, chunk_rows, CHUNK_ROWS, "chunks").join(users, "user_id")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    m = mine.join(sizes, "user_id").select("user_id", of("id", "chunks").alias("chunk"), every("blocks").alias("block"), "id", "vector")
    q = queries.select("request_id", "user_id", "vector").join(sizes, "user_id")
    q = q.select("user_id", every("chunks").alias("chunk"), of("request_id", "blocks").alias("block"), "request_id", "vector")

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"request_id": left["request_id"].iloc[:0], "id": right["id"].iloc[:0], "score": np.zeros(0)})
        right = right.sort_values("id")
        ids, unit = right["id"].to_numpy(), _unit(right["vector"])
        return pd.concat([_best(left["request_id"].to_numpy()[i : i + 256], _unit(left["vector"][i : i + 256]), ids, unit, k, chunk_rows) for i in range(0, len(left), 256)])

    keys = ("user_id", "chunk", "block")
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(block, HITS)


def knn_global(queries: DataFrame, memories: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK) -> DataFrame:
    """No user filter. Up to `block` queries are sent to all tasks, and memories are not shuffled; more queries take turns, in
    blocks of about that many, each of which passes over the memories once. For very many, `operators.index` meets fewer rows."""
    few = queries.select("request_id", "vector").limit(block + 1).toPandas()
    if few.empty:
        return queries.sparkSession.createDataFrame([], HITS + ", rank int")
    if len(few) <= block:
        return _sent(few, memories, k)
    from sparkrecall.sources.tables import written

    turns = -(-queries.count() // block)
    own = written(queries.select("request_id", "vector", F.pmod(F.xxhash64("request_id"), F.lit(turns)).alias("_turn")), "queries")
    found = None
    for turn in range(turns):
        part = own.filter(F.col("_turn") == turn).toPandas()
        if not part.empty:
            hits = written(_sent(part, memories, k), "hits")
            found = hits if found is None else found.unionByName(hits)
    return found


def _sent(few: pd.DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """The k best of all memories for queries that are sent to every task."""
    sent = memories.sparkSession.sparkContext.broadcast((few["request_id"].to_numpy(), _unit(few["vector"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = sent.value
        kept = None
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("id")
            right = _unit(batch["vector"])
            new = pd.concat([_best(q_ids[i : i + 512], q[i : i + 512], batch["id"].to_numpy(), right, k) for i in range(0, len(q_ids), 512)])
            kept = new if kept is None else pd.concat([kept, new])
            kept = kept.sort_values(["request_id", "score", "id"], ascending=[True, False, True]).groupby("request_id").head(k)
        if kept is not None:
            yield kept

    return _top(memories.select("id", "vector").mapInPandas(search, HITS), k)


def hashed_bigrams(dims: int = DIMS, seed: int = 7) -> Callable[[pd.Series], pd.Series]:
    """U2's default: signed counts of hashed bigrams of code points of the lower-cased text, unit length. Blank texts, and
    those whose counts cancel out, give no vector.

    The hash of code points a, b is (a * 2654435761 + b * 40503 + seed) mod 2^32; its upper 24 bits choose the place, its
    lowest bit the sign.
    """

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            h = (c[:-1] * 2654435761 + c[1:] * 40503 + seed) & 0xFFFFFFFF
            v = np.bincount((h >> 8) % dims, 1.0 - 2 * (h & 1), dims)
            size = np.sqrt((v * v).sum())
            out.append((v / size).astype(np.float32).tolist() if size else None)
        return pd.Series(out)

    return embed


def embed_texts(rows: DataFrame, embedder: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Adds `vector`, made once per distinct text by a batch function; rows it gives no vector are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_text": batch["_text"], "vector": embedder(batch["_text"])})

    distinct = rows.select(F.col(text).alias("_text")).filter("_text is not null").distinct()
    made = distinct.mapInPandas(run, "_text string, vector array<float>").filter("vector is not null")
    return rows.join(made, F.col(text) == F.col("_text")).drop("_text")
