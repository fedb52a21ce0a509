"""What models have answered, as a stored table: a text is given to a model once, whatever batch, retry or use it comes up in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.operators.memory import Model, one_by_one
from sparkrecall.sources.buckets import BucketTable
from sparkrecall.sources.tables import written

ANSWERS = "key string, model string, response string, usage string"
VECTORS = "key string, model string, vector array<float>"


def _missing(asked: DataFrame, table: BucketTable, model: str) -> DataFrame:
    """The distinct rows of `asked` whose key a model has not answered yet; only the buckets they fall in are read."""
    known = table.read(table.buckets_of(asked)).filter(F.col("model") == model).select("key")
    return asked.dropDuplicates(["key"]).join(known, "key", "left_anti")


class ModelCache:
    """Answers of models at `path`, by a hash of what was asked.

    `answers` and `embedder` ask about what is not stored, add it in one write, and join it back. A call that fails is
    not stored, so that it is made again next time. Calls of one batch are made once each, however many rows ask the same;
    a job that dies before its write asks again, as nothing of it counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.said = BucketTable(spark, f"{path}/answers", ANSWERS, "key", buckets)
        self.vectors = BucketTable(spark, f"{path}/vectors", VECTORS, "key", buckets)

    def answers(self, name: str) -> Callable[[DataFrame, Model, str, str], DataFrame]:
        """For the argument `answers` of `model_extractor` and `model_decider`; name: the model's, under which answers are kept."""

        def ask(rows: DataFrame, model: Model, first: str, second: str) -> DataFrame:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    got = one_by_one(model, batch["first"].tolist(), batch["second"].tolist())
                    yield pd.DataFrame([(k, name, g[0], g[1]) for k, g in zip(batch["key"], got) if g], columns=["key", "model", "response", "usage"])

            key = F.sha2(F.concat_ws("\0", F.lit(name), F.length(first).cast("string"), first, second), 256)
            asked = written(rows.select("request_id", "user_id", key.alias("key"), F.col(first).alias("first"), F.col(second).alias("second")), "asked")
            new = written(_missing(asked, self.said, name).select("key", "first", "second").mapInPandas(run, ANSWERS), "answers")
            if not new.isEmpty():
                self.said.append(new, f"{name}/{self.said.version() + 1}")
            known = self.said.read(self.said.buckets_of(asked)).filter(F.col("model") == name)
            found = asked.select("request_id", "user_id", "key").join(known, "key", "left")
            return found.select("request_id", "user_id", F.coalesce("response", F.lit("")).alias("response"), F.coalesce("usage", F.lit("")).alias("usage"))

        return ask

    def embed(self, rows: DataFrame, name: str, embedder: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
        """L5 with vectors kept over batches: adds `vector`; rows whose text gets none are dropped, and asked about again next time."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = one_by_one(lambda t: embedder(pd.Series(t)), batch["text"].tolist())
                yield pd.DataFrame([(k, name, v) for k, v in zip(batch["key"], made) if v is not None], columns=["key", "model", "vector"])

        own = rows.withColumn("_key", F.sha2(F.concat_ws("\0", F.lit(name), text), 256))
        asked = written(own.filter(F.col(text).isNotNull()).select(F.col("_key").alias("key"), F.col(text).alias("text")).distinct(), "asked")
        new = written(_missing(asked, self.vectors, name).select("key", "text").mapInPandas(run, VECTORS), "vectors")
        if not new.isEmpty():
            self.vectors.append(new, f"{name}/{self.vectors.version() + 1}")
        known = self.vectors.read(self.vectors.buckets_of(asked)).filter(F.col("model") == name).select(F.col("key").alias("_key"), "vector")
        return own.filter(F.col(text).isNotNull()).join(known, "_key").drop("_key")
