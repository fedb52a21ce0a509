"""Models asked once: answers and vectors kept over batches, failures row by row."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from sparkrecall.operators import memory as M
from sparkrecall.plans import jobs
from sparkrecall.sources.models import ModelCache
from tests.test_memory import request


def day():
    return F.lit("2024-02-03").cast("date")


def counting(folder):
    """A model that leaves a file for each text it is asked about; it fails for texts with `bad` in them."""
    os.makedirs(folder, exist_ok=True)

    def model(system, user):
        import uuid

        if any("bad" in u for u in user):
            raise RuntimeError("bad")
        for u in user:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(u)
        return [(json.dumps({"facts": [u.split("user: ")[1].split("\n")[0]]}), '{"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}') for u in user]

    return model


def asked(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


def test_each_text_once_over_batches(spark, tmp_path):
    folder, cache = f"{tmp_path}/calls", ModelCache(spark, f"{tmp_path}/cache", 4)
    extract = M.model_extractor(counting(folder), day(), answers=cache.answers("own"))
    first = request(spark, [("r1", "u1", "tea"), ("r2", "u2", "tea"), ("r3", "u1", "bad one"), ("r4", "u3", "cats")])
    facts, usage = extract(first)
    assert sorted(tuple(r) for r in facts.collect()) == [("r1", "u1", 0, "tea"), ("r2", "u2", 0, "tea"), ("r4", "u3", 0, "cats")]
    assert {r["request_id"]: r["total_tokens"] for r in usage.collect()} == {"r1": 3, "r2": 3, "r4": 3}
    assert len(asked(folder)) == 2  # of two texts, though three requests ask and facts and usage are both taken
    again = ModelCache(spark, f"{tmp_path}/cache", 4)
    second = request(spark, [("s1", "u1", "cats"), ("s2", "u9", "dogs"), ("s3", "u9", "tea")])
    facts, _ = M.model_extractor(counting(folder), day(), answers=again.answers("own"))(second)
    assert facts.count() == 3 and len(asked(folder)) == 3
    other, _ = M.model_extractor(counting(folder), day(), answers=again.answers("other"))(second)
    assert other.count() == 3 and len(asked(folder)) == 6  # another model's answers are its own


def test_without_a_cache_answers_are_made_once(spark, tmp_path):
    folder = f"{tmp_path}/calls"
    facts, usage = M.model_extractor(counting(folder), day())(request(spark, [("r1", "u1", "tea"), ("r2", "u1", "bad"), ("r3", "u1", "rain")]))
    assert facts.count() == 2 and facts.count() == 2 and usage.count() == 2 and len(asked(folder)) == 2


def test_one_bad_text_loses_no_other(spark):
    def fails(texts):
        if "line 3" in " ".join(texts):
            raise RuntimeError
        return [[t] for t in texts]

    calls = request(spark, [(f"r{k}", "u", f"line {k}") for k in range(8)])
    assert sorted(r["request_id"] for r in M.extract_facts(calls, M.batch_extractor(fails)).collect()) == [f"r{k}" for k in range(8) if k != 3]


def test_vectors_over_batches(spark, tmp_path):
    folder = f"{tmp_path}/calls"
    os.makedirs(folder)

    def embedder(texts):
        import uuid

        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return pd.Series([[float(len(t)), 1.0] if t else None for t in texts])

    cache = ModelCache(spark, f"{tmp_path}/cache", 4)
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "n int, t string")
    got = sorted((r["n"], r["vector"]) for r in cache.embed(rows, "own", embedder, "t").collect())
    assert got == [(1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0])] and asked(folder) == ["", "a", "bb"]
    more = spark.createDataFrame([(6, "bb"), (7, "ccc"), (8, "")], "n int, t string")
    assert cache.embed(more, "own", embedder, "t").count() == 2 and asked(folder) == ["", "", "a", "bb", "ccc"]
    assert cache.embed(rows.filter("n > 9"), "own", embedder, "t").count() == 0


def test_a_store_with_remembered_answers(spark, tmp_path):
    from sparkrecall import schemas
    from sparkrecall.operators import vectors as N

    folder, cache = f"{tmp_path}/calls", ModelCache(spark, f"{tmp_path}/cache", 4)
    extract = M.model_extractor(counting(folder), day(), answers=cache.answers("own"))
    calls = request(spark, [("r1", "u1", "tea and cake"), ("r2", "u2", "rain")])
    for _ in range(2):
        done = jobs.store(calls, spark.createDataFrame([], schemas.ROUNDS), spark.createDataFrame([], schemas.MEMORIES), F.current_timestamp(), N.hashed_bigrams(16), extract)
        assert sorted(r["data"] for r in done.memories.collect()) == ["rain", "tea and cake"]
    assert len(asked(folder)) == 2
