"""Memory: parsing, decisions, the merge against a plain fold, searches in two ways, store and recall."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.operators import memory as M
from sparkrecall.operators import vectors as N
from sparkrecall.plans import jobs

T0 = dt.datetime(2024, 1, 1)


def doc_id(user, text):
    return hashlib.sha256(f"{user}\0{' '.join(text.split())}".encode()).hexdigest()


def memories(spark, rows):
    return spark.createDataFrame([(i, u, t, v, f"h-{i}", T0, T0) for i, u, t, v in rows], schemas.MEMORIES)


def responses(spark, rows):
    return spark.createDataFrame([(r, "u", t) for r, t in rows], "request_id string, user_id string, response string")


FACTS = "request_id string, user_id string, fact_pos int, fact string"


def test_facts(spark):
    got = M.parse_facts(responses(spark, [("a", '{"facts": ["x", "y"]}'), ("b", "{broken"), ("c", "{}"), ("d", '{"facts": []}')]))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "x"), ("a", 1, "y")]


def test_usage(spark):
    raw = spark.createDataFrame([("u", '{"prompt_tokens": 50, "completion_tokens": 20, "total_tokens": 70}'), ("u", "[]"), ("u", None)], "user_id string, usage string")
    assert M.sum_usage(M.usage_from_response(raw), "user_id").first()[:] == ("u", 50, 20, 70)


def test_actions_parsed(spark):
    cases = {
        "bad": "{broken", "null": '{"memory": null}', "null_later": '{"a": 1, "memory": null}', "none": '{"other": 1}', "list": "[1]", "text": '"x"', "empty": '{"memory": []}',
        "good": '{"memory": [{"id": "1", "text": "t", "event": "UPDATE", "old_memory": "o"}, {"id": "2", "event": "DELETE"}]}', "void": "null",
    }
    facts = spark.createDataFrame([(k, "u", 0, f"f-{k}") for k in cases], FACTS)
    got = sorted((r["request_id"], r["pos"], r["id"], r["text"], r["event"]) for r in M.parse_actions(responses(spark, list(cases.items())), facts).collect())
    assert got == [("bad", 0, None, "f-bad", "ADD"), ("good", 0, "1", "t", "UPDATE"), ("good", 1, "2", None, "DELETE"), ("null", 0, None, "f-null", "ADD"), ("null_later", 0, None, "f-null_later", "ADD")]


ACTIONS = schemas.ACTIONS + ", vector array<float>, ts timestamp"


def act(request, pos, event, id=None, text=None, user="u", vector=(1.0,), ts=T0):
    return (request, pos, user, id, text, event, None, None if vector is None else list(vector), ts)


def test_literal_merges(spark):
    table = memories(spark, [("k7", "u", "Oslo", [1.0]), ("k9", "u", "gone", [1.0])])
    steps = [act("r", 0, "UPDATE", "k7", "Lima"), act("r", 1, "delete", "k9"), act("r", 2, "UPDATE", "missing", "x"), act("r", 3, "NONE", "k7"), act("r", 4, None, "k7"), act("r", 5, "DELETE", None)]
    got = M.apply_actions(table, spark.createDataFrame(steps, ACTIONS)).collect()
    assert [(r["id"], r["data"], r["hash"]) for r in got] == [("k7", "Lima", "h-k7")]


def plain_merge(table, actions):
    rows = dict(table)
    for request, pos, user, id_, text, event, _, vector, ts in sorted(actions, key=lambda a: (a[8], a[0], a[1])):
        event = (event or "").upper()
        if event == "ADD" and vector is not None and text is not None:
            i = doc_id(user, text)
            rows[i] = (user, text, i, ts, ts)
        elif event == "UPDATE" and id_ and vector is not None and id_ in rows:
            u, _, h, created, _ = rows[id_]
            rows[id_] = (u, text, h, created, ts)
        elif event == "DELETE" and id_:
            rows.pop(id_, None)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_the_fold(spark, seed):
    rnd = random.Random(seed)
    texts = ["one", "two", " two ", "three"]
    ids = ["a", "b", *[doc_id("u", t) for t in texts]]
    table = [(i, ("u", f"old {i}", f"h-{i}", T0, T0)) for i in ids[:3]]
    actions = [
        act(f"r{rnd.randrange(3)}", k, rnd.choice(["ADD", "UPDATE", "update", "DELETE", "NONE", "other", None]), rnd.choice([*ids, "", None]), rnd.choice(texts), "u", rnd.choice([(1.0,), (1.0,), None]), T0 + dt.timedelta(seconds=rnd.randrange(5)))
        for k in range(40)
    ]
    df = M.apply_actions(memories(spark, [(i, r[0], r[1], [1.0]) for i, r in table]), spark.createDataFrame(actions, ACTIONS))
    got = {r["id"]: (r["user_id"], r["data"], r["hash"], r["created_at"], r["updated_at"]) for r in df.collect()}
    assert got == plain_merge(table, actions)


def vectors(n, dims=8, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32).tolist()


@pytest.mark.parametrize("chunk", [3, 1000])
def test_searches_agree(spark, chunk):
    own = [(f"m{k}", f"u{k % 3 if k < 40 else 0}", f"t{k}", v) for k, v in enumerate(vectors(60))] + [("zero", "u0", "t", [0.0] * 8), ("same", "u1", "t", vectors(60)[1])]
    queries = spark.createDataFrame([(f"q{k}", f"u{k % 4}", v) for k, v in enumerate(vectors(12, seed=1))], "request_id string, user_id string, vector array<float>")
    table = memories(spark, own)
    plain = sorted((r["request_id"], r["rank"], r["id"], round(r["score"], 6)) for r in N.knn(queries, table, 5).collect())
    blocks = sorted((r["request_id"], r["rank"], r["id"], round(r["score"], 6)) for r in N.knn_blocks(queries, table, 5, chunk, 2).collect())
    assert plain == blocks and len(plain) == 45  # u3 has no memories
    whole = N.knn_global(queries, table, 5, block=5)
    cross = N.knn(queries.withColumn("user_id", F.lit("x")), table.withColumn("user_id", F.lit("x")), 5)
    assert sorted((r["request_id"], r["rank"], r["id"]) for r in whole.collect()) == sorted((r["request_id"], r["rank"], r["id"]) for r in cross.collect())


@pytest.mark.parametrize("together", [None, (40, 6)])
def test_small_blocks_share_tasks(spark, monkeypatch, together):
    """What leaves the tasks, and so what is shuffled, follows the rows of a task, not those of a chunk."""
    if together:
        monkeypatch.setattr(N, "CHUNK_ROWS", together[0])
        monkeypatch.setattr(N, "QUERY_ROWS", together[1])
    rnd = np.random.default_rng(4)
    table = spark.createDataFrame([(f"m{k:03}", "u", rnd.integers(-2, 3, 4).astype(float).tolist()) for k in range(200)], "id string, user_id string, vector array<float>")
    queries = spark.createDataFrame([(f"q{k:02}", "u", rnd.integers(-2, 3, 4).astype(float).tolist()) for k in range(24)] + [("zero", "u", [0.0] * 4)], "request_id string, user_id string, vector array<float>")
    hits = N.block_hits(queries, table, 5, 20, 3).groupBy("request_id").count().collect()
    assert max(r["count"] for r in hits) <= 5 * (200 // together[0] if together else 1)

    def own(df):
        return sorted((r["request_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())

    rounded = N.knn(queries, table, 200).withColumn("score", F.round("score", 12))
    assert own(N.knn_blocks(queries, table, 5, 20, 3)) == own(N._top(rounded.drop("rank"), 5))


def test_equal_vectors_stay_few(spark):
    """Of many memories of one score the first ids stay, in every block."""
    table = memories(spark, [(f"m{k:03d}", "u", "t", [1.0, 2.0]) for k in range(200)])
    queries = spark.createDataFrame([("q", "u", [2.0, 4.0])], "request_id string, user_id string, vector array<float>")
    for got in (N.knn_blocks(queries, table, 3, 50), N.knn_global(queries, table, 3)):
        assert [(r["rank"], r["id"]) for r in got.orderBy("rank").collect()] == [(1, "m000"), (2, "m001"), (3, "m002")]
    assert len(N._best(np.array(["q"]), N._unit(__import__("pandas").Series([[1.0, 2.0]])), np.array([f"m{k:03d}" for k in range(200)]), N._unit(__import__("pandas").Series([[1.0, 2.0]] * 200)), 3)) == 3


def test_search_of_nothing(spark):
    queries = spark.createDataFrame([], "request_id string, user_id string, vector array<float>")
    table = memories(spark, [("m", "u", "t", [1.0])])
    assert N.knn_blocks(queries, table).count() == N.knn_global(queries, table).count() == N.knn(queries, table).count() == 0


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, "a"), (4, None)], "k int, text string")
    got = {r["k"]: r["vector"] for r in N.embed_texts(rows, N.hashed_bigrams(16)).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_similar_in_first_seen_order(spark):
    table = memories(spark, [("a", "u", "A", [1.0, 0.0]), ("b", "u", "B", [0.0, 1.0]), ("", "u", "C", [0.7, 0.7])])
    facts = spark.createDataFrame([("r", "u", 0, [0.0, 1.0]), ("r", "u", 1, [1.0, 0.0])], "request_id string, user_id string, fact_pos int, vector array<float>")
    got = M.similar_memories(facts, table, 2).orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["text"]) for r in got] == [(1, "b", "B"), (2, "a", "A")]


def test_threshold_and_context(spark):
    table = memories(spark, [("a", "u", "likes tea", [1.0, 0.0]), ("b", "u", "", [1.0, 0.0]), ("c", "u", "far", [-1.0, 0.0])])
    queries = spark.createDataFrame([("r", "u", "q", [1.0, 0.0]), ("s", "u", "", [1.0, 0.0])], "request_id string, user_id string, query_text string, vector array<float>")
    got = M.retrieve(queries, table)
    assert [(r["request_id"], r["id"], r["importance"]) for r in got.collect()] == [("r", "a", 2.0)]
    assert M.memory_context(got).first()["content"].endswith("instructions:\n- likes tea")
    assert M.retrieve(queries, table, threshold=2.1).count() == 0


def request(spark, rows):
    return spark.createDataFrame([(r, T0 + dt.timedelta(seconds=k), u, "s", None, [("user", t, None), ("assistant", "noted", None)]) for k, (r, u, t) in enumerate(rows)], schemas.REQUESTS)


def test_store_then_recall(spark):
    none, rounds = spark.createDataFrame([], schemas.MEMORIES), spark.createDataFrame([], schemas.ROUNDS)
    now = F.lit(T0 + dt.timedelta(minutes=1))
    embed = N.hashed_bigrams(64)
    done = jobs.store(request(spark, [("r1", "u1", "I live in Oslo\n\nI like tea"), ("r2", "u2", "I like tea")]), rounds, none, now, embed)
    got = {(r["user_id"], r["data"]): r["id"] for r in done.memories.collect()}
    assert got == {(u, t): doc_id(u, t) for u, t in (("u1", "I live in Oslo"), ("u1", "I like tea"), ("u2", "I like tea"))}
    again = jobs.store(request(spark, [("r3", "u1", "I like tea")]), done.rounds, done.memories, now, embed)
    assert [r["event"] for r in again.actions.collect()] == ["NONE"] and again.memories.count() == 3 and again.rounds.count() == 3
    out = jobs.recall(request(spark, [("r4", "u1", "I like tea")]), again.rounds, again.memories, now, embed)
    rows = out.history.orderBy("pos").collect()
    assert rows[0]["role"] == "system" and "- I like tea" in rows[0]["content"] and [r["pos"] for r in rows] == list(range(5))


def answers(old, facts):
    """A model that adds all facts where it is asked, and says what that took."""
    import json

    return [(json.dumps({"memory": [{"text": f + "!", "event": "ADD"} for f in json.loads(x)]}), '{"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}') for x in facts]


def extracted(system, user):
    return [("{broken" if "bad" in u else '{"facts": ["likes tea"]}', '{"prompt_tokens": 50, "completion_tokens": 20, "total_tokens": 70}') for u in user]


def test_store_routes_and_counts(spark):
    """Requests without any hit add their facts as they are; the others ask the decider; usage is summed by request."""
    none, rounds = spark.createDataFrame([], schemas.MEMORIES), spark.createDataFrame([], schemas.ROUNDS)
    now, embed = F.lit(T0 + dt.timedelta(minutes=1)), N.hashed_bigrams(64)
    extractor, decider = M.model_extractor(extracted, now), M.model_decider(answers)
    calls = request(spark, [("r1", "u1", "tea"), ("r2", "u2", "tea"), ("r3", "u3", "bad")])
    first = jobs.store(calls, rounds, none, now, embed, extractor, decider)
    assert sorted((r["user_id"], r["data"]) for r in first.memories.collect()) == [("u1", "likes tea"), ("u2", "likes tea")]
    assert sorted(tuple(r) for r in first.usage.collect()) == [("r1", 50, 20, 70), ("r2", 50, 20, 70), ("r3", 0, 0, 0)]
    again = jobs.store(request(spark, [("r4", "u1", "tea"), ("r5", "u9", "tea")]), rounds, first.memories, now, embed, extractor, decider)
    assert sorted((r["user_id"], r["data"]) for r in again.memories.collect()) == [("u1", "likes tea"), ("u1", "likes tea!"), ("u2", "likes tea"), ("u9", "likes tea")]
    assert sorted(tuple(r) for r in again.usage.collect()) == [("r4", 53, 22, 75), ("r5", 50, 20, 70)]


def test_modules_can_be_swapped(spark):
    none, rounds = spark.createDataFrame([], schemas.MEMORIES), spark.createDataFrame([], schemas.ROUNDS)
    now, calls = F.lit(T0), request(spark, [("r1", "u1", "tea")])

    def nothing(requests, memories, *_):
        return jobs.Remembered(memories, memories, requests.select("request_id"))

    done = jobs.store(calls, rounds, none, now, long_term=nothing, journal=lambda r: r.select("user_id"))
    assert done.memories.count() == 0 and done.attachments.first()[0] == "u1" and done.usage.columns == ["request_id"]


def test_recall_sees_what_was_stored_by_then(spark):
    calls = request(spark, [(f"r{k}", "u1", f"line {k}") for k in range(4)])
    from sparkrecall.operators import sessions as S

    rounds = S.rounds_of_requests(calls).drop("request_id")
    asked = request(spark, [("a", "u1", "x"), ("b", "u1", "x")]).withColumn("ts", F.when(F.col("request_id") == "a", F.lit(T0 + dt.timedelta(seconds=1))).otherwise(F.lit(T0 + dt.timedelta(days=3))))
    out = jobs.recall(asked, rounds, spark.createDataFrame([], schemas.MEMORIES), None, N.hashed_bigrams(64), cap=1)
    assert [(r["request_id"], r["role"], r["content"]) for r in out.history.orderBy("pos").collect()] == [("a", "user", "line 1"), ("a", "assistant", "noted")]


def test_waves_see_each_other(spark, tmp_path):
    def keep(df, name):
        path = f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    none, rounds = spark.createDataFrame([], schemas.MEMORIES), spark.createDataFrame([], schemas.ROUNDS)
    calls = request(spark, [("r1", "u1", "I like green tea"), ("r2", "u1", "I like green tea!")])
    now = F.lit(T0 + dt.timedelta(minutes=1))
    assert jobs.store(calls, rounds, none, now, N.hashed_bigrams(64)).memories.count() == 2
    done = jobs.store_in_waves(calls, rounds, none, now, keep, embedder=N.hashed_bigrams(64))
    assert [r["data"] for r in done.memories.collect()] == ["I like green tea!"] and done.rounds.count() == 2


def test_extractors(spark):
    calls = request(spark, [("r1", "u1", "one\n \n two "), ("r2", "u1", "x")])
    assert sorted(tuple(r) for r in M.extract_facts(calls).collect()) == [("r1", "u1", 0, "one"), ("r1", "u1", 1, "two"), ("r2", "u1", 0, "x")]
    assert M.extract_facts(calls, M.batch_extractor(lambda texts: [[t.upper()] for t in texts])).count() == 2

    def fails(texts):
        raise RuntimeError

    assert M.extract_facts(calls, M.batch_extractor(fails)).count() == 0
    text = M.extraction_inputs(calls, F.lit("2024-02-03").cast("date")).orderBy("request_id").first()
    assert "2024-02-03" in text["system"] and text["user"] == "Input:\nuser: one\n \n two \nassistant: noted"


def test_counts(spark):
    df = spark.createDataFrame([act("r", 0, "add", text="x"), act("r", 1, "ADD", text="y"), act("r", 2, None)], ACTIONS)
    assert sorted(tuple(r) for r in M.action_counts(df).collect()) == [("u", "ADD", 2), ("u", "NONE", 1)]
